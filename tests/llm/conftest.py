import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size int, rep string, name string, start int, score double, kept boolean"


def rows_of(texts):
    """Documents (id, text, lang, source) with extra columns whose names the operators use themselves."""
    return [(*t, len(t[1] or ""), 7, 8, "x", None, 9, 0.5, True) for t in texts]


@pytest.fixture(scope="session")
def words():
    random.seed(11)
    return ["".join(random.choice(["ba", "ke", "lo", "mi", "tu", "ra", "so"]) for _ in range(random.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(spark, words):
    """Documents with nulls, empty and very long texts, exact and near copies, shared passages, repeated rows."""
    random.seed(12)
    make = lambda n: " ".join(random.choice(words) + random.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))
    passage = make(70)
    base = [(i, make(random.randint(3, 160)), random.choice(["en", "fr", None]), random.choice(["b", "a", "c", None])) for i in range(60)]
    base += [(100 + i, base[i][1].replace(" ", "  "), "en", "a") for i in range(5)]
    base += [(200 + i, base[40 + i][1] + " " + make(2), "en", "b") for i in range(6)]
    base += [(300 + i, f"{make(40)} {passage} {make(30)}", "fr", "a") for i in range(4)]
    base += [(400, None, None, None), (401, "", "en", "a"), (402, " \n ", "fr", "b"), (403, "one", "en", "c"), (404, make(30_000), "fr", "a"), (405, "x" * 50_000, "en", "b")]
    base += [(None, make(20), "en", "a"), (None, None, None, None), (7, base[7][1], base[7][2], base[7][3])]
    return spark.createDataFrame(rows_of(base), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
