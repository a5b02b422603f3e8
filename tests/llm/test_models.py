"""Toxicity and language: held-out accuracy and the cases at the edge."""

import random
import zlib

import numpy as np
import pytest

from rulewright.llm import langid, toxicity


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_toxicity_on_held_out_documents(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == is_held_out(d) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in got.items())
    held = [(got[d].predicted, t) for d, t in truth.items() if is_held_out(d)]
    assert np.mean([p == t for p, t in held]) > 0.9


def test_unseen_misspellings_share_grams():
    clean = [f"the {w} walks in the green garden today" for w in ("cat", "dog", "man", "child", "bird", "horse")] * 4
    toxic = [f"you are a horrible stupidhead {w} today" for w in ("cat", "dog", "man", "child", "bird", "horse")] * 4
    model = toxicity.fit(clean + toxic, np.array([0.0] * len(clean) + [1.0] * len(toxic)))
    words = [toxicity.words_of(t) for t in ("you are a horible stupidhed dog", "the bird walks in the garden")]
    scores = model.scores(model.table(), [w for ws in words for w in ws], np.array([len(ws) for ws in words]))
    assert scores[0] > 0.5 > scores[1]


def test_toxicity_edges(corpus, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(corpus, labels).count() == corpus.count()
    assert toxicity.score_documents(empty, labels).count() == 0
    none = labels.filter("false")
    scores = {r.score for r in toxicity.score_documents(corpus, none).collect()}
    assert len(scores) == 1
    kept = toxicity.drop_toxic(corpus, labels)
    assert kept.columns == corpus.columns and {None, 400, 401, 402} <= {r.doc_id for r in kept.collect()}
    assert toxicity.drop_toxic(empty, labels).count() == 0


def test_language_on_held_out_documents(tables):
    docs, _ = tables
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in langid.predict(docs).collect()}
    held = [d for d in truth if is_held_out(d) and got[d].lang_pred != "und"]
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.held_out == is_held_out(d) for d, r in got.items())


def code_length(texts, word):
    """Bits of a word and its closing blank by prediction by partial matching, method C, read off the texts each time."""
    seen = [f" {w} ".encode() for t in texts for w in t.split()]
    data, bits = f" {word} ".encode(), 0.0
    for i in range(1, len(data)):
        for k in range(min(langid.ORDER, i), -1, -1):
            context = data[i - k : i]
            after = [s[j + k] for s in seen for j in range(0 if k else 1, len(s) - k) if s[j : j + k] == context]
            if not after:
                continue
            if data[i] in after:
                bits -= np.log2(after.count(data[i]) / (len(after) + len(set(after))))
                break
            bits -= np.log2(len(set(after)) / (len(after) + len(set(after))))
        else:
            bits += 8
    return bits


def test_code_lengths_are_those_of_partial_matching():
    random.seed(4)
    make = lambda letters, n: " ".join("".join(random.choice(letters) for _ in range(random.randint(1, 7))) for _ in range(n))
    texts = {"a": [make("abcde", 60), make("abx", 20)], "x": [make("vwxyz", 50)], "é": [make("éèab", 40)]}
    model = langid.fit([t for ts in texts.values() for t in ts], [g for g, ts in texts.items() for _ in ts])
    words = [*make("abvwxéq", 60).split(), "a", "é", "zzzzzzzz"]
    want = [[code_length(texts[g], w) for g in model.langs] for w in words]
    assert np.allclose(model.bits([w.encode() for w in words]), want, atol=1e-3)


def test_language_names_the_shortest_code(spark):
    random.seed(6)
    make = lambda letters, n: " ".join("".join(random.choice(letters) for _ in range(random.randint(1, 7))) for _ in range(n))
    rows = [(i, make("abcde" if i % 2 else "cdefg", 12), "ab" if i % 2 else "fg") for i in range(60)]
    # the documents of this language are all longer than what is learned of each
    rows += [(60 + i, make("xyz", 20_000), "xy") for i in range(6)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    learn = {g: [t[: langid.SAMPLE_CHARS] for d, t, x in rows if x == g and not is_held_out(d)] for g in ("ab", "fg", "xy")}
    for d, text, _ in rows[:40]:
        bits = {g: sum(code_length(learn[g], w) for w in text.split()) for g in ("ab", "fg")}
        assert got[d].lang_pred == min(bits, key=bits.get)
        assert abs(got[d].score - 1 / (1 + 2.0 ** (min(bits.values()) - max(bits.values())))) < 1e-3
    assert {got[60 + i].lang_pred for i in range(6)} == {"xy"}


def naive_score(model, text):
    """A document's score by a loop over words, n-grams and runs."""
    def bucket(data, n):
        code = 0
        for c in data:
            code = (code * 0x100000001B3 + c + 1) % 2**64
        return int(toxicity.mix64(np.array([(code + n) % 2**64], np.uint64))[0]) % toxicity.BUCKETS

    values = []
    for word in text.lower().encode().split():
        bare = word.strip(toxicity._EDGE) or word
        marked = b"<" + bare + b">"
        bag = [bucket(marked[i : i + n], n) for n in (3, 4, 5, 6) for i in range(len(marked) - n + 1)]
        bag.append(int(toxicity.mix64(np.array([zlib.crc32(marked) | zlib.adler32(marked) << 32], np.uint64))[0]) % toxicity.BUCKETS)
        values.append(np.mean([model.weights[b] for b in bag]))
    runs = [np.mean(values[i : i + toxicity.RUN]) for i in range(max(1, len(values) - toxicity.RUN + 1))] if values else [0.0]
    return 1 / (1 + np.exp(-(model.bias + max(runs))))


def test_scores_are_those_of_bags_and_runs(words):
    rng, texts = np.random.default_rng(8), []
    random.seed(9)
    for n in (0, 1, 2, 3, 4, 5, 9, 40, 200):
        texts.append(" ".join(random.choice(words) + random.choice(["", ",", "!", "É"]) for _ in range(n)))
    model = toxicity.Model(rng.normal(0, 3, toxicity.BUCKETS).astype(np.float32), -0.5)
    found = [toxicity.words_of(t) for t in texts]
    got = model.scores(model.table(), [w for ws in found for w in ws], np.array([len(ws) for ws in found]))
    assert np.allclose(got, [naive_score(model, t) for t in texts], atol=1e-4)


def test_sample_is_bounded_and_replaces_what_is_missing(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 50)
    monkeypatch.setattr(toxicity, "CLASS_CHARS", 400)
    docs = [(i, ("w " * (10 if i % 3 else 100))[: 20 if i % 3 else 200]) for i in range(300)] + [(1, "w"), (2, None)]
    labels = [(i, int(i % 2)) for i in range(600)] + [(5, None), (None, 1)]
    rows = toxicity.sample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", 15, 40).collect()
    assert all(not is_held_out(r.key) and r.mark == r.key % 2 and r.key < 300 and r.key % 3 for r in rows)
    assert sum(r.mark for r in rows) == 15 and sum(1 - r.mark for r in rows) == 20


def test_language_edges(corpus, empty):
    got = [r for r in langid.predict(corpus).collect()]
    assert len(got) == corpus.count()
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[d].lang_pred == "und" and by_id[d].score == 0 for d in (400, 401, 402))
    assert {r.lang_pred for r in got} <= {"en", "fr", "und"}
    assert langid.predict(empty).count() == 0
    assert {r.lang_pred for r in langid.predict(corpus.withColumn("lang", corpus["lang"].substr(9, 1)).filter("lang is null")).collect()} <= {"und"}


def test_toxic_words_behind_long_runs_without_blanks(words):
    random.seed(21)
    clean = lambda n: [random.choice(words) for _ in range(n)]
    texts = [" ".join([*clean(12), *["vilezzq"] * (i % 2), *clean(12)]) for i in range(300)]
    model = toxicity.fit(texts, np.arange(300) % 2)
    for join in ("_", "\u00a0", "/"):
        behind = [join.join([*clean(30), *["vilezzq"] * k, *clean(30)]) for k in (0, 8)]
        found = [toxicity.words_of(t) for t in [*behind, ""]]
        assert [len(x) for x in found] == [1, 1, 0] and all(len(join.join(t.split(join)[:30]).encode()) > 64 for t in behind)
        scores = model.scores(model.table(), [w for x in found for w in x], np.array([1, 1, 0]))
        assert scores[0] < 0.5 <= scores[1]


def test_long_words_are_taken_apart_whole():
    word = bytes(random.Random(1).randrange(97, 123) for _ in range(1000))
    parts, counts = toxicity.parted([b"a", word, b"b", b"-" * 200], np.array([0, 2, 0, 2]))
    grams = {word[i : i + 6] for i in range(995)}
    assert grams == {p[i : i + 6] for p in parts[1:-5] for i in range(len(p) - 5)}
    assert counts.sum() == len(parts) and max(map(len, parts)) <= toxicity.PART and counts[0] == counts[2] == 0
