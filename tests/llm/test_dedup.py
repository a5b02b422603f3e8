"""Exact, passage, near and line dedup against plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.llm import components, exact, lines, near, passages
from tests.llm.conftest import SCHEMA, rows_of

BLANK = "[\x20\x09-\x0d]+"


def collected(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def check_exact(corpus, **options):
    groups = collections.defaultdict(list)
    for d, t in collected(corpus):
        groups[re.sub(BLANK, " ", t or "")].append(d)
    want = collections.Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    got = exact.exact_groups(corpus, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert collections.Counter(tuple(r) for r in got) == want


def test_exact_groups(corpus):
    check_exact(corpus)


def test_exact_groups_of_many_blocks_and_colliding_marks(corpus):
    check_exact(corpus, chars=32)
    check_exact(corpus.filter("doc_id < 40"), chars=16, fingerprint=lambda block: F.length(block) % 3)


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(BLANK, low) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked_components(sets, percent):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            inverted[s].append(d)
    pairs = collections.Counter((a, b) for ids in inverted.values() for i, a in enumerate(ids) for b in ids[i + 1 :])
    for (a, b), both in pairs.items():
        if both * 100 >= (len(sets[a]) + len(sets[b]) - both) * percent:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: root(d) for d in sets}


def check_near(df, percent):
    rows = [(d, t) for d, t in collected(df)]
    sets = {d: shingles(t) for d, t in rows if d is not None}
    want = linked_components(sets, percent)
    got = near.near_groups(df, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.doc_id is None or (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])
        assert r.doc_id is not None or (r.component_id is None and r.kept)


def test_near_groups(corpus):
    check_near(corpus, 85)


def test_near_groups_of_a_crowded_region(spark):
    random.seed(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 2, 3])):
            w[random.randrange(100)] = f"z{random.randrange(60)}"
        rows.append((i, " ".join(w), "en", "a"))
    check_near(spark.createDataFrame(rows_of(rows), SCHEMA), 85)


def test_drop_near_duplicates_keeps_columns(corpus):
    kept = near.drop_near_duplicates(corpus)
    assert kept.columns == corpus.columns
    stay = collections.Counter(r.doc_id for r in near.near_groups(corpus).filter("kept").collect())
    assert collections.Counter(r.doc_id for r in kept.collect()) == stay


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(1, 7)] + [(3, 3), (None, 4)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 1 for i in range(1, 8)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_passages(corpus):
    rows = {(d, t) for d, t in collected(corpus) if d is not None}
    words = {x: [w.lower() for w in re.split(BLANK, x[1] or "") if w] for x in rows}
    runs = lambda x, n: {tuple(words[x][i : i + n]) for i in range(len(words[x]) - n + 1)}
    first = {}
    for x in sorted(rows, key=lambda x: x[0]):
        for run in runs(x, passages.MIN_RUN):
            first.setdefault(run, x[0])
    must = {x[0] for x in rows if any(first[run] < x[0] for run in runs(x, passages.MIN_RUN))}
    got = {r.doc_id: r for r in passages.repeated_passages(corpus).collect()}
    assert must <= got.keys() and {301, 302, 303} <= must
    texts = dict(rows)
    for d, r in got.items():
        assert all(k < d for k in r.keep_ids)
        data = texts[d].encode()
        # what is removed stands in a document that keeps it, or nearly so
        kept = set().union(*(shingles(texts[k]) for k in r.keep_ids))
        for span in r.spans:
            own = shingles(data[span["from"] : span.to].decode())
            assert len(own & kept) >= 0.6 * len(own)
        assert r.removed_bytes == sum(s.to - s["from"] for s in r.spans)


def test_passages_are_removed_to_their_last_word(spark):
    random.seed(31)
    new = iter(range(10**6))
    own = lambda n: [f"u{next(new)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(120):
        run = own(random.choice([40, 49, 50, 51, 55, 64, 90, 200]))
        # the later document has the run with other neighbours, in capitals and by other blanks
        rows.append((2 * i, " ".join(own(random.randrange(60)) + run + own(random.randrange(60)))))
        before, after = own(random.randrange(60)), own(random.randrange(60))
        text = " ".join(before + [w.upper() if j % 7 == 0 else w for j, w in enumerate(run)] + after).replace(" ", "\t ")
        rows.append((2 * i + 1, text))
        if len(run) >= passages.MIN_RUN:
            low = len("\t ".join(before).encode()) + (2 if before else 0)
            want[2 * i + 1] = [(low, low + len("\t ".join(run)))]
    got = passages.repeated_passages(spark.createDataFrame(rows_of([(*r, "en", "a") for r in rows]), SCHEMA)).collect()
    assert {r.doc_id: [(s["from"], s.to) for s in r.spans] for r in got} == want
    assert all(r.keep_ids == [r.doc_id - 1] for r in got)


def removed_words(spark, texts):
    """The words that go of each text, by number, and the result's rows by doc_id; texts are lists of words joined by blanks."""
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows_of([(i, " ".join(t), "en", "a") for i, t in texts.items()]), SCHEMA).repartition(4)).collect()}
    out = {}
    for i, t in texts.items():
        starts = [0]
        for w in t:
            starts.append(starts[-1] + len(w) + 1)
        out[i] = {k for s in (got[i].spans if i in got else ()) for k in range(len(t)) if s["from"] <= starts[k] < s.to}
    return out, got


def runs_in(words, n=50):
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def test_the_last_copy_of_a_run_stays(spark):
    random.seed(41)
    new = iter(range(10**7))
    own = lambda n: [f"u{next(new)}" for _ in range(n)]
    texts = {}
    for g in range(60):
        z, c = own(900), own(60)
        at = random.randrange(100, 700)
        # A is Z but for 60 words, and so like it; C has those words elsewhere
        texts |= {3 * g: z, 3 * g + 1: [*z[:at], *c, *z[at + 60 :]], 3 * g + 2: [*own(200), *c, *own(200)]}
    gone, _ = removed_words(spark, texts)
    for g in range(60):
        assert not gone[3 * g] and len(gone[3 * g + 1]) == 900 and not gone[3 * g + 2]


def test_runs_that_earlier_documents_hold_in_part(spark):
    random.seed(42)
    new = iter(range(10**7))
    own = lambda n: [f"u{next(new)}" for _ in range(n)]
    texts = {}
    for g in range(200):
        run, a = own(60), random.randrange(32)
        # the middle stands earlier alone; or the keeper has it first alone and the whole run later
        part = run[a : a + 28]
        texts |= {10 * g: own(30) + part + own(30), 10 * g + 1: own(40) + run + own(9), 10 * g + 2: own(11) + run + own(40)}
        run, a = own(60), random.randrange(32)
        texts |= {10 * g + 5: own(30) + run[a : a + 28] + own(90) + run + own(20), 10 * g + 6: own(25) + run + own(33)}
    gone, got = removed_words(spark, texts)
    for g in range(200):
        assert not gone[10 * g] and not gone[10 * g + 1] and not gone[10 * g + 5]
        assert gone[10 * g + 2] == set(range(11, 71)) and list(got[10 * g + 2].keep_ids) == [10 * g + 1]
        assert gone[10 * g + 6] == set(range(25, 85)) and list(got[10 * g + 6].keep_ids) == [10 * g + 5]


def test_passages_by_brute_force(spark):
    random.seed(43)
    new = iter(range(10**7))
    own = lambda n: [f"u{next(new)}" for _ in range(n)]
    pool, texts = [own(400) for _ in range(12)], {}
    for i in range(160):
        parts = []
        for _ in range(random.randint(1, 4)):
            source, a = random.choice(pool), random.randrange(340)
            parts += source[a : a + random.randint(20, 180)] + own(random.randrange(1, 60))
        texts[i] = own(150) + parts
    gone, got = removed_words(spark, texts)
    paragraphs = {i for i, t in texts.items() if len(gone[i]) == len(t)}
    first = {}
    for i in sorted(texts):
        if i not in paragraphs:
            for k, run in enumerate(zip(*[texts[i][j:] for j in range(50)], strict=False)):
                first.setdefault(run, (i, k))
    want = {i: {k + j for k, run in enumerate(zip(*[t[j:] for j in range(50)], strict=False)) if first[run][0] < i for j in range(50)} for i, t in texts.items() if i not in paragraphs}
    assert {i: gone[i] for i in want} == want and sum(map(bool, want.values())) > 60
    # every word of a run that goes stands in the run's first document, or in an earlier one that keeps it there
    left = {w for i, t in texts.items() for k, w in enumerate(t) if k not in gone[i]}
    assert all(w in left for i in want for w in texts[i])


def test_hashes_of_runs_do_not_depend_on_their_place(monkeypatch):
    words = np.random.default_rng(2).integers(0, 1 << 62, 400).astype(np.uint64)
    twice = np.concatenate((words, words))
    starts = np.arange(len(twice) - 49)
    whole = passages.run_hashes(twice, starts)
    monkeypatch.setattr(passages, "BLOCK", 64)
    parts = passages.run_hashes(twice, starts)
    for a, b in zip(whole, parts, strict=True):
        assert (a == b).all() and (a[:351] == a[400:]).all() and len(set(a.tolist())) == 400


def test_a_passage_of_most_documents_is_dealt_over_tasks(spark, monkeypatch):
    from rulewright.llm import common

    monkeypatch.setattr(common, "SALT_ROWS", 8)
    run = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {run}\n{run}. c{i}", "en", "a") for i in range(50)]
    got = passages.repeated_passages(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 50)) and {tuple(r.keep_ids) for r in got} == {(0,)}
    assert all(r.removed_bytes >= 2 * len(run) - 2 for r in got)


def test_rows_of_one_doc_id_with_other_texts_stay_apart(spark):
    random.seed(32)
    make = lambda n: [f"{random.choice('abcdefgh')}{random.randrange(10**6)}" for _ in range(n)]
    one, two, three = make(80), make(80), make(80)
    texts = [(1, " ".join(one)), (2, " ".join(make(30) + one)), (2, " ".join(two)), (2, " ".join(two)), (3, " ".join(two + ["x"])), (3, " ".join(three)), (4, " ".join(three + ["y"])), (None, " ".join(three)), (4, None)]
    df = spark.createDataFrame(rows_of([(*t, "en", "a") for t in texts]), SCHEMA)
    # passages: the second text of document 2 loses nothing, though its other text does
    out = collections.Counter((r.doc_id, len((r.text or "").split())) for r in passages.drop_repeated_passages(df).collect())
    assert out == collections.Counter([(1, 80), (2, 30), (2, 80), (2, 80), (3, 0), (3, 80), (4, 0), (None, 80), (4, 0)])
    near_rows = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_groups(df, percent=60).collect())
    assert near_rows == collections.Counter([(1, 76, 1, True), (2, 106, 1, False), (2, 76, 2, True), (2, 76, 2, True), (3, 77, 2, False), (3, 76, 3, True), (4, 77, 3, False), (None, 76, None, True), (4, 0, 4, True)])
    kept = collections.Counter((r.doc_id, r.text) for r in near.drop_near_duplicates(df, percent=60).collect())
    assert kept == collections.Counter([texts[i] for i in (0, 2, 3, 5, 7, 8)])


def test_drop_repeated_passages(corpus):
    unique = corpus.dropDuplicates(["doc_id"])
    out = {r.doc_id: r.text for r in passages.drop_repeated_passages(unique).collect()}
    gone = {r.doc_id: r.removed_bytes for r in passages.repeated_passages(unique).collect()}
    for r in unique.collect():
        assert (out[r.doc_id] is None) == (r.text is None)
        assert len((r.text or "").encode()) - len((out[r.doc_id] or "").encode()) == gone.get(r.doc_id, 0)


def test_near_paragraphs_are_found(spark, words):
    random.seed(5)
    line = [random.choice(words) for _ in range(80)]
    other = [*line[:40], "changed", *line[41:]]
    texts = [(1, " ".join(line), None, None), (2, f"something else\n{' '.join(other)}\nand an end", None, None), (3, " ".join(random.choice(words) for _ in range(80)), None, None)]
    got = passages.repeated_passages(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    assert [(r.doc_id, r.keep_ids) for r in got] == [(2, [1])]
    data = texts[1][1].encode()
    assert data[got[0].spans[0]["from"] : got[0].spans[0].to].decode() == " ".join(other)


def test_near_paragraphs_of_crowded_bands(spark):
    random.seed(8)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(300):
        w = list(base)
        for _ in range(random.choice([2, 2, 3])):
            w[random.randrange(100)] = f"z{random.randrange(40)}"
        rows.append((i, " ".join(w), "en", "a"))
    sets = {i: shingles(t) for i, t, *_ in rows}
    want = linked_components(sets, 80)
    assert len(set(want.values())) > 5 and sum(k != d for d, k in want.items()) > 50
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()}
    # a linked paragraph goes as a whole, since the least of its component keeps it
    missed = [i for i, text, *_ in rows if want[i] != i and (i not in got or want[i] not in got[i].keep_ids or got[i].removed_bytes != len(text))]
    assert not missed


def test_line_dedup(spark):
    block = "a\nb\nc\nd"
    texts = [(1, f"{block}\nx\ny", None, None), (2, f"q\n{block}\nz", None, None), (3, "a\nb\nx", None, None), (4, "r\nr\nr\nr\nr", None, None), (5, None, None, None), (6, "", None, None), (7, "a\nb\nc", None, None), (None, "a\nb\nc", None, None)]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    out = lines.drop_repeated_lines(df, counts="counts")
    got = {r.doc_id: (r.text, r.counts.n_lines, r.counts.removed_lines) for r in out.collect()}
    assert lines.drop_repeated_lines(df).columns == df.columns
    # of document 4 the windows at its second and third line repeat the first one, so one line is left
    assert got == {1: (texts[0][1], 6, 0), 2: ("q\nz", 6, 4), 3: ("a\nb\nx", 3, 0), 4: ("r", 5, 4), 5: (None, 0, 0), 6: ("", 1, 0), 7: ("", 3, 3), None: ("", 3, 3)}


def test_lines_of_repeated_and_null_ids(spark):
    texts = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nq"), (2, "uno\ndue\ntre\nquattro"), (2, "uno\ndue\ntre\nquattro"), (None, "a\nb\nc"), (None, "x\ny\nz"), (None, None), (3, "x\ny\nz\nw")]
    df = spark.createDataFrame([(*t, 5, "l", "k") for t in texts], "doc_id long, text string, n_lines int, removed_lines string, key string")
    out = lines.drop_repeated_lines(df)
    assert out.columns == df.columns and {(r.n_lines, r.removed_lines, r.key) for r in out.collect()} == {(5, "l", "k")}
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert got == collections.Counter([(1, "a\nb\nc\nd"), (2, "q"), *[(2, "uno\ndue\ntre\nquattro")] * 2, (None, ""), (None, ""), (None, None), (3, "x\ny\nz\nw")])
    with pytest.raises(ValueError):
        lines.drop_repeated_lines(df, counts="N_lines")


def test_empty_tables(empty):
    assert exact.exact_groups(empty).count() == 0
    assert near.near_groups(empty).count() == 0
    assert near.drop_near_duplicates(empty).count() == 0
    assert passages.repeated_passages(empty).count() == 0
    assert passages.drop_repeated_passages(empty).count() == 0
    assert lines.drop_repeated_lines(empty).count() == 0
