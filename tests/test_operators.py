"""Operators against plain Python, on small fixtures with the cases at the edge."""

import collections
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.functions import geometry as G
from rulewright.functions import text as T
from rulewright.operators import corpus, mining, scores, tracks, trackscores
from rulewright.sources import records


def test_pruning_is_the_greedy_pass(spark):
    random.seed(2)
    for _ in range(3):
        rules = {}
        for _ in range(60):
            items = tuple(sorted(random.sample("abcd", random.randint(0, 3))))
            rules[(items, random.choice("xyz"))] = (random.choice([0.5, 0.7, 0.9]), random.randint(1, 9))
        order = sorted(rules, key=lambda r: (-rules[r][0], -rules[r][1], len(r[0]), r[1], r[0]))
        kept, seen = [], set()
        for items, answer in order:
            smaller = {s for n in range(len(items)) for s in itertools.combinations(items, n)}
            if items not in seen and not any((s, answer) in kept for s in smaller):
                kept.append((items, answer))
                seen.add(items)
        rows = [(list(r[0]), r[1], rules[r][1], 1, rules[r][0]) for r in rules]
        df = mining.ranked(spark.createDataFrame(rows, "itemset array<string>, answer string, n_items long, n_both long, confidence double"))
        got = {(tuple(r.itemset), r.answer) for r in mining.without_redundant(df, 4).collect()}
        assert got == set(kept)


def test_rules_count_what_baskets_hold(spark):
    random.seed(3)
    rows = [(i, sorted(random.sample("abcde", random.randint(1, 4))), random.choice("xy")) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, items array<string>, answer string")
    got = {(tuple(r.itemset), r.answer): (r.n_items, r.n_both) for r in mining.rules(df, "k", 3, 4, 0.0).collect()}
    want = {}
    for n in (1, 2, 3):
        for items in itertools.combinations("abcde", n):
            for answer in "xy":
                have = [a for _, own, a in rows if set(items) <= set(own)]
                if have.count(answer) >= 3:
                    want[(items, answer)] = (len(have), have.count(answer))
    assert got == want


def test_split_counts(spark):
    for weights, largest, want in (((9, 1, 1), False, {0: (0, 0, 0), 1: (1, 0, 0), 10: (9, 1, 0), 11: (9, 1, 1), 12: (10, 1, 1), 21: (18, 2, 1), 22: (18, 2, 2)}),
                                   ((8, 1, 1), True, {0: (0, 0, 0), 1: (1, 0, 0), 5: (4, 1, 0), 10: (8, 1, 1), 14: (11, 2, 1), 15: (12, 2, 1)})):
        df = spark.createDataFrame([(n,) for n in want], "n long")
        got = {r[0]: tuple(r[1:]) for r in df.select("n", *[c.alias(f"c{i}") for i, c in enumerate(corpus.split_counts(F.col("n"), weights, largest))]).collect()}
        assert all(sum(c) == n for n, c in got.items())
        assert got == want


def test_numbered_and_guards(spark):
    rows = spark.range(0, 1000, 7).withColumnRenamed("id", "k").repartition(5)
    got = sorted((r.k, r.at) for r in corpus.numbered(rows, [F.col("k")], "at", 10).collect())
    assert got == [(k, i + 10) for i, k in enumerate(range(0, 1000, 7))]
    a, b = spark.range(5).toDF("k"), spark.range(3, 8).toDF("k")
    assert sorted(r.k for r in corpus.disjoint(a, b, "k").collect()) == [3, 4]
    assert corpus.uncovered(spark.range(8).toDF("k"), [a, b], "k").count() == 0
    assert {(r.k, r.problem) for r in corpus.uncovered(spark.range(1, 9).toDF("k"), [a, b], "k").collect()} == {(0, "extra"), (8, "missing")}
    assert corpus.repeated_keys(a, ["k"]).count() == 0


def test_assignment_is_the_best_one():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (2, 4), (4, 4), (5, 3), (6, 6)):
        cost = rng.random((n, m)).round(2)
        rows, columns = tracks.assignment(cost)
        small, large = min(n, m), max(n, m)
        square = cost if n <= m else cost.T
        best = min(sum(square[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(rows) == small and abs(cost[rows, columns].sum() - best) < 1e-9


def test_suppression(spark):
    boxes = [(1, 1, 0.9, 0, 0, 10, 10), (1, 2, 0.8, 1, 1, 11, 11), (1, 3, 0.7, 20, 20, 30, 30), (1, 4, 0.7, 0, 0, 10, 5), (2, 5, 0.1, 0, 0, 1, 1)]
    df = spark.createDataFrame(boxes, "image long, id long, score double, x0 long, y0 long, x1 long, y1 long")
    kept = lambda **o: sorted(r.id for r in tracks.suppressed(df, "image", "id", **o).collect())
    assert kept(most=0.5) == [1, 3, 4, 5]
    assert kept(most=0.5, at_most=False) == [1, 3, 5]
    assert kept(most=0.9, of_smaller=True) == [1, 2, 3, 5]


def test_hota_of_perfect_and_missing_tracks(spark):
    truth = spark.createDataFrame([(1, f, t, 20.0 * t, 0.0, 20.0 * t + 10, 10.0) for f in range(4) for t in range(2)], "video long, frame long, track long, x0 double, y0 double, x1 double, y1 double")
    perfect = trackscores.hota(trackscores.hota_parts(truth, truth.withColumn("track", F.col("track") + 7))).first()
    assert [round(x, 9) for x in perfect] == [1] * 9
    swapped = truth.withColumn("track", F.when(F.col("frame") >= 2, 1 - F.col("track")).otherwise(F.col("track")))
    got = trackscores.hota(trackscores.hota_parts(truth, swapped)).first()
    assert round(got.det_a, 9) == 1 and round(got.ass_a, 6) == round(1 / 3, 6)
    nothing = trackscores.hota(trackscores.hota_parts(truth, truth.filter("false"))).first()
    assert nothing.hota == 0
    assert tracks.matched(truth.withColumn("id", F.col("track")), truth.withColumn("id", F.col("track")).filter("false"), "frame", 0.5).count() == 0


def box_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def best_assignment(rows, columns, weight):
    """The one-to-one pairs of most total weight, by trying all of them."""
    if len(rows) > len(columns):
        return [(a, b) for b, a in best_assignment(columns, rows, lambda b, a: weight(a, b))]
    tries = [list(zip(rows, p, strict=True)) for p in itertools.permutations(columns, len(rows))]
    return max(tries, key=lambda pairs: sum(weight(a, b) for a, b in pairs))


def aligned(truth, found):
    """Matches of each frame by brute force: {frame: [(a, b, iou)]}; truth and found are {frame: {track: box}}."""
    potential, frames = {}, sorted(truth)
    for f in frames:
        own = {(a, b): box_iou(x, y) for a, x in truth[f].items() for b, y in found.get(f, {}).items()}
        for (a, b), v in own.items():
            rest = sum(w for (c, d), w in own.items() if c == a or d == b)
            potential[a, b] = potential.get((a, b), 0) + (v / rest if rest > 0 else 0)
    count = lambda side, t: sum(t in x for x in side.values())
    score = {(a, b): v / (count(truth, a) + count(found, b) - v) for (a, b), v in potential.items()}
    out = {}
    for f in frames:
        a, b = sorted(truth[f]), sorted(found.get(f, {}))
        iou = {(x, y): box_iou(truth[f][x], found[f][y]) for x in a for y in b}
        out[f] = [(x, y, iou[x, y]) for x, y in best_assignment(a, b, lambda x, y: score[x, y] * iou[x, y])] if a and b else []  # noqa: B023
    return out, count


def random_tracks(seed):
    rng = random.Random(seed)
    box = lambda x, y: (x, y, x + rng.uniform(5, 12), y + rng.uniform(5, 12))
    side = lambda n: {f: {t: box(rng.uniform(0, 15), rng.uniform(0, 6)) for t in range(n) if rng.random() < 0.8} for f in range(5)}
    return side(4), side(4)


def test_hota_by_brute_force(spark):
    rows, want = ([], []), []
    for video in range(4):
        truth, found = random_tracks(video)
        for out, side in zip(rows, (truth, found), strict=True):
            out += [(video, f, t, *box) for f, own in side.items() for t, box in own.items()]
        matches, count = aligned(truth, found)
        n, m = (sum(len(x) for x in side.values()) for side in (truth, found))
        for step in range(1, 20):
            hits = [(a, b, v) for own in matches.values() for a, b, v in own if v >= step * 0.05 - 1e-12]
            met = collections.Counter((a, b) for a, b, _ in hits)
            association = sum(k * k / (count(truth, a) + count(found, b) - k) for (a, b), k in met.items())
            want.append((video, step, len(hits), n - len(hits), m - len(hits), round(association, 6), round(sum(v for *_, v in hits), 6)))
    schema = "video long, frame long, track long, x0 double, y0 double, x1 double, y1 double"
    got = trackscores.hota_parts(*[spark.createDataFrame(x, schema) for x in rows]).collect()
    assert sorted((r.video, r.step, r.tp, r.fn, r.fp, round(r.association, 6), round(r.located, 6)) for r in got) == sorted(want)


def teta_by_definition(truth, found, classes, exhaustive):
    """Counts of one video, {(cls, step, name): count}; truth and found are {frame: {track: (box, cls)}}."""
    want = collections.Counter()
    boxes = lambda side, keep: {f: {t: x[0] for t, x in own.items() if keep(t, x[1])} for f, own in side.items()}
    near = lambda f, a, b: box_iou(truth[f][a][0], found[f][b][0]) >= 0.5
    close = {b for f in truth for a in truth[f] for b in found[f] if near(f, a, b)}
    first, _ = aligned(boxes(truth, lambda t, c: True), boxes(found, lambda t, c: t in close))
    of = {(f, b): truth[f][a][1] for f, pairs in first.items() for a, b, v in pairs if v >= 0.5}
    blank = set()
    for c in classes:
        own = boxes(truth, lambda t, k: k == c)  # noqa: B023
        counted = {(f, b) for f in truth for b in found[f] if any(near(f, a, b) for a in own[f]) and of.get((f, b), c) == c}
        for step in range(20):
            want[c, step, "loc_fn"] += sum(map(len, own.values()))
            if exhaustive and step >= 10:
                want[c, step, "cls_fp"] += sum(x[1] == c and (f, b) not in counted for f in found for b, x in found[f].items())
        if not counted:
            blank.add(c)
            continue
        kept = boxes(found, lambda t, k: t in {b for _, b in counted})  # noqa: B023
        matches, count = aligned(own, kept)
        paired = []
        for f, pairs in matches.items():
            real = [p for p in pairs if p[2] > 0]
            spare = [sorted(set(side[f]) - {p[i] for p in real}) for i, side in enumerate((own, kept))]
            paired += [(f, *p) for p in real] + [(f, a, b, 0.0) for a, b in zip(*spare, strict=False)]
        for step in range(20):
            hits = [p for p in paired if p[3] >= step * 0.05 - 1e-12]
            met = collections.Counter((a, b) for _, a, b, _ in hits)
            want[c, step, "loc_tp"] += len(hits)
            want[c, step, "loc_fn"] -= len(hits)
            want[c, step, "loc_fp"] += len(counted - {(f, b) for f, _, b, _ in hits})
            for name, share in (("association", lambda a, b, k: count(own, a) + count(kept, b) - k), ("association_re", lambda a, b, k: count(own, a)), ("association_pr", lambda a, b, k: count(kept, b))):  # noqa: B023
                want[c, step, name] += sum(k * k / share(a, b, k) for (a, b), k in met.items())
            for f, _, b, _ in hits if step >= 10 else []:
                said = found[f][b][1]
                want[c, step, "cls_tp" if said == c else "cls_fn"] += 1
                if said != c:
                    want[said, step, "cls_fp", c] += 1
    for (said, step, name, by), n in [(k, n) for k, n in want.items() if len(k) == 4]:
        if not (exhaustive and said in blank and by < said):
            want[said, step, name] += n
    return want


@pytest.mark.parametrize("exhaustive", [False, True])
def test_teta_by_brute_force(spark, exhaustive):
    rows, want, rng = ([], []), {}, random.Random(9)
    for video in range(6):
        truth, found = random_tracks(video + 50)
        if video % 2:
            found = {f: {t: x if rng.random() < 0.3 else tuple(v + rng.uniform(-1, 1) for v in truth[f].get(t, x)) for t, x in own.items()} for f, own in found.items()}
        truth = {f: {t: (x, t % 2) for t, x in own.items()} for f, own in truth.items()}
        found = {f: {t: (x, (t + rng.choice([0, 0, 0, 1, 2])) % 3) for t, x in own.items()} for f, own in found.items()}
        for out, side in zip(rows, (truth, found), strict=True):
            out += [(video, f, t, c, *box) for f, own in side.items() for t, (box, c) in own.items()]
        want[video] = teta_by_definition(truth, found, (0, 1, 2), exhaustive)
    schema = "video long, frame long, track long, cls long, x0 double, y0 double, x1 double, y1 double"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    parts = trackscores.teta_parts(*map(frame, rows), exhaustive=exhaustive).collect()
    names = set(trackscores.TETA_PARTS)
    assert {k[2] for w in want.values() for k, n in w.items() if n and len(k) == 3} == names
    for r in parts:
        for name in names:
            assert abs(r[name] - want[r.video][r.cls, r.step, name]) < 1e-6, (r, name)
    if not exhaustive:
        perfect = trackscores.teta(trackscores.teta_parts(frame(rows[0]), frame(rows[0]))).first()
        assert [round(x, 9) for x in perfect] == [1] * 10


def test_combined_scores(spark):
    rng = random.Random(8)
    parts = [(v, c, s, *[float(rng.randrange(5)) for _ in range(3)], *[rng.random() for _ in range(4)]) for v in range(3) for c in range(4) for s in range(1, 20)]
    parts = [p if p[1] < 3 else (*p[:3], *[0.0] * 7) for p in parts]
    df = spark.createDataFrame(parts, "video long, cls long, step long, " + ", ".join(f"{c} double" for c in trackscores.HOTA_PARTS))
    at = lambda keep, s, i: sum(p[3 + i] for p in parts if keep(p) and p[2] == s)
    mean = lambda f: sum(f(s) for s in range(1, 20)) / 19
    hota = lambda keep: mean(lambda s: (at(keep, s, 0) / max(1, at(keep, s, 0) + at(keep, s, 1) + at(keep, s, 2)) * at(keep, s, 3) / max(1, at(keep, s, 0))) ** 0.5)
    own = [hota(lambda p, c=c: p[1] == c) for c in range(4)]
    assert abs(trackscores.hota(df).first().hota - hota(lambda p: True)) < 1e-9
    assert abs(trackscores.hota(df, classes=True).first().hota - sum(own) / 4) < 1e-9
    assert abs(trackscores.hota(df, classes=True, ignore_empty=True).first().hota - sum(own[:3]) / 3) < 1e-9
    assert {r.video: round(r.hota, 9) for r in trackscores.hota(df, ["video"]).collect()} == {v: round(hota(lambda p, v=v: p[0] == v), 9) for v in range(3)}
    assert abs(trackscores.hota_at_first(df).first().loc_a_0 - at(lambda p: True, 1, 6) / at(lambda p: True, 1, 0)) < 1e-9


def test_sparse_assignment_by_brute_force(spark):
    rng = random.Random(3)
    rows, want = [], 0.0
    for g in range(40):
        pairs = {(a, b): rng.random() for a in range(5) for b in range(4) if rng.random() < 0.4}
        rows += [(g, a, b, v) for (a, b), v in pairs.items()]
        want += sum(pairs.get(p, 0) for p in best_assignment(range(5), range(4), lambda a, b: pairs.get((a, b), 0)))  # noqa: B023
    got = tracks.assigned(spark.createDataFrame(rows, "g long, a long, b long, iou double").repartition(3), ["g"]).collect()
    assert abs(sum(r.iou for r in got) - want) < 1e-9
    assert len({(r.g, r.a) for r in got}) == len(got) == len({(r.g, r.b) for r in got})


def test_overlaps_by_cells(spark):
    rng = random.Random(5)
    rows = [(i % 3, i, x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.uniform(0, 30), y + rng.uniform(0, 30)) for i in range(150)]
    df = spark.createDataFrame(rows, "g long, id long, x0 double, y0 double, x1 double, y1 double")
    sets = [sorted((r.a, r.b, round(r.iou, 9)) for r in tracks.overlapping(df, df, ["g"], cell=c).collect()) for c in (None, 10.0)]
    assert sets[0] == sets[1] and len(sets[0]) == sum(p[0] == q[0] and box_iou(p[2:], q[2:]) > 0 for p in rows for q in rows)


def test_greedy_matches_by_brute_force(spark):
    rng = random.Random(7)
    truth, found = [], []
    for g in range(12):
        for rows, n in ((truth, 4), (found, 5)):
            for i in range(n):
                x, y = rng.uniform(0, 12), rng.uniform(0, 12)
                box = (x, y, x + rng.uniform(4, 12), y + rng.uniform(4, 12))
                rows.append((g, i, (box[2] - box[0]) * (box[3] - box[1]), rng.random() < 0.2, *box) if rows is truth else (g, i, rng.choice([0.3, 0.6, 0.9]), *box))
    thresholds, ranges = [0.3, 0.5], [(0.0, 1e9), (0.0, 60.0), (60.0, 1e9)]
    want = {}
    for g in range(12):
        mine = sorted((f for f in found if f[0] == g), key=lambda f: (-f[2], f[1]))
        for t, least in enumerate(thresholds):
            for r, (low, high) in enumerate(ranges):
                taken = set()
                for f in mine:
                    size = (f[5] - f[3]) * (f[6] - f[4])
                    options = []
                    for x in (x for x in truth if x[0] == g and x[1] not in taken):
                        both = max(min(x[6], f[5]) - max(x[4], f[3]), 0) * max(min(x[7], f[6]) - max(x[5], f[4]), 0)
                        iou, ignored = both / size if x[3] else box_iou(x[4:], f[3:]), x[3] or not low <= x[2] <= high
                        if both > 0 and iou >= least:
                            options.append((not ignored, iou, x))
                    best = max(options, default=None)
                    if best and not best[2][3]:
                        taken.add(best[2][1])
                    want[g, f[1], t * 3 + r] = (best[0], not best[0]) if best else (False, not low <= size <= high)
    frames = [spark.createDataFrame(truth, "g long, id long, area double, crowd boolean, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(found, "g long, id long, score double, x0 double, y0 double, x1 double, y1 double")]
    rows = tracks.greedy_matches(*frames, ["g"], thresholds, ranges).collect()
    assert {(r.g, r.id, i): (r.hit[i], r.ignored[i]) for r in rows for i in range(6)} == want


def test_average_precision(spark):
    random.seed(4)
    rows = [("g", i, random.random(), random.random() < 0.4) for i in range(50)] + [("none", 100, 0.5, False)]
    df = spark.createDataFrame(rows, "g string, id long, s double, hit boolean")
    positives = spark.createDataFrame([("g", 25), ("none", 2)], "g string, positives long")
    got = {r.g: r.ap for r in scores.average_precision(df, "g", "s", "id", "hit", positives).collect()}
    ranked = [r[3] for r in sorted(rows[:50], key=lambda r: -r[2])]
    curve = [(sum(ranked[: k + 1]), sum(ranked[: k + 1]) / (k + 1)) for k in range(50) if ranked[k]]
    want = np.mean([max((p for tp, p in curve if tp * 100 >= r * 25), default=0.0) for r in range(101)])
    assert abs(got["g"] - want) < 1e-9 and got["none"] == 0


def test_geometry(spark):
    df = spark.createDataFrame([([0, 1, 1, 0, 1],), ([1, 1],), ([0],)], "bits array<int>")
    got = [(r.runs, r.area, r.back) for r in df.select(G.run_lengths(F.col("bits")).alias("runs"), "bits").select("runs", G.run_area(F.col("runs")).alias("area"), G.bits_of(F.col("runs")).alias("back")).collect()]
    assert got == [([1, 2, 1, 1], 3, [0, 1, 1, 0, 1]), ([0, 2], 2, [1, 1]), ([1], 0, [0])]
    one = spark.range(1)
    a, b = G.box(*[F.lit(x) for x in (0, 0, 2, 2)]), G.box(*[F.lit(x) for x in (1, 1, 3, 3)])
    zero = G.box(*[F.lit(0)] * 4)
    r = one.select(G.iou(a, b).alias("iou"), G.giou(a, b).alias("giou"), G.iou(zero, zero).alias("none"), G.padded(F.array(F.lit(1)), 3, F.lit(0)).alias("p"), G.frame_sample(F.lit(9), 3).alias("f")).first()
    assert abs(r.iou - 1 / 7) < 1e-12 and abs(r.giou - (1 / 7 - 2 / 9)) < 1e-12 and r.none == 0 and r.p == [1, 0, 0] and r.f == [1, 4, 7]


@pytest.mark.parametrize(("text", "want"), [("The <image> boxes  of people's", ["the", "box", "of", "person"]), ("s wolves knives news berries", ["wolf", "knife", "news", "berry"]), (None, []), ("", [])])
def test_question_tokens(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.question_tokens(F.col("t")).alias("w")).first().w == want


def test_answers(spark):
    texts = ["The 2 dogs, and a cat.", "Yes!", "two", None, "no. maybe", "Nothing", "I know", "It is"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.plain_answer(F.col("t")).alias("p"), T.yes_no_words(F.col("t")).alias("w"), T.is_truncated(F.col("t")).alias("x")).collect()
    assert [r.p for r in rows[:4]] == ["2 dogs and cat", "yes", "2", None]
    assert [r.w for r in rows] == ["yes", "yes", "yes", "yes", "no", "yes", "yes", "yes"]
    assert rows[7].x and not rows[1].x


def test_records(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    rows = [{"id": 1, "q": "a"}, {"id": 2}]
    listed = records.json_document(spark, write("a.json", json.dumps(rows)), "id long, q string")
    keyed = records.json_document(spark, write("b.json", json.dumps({"rows": rows})), "id long, q string", "rows")
    assert [(r.id, r.q) for r in listed.orderBy("ord").collect()] == [(1, "a"), (2, None)] and [(r.ord, r.id) for r in keyed.orderBy("ord").collect()] == [(0, 1), (1, 2)]
    path = write("c.jsonl", '{"id": 1, "q": "a"}\n\n{bad\n{"id": 2}\n')
    assert records.json_lines(spark, [path, path], "id long, q string").count() == 2
    assert records.bad_lines(spark, path).first().bad == 1
    with pytest.raises(ValueError, match="line 3 of"):
        records.json_lines(spark, path, "id long, q string", strict=True)
    assert records.json_any(spark, write("h.json", '[{"id": 1},\n {"id": 2}]'), "id long").count() == 2
    assert records.json_any(spark, write("i.json", '{"id": 1}\n\n{"id": 2}\n'), "id long").count() == 2
    assert records.json_any(spark, write("j.json", '{"id": 1}'), "id long").count() == 1 and records.json_any(spark, write("k.json", "") or str(tmp_path / "k.json"), "id long").count() == 0
    nested = write("d.json", json.dumps([{"id": 5, "qas": [{"qa_id": 1, "question": "x", "answer": "y"}]}, {"question_id": 2, "image_id": 6, "question": "z", "answer": "w"}]))
    assert sorted((r.question_id, r.image_id, r.question) for r in records.nested_answers(spark, nested).collect()) == [(1, 5, "x"), (2, 6, "z")]
    by_id = write("e.json", json.dumps({"02": {"imageId": "n1", "question": "b", "answer": "c"}, "01": {"imageId": "n2", "question": "d", "answer": "e"}}))
    assert [(r.ord, r.question_id, r.image_id) for r in records.keyed_answers(spark, by_id).orderBy("ord").collect()] == [(0, "01", "n2"), (1, "02", "n1")]
    notes = write("f.json", json.dumps({"images": [{"id": 0}], "categories": [{"id": 0, "name": "cat"}, {"id": 1, "name": "ant"}], "annotations": [{"id": 0, "image_id": 0, "category_id": c, "score": s} for c, s in ((0, 0.9), (1, None), (0, 0.1))]}))
    assert records.annotated_images(spark, notes, 0.5).first().names == ["ant", "cat"]
    assert records.tab_separated(spark, write("g.tsv", "a\tb\n1\tx\n"), "a int, b string").first() == (1, "x")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"], "train"), (2, [], "test")], "id long, names array<string>, split string")
    records.write_splits(rows, f"{tmp_path}/splits")
    assert spark.read.parquet(f"{tmp_path}/splits/split=train").first().id == 1
    records.write_lines(rows, f"{tmp_path}/lines")
    assert spark.read.json(f"{tmp_path}/lines").count() == 2
    records.write_table(rows, f"{tmp_path}/csv")
    assert {r.names for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()} == {"a|b", None}
    predictions = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "id long, text string, ord long")
    assert sorted(map(tuple, records.submission(rows, predictions, "id", "text").collect())) == [(1, "y"), (2, "")]


def test_array_archives(spark, tmp_path):
    np.savez(tmp_path / "a.npz", question_ids=[5, 6, 5], coverage=np.arange(12).reshape(3, 2, 2) / 10, has_mask=np.ones((3, 2, 2), bool))
    np.savez(tmp_path / "b.npz", image_names=["x/7_1.png", "no.png", "8_2_3.png"], coverage=np.zeros((3, 4)), has_mask=np.zeros((3, 4), bool))
    rows = {r.question_id: r for r in records.array_archives(spark, str(tmp_path), "question_ids", {"coverage": "double", "has_mask": "boolean"}).collect()}
    assert rows.keys() == {5, 6, 7} and rows[5].coverage == [0.0, 0.1, 0.2, 0.3] and rows[6].ord == 1 and rows[7].has_mask == [False] * 4


def test_content_hashes(spark):
    import hashlib

    from rulewright.operators import images

    rows = spark.createDataFrame([(1, '{"b": [1, 2], "a": "é"}'), (2, '{"a":"é","b":[1,2]}'), (3, "no"), (4, None), (5, "{}")], "id long, t string")
    want = hashlib.blake2b('{"a":"é","b":[1,2]}'.encode(), digest_size=16).hexdigest()
    got = {r.id: r.h for r in rows.select("id", images.content_hash("t").alias("h")).collect()}
    assert got[1] == got[2] == want and got[3] is None and got[4] is None
    assert sorted(r.id for r in images.without_hashes(rows, "t", spark.createDataFrame([(want,)], "hash string")).collect()) == [3, 4, 5]


def test_mentions_take_terms_as_they_are(spark):
    from rulewright.operators import packages

    rows = spark.createDataFrame([("i like c++ a lot",), ("ccc",), ("axb (",)], "t string")
    got = [tuple(r) for r in rows.select(packages.mentions(F.col("t"), ["c++"]), packages.mentions(F.col("t"), ["a.b"]), packages.mentions(F.col("t"), ["("])).collect()]
    assert got == [(True, False, False), (False, False, False), (False, False, True)]


def test_other_masters_need_a_shared_folder():
    from types import SimpleNamespace

    from rulewright.sources.staging import shared_dir

    def session(master):
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _: None), getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))

    assert shared_dir(session("local[4]"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://a:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(session(master))


def test_samples_that_are_too_small_are_refused(spark):
    from rulewright.operators import mixtures

    ids = spark.range(5).withColumnRenamed("id", "k")
    assert mixtures.sampled(ids, "k", 9, 1).count() == 5 and mixtures.limited_ids(ids, "k", 0).count() == 5
    with pytest.raises(ValueError, match="fewer"):
        mixtures.sampled(ids, "k", 9, 1, exact=True)
