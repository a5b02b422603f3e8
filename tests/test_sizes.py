"""Plans that have to hold for tables of any size: no frame that is read anew for each row, no broadcast of what is only small on disk."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rulewright.operators import answerability as A
from rulewright.operators import datapoints, mining, spans
from rulewright.operators import scores as S
from rulewright.operators import tracks, trackscores
from rulewright.operators.joins import PART_ROWS, hashed, spread
from rulewright.plans import mining as orders_mining
from rulewright.sources.staging import staged


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_precision_reads_no_frame_anew_for_each_row(spark):
    rows = spark.range(40).select(F.lit(1).alias("g"), (F.col("id") % 7).alias("score"), "id", (F.col("id") % 3 == 0).alias("hit"))
    found = S.average_precision(rows, "g", "score", "id", "hit", spark.createDataFrame([(1, 14)], "g int, positives long"))
    assert "unboundedfollowing" not in plan(found).lower()
    # brute force: the best precision from each recall on
    order = sorted(range(40), key=lambda i: (-(i % 7), i))
    hits = [i % 3 == 0 for i in order]
    points = [(sum(hits[: n + 1]), sum(hits[: n + 1]) / (n + 1)) for n in range(40) if hits[n]]
    want = sum(max((p for tp, p in points if tp * 100 >= r * 14), default=0.0) for r in range(101)) / 101
    assert abs(found.first()["ap"] - want) < 1e-12


def test_tracking_scores_broadcast_no_boxes(spark):
    boxes = staged(spark.range(60).selectExpr("id % 2 as video", "id % 5 as frame", "id % 3 as track", "id % 2 as cls", "0D as x0", "0D as y0", "9D as x1", "9D as y1").dropDuplicates(["video", "frame", "track"]))
    for parts in (trackscores.teta_parts(boxes, boxes), trackscores.teta_parts(boxes, boxes, exhaustive=True), trackscores.hota_parts(boxes, boxes)):
        assert "Broadcast" not in plan(parts)


def test_tracking_scores_shuffle_boxes_by_video_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(trackscores, "staged", lambda df: seen.append(plan(df)) or staged(df))
    boxes = staged(spark.range(60).selectExpr("id % 2 as video", "id % 5 as frame", "id % 3 as track", "id % 2 as cls", "0D as x0", "0D as y0", "9D as x1", "9D as y1").dropDuplicates(["video", "frame", "track"]))
    for parts in (trackscores.teta_parts(boxes, boxes), trackscores.hota_parts(boxes, boxes)):
        seen.append(plan(parts))
    assert len(seen) == 3
    for text in seen:
        # thresholds are told after the last shuffle, and nothing is joined
        dealt = re.findall(r"Exchange (\w+)\((.*)\), \w+, \[", text)
        assert dealt and all(kind == "hashpartitioning" and re.fullmatch(r"video#\d+L?, \d+", keys) for kind, keys in dealt)
        assert "Join" not in text and "sequence(" not in text[text.index("Exchange") :]


def test_rules_are_broadcast_and_baskets_never(spark):
    own = staged(spark.createDataFrame([(1, ["V_a", "b"], "x"), (2, ["b", "c"], "y")], "k long, items array<string>, answer string"))
    # many rules, so that the baskets are smaller on disk
    some = spark.range(3000).selectExpr("cast(id as int) as rank", "array(concat(if(id % 3 = 0, 'V_', ''), substr('abc', id % 3 + 1, 1)), sha2(cast(id as string), 256)) as itemset", "if(id % 2 = 0, 'x', 'y') as answer")
    rules = staged(some.unionByName(spark.createDataFrame([(3000, ["b"], "x"), (3001, ["V_a"], "x"), (3002, [], "y")], "rank int, itemset array<string>, answer string")))
    for any_cue, want in ((False, {(1, 3000, True), (1, 3001, True), (1, 3002, False), (2, 3000, False), (2, 3002, True)}), (True, None)):
        met = mining.match_all_items(own, rules, "k", any_cue)
        assert "BroadcastHashJoin" in plan(met) and "BuildLeft" not in plan(met)
        assert want is None or set(map(tuple, met.collect())) == want
    best = mining.match_any_cue(own, rules, "k", bare=True)
    assert "BuildLeft" not in plan(best) and dict(map(tuple, best.collect())) == {1: 3000, 2: 3002}


def test_matches_by_any_cue_are_not_shuffled(spark):
    baskets = [(n, [x for i, x in enumerate(("V_a", "V_b", "V_c", "p", "q", "r")) if n >> i & 1], "xy"[n % 3 == 0]) for n in range(1, 64)]
    parts = [[], ["V_a"], ["V_b", "V_c"], ["V_a", "V_c"], ["V_a", "V_b", "V_c"], ["p"], ["p", "q"], ["p", "q", "r"], ["V_c", "p"], ["V_a", "V_b", "q"], ["V_z", "r"], ["V_b", "z"]]
    rules = [(rank, part, "xy"[rank % 2]) for rank, part in enumerate(parts * 2)]
    own = staged(spark.createDataFrame(baskets, "k long, items array<string>, answer string"))
    mined = staged(spark.createDataFrame(rules, "rank int, itemset array<string>, answer string"))
    cued = lambda part: [x for x in part if x.startswith("V_")]
    worded = lambda part, items: all(x in items for x in part if not x.startswith("V_"))
    met = mining.match_all_items(own, mined, "k", any_cue=True)
    assert "Aggregate" not in plan(met) and "hashpartitioning" not in plan(met)
    want = [(k, rank, answer == of) for k, items, answer in baskets for rank, part, of in rules if worded(part, items) and (not cued(part) or set(cued(part)) & set(items))]
    assert sorted(map(tuple, met.collect())) == sorted(want)
    for bare in (False, True):
        best = mining.match_any_cue(own, mined, "k", bare)
        assert plan(best).count("Exchange hashpartitioning(k") == 1
        fits = {(k, rank) for k, items, answer in baskets for rank, part, of in rules if answer == of and worded(part, items) and (set(cued(part)) & set(items) or (bare and not cued(part)))}
        assert dict(map(tuple, best.collect())) == {k: min(r for j, r in fits if j == k) for k, _ in fits}


def test_matches_take_their_group_along(spark):
    own = staged(spark.createDataFrame([(1, ["V_a", "b"], "x", "F"), (2, ["b", "c"], "y", "O"), (3, ["b"], "x", None)], "k long, items array<string>, answer string, s string"))
    rules = staged(spark.createDataFrame([(1, ["b"], "x"), (2, ["V_a", "b"], "x"), (3, [], "y")], "rank int, itemset array<string>, answer string"))
    told = mining.diluted(mining.match_all_items(own, rules, "k", carried=("s",)), "s")
    assert "SortMergeJoin" not in plan(told)
    want = mining.dilution(mining.match_all_items(own, rules, "k"), own, "k", "s")
    assert sorted(map(str, told.collect())) == sorted(map(str, want.collect()))


def test_items_of_a_row_and_numbered_items(spark):
    rows = spark.createDataFrame([(1, ["b", "V_a"]), (1, ["b", "V_c"]), (2, ["b", "V_a"]), (3, [None, "d"]), (4, [None])], "k long, item array<string>")
    answers = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y")], "k long, answer string")
    own = mining.baskets(rows, answers, "k")
    assert sorted(map(str, own.collect())) == sorted(map(str, mining.baskets(rows.select("k", F.explode("item").alias("item")), answers, "k").collect()))
    found = mining.rules(staged(own), "k", 1, 4, 0.1)
    assert {(tuple(r.itemset), r.n_both) for r in found.collect() if len(r.itemset) > 1} == {(("V_a", "b"), 2), (("V_a", "V_c"), 1), (("V_c", "b"), 1), (("V_a", "V_c", "b"), 1)}


def test_lines_are_dealt_out_with_the_number_of_their_items(spark, tmp_path):
    parts = [(1, "a", "x"), (2, "a", "y"), (3, None, "x"), (4, None, None), (5, "a", "x")]
    lines = [(1, 1), (1, 5), (1, 2), (2, 3), (3, 4), (4, 1), (5, 2), (6, 9), (7, None), (None, 1)]
    said = [(1, "p"), (2, "q"), (3, "q"), (4, None), (5, ""), (6, "p"), (7, "p")]
    for name, rows, schema in (("part", parts, "p_partkey long, p_type string, p_brand string"), ("lineitem", lines, "l_orderkey long, l_partkey long"), ("orders", said, "o_orderkey long, o_orderpriority string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = orders_mining.order_baskets(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, ["V_a", "x", "y"], "p"), (2, ["x"], "q")]
    # lines and answers are shuffled, and no sets of items
    shuffled = [line for line in found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 2 and sum("REPARTITION_BY_NUM" in line for line in shuffled) == 1
    assert "ShuffledHashJoin" in plan(spark.range(9).join(hashed(spark.range(5), 2), "id"))
    assert spread(spark.range(9), "id", count=40 * PART_ROWS + 1).rdd.getNumPartitions() == 41


def test_rules_shuffle_no_baskets(spark, monkeypatch):
    made, seen = [(n, [x for i, x in enumerate(("V_a", "V_b", "p", "q", "r")) if n >> i & 1], "xy"[n % 3 == 0]) for n in range(1, 32)], []
    own = staged(spark.createDataFrame([(k, items[::-1], answer) for k, items, answer in made], "k long, items array<string>, answer string"))
    monkeypatch.setattr(mining, "staged", lambda df: seen.append(plan(df)) or staged(df))
    counts = {}
    for _, items, answer in made:
        for mask in range(1, 1 << len(items)):
            part = tuple(x for i, x in enumerate(items) if mask >> i & 1)
            if len(part) < 4:
                counts.setdefault(part, {}).setdefault(answer, []).append(1)
    want = {(part, answer, sum(map(len, by.values())), len(by[answer])) for part, by in counts.items() for answer in by if len(by[answer]) >= 2}
    for most in (50_000, 2):
        # with more frequent items than that, baskets are made again of their numbers
        monkeypatch.setattr(mining, "BROADCAST_ROWS", most)
        seen.clear()
        found = mining.rules(own, "k", 2, 4, 0.0)
        assert {(tuple(r.itemset), r.answer, r.n_items, r.n_both) for r in found.collect()} == want
        assert any("hashpartitioning(k" in text for text in seen) == (most == 2)


def test_baskets_meet_bare_rules_in_one_pass(spark):
    own = staged(spark.createDataFrame([(1, ["V_a", "b"], "x"), (2, ["c"], "y"), (3, [], "y"), (4, ["b"], "z"), (5, ["V_z"], "x"), (6, ["b"], "x")], "k long, items array<string>, answer string"))
    rules = staged(spark.createDataFrame([(1, ["V_a"], "x"), (2, ["b"], "x"), (3, [], "y"), (4, ["c"], "y"), (5, [], "y"), (6, ["V_q"], "z")], "rank int, itemset array<string>, answer string"))
    best = mining.match_any_cue(own, rules, "k", bare=True)
    assert "Union" not in plan(best)
    assert dict(map(tuple, best.collect())) == {1: 1, 2: 3, 3: 3, 6: 2}


def test_texts_are_dealt_out_and_meet_broadcast_answers(spark, monkeypatch):
    rows = staged(spark.createDataFrame([(1, "maybe 1 urgent or 2-high"), (2, "5-low"), (3, "none")], "k long, text string"))
    answers = staged(spark.createDataFrame([(1, "1 urgent"), (2, "2 high"), (3, "5-low"), (4, "2-high")], "answer_id int, answer string"))
    for most in (50_000, 2):
        # with more different texts than that, each row is looked through
        monkeypatch.setattr(mining, "BROADCAST_ROWS", most)
        found = mining.answer_candidates(rows, "k", "text", answers)
        assert "SortMergeJoin" not in plan(found) and "REPARTITION_BY_NUM" in plan(found) and plan(found).count("Exchange hashpartitioning(k") == 1
        assert sorted(map(tuple, found.collect())) == [(1, "1 urgent"), (1, "2 high"), (2, "5-low")]


def test_bleu_broadcasts_no_runs_of_tokens(spark):
    rows = staged(spark.range(20).selectExpr("id", "id % 2 as grp", "array('a', 'b') as found", "array(array('a', 'b', 'c')) as truths"))
    assert "Broadcast" not in plan(S.bleu(rows, "id", by=["grp"]))


def test_questions_meet_broadcast_categories(spark):
    asked = staged(spark.createDataFrame([(1, "Is the cat red?"), (2, "Rings and small bolts")], "question_id long, question string"))
    found = A.mentioned_categories(asked, spark.createDataFrame([("cat",), ("ring",), ("small bolt",)], "category string"))
    assert "BuildRight" in plan(found) and "BuildLeft" not in plan(found)
    assert set(map(tuple, found.collect())) == {(1, "cat"), (2, "ring"), (2, "small bolt")}


def test_questions_are_read_by_many_tasks(spark):
    asked = spark.range(400).coalesce(1).selectExpr("id as question_id", "'Is the cat red?' as question")
    text = plan(A.mentioned_categories(asked, spark.createDataFrame([("cat",)], "category string")))
    assert "REPARTITION_BY_NUM" in text and text.index("REPARTITION_BY_NUM") > text.index("explode")


def test_targets_of_one_group_are_dealt_out(spark):
    box = "named_struct('cx', id / 9, 'cy', 0.5D, 'w', 0.2D, 'h', 0.2D) as box"
    a, b = spark.range(5).selectExpr("id div 1000 as g", "id", box, "array(0.5D, 0.5D) as probs"), spark.range(400).selectExpr("id div 1000 as g", "id", box, "cast(id % 2 as int) as label")
    met = datapoints.assignment_costs(a, b, "g")
    assert met.select("a", "b").distinct().count() == met.count() == 2000
    assert "__part" in plan(met) and "Broadcast" not in plan(met)


def test_costs_are_made_once_for_equal_rows(spark):
    rng = np.random.default_rng(5)
    boxes = [tuple(map(float, rng.uniform(0, 1, 4))) for _ in range(5)] + [(-0.0, 0.0, 0.0, 0.0), None]
    own = [(n % 3, None if n == 7 else n, boxes[n % 7], [0.2, 0.8] if n % 4 else None) for n in range(40)]
    found = [(n % 3, None if n < 2 else n, boxes[n % 5 + 2], n % 2) for n in range(90)]
    kind = "box struct<cx: double, cy: double, w: double, h: double>"
    met = datapoints.assignment_costs(spark.createDataFrame(own, f"g long, id long, {kind}, probs array<double>"), spark.createDataFrame(found, f"g long, id long, {kind}, label int"), "g", digits=6)
    text = plan(met)
    above = text[: text.index("SortMergeJoin")]
    assert above.count("Generate explode") == 2 and "abs(" not in above[: above.rindex("Generate explode")]

    def cost(p, probs, t, label):
        if p is None or t is None or probs is None:
            return None
        (a, b), area = ([(x[0] - x[2] / 2, x[1] - x[3] / 2, x[0] + x[2] / 2, x[1] + x[3] / 2) for x in (p, t)]), lambda x: (x[2] - x[0]) * (x[3] - x[1])
        both = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        union, hull = area(a) + area(b) - both, (max(a[2], b[2]) - min(a[0], b[0])) * (max(a[3], b[3]) - min(a[1], b[1]))
        giou = (both / union if union else 0) - ((hull - union) / hull if hull else 0)
        return 5 * sum(abs(x - y) for x, y in zip(p, t, strict=True)) - 2 * probs[label] - 2 * giou

    want = [(g, a, b, cost(p, probs, t, label)) for g, a, p, probs in own for h, b, t, label in found if g == h]
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
    got = order(map(tuple, met.collect()))
    for x, y in zip(got, order(want), strict=True):
        assert x[:3] == y[:3] and ((x[3] is None) == (y[3] is None)) and (x[3] is None or abs(x[3] - y[3]) < 1e-6), (x, y)


def test_spans_are_scored_by_many_tasks(spark):
    rows = spark.range(200).coalesce(1).selectExpr("id", "'Is the ring red or blue?' as question", "'Yes, the small ring is red and blue.' as answer", "'red' as said")
    found = spans.scored_spans(rows, "id", 4)
    assert found.groupBy(F.spark_partition_id()).count().count() > 1


def test_boxes_are_graded_by_many_tasks(spark):
    box = "named_struct('x0', 0D, 'y0', 0D, 'x1', 9D, 'y1', 9D)"
    rows = spark.range(300).coalesce(1).selectExpr("id div 3 as image", "id", "id % 3 as score", "81D as area", "false as crowd", f"inline(array({box}))")
    met = tracks.greedy_matches(rows, rows, ["image"], [0.5], [(0.0, 1e10)])
    parts = tracks.by_groups(rows.select("image", "id"), ["image"], [F.col("id")], lambda block: block, "image long, id long")
    assert parts.groupBy(F.spark_partition_id()).count().count() > 1
    # three equal boxes on three equal truths: each takes one that is left
    assert met.filter("hit[0] AND NOT ignored[0]").count() == met.count() == 300


def test_boxes_of_all_groups_are_graded_in_rounds():
    # in image 1 box 9 takes truth 1 before box 8 comes; truth 3 is a crowd, truth 5 lies outside the second range
    columns = ["image", "a", "b", "area", "crowd", "score", "size", "iou"]
    rows = [(1, 1, 9, 10.0, False, 0.9, 10.0, 0.8), (1, 2, 9, 10.0, False, 0.9, 10.0, 0.6), (1, 1, 8, 10.0, False, 0.5, 10.0, 0.9), (1, 3, 7, 10.0, True, 0.4, 10.0, 0.9), (1, 3, 6, 10.0, True, 0.3, 10.0, 0.9), (2, 5, 4, 90.0, False, 0.2, 10.0, 0.7)]
    found = tracks.graded_boxes(pd.DataFrame(rows, columns=columns), ["image"], np.array([0.5, 0.75]), np.array([(0.0, 100.0), (0.0, 20.0)]))
    told = {r.id: ([bool(x) for x in r.hit], [bool(x) for x in r.ignored]) for r in found.itertuples()}
    yes, no = [True] * 4, [False] * 4
    assert told == {9: (yes, no), 8: (no, no), 7: (no, yes), 6: (no, yes), 4: ([True, False, False, False], [False, True, False, False])}
