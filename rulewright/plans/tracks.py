"""Queries of grouped choices over boxes made of parts and tracks made of orders' lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.operators import tracks as K
from rulewright.operators import trackscores as S
from rulewright.operators.images import bit_overlap
from rulewright.plans.catalog import query
from rulewright.plans.geometry import _GRID, BOXES_SQL, grids, part_boxes
from rulewright.sources.staging import staged
from rulewright.sources.tables import table


def _flat(boxes: DataFrame) -> DataFrame:
    return boxes.select("image", "id", "score", *[F.col("b")[c].alias(c) for c in K.BOX])


_SUPPRESSED = f"""WITH RECURSIVE {BOXES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS rank, (x1 - x0) * (y1 - y0) AS area FROM b),
    p AS (SELECT a.image, a.rank, c.rank AS better, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS i, a.area AS s1, c.area AS s2 FROM o a JOIN o c ON a.image = c.image AND c.rank < a.rank),
    q AS (SELECT o.image, o.id, o.rank, coalesce(list(better) FILTER ({{}}), []) AS bad FROM o LEFT JOIN p USING (image, rank) GROUP BY ALL),
    r AS (SELECT image, 0::BIGINT AS rank, []::BIGINT[] AS kept FROM o GROUP BY image
          UNION ALL SELECT r.image, q.rank, CASE WHEN list_has_any(q.bad, r.kept) THEN r.kept ELSE list_append(r.kept, q.rank) END FROM r JOIN q ON q.image = r.image AND q.rank = r.rank + 1)
    SELECT q.image, q.id FROM q JOIN (SELECT image, arg_max(kept, rank) AS kept FROM r GROUP BY image) k ON k.image = q.image AND list_contains(k.kept, q.rank)"""


@query(_SUPPRESSED.format("i > 0.3 * (s1 + s2 - i)"))
def k1_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each image that greedy suppression keeps."""
    return K.suppressed(_flat(part_boxes(spark, sf_dir)), "image", "id", 0.3)


@query(_SUPPRESSED.format("i > 0.5 * least(s1, s2)"))
def k2_suppression_of_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the share of the smaller box."""
    return K.suppressed(_flat(part_boxes(spark, sf_dir)), "image", "id", 0.5, of_smaller=True)


@query()
def k3_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best one-to-one matching of the even parts' boxes with the odd ones' of each image."""
    boxes = _flat(part_boxes(spark, sf_dir))
    return K.matched(boxes.filter("id % 2 = 0"), boxes.filter("id % 2 = 1"), "image", 0.05).withColumn("iou", F.round("iou", 9))


def _tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tracks of true boxes, and shifted ones that drift: a customer's orders are the frames of a track."""
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 5).alias("video"), F.pmod("o_orderkey", F.lit(12)).alias("frame"), F.pmod("o_custkey", F.lit(5)).alias("track"), "o_orderkey")
    rows = rows.groupBy("video", "frame", "track").agg(F.min("o_orderkey").alias("k"))
    x, y = (F.col("track") * 20 + F.col("frame")).cast("double"), F.lit(10.0)
    truth = rows.select("video", "frame", "track", x.alias("x0"), y.alias("y0"), (x + 15).alias("x1"), (y + 15).alias("y1"))
    dx = F.pmod("k", F.lit(11)).cast("double")
    found = rows.filter("k % 9 <> 0").select("video", "frame", F.when(F.col("frame") > 8, (F.col("track") + 1) % 5).otherwise(F.col("track")).alias("track"), (x + dx).alias("x0"), y.alias("y0"), (x + dx + 15).alias("x1"), (y + 15).alias("y1"))
    return truth, found


@query("""WITH r AS (SELECT o_custkey // 5 AS video, o_orderkey % 12 AS frame, o_custkey % 5 AS track, min(o_orderkey) AS k FROM orders GROUP BY 1, 2, 3),
    t AS (SELECT video, frame, track, k, (track * 20 + frame)::DOUBLE AS x FROM r),
    f AS (SELECT video, frame, CASE WHEN frame > 8 THEN (track + 1) % 5 ELSE track END AS track, x + k % 11 AS x FROM t WHERE k % 9 <> 0),
    p AS (SELECT video, t.track AS truth_track, f.track AS found_track, sum(greatest(least(t.x, f.x) + 15 - greatest(t.x, f.x), 0) * 15) AS shared FROM t JOIN f USING (video, frame) GROUP BY ALL HAVING shared > 0),
    a AS (SELECT video, track AS truth_track, count(*) * 225 AS s1 FROM t GROUP BY ALL), b AS (SELECT video, track AS found_track, count(*) * 225 AS s2 FROM f GROUP BY ALL)
    SELECT video, truth_track, found_track, round(shared / (s1 + s2 - shared), 9) AS iou FROM p JOIN a USING (video, truth_track) JOIN b USING (video, found_track)""")
def k4_track_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of tracks over all their frames."""
    return K.track_overlaps(*_tracks(spark, sf_dir)).withColumn("iou", F.round("iou", 9))


def _rounded(found: DataFrame, fields: tuple[str, ...], *keys: str) -> DataFrame:
    return found.select(*keys, *[F.round(c, 6).alias(c) for c in fields])


def _with_classes(truth: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tracks with one of three classes each; in one frame found boxes have the next class."""
    cls = F.pmod(F.col("video") + F.col("track"), F.lit(3))
    return truth.withColumn("cls", cls), found.withColumn("cls", F.when(F.col("frame") == 4, (cls + 1) % 3).otherwise(cls))


@query()
def k5_hota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking scores over all videos."""
    return _rounded(S.hota(S.hota_parts(*_tracks(spark, sf_dir))), S.HOTA_FIELDS)


@query()
def k6_teta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location, association and class scores, by class and over all boxes, with and without errors on boxes that match nothing."""
    sums = staged(S.combined(S.teta_sums(*_with_classes(*_tracks(spark, sf_dir))), ["cls"]))
    rows = []
    for exhaustive in (False, True):
        parts = S.told(sums, exhaustive)
        for averaged, classes in (("class", True), ("boxes", False)):
            rows.append(S.teta(parts, classes=classes).select(F.lit(averaged).alias("averaged"), F.lit(exhaustive).alias("exhaustive"), "*"))
    return _rounded(reduce(DataFrame.unionByName, rows), (*S.TETA_FIELDS, "teta"), "averaged", "exhaustive")


def _lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same tracks so far apart that a found box overlaps one true box only, so every assignment is forced."""
    truth, found = _with_classes(*_tracks(spark, sf_dir))
    # the found track's number is one ahead after frame 8
    lane = F.when(F.col("frame") > 8, F.pmod(F.col("track") - 1, F.lit(5))).otherwise(F.col("track"))
    moved = lambda rows, by: rows.withColumns({c: F.col(c) + by * 20 for c in ("x0", "x1")})
    return moved(truth, F.col("track")), moved(found, lane)


_LANES = """r AS (SELECT o_custkey // 5 AS video, o_orderkey % 12 AS frame, o_custkey % 5 AS a, min(o_orderkey) AS k FROM orders GROUP BY 1, 2, 3),
    t AS (SELECT *, (video + a) % 3 AS cls, CASE WHEN frame > 8 THEN (a + 1) % 5 ELSE a END AS b FROM r),
    f AS (SELECT video, frame, a, b, cls, (video + b + CASE WHEN frame = 4 THEN 1 ELSE 0 END) % 3 AS said, (15 - k % 11) / (15 + k % 11) AS iou FROM t WHERE k % 9 <> 0)"""


def _means_sql(sums: str, fields: str, names: tuple[str, ...]) -> str:
    """From the sums ``s`` of (cls, step): each class's fields, their mean over classes, and the fields of all boxes."""
    added, means = ", ".join(f"sum({c.strip()})" for c in sums.split(",")), ", ".join(f"avg({c}) AS {c}" for c in names)
    return f"""u AS (SELECT 'class ' || cls AS scope, step, {sums} FROM s UNION ALL SELECT 'boxes', step, {added} FROM s GROUP BY step),
    e AS (SELECT scope, step, {fields} FROM u), m AS (SELECT scope, {means} FROM e GROUP BY scope),
    w AS (SELECT * FROM m UNION ALL SELECT 'classes', {means} FROM m WHERE scope LIKE 'class %')"""


_HOTA_MEANS = _means_sql("tp, n, m, located, aa, re, pr", """tp / greatest(1, n + m - tp) AS det_a, tp / greatest(1, n) AS det_re, tp / greatest(1, m) AS det_pr, aa / greatest(1, tp) AS ass_a, re / greatest(1, tp) AS ass_re, pr / greatest(1, tp) AS ass_pr,
    greatest(1e-10, located) / greatest(1e-10, tp) AS loc_a, sqrt(tp / greatest(1, n + m - tp) * aa / greatest(1, tp)) AS hota, sqrt(tp / greatest(1, n) * aa / greatest(1, tp)) AS owta""", S.HOTA_FIELDS)  # fmt: skip
_HOTA_SQL = f"""WITH {_LANES}, p AS (SELECT * FROM f WHERE cls = said),
    na AS (SELECT video, cls, a, count(*) AS na FROM t GROUP BY ALL), nb AS (SELECT video, said AS cls, b, count(*) AS nb FROM f GROUP BY ALL),
    h AS (SELECT *, unnest(range(1, 20)) AS step FROM p), hs AS (SELECT * FROM h WHERE iou >= step * 0.05 - 1e-12),
    g AS (SELECT video, cls, step, a, b, count(*) AS c, sum(iou) AS located FROM hs GROUP BY ALL),
    x AS (SELECT video, cls, step, sum(c) AS tp, sum(located) AS located, sum(c * c / (na + nb - c)) AS aa, sum(c * c / na) AS re, sum(c * c / nb) AS pr FROM g JOIN na USING (video, cls, a) JOIN nb USING (video, cls, b) GROUP BY ALL),
    sizes AS (SELECT cls, step, (SELECT count(*) FROM t WHERE t.cls = c.cls) AS n, (SELECT count(*) FROM f WHERE f.said = c.cls) AS m FROM (SELECT cls, unnest(range(1, 20)) AS step FROM (SELECT DISTINCT cls FROM t)) c),
    s AS (SELECT cls, step, coalesce(sum(tp), 0) AS tp, any_value(n) AS n, any_value(m) AS m, coalesce(sum(located), 0) AS located, coalesce(sum(aa), 0) AS aa, coalesce(sum(re), 0) AS re, coalesce(sum(pr), 0) AS pr FROM sizes LEFT JOIN x USING (cls, step) GROUP BY cls, step),
    {_HOTA_MEANS}
    SELECT scope, {', '.join(f'round({c}, 6) AS {c}' for c in S.HOTA_FIELDS)} FROM w"""


@query(_HOTA_SQL)
def k8_hota_of_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking scores of each class, averaged over classes, and of all boxes together."""
    parts = staged(S.combined(S.hota_parts(*_lanes(spark, sf_dir), ["video", "cls"]), ["cls"]))
    own = S.hota(parts, ["cls"]).select(F.concat(F.lit("class "), F.col("cls")).alias("scope"), *S.HOTA_FIELDS)
    rows = own.unionByName(S.hota(parts, classes=True).withColumn("scope", F.lit("classes"))).unionByName(S.hota(parts).withColumn("scope", F.lit("boxes")))
    return _rounded(rows, S.HOTA_FIELDS, "scope")


_TETA_MEANS = _means_sql("tp, fn, fp, aa, re, pr, ctp, cfn, cfp", """tp / greatest(1, tp + fn + fp) AS loc_a, tp / greatest(1, tp + fn) AS loc_re, tp / greatest(1, tp + fp) AS loc_pr, aa / greatest(1, tp) AS assoc_a, re / greatest(1, tp) AS assoc_re, pr / greatest(1, tp) AS assoc_pr,
    CASE WHEN step >= 10 THEN ctp / greatest(1, ctp + cfn + cfp) END AS cls_a, CASE WHEN step >= 10 THEN ctp / greatest(1, ctp + cfn) END AS cls_re, CASE WHEN step >= 10 THEN ctp / greatest(1, ctp + cfp) END AS cls_pr""", S.TETA_FIELDS)  # fmt: skip
_TETA_SQL = f"""WITH {_LANES}, c AS (SELECT * FROM f WHERE iou >= 0.5), tr AS (SELECT DISTINCT video, cls, b FROM c),
    m0 AS (SELECT video, cls, frame, a, b, iou FROM f SEMI JOIN tr USING (video, cls, b)),
    la AS (SELECT video, cls, frame, a, row_number() OVER (PARTITION BY video, cls, frame ORDER BY a) AS k FROM t SEMI JOIN tr USING (video, cls) ANTI JOIN m0 USING (video, cls, frame, a)),
    lb AS (SELECT video, cls, frame, b, row_number() OVER (PARTITION BY video, cls, frame ORDER BY b) AS k FROM (SELECT f.video, tr.cls, f.frame, f.b FROM f JOIN tr ON tr.video = f.video AND tr.b = f.b) ANTI JOIN m0 USING (video, cls, frame, b)),
    mm AS (SELECT * FROM m0 UNION ALL SELECT video, cls, frame, a, b, 0 FROM la JOIN lb USING (video, cls, frame, k)),
    h AS (SELECT *, unnest(range(0, 20)) AS step FROM mm), hs AS (SELECT h.*, f.said FROM h JOIN f ON f.video = h.video AND f.frame = h.frame AND f.b = h.b WHERE h.iou >= step * 0.05 - 1e-12),
    na AS (SELECT video, cls, a, count(*) AS na FROM t GROUP BY ALL), nb AS (SELECT video, b, count(*) AS nb FROM f GROUP BY ALL),
    g AS (SELECT video, cls, step, a, b, count(*) AS n FROM hs GROUP BY ALL),
    x AS (SELECT cls, step, sum(n) AS tp, sum(n * n / (na + nb - n)) AS aa, sum(n * n / na) AS re, sum(n * n / nb) AS pr FROM g JOIN na USING (video, cls, a) JOIN nb USING (video, b) GROUP BY ALL),
    y AS (SELECT cls, step, count(*) FILTER (said = cls) AS ctp, count(*) FILTER (said <> cls) AS cfn FROM hs WHERE step >= 10 GROUP BY ALL),
    z AS (SELECT said AS cls, step, count(*) AS cfp FROM hs WHERE step >= 10 AND said <> cls GROUP BY ALL),
    q AS (SELECT cls, step, count(*) AS fp FROM (SELECT *, unnest(range(0, 20)) AS step FROM c) ANTI JOIN hs USING (video, cls, frame, b, step) GROUP BY ALL),
    sizes AS (SELECT cls, unnest(range(0, 20)) AS step, n FROM (SELECT cls, count(*) AS n FROM t GROUP BY cls)),
    s AS (SELECT cls, step, coalesce(tp, 0) AS tp, n - coalesce(tp, 0) AS fn, coalesce(fp, 0) AS fp, coalesce(aa, 0) AS aa, coalesce(re, 0) AS re, coalesce(pr, 0) AS pr, coalesce(ctp, 0) AS ctp, coalesce(cfn, 0) AS cfn, coalesce(cfp, 0) AS cfp
          FROM sizes LEFT JOIN x USING (cls, step) LEFT JOIN y USING (cls, step) LEFT JOIN z USING (cls, step) LEFT JOIN q USING (cls, step)),
    {_TETA_MEANS}
    SELECT scope, {', '.join(f'round({c}, 6) AS {c}' for c in S.TETA_FIELDS)}, round((loc_a + assoc_a + cls_a) / 3, 6) AS teta FROM w"""


@query(_TETA_SQL)
def k9_teta_of_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location, association and class scores of each class, averaged over classes, and of all boxes together."""
    parts = staged(S.combined(S.teta_parts(*_lanes(spark, sf_dir)), ["cls"]))
    fields = (*S.TETA_FIELDS, "teta")
    own = S.teta(parts, ["cls"], classes=False).select(F.concat(F.lit("class "), F.col("cls")).alias("scope"), *fields)
    rows = own.unionByName(S.teta(parts).withColumn("scope", F.lit("classes"))).unionByName(S.teta(parts, classes=False).withColumn("scope", F.lit("boxes")))
    return _rounded(rows, fields, "scope")


@query(f"""WITH RECURSIVE {_GRID}, g8 AS (SELECT vec_id, vec_id // 8 AS image, label % 3 AS score, bits FROM g), o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, vec_id) AS rank FROM g8),
    p AS (SELECT a.image, a.rank, c.rank AS better, list_sum([x * c.bits[i] for x, i in a.bits]) AS i, list_sum(a.bits) AS s1, list_sum(c.bits) AS s2 FROM o a JOIN o c ON a.image = c.image AND c.rank < a.rank),
    q AS (SELECT o.image, o.vec_id, o.rank, coalesce(list(better) FILTER (i / (s1 + s2 - i) >= 0.3), []) AS bad FROM o LEFT JOIN p USING (image, rank) GROUP BY ALL),
    r AS (SELECT image, 0::BIGINT AS rank, []::BIGINT[] AS kept FROM o GROUP BY image
          UNION ALL SELECT r.image, q.rank, CASE WHEN list_has_any(q.bad, r.kept) THEN r.kept ELSE list_append(r.kept, q.rank) END FROM r JOIN q ON q.image = r.image AND q.rank = r.rank + 1)
    SELECT q.image, q.vec_id FROM q JOIN (SELECT image, arg_max(kept, rank) AS kept FROM r GROUP BY image) k ON k.image = q.image AND list_contains(k.kept, q.rank)""")
def k7_mask_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of each image that suppression by their overlaps keeps, equal overlaps suppressed too."""
    rows = grids(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).alias("image"), "vec_id", (F.col("label") % 3).alias("score"), "bits")
    a, b = rows.select("image", F.col("vec_id").alias("a"), F.col("bits").alias("x")), rows.select("image", F.col("vec_id").alias("b"), F.col("bits").alias("y"))
    pairs = a.join(b, "image").filter("a < b").select("image", "a", "b", bit_overlap(F.col("x"), F.col("y")).alias("iou"))
    return K.suppressed_pairs(rows, pairs, "image", "vec_id", 0.3, at_most=False)
