"""Queries on masked images; embeddings stand for masks and objects, parts for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import geometry as G
from rulewright.functions import runs as R
from rulewright.operators import answerability as A
from rulewright.operators.joins import spread
from rulewright.plans.catalog import query
from rulewright.plans.geometry import grids
from rulewright.sources.tables import table

_CATEGORIES = ["ring", "widget", "small bolt", "gear", "cat"]


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 3 == 0, "How many of Germany's ").otherwise("Is the "), F.col("p_name"), F.when(k % 4 == 0, "s, cats").when(k % 4 == 1, "es and_cat").otherwise(" concats"), F.lit("?"))
    return table(spark, sf_dir, "part").select(k.alias("question_id"), text.alias("question"), F.when(k % 5 == 0, "yes/no").otherwise("other").alias("answer_type"))


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = F.col("vec_id") % 4 * 0.05 - 0.05
    return grids(spark, sf_dir).select(F.col("vec_id").alias("question_id"), F.floor(F.col("vec_id") / 8).alias("image_id"), F.transform("cells", lambda x: (x >= least).cast("int")).alias("bits"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    name = F.element_at(F.array(*[F.lit(c) for c in _CATEGORIES]), (k % len(_CATEGORIES) + 1).cast("int"))
    bits = F.transform("cells", lambda x, i: F.when(i < k % 8 * 8, (x >= 0.0).cast("int")).otherwise(0))
    return grids(spark, sf_dir).select(F.floor(k / 8).alias("image_id"), k.alias("object"), name.alias("category"), bits.alias("bits"))


def _categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in _CATEGORIES], "category string")


_Q = f"""q AS (SELECT p_partkey AS question_id, CASE WHEN p_partkey % 3 = 0 THEN 'How many of Germany''s ' ELSE 'Is the ' END || p_name || CASE p_partkey % 4 WHEN 0 THEN 's, cats' WHEN 1 THEN 'es and_cat' ELSE ' concats' END || '?' AS question,
      CASE WHEN p_partkey % 5 = 0 THEN 'yes/no' ELSE 'other' END AS answer_type FROM part), cat AS (SELECT unnest({_CATEGORIES}) AS category),
    n AS (SELECT question_id, category FROM q, cat WHERE regexp_matches(lower(question), '\\b' || category || '(s|es)?\\b'))"""


@query(f"WITH {_Q} SELECT * FROM n")
def e1_mentioned_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that questions name."""
    return A.mentioned_categories(_questions(spark, sf_dir), _categories(spark))


_M = f"""m AS (SELECT vec_id AS question_id, vec_id // 8 AS image_id, list_transform(embedding, lambda x: (x::DOUBLE >= vec_id % 4 * 0.05 - 0.05)::INT) AS bits FROM embeddings WHERE len(embedding) = 64),
    o AS (SELECT vec_id // 8 AS image_id, vec_id AS object, {_CATEGORIES}[vec_id % {len(_CATEGORIES)} + 1] AS category, [CASE WHEN i <= vec_id % 8 * 8 AND x::DOUBLE >= 0 THEN 1 ELSE 0 END for x, i in embedding] AS bits FROM embeddings WHERE len(embedding) = 64),
    j AS (SELECT question_id, category, object, list_sum(o.bits) AS n, list_sum(m.bits) AS k, list_sum([a * m.bits[i] for a, i in o.bits]) AS b FROM m JOIN o USING (image_id)),
    s AS (SELECT question_id, category, object, b / n AS coverage, b / greatest(1, n + k - b) AS iou, b / greatest(1, k) AS share FROM j WHERE n > 0),
    best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question_id, category ORDER BY coverage DESC, iou DESC, share DESC, object) = 1)"""


@query(f"WITH {_M} SELECT question_id, category, object, round(coverage, 9) AS coverage, round(iou, 9) AS iou, round(share, 9) AS share FROM best")
def e2_mask_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object of each category that a mask covers best."""
    rows = A.mask_matches(_masks(spark, sf_dir), _objects(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 9) for c in ("coverage", "iou", "share")})


@query(f"""WITH {_Q}, {_M}, x AS (SELECT q.*, (SELECT count(*) FROM n WHERE n.question_id = q.question_id) AS mentions, list_sum(m.bits) / 64 AS ratio, (SELECT max(coverage) FROM best JOIN n USING (question_id, category) WHERE question_id = q.question_id) AS cov,
      (SELECT max(iou) FROM best JOIN n USING (question_id, category) WHERE question_id = q.question_id) AS iou FROM q JOIN m USING (question_id)),
    y AS (SELECT *, CASE WHEN cov IS NULL THEN NULL WHEN cov >= 0.7 AND iou >= 0.15 THEN 'question_object_strongly_masked' WHEN cov >= 0.35 AND iou >= 0.05 THEN 'question_object_partially_masked' ELSE 'question_object_mostly_visible' END AS seen FROM x)
    SELECT question_id, mentions, round(ratio, 9) AS mask_ratio, round(cov, 9) AS coverage, round(iou, 9) AS iou,
      CASE WHEN seen LIKE '%strongly%' THEN 'likely_unanswerable' WHEN seen LIKE '%partially%' THEN 'borderline' WHEN seen IS NOT NULL OR (mentions = 0 AND ratio < 0.25) THEN 'likely_answerable' WHEN ratio > 0.45 AND answer_type <> 'yes/no' THEN 'borderline' ELSE 'likely_answerable' END AS label,
      concat_ws('|', CASE WHEN mentions = 0 THEN 'no_explicit_coco_object_in_question' END, CASE WHEN ratio > 0.45 THEN 'large_mask' END, seen, CASE WHEN contains(lower(question), 'many') OR contains(lower(question), 'number of') THEN 'count_question' END, 'attribute_or_relation_question') AS reasons FROM y""")
def e3_answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether questions can still be answered, and why."""
    rows = A.labelled(_questions(spark, sf_dir), _masks(spark, sf_dir), _objects(spark, sf_dir), _categories(spark))
    return rows.withColumns({c: F.round(c, 9) for c in ("mask_ratio", "coverage", "iou")} | {"reasons": F.array_join("reasons", "|")})


_CUE_MASKS = f"""c AS (SELECT p_partkey AS question_id, p_partkey // 8 AS image_id, list_distinct([{_CATEGORIES}[p_partkey % 5 + 1], {_CATEGORIES}[p_partkey % 3 + 1]]) AS cues FROM part WHERE p_partkey % 7 > 0),
    i AS (SELECT DISTINCT image_id FROM o), h AS (SELECT question_id, image_id, object, o.bits FROM c JOIN o USING (image_id) WHERE list_contains(cues, category)),
    e AS (SELECT question_id, unnest(range(1, 65)) AS at_, unnest(bits) AS b FROM h), f AS (SELECT question_id, at_, max(b) AS b FROM e GROUP BY ALL), g AS (SELECT question_id, list(b ORDER BY at_) AS bits FROM f GROUP BY 1),
    m AS (SELECT c.question_id, c.image_id, coalesce(g.bits, list_transform(range(64), lambda x: 0)) AS bits, (SELECT count(*) FROM h WHERE h.question_id = c.question_id) AS instances FROM c SEMI JOIN i USING (image_id) LEFT JOIN g USING (question_id))"""
_OBJECTS_SQL, _MATCHED_SQL = _M[_M.index("o AS (") : _M.index(",\n    j AS")], _M[_M.index("j AS (") :]


@query(f"""WITH {_Q}, {_OBJECTS_SQL}, {_CUE_MASKS}, {_MATCHED_SQL}, x AS (SELECT q.*, m.instances, (SELECT count(*) FROM n WHERE n.question_id = q.question_id) AS mentions, list_sum(m.bits) / 64 AS ratio, (SELECT max(coverage) FROM best JOIN n USING (question_id, category) WHERE question_id = q.question_id) AS cov,
      (SELECT max(iou) FROM best JOIN n USING (question_id, category) WHERE question_id = q.question_id) AS iou FROM q JOIN m USING (question_id)),
    y AS (SELECT *, CASE WHEN cov IS NULL THEN NULL WHEN cov >= 0.7 AND iou >= 0.15 THEN 'strongly' WHEN cov >= 0.35 AND iou >= 0.05 THEN 'partially' ELSE 'visible' END AS seen FROM x)
    SELECT question_id, instances::INT AS instances, mentions, round(ratio, 9) AS mask_ratio, round(cov, 9) AS coverage, round(iou, 9) AS iou,
      CASE WHEN seen = 'strongly' THEN 'likely_unanswerable' WHEN seen = 'partially' THEN 'borderline' WHEN seen IS NOT NULL OR (mentions = 0 AND ratio < 0.25) THEN 'likely_answerable' WHEN ratio > 0.45 AND answer_type <> 'yes/no' THEN 'borderline' ELSE 'likely_answerable' END AS label FROM y""")
def e7_answerability_of_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the masks are all objects of the categories that a question's cues name."""
    k = F.col("p_partkey")
    name = lambda n: F.element_at(F.array(*[F.lit(c) for c in _CATEGORIES]), (k % n + 1).cast("int"))
    cues = table(spark, sf_dir, "part").filter(k % 7 > 0).select(k.alias("question_id"), F.floor(k / 8).alias("image_id"), F.array(name(5), name(3)).alias("cues"))
    objects = _objects(spark, sf_dir)
    masks = A.masks_of_cues(cues, objects, objects.select("image_id", F.lit(64).alias("cells")).distinct())
    rows = A.labelled(_questions(spark, sf_dir), masks, objects, _categories(spark)).join(masks.select("question_id", "instances"), "question_id")
    return rows.select("question_id", "instances", "mentions", *[F.round(c, 9).alias(c) for c in ("mask_ratio", "coverage", "iou")], "label")


@query("""WITH p AS (SELECT p_partkey AS id, [p_partkey % 5, 0, 7, p_partkey % 8, p_partkey % 7, 7, 0, p_partkey % 4]::DOUBLE[] AS v FROM part),
    e AS (SELECT id, i, v[2 * i - 1] AS ax, v[2 * i] AS ay, v[2 * (i % 4) + 1] AS bx, v[2 * (i % 4) + 2] AS by_ FROM p, (SELECT unnest([1, 2, 3, 4]) AS i) t), c AS (SELECT unnest(range(64)) AS cell),
    d AS (SELECT id, cell, (bx - ax) * (cell // 8 - ay) - (by_ - ay) * (cell % 8 - ax) AS cross_, ax, ay, bx, by_, cell % 8 AS px, cell // 8 AS py FROM e, c),
    f AS (SELECT id, cell, bool_or(cross_ = 0 AND px BETWEEN least(ax, bx) AND greatest(ax, bx) AND py BETWEEN least(ay, by_) AND greatest(ay, by_)) AS on_edge,
      count(*) FILTER ((ay > py) <> (by_ > py) AND px < ax + (py - ay) * (bx - ax) / nullif(by_ - ay, 0)) AS crossed FROM d GROUP BY ALL)
    SELECT id, string_agg(CASE WHEN on_edge OR crossed % 2 = 1 THEN '1' ELSE '0' END, '' ORDER BY cell) AS bits FROM f GROUP BY id""")
def e4_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of four points drawn on a grid."""
    k = F.col("p_partkey")
    points = F.array(*[F.lit(x) if isinstance(x, int) else x for x in (k % 5, 0, 7, k % 8, k % 7, 7, 0, k % 4)]).cast("array<double>")
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(k.alias("id"), F.array_join(G.bits_of(R.polygon_runs(F.array(points), 8, 8).cast("array<int>")), "").alias("bits"))


@query("""WITH p AS (SELECT event_id, [[event_id % 256, 100, 200], [90, 90, 90]] AS a, [[event_id % 64, 60, event_id % 31], [event_id % 120, 10, 29]] AS b FROM events)
    SELECT event_id, array_to_string([CASE WHEN list_avg(a[i]) - list_avg(b[i]) > 40 OR list_max(b[i]) < 30 THEN 1 ELSE 0 END for i in [1, 2]], '') AS darkened,
      array_to_string([CASE WHEN greatest(a[i][1] - b[i][1], a[i][2] - b[i][2], a[i][3] - b[i][3], 0) >= 25 AND list_max(b[i]) <= 30 THEN 1 ELSE 0 END for i in [1, 2]], '') AS blackened FROM p""")
def e5_masked_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that a mask darkened, by two rules."""
    e = F.col("event_id")
    pixel = lambda *v: F.array(*[F.lit(x) if isinstance(x, int) else x for x in v]).cast("array<int>")
    before, after = F.array(pixel(e % 256, 100, 200), pixel(90, 90, 90)), F.array(pixel(e % 64, 60, e % 31), pixel(e % 120, 10, 29))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(A.darkened(before, after), "").alias("darkened"), F.array_join(A.blackened(before, after), "").alias("blackened"))


@query("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE >= -0.05)::INT) AS a, list_transform(embedding, lambda x: (x::DOUBLE >= 0)::INT) AS b FROM embeddings WHERE len(embedding) = 64),
    c AS (SELECT vec_id, i, i % 8 AS x, i // 8 AS y, a[i + 1] AS a, b[i + 1] AS b FROM g, (SELECT unnest(range(64)) AS i) t),
    d AS (SELECT c.vec_id, c.i, (c.a = 1 AND (c.x IN (0, 7) OR c.y IN (0, 7) OR bool_or(n.a = 0)))::INT AS a, (c.b = 1 AND (c.x IN (0, 7) OR c.y IN (0, 7) OR bool_or(n.b = 0)))::INT AS b, c.x, c.y FROM c JOIN c n ON n.vec_id = c.vec_id AND abs(n.x - c.x) + abs(n.y - c.y) = 1 GROUP BY c.vec_id, c.i, c.a, c.b, c.x, c.y),
    w AS (SELECT d.vec_id, d.i, d.a, d.b, max(n.a) AS wa, max(n.b) AS wb FROM d JOIN d n ON n.vec_id = d.vec_id AND abs(n.x - d.x) <= 1 AND abs(n.y - d.y) <= 1 GROUP BY ALL),
    f AS (SELECT vec_id, sum(a) AS n, sum(b) AS m, sum(a * wb) AS r, sum(b * wa) AS p FROM w GROUP BY 1), h AS (SELECT vec_id, CASE WHEN m > 0 THEN CASE WHEN n > 0 THEN p / m ELSE 0 END ELSE 1 END AS p, CASE WHEN n > 0 THEN CASE WHEN m > 0 THEN r / n ELSE 0 END ELSE 1 END AS r FROM f)
    SELECT vec_id, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f FROM h""")
def e6_boundary_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the boundaries of two masks agree within one cell."""
    rows = grids(spark, sf_dir).select("vec_id", A.boundary(G.active(F.col("cells"), -0.05), 8).alias("a"), A.boundary(G.active(F.col("cells"), 0.0), 8).alias("b"))
    rows = rows.select("vec_id", "a", "b", A.widened(F.col("a"), 8).alias("wa"), A.widened(F.col("b"), 8).alias("wb"))
    return rows.select("vec_id", F.round(A.boundary_f(F.col("a"), F.col("wa"), F.col("b"), F.col("wb")), 9).alias("f"))
