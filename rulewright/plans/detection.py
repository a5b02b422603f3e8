"""Queries that evaluate boxes; each part is a truth and a shifted box that was found, in a lane of its own within its image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.operators import detection as D
from rulewright.operators import tracks as K
from rulewright.plans.catalog import query
from rulewright.sources.staging import staged
from rulewright.sources.tables import table


def lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truth and found boxes: (image, id, category, area, crowd, score, x0, y0, x1, y1)."""
    k = F.col("p_partkey")
    w, h, dx = (20 + k % 5 * 25).cast("double"), (20 + k % 4 * 20).cast("double"), (k % 9 * 3).cast("double")
    y = (k % 20 * 100).cast("double")
    rows = table(spark, sf_dir, "part").select(
        F.floor(k / 20).alias("image"), k.alias("id"), F.col("p_type").alias("category"), (w * h).alias("area"), F.lit(False).alias("crowd"), (F.pmod(k * 29, F.lit(101)) / 101).alias("score"), w.alias("w"), h.alias("h"), dx.alias("dx"), y.alias("y0")
    )
    box = lambda x: {"x0": x, "x1": x + F.col("w"), "y1": F.col("y0") + F.col("h")}
    return rows.filter("id % 7 <> 0 and image % 11 <> 3").withColumns(box(F.lit(0.0))).drop("w", "h", "dx"), rows.filter("id % 5 <> 0 and image % 13 <> 3").withColumns(box(F.col("dx"))).drop("w", "h", "dx")


_LANES = """l AS (SELECT p_partkey // 20 AS image, p_partkey AS id, p_type AS category, 20 + p_partkey % 5 * 25 AS w, 20 + p_partkey % 4 * 20 AS h, p_partkey % 9 * 3 AS dx, p_partkey * 29 % 101 / 101 AS score FROM part),
    t AS (SELECT * FROM l WHERE id % 7 <> 0 AND image % 11 <> 3), f AS (SELECT * FROM l WHERE id % 5 <> 0 AND image % 13 <> 3),
    m AS (SELECT f.image, f.id, CASE WHEN t.id IS NOT NULL AND f.w > f.dx THEN (f.w - f.dx) / (f.w + f.dx) END AS iou, t.w * t.h AS tarea, f.w * f.h AS farea, f.score, f.category FROM f LEFT JOIN t USING (id)), s AS (SELECT unnest(range(10)) AS step)"""
_COUNTS = """i AS (SELECT DISTINCT image FROM l), c AS (SELECT i.image, step, (SELECT count(*) FROM t WHERE t.image = i.image) AS nt, (SELECT count(*) FROM f WHERE f.image = i.image AND score >= 0.5) AS nf,
      (SELECT count(*) FROM m WHERE m.image = i.image AND score >= 0.5 AND iou >= 0.5 + 0.05 * step - 1e-12) AS tp, (SELECT coalesce(sum(iou), 0) FROM m WHERE m.image = i.image AND score >= 0.5) AS iou FROM i, s),
    d AS (SELECT *, tp / (nf + 1e-4) AS p, tp / (nt + 1e-4) AS r FROM c), e AS (SELECT *, CASE WHEN nt + nf > 0 THEN 2 * p * r / (p + r + 1e-4) END AS f1, CASE WHEN least(nt, nf) > 0 THEN iou / least(nt, nf) END AS mean_iou FROM d)"""


@query(f"WITH {_LANES}, {_COUNTS} SELECT image, step::INT AS step, nt AS n_truth, nf AS n_found, tp, nf - tp AS fp, nt - tp AS fn, round(f1, 9) AS f1, round(mean_iou, 9) AS mean_iou FROM e")
def d1_image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and false boxes of each image at ten thresholds."""
    truth, found = lanes(spark, sf_dir)
    counts = D.image_counts(table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).alias("image")), truth, found)
    return counts.withColumns({c: F.round(c, 9) for c in ("f1", "mean_iou")})


@query(f"""WITH {_LANES}, {_COUNTS}, g AS (SELECT step, sum(tp) AS tp, sum(nf - tp) AS fp, sum(nt - tp) AS fn, coalesce(sum(nf - tp) FILTER (nt > 0 AND nf > 0), 0) AS pfp, coalesce(avg(f1) FILTER (nt > 0), 0) AS macro, coalesce(avg(f1) FILTER (nt > 0 AND nf > 0), 0) AS answered,
      count(*) FILTER (nt > 0 AND nf > 0) AS a, count(*) FILTER (nt = 0 AND nf > 0) AS b, count(*) FILTER (nt > 0 AND nf = 0) AS cc, count(*) FILTER (nt = 0 AND nf = 0) AS dd, count(*) FILTER (nt > 0 AND tp = nt AND tp = nf) AS pp, avg(mean_iou) AS mean_iou FROM e GROUP BY step),
    h AS (SELECT *, tp / (tp + fp + 1e-4) AS p, tp / (tp + pfp + 1e-4) AS pp_, tp / (tp + fn + 1e-4) AS r, (a * dd - b * cc) / (sqrt((a + b)::DOUBLE * (a + cc) * (dd + b) * (dd + cc)) + 1e-6) AS mcc FROM g)
    SELECT step::INT AS step, round(2 * p * r / (p + r + 1e-4), 6) AS micro_f1, round(2 * pp_ * r / (pp_ + r + 1e-4), 6) AS positive_micro_f1, round(answered, 6) AS positive_macro_f1, round(macro, 6) AS positive_w0dt_macro_f1, round(mcc, 6) AS mcc, round(pp / (a + cc + 1e-9), 6) AS perfect_positive,
      round(dd / (b + dd + 1e-9), 6) AS perfect_negative, round(mean_iou, 6) AS mean_iou, round(2 * pp_ * r / (pp_ + r + 1e-4) * mcc, 6) AS cg_f1, round(answered * mcc, 6) AS cg_f1_macro, round(macro * mcc, 6) AS cg_f1_w0dt FROM h""")
def d2_gated_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated F1 at ten thresholds, micro and macro."""
    truth, found = lanes(spark, sf_dir)
    images = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).alias("image"))
    rows = D.gated_f1(D.image_counts(images, truth, found))
    return rows.select("step", *[F.round(c, 6).alias(c) for c in rows.columns if c != "step"])


@query(f"""WITH {_LANES}, {_COUNTS}, c2 AS (SELECT i.image, step, (SELECT count(*) FROM t WHERE t.image = i.image AND id % 2 = 0) AS nt, (SELECT count(*) FROM f WHERE f.image = i.image AND score >= 0.5) AS nf,
      (SELECT count(*) FROM m WHERE m.image = i.image AND id % 2 = 0 AND score >= 0.5 AND iou >= 0.5 + 0.05 * step - 1e-12) AS tp FROM i, s),
    e2 AS (SELECT *, CASE WHEN nt + nf > 0 THEN 2 * (tp / (nf + 1e-4)) * (tp / (nt + 1e-4)) / (tp / (nf + 1e-4) + tp / (nt + 1e-4) + 1e-4) END AS f1 FROM c2),
    u AS (SELECT image, 0 AS truth, round(coalesce(avg(f1), 2), 9) AS mean FROM e GROUP BY 1 UNION ALL SELECT image, 1, round(coalesce(avg(f1), 2), 9) FROM e2 GROUP BY 1)
    SELECT image, truth FROM u QUALIFY row_number() OVER (PARTITION BY image ORDER BY mean DESC, truth) = 1""")
def d3_best_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two ground truths fits each image best."""
    truth, found = lanes(spark, sf_dir)
    images = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).alias("image"))
    one, two = (D.image_counts(images, x, found).withColumn("truth", F.lit(i)) for i, x in enumerate((truth, truth.filter("id % 2 = 0"))))
    return D.best_truths(one.unionByName(two)).select("image", "truth").distinct()


def _precision_sql(ranges: list[tuple[float, float]], scale: int, category: str) -> str:
    inside = lambda x: " OR ".join(f"(rng = {i} AND {x} BETWEEN {low} AND {high})" for i, (low, high) in enumerate(ranges))
    return f"""WITH {_LANES}, g AS (SELECT unnest(range({len(ranges)})) AS rng), n AS (SELECT {category} AS category, rng, count(*) AS positives FROM t, g WHERE {inside(f"w * h * {scale}")} GROUP BY ALL),
    x AS (SELECT {category} AS category, step, rng, id, score, coalesce(iou >= 0.5 + 0.05 * step - 1e-12, false) AS met, ({inside(f"tarea * {scale}")}) AS tin, ({inside(f"farea * {scale}")}) AS fin FROM m, s, g),
    y AS (SELECT *, met AND tin AS hit FROM x WHERE CASE WHEN met THEN tin ELSE fin END),
    z AS (SELECT *, sum(hit::INT) OVER w AS tp, row_number() OVER w AS k FROM y WINDOW w AS (PARTITION BY category, step, rng ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    h AS (SELECT category, step, rng, tp, tp / k AS p FROM z WHERE hit), q AS (SELECT n.category, n.rng, s.step, positives, r.r, (SELECT count(*) FROM h WHERE h.category = n.category AND h.rng = n.rng AND h.step = s.step) AS hits FROM n, s, (SELECT unnest(range(101)) AS r) r),
    v AS (SELECT q.category, q.rng, q.step, q.r, any_value(hits / positives) AS recall, coalesce(max(h.p), 0) AS p FROM q LEFT JOIN h ON h.category = q.category AND h.rng = q.rng AND h.step = q.step AND h.tp * 100 >= q.r * positives GROUP BY ALL),
    a AS (SELECT category, rng, step, avg(p) AS ap, any_value(recall) AS recall FROM v GROUP BY ALL)
    SELECT category, rng::INT AS range, round(avg(ap), 6) AS ap, round(max(ap) FILTER (step = 0), 6) AS ap50, round(max(ap) FILTER (step = 5), 6) AS ap75, round(avg(recall), 6) AS ar FROM a GROUP BY ALL"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("category", "range", *[F.round(c, 6).alias(c) for c in ("ap", "ap50", "ap75", "ar")])


@query(_precision_sql(D.BOX_RANGES, 1, "category"))
def d4_precision_and_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision and recall of each category by area."""
    return _rounded(D.precision_and_recall(*lanes(spark, sf_dir)))


def _as_tracks(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("image").alias("video"), F.lit(0).cast("long").alias("category"), "id", (F.col("area") * 4).alias("area"), "score")


@query(_precision_sql(D.TRACK_RANGES, 4, "0"))
def d5_track_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of tracks, all categories as one."""
    truth, found = lanes(spark, sf_dir)
    pairs = K.overlapping(truth, found, ["image"]).select(F.col("image").alias("video"), F.lit(0).cast("long").alias("category"), "a", "b", "iou")
    return _rounded(D.track_precision(_as_tracks(truth), _as_tracks(found), pairs, by_category=False))


@query(f"WITH {_LANES} SELECT image, count(*) FILTER (score > 0.3) AS n FROM f GROUP BY image")
def d6_score_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each image above a score."""
    return D.score_counts(lanes(spark, sf_dir)[1], 0.3)


@query(f"""WITH {_LANES}, n AS (SELECT image, id, 'new' AS kind FROM m WHERE coalesce(iou, 0) < 0.5 AND (score >= 0.4 OR image NOT IN (SELECT image FROM t))),
    o AS (SELECT t.image, t.id, 'lost' AS kind FROM t LEFT JOIN m USING (id) WHERE t.image IN (SELECT image FROM f) AND coalesce(m.iou, 0) < 0.3)
    SELECT * FROM n UNION ALL SELECT * FROM o UNION ALL SELECT image, id, 'met' FROM m WHERE iou >= 0.5""")
def d7_associated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New detections, lost tracks, and the pairs that meet."""
    truth, found = lanes(spark, sf_dir)
    new, lost, close = K.associated(found, staged(K.overlapping(found, truth, ["image"])), truth, "image", 0.5, 0.3, 0.4)
    rows = new.withColumn("kind", F.lit("new")).unionByName(lost.withColumn("kind", F.lit("lost")))
    return rows.unionByName(close.select("image", F.col("a").alias("id"), F.lit("met").alias("kind")))


@query("""WITH a AS (SELECT o_custkey, avg(CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_totalprice END) AS m FROM orders GROUP BY 1) SELECT o_custkey, round(coalesce(m, 0), 6) AS area FROM a""")
def d8_mean_track_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean areas of tracks over the frames that have one; customers and orders stand for them."""
    k = F.col("o_orderkey") % 4
    areas = table(spark, sf_dir, "orders").select("o_custkey", F.when(k == 1, 0.0).when(k > 1, F.col("o_totalprice")).alias("x"))
    rows = areas.groupBy("o_custkey").agg(F.collect_list(F.struct("x")).alias("xs"))
    return rows.select("o_custkey", F.round(K.mean_track_area(F.transform("xs", lambda s: s["x"])), 6).alias("area"))
