"""Queries over masks as run lengths: embeddings read as grids are the truth, and grids with flipped cells what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import geometry as G
from rulewright.functions import runs as R
from rulewright.operators import answerability as A
from rulewright.operators import detection as D
from rulewright.operators import tracks as K
from rulewright.operators.joins import spread
from rulewright.plans.catalog import query
from rulewright.plans.geometry import _GRID, grids
from rulewright.sources.staging import staged
from rulewright.sources.tables import table

#: A canvas of 8 x 7 cells, and area ranges on it.
WIDTH, HEIGHT = 8, 7
RANGES = [(0.0, 1e10), (0.0, 12.0), (12.0, 24.0), (24.0, 1e10)]
FLIPS = (11, 5, 3)


def _flipped(bits: Column, key: Column, v: int) -> Column:
    return F.transform(bits, lambda b, i: F.when((key + i * (v + 1)) % FLIPS[v] == 0, 1 - b).otherwise(b))


def _masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truth and found masks, (image, id, category, area, crowd, score, runs), by columns."""
    rows = spread(grids(spark, sf_dir), "vec_id").select(F.col("vec_id").alias("image"), (F.col("label") % 4).alias("category"), F.slice("bits", 1, WIDTH * HEIGHT).alias("bits"))
    runs = lambda bits: G.run_lengths(R.by_columns(bits, WIDTH, HEIGHT))
    truth = rows.filter("image % 7 <> 0").select("image", F.col("image").alias("id"), "category", (F.col("image") % 5 == 0).alias("crowd"), runs(F.col("bits")).alias("runs"))
    found = rows.select("image", "category", F.posexplode(F.array(*[_flipped(F.col("bits"), F.col("image"), v) for v in range(3)])).alias("v", "bits")).filter("NOT (image % 6 = 1 AND v = 1)")
    found = found.select("image", (F.col("image") * 3 + F.col("v")).alias("id"), "category", (F.pmod(F.col("image") * 29 + F.col("v") * 37, F.lit(101)) / 101).alias("score"), runs(F.col("bits")).alias("runs"))
    # several steps read them, and runs take longer to make than to read
    return staged(truth.withColumn("area", R.area(F.col("runs")))), staged(found)


_FOUND = f"""f AS (SELECT vec_id, label % 4 AS category, v, i, b, CASE WHEN (vec_id + i * (v + 1)) % [11, 5, 3][v + 1] = 0 THEN 1 - b ELSE b END AS fb FROM (SELECT vec_id, label, unnest(range(64)) AS i, unnest(bits) AS b FROM g), (SELECT unnest(range(3)) AS v) WHERE i < {WIDTH * HEIGHT} AND NOT (vec_id % 6 = 1 AND v = 1)),
    p AS (SELECT vec_id, category, v, vec_id * 3 + v AS id, sum(b * fb) AS both_, sum(b) AS ta, sum(fb) AS fa, (vec_id * 29 + v * 37) % 101 / 101 AS score FROM f GROUP BY ALL)"""


def _inside(x: str) -> str:
    return " OR ".join(f"(rng = {i} AND {x} BETWEEN {low} AND {high})" for i, (low, high) in enumerate(RANGES))


@query(f"""WITH {_GRID}, {_FOUND}, gs AS (SELECT unnest(range(4)) AS rng), s AS (SELECT unnest(range(10)) AS step),
    n AS (SELECT category, rng, count(*) AS positives FROM (SELECT DISTINCT vec_id, category, ta FROM p WHERE vec_id % 7 <> 0 AND vec_id % 5 <> 0), gs WHERE {_inside('ta')} GROUP BY ALL),
    m AS (SELECT *, vec_id % 5 = 0 AS crowd, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, id) AS place, CASE WHEN vec_id % 7 <> 0 AND both_ > 0 THEN both_ / CASE WHEN vec_id % 5 = 0 THEN fa ELSE ta + fa - both_ END END AS iou FROM p),
    x AS (SELECT *, coalesce(iou >= 0.5 + 0.05 * step - 1e-12, false) AS near, ({_inside('ta')}) AND NOT crowd AS tin, ({_inside('fa')}) AS fin FROM m, s, gs),
    k AS (SELECT *, near AND (crowd OR row_number() OVER (PARTITION BY vec_id, step, rng, near ORDER BY score DESC, id) = 1) AS met FROM x),
    y AS (SELECT *, met AND tin AS hit FROM k WHERE CASE WHEN met THEN tin ELSE fin END),
    z AS (SELECT *, sum(hit::INT) OVER w AS tp, row_number() OVER w AS k FROM y WINDOW w AS (PARTITION BY category, step, rng ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    h AS (SELECT category, step, rng, place, tp, tp / k AS p FROM z WHERE hit),
    r AS (SELECT n.category, n.rng, s.step, count(h.p) / positives AS ar, count(h.p) FILTER (place <= 1) / positives AS ar_1, count(h.p) FILTER (place <= 2) / positives AS ar_2 FROM n CROSS JOIN s LEFT JOIN h USING (category, rng, step) GROUP BY n.category, n.rng, s.step, positives),
    q AS (SELECT n.category, n.rng, s.step, positives, t.t FROM n, s, (SELECT unnest(range(101)) AS t) t),
    v AS (SELECT q.category, q.rng, q.step, q.t, coalesce(max(h.p), 0) AS p FROM q LEFT JOIN h ON h.category = q.category AND h.rng = q.rng AND h.step = q.step AND h.tp * 100 >= q.t * positives GROUP BY ALL),
    a AS (SELECT category, rng, step, avg(p) AS ap FROM v GROUP BY ALL)
    SELECT category, rng::INT AS range, round(avg(ap), 6) AS ap, round(max(ap) FILTER (step = 0), 6) AS ap50, round(max(ap) FILTER (step = 5), 6) AS ap75, round(avg(ar), 6) AS ar, round(avg(ar_1), 6) AS ar_1, round(avg(ar_2), 6) AS ar_2 FROM a JOIN r USING (category, rng, step) GROUP BY ALL""")
def d9_mask_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of masks by area, and the recall of the best one, two and all of an image."""
    rows = D.precision_and_recall(*_masks(spark, sf_dir), RANGES, masks=True, recalls=(1, 2))
    return rows.select("category", "range", *[F.round(c, 6).alias(c) for c in ("ap", "ap50", "ap75", "ar", "ar_1", "ar_2")])


@query(f"""WITH {_GRID}, f AS (SELECT vec_id, k.v, i, i % 8 AS x, i // 8 AS y, b, CASE WHEN (vec_id + i * (k.v + 1)) % [11, 5, 3][k.v + 1] = 0 THEN 1 - b ELSE b END AS fb FROM u, (SELECT unnest(range(3)) AS v) k),
    p AS (SELECT vec_id, v, sum(b * fb) / nullif(sum(greatest(b, fb)), 0) AS iou FROM f GROUP BY ALL), best AS (SELECT vec_id, v, coalesce(iou, 0) AS j FROM p WHERE vec_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY coalesce(iou, 0) DESC, v) = 1),
    c AS (SELECT f.* FROM f SEMI JOIN best USING (vec_id, v)),
    d AS (SELECT c.vec_id, c.i, c.x, c.y, (c.b = 1 AND (c.x IN (0, 7) OR c.y IN (0, 7) OR bool_or(n.b = 0)))::INT AS a, (c.fb = 1 AND (c.x IN (0, 7) OR c.y IN (0, 7) OR bool_or(n.fb = 0)))::INT AS b FROM c JOIN c n ON n.vec_id = c.vec_id AND abs(n.x - c.x) + abs(n.y - c.y) = 1 GROUP BY c.vec_id, c.i, c.x, c.y, c.b, c.fb),
    w AS (SELECT d.vec_id, d.i, d.a, d.b, max(n.a) AS wa, max(n.b) AS wb FROM d JOIN d n ON n.vec_id = d.vec_id AND abs(n.x - d.x) <= 1 AND abs(n.y - d.y) <= 1 GROUP BY ALL),
    e AS (SELECT vec_id, sum(a) AS n, sum(b) AS m, sum(a * wb) AS r, sum(b * wa) AS p FROM w GROUP BY 1), h AS (SELECT vec_id, CASE WHEN m > 0 THEN CASE WHEN n > 0 THEN p / m ELSE 0 END ELSE 1 END AS p, CASE WHEN n > 0 THEN CASE WHEN m > 0 THEN r / n ELSE 0 END ELSE 1 END AS r FROM e),
    o AS (SELECT vec_id, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END / (1 + 1e-9) AS f FROM h)
    SELECT g.vec_id AS image, (j IS NOT NULL)::BIGINT AS n_matches, round(j, 6) AS j, round(f, 6) AS f, round((j + f) / 2, 6) AS jf FROM g LEFT JOIN best USING (vec_id) LEFT JOIN o USING (vec_id)""")
def d10_mask_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean IoU and boundary F of the matched masks of each image."""
    rows = grids(spark, sf_dir).select(F.col("vec_id").alias("image"), "bits")
    edged = lambda df: df.select("image", "id", G.run_lengths(F.col("bits")).alias("runs"), A.boundary(F.col("bits"), 8).alias("e")).select("image", "id", "runs", G.run_lengths(F.col("e")).alias("boundary"), G.run_lengths(A.widened(F.col("e"), 8)).alias("wide"))
    truth = rows.filter("image % 7 <> 0").withColumn("id", F.lit(0))
    found = rows.select("image", F.posexplode(F.array(*[_flipped(F.col("bits"), F.col("image"), v) for v in range(3)])).alias("id", "bits"))
    return D.mask_agreement(rows, edged(truth), edged(found)).select("image", "n_matches", *[F.round(c, 6).alias(c) for c in ("j", "f", "jf")])


@query(f"""WITH {_GRID}, c AS (SELECT vec_id // 32 AS video, vec_id // 4 % 8 AS frame, vec_id % 4 AS a, CASE WHEN vec_id // 4 % 8 > 5 THEN (vec_id + 1) % 4 ELSE vec_id % 4 END AS b, vec_id, i, u.b AS x FROM u),
    t AS (SELECT video, frame, a, i, CASE WHEN video % 2 = 0 AND a = 3 THEN 0 ELSE x END AS x FROM c WHERE vec_id % 9 <> 0),
    f AS (SELECT video, frame, b, i, CASE WHEN video % 2 = 0 AND b = 2 THEN 0 WHEN (vec_id + 2 * i) % 5 = 0 THEN 1 - x ELSE x END AS x FROM c WHERE vec_id % 11 <> 0),
    ta AS (SELECT video, a, sum(x) AS s FROM t GROUP BY ALL), fa AS (SELECT video, b, sum(x) AS s FROM f GROUP BY ALL),
    p AS (SELECT t.video, a, b, sum(t.x * f.x) AS both_ FROM t JOIN f USING (video, frame, i) GROUP BY ALL)
    SELECT ta.video, ta.a AS truth_track, fa.b AS found_track, round(CASE WHEN ta.s + fa.s = 0 THEN 1 ELSE both_ / (ta.s + fa.s - both_) END, 9) AS iou FROM ta JOIN fa USING (video) LEFT JOIN p ON p.video = ta.video AND p.a = ta.a AND p.b = fa.b WHERE both_ > 0 OR ta.s + fa.s = 0""")
def k10_masklet_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of masks' tracks over all their frames; four masks of eight frames are a video."""
    k = F.col("vec_id")
    rows = grids(spark, sf_dir).select("vec_id", F.floor(k / 32).alias("video"), F.pmod(F.floor(k / 4), F.lit(8)).alias("frame"), (k % 4).alias("track"), "bits")
    emptied = lambda df, no: df.select("video", "frame", "track", G.run_lengths(F.when((F.col("video") % 2 == 0) & (F.col("track") == no), F.array_repeat(F.lit(0), 64)).otherwise(F.col("bits"))).alias("runs"))
    truth = emptied(rows.filter("vec_id % 9 <> 0"), 3)
    moved = rows.filter("vec_id % 11 <> 0").withColumn("track", F.when(F.col("frame") > 5, (F.col("track") + 1) % 4).otherwise(F.col("track"))).withColumn("bits", _flipped(F.col("bits"), k, 1))
    return K.masklet_overlaps(truth, emptied(moved, 2)).withColumn("iou", F.round("iou", 9))


@query("""WITH q AS (SELECT p_partkey AS id, unnest([0, 1]) AS part, unnest([[p_partkey % 5, 0, 9, p_partkey % 6, p_partkey % 7, 5, 0, p_partkey % 4], [p_partkey % 3 + 4, 1, 9, 5, p_partkey % 6, 5]])::DOUBLE[] AS v FROM part),
    e AS (SELECT id, part, i, v[2 * i - 1] AS ax, v[2 * i] AS ay, v[2 * (i % (len(v) // 2)) + 1] AS bx, v[2 * (i % (len(v) // 2)) + 2] AS by_ FROM (SELECT *, unnest(range(1, len(v) // 2 + 1)) AS i FROM q)), c AS (SELECT unnest(range(60)) AS cell),
    d AS (SELECT id, part, cell, (bx - ax) * (cell // 10 - ay) - (by_ - ay) * (cell % 10 - ax) AS cross_, ax, ay, bx, by_, cell % 10 AS px, cell // 10 AS py FROM e, c),
    f AS (SELECT id, part, cell, bool_or(cross_ = 0 AND px BETWEEN least(ax, bx) AND greatest(ax, bx) AND py BETWEEN least(ay, by_) AND greatest(ay, by_)) AS on_edge,
      count(*) FILTER ((ay > py) <> (by_ > py) AND px < ax + (py - ay) * (bx - ax) / nullif(by_ - ay, 0)) AS crossed FROM d GROUP BY ALL),
    h AS (SELECT id, cell, bool_or(on_edge OR crossed % 2 = 1) AS b FROM f GROUP BY ALL)
    SELECT id, string_agg(b::INT::VARCHAR, '' ORDER BY cell) AS bits, sum(b::INT)::BIGINT AS area FROM h GROUP BY id""")
def g11_polygon_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two polygons drawn as one mask on a canvas of 10 x 6 cells."""
    k = F.col("p_partkey")
    points = lambda *v: F.array(*[F.lit(x) if isinstance(x, int) else x for x in v]).cast("array<double>")
    parts = F.array(points(k % 5, 0, 9, k % 6, k % 7, 5, 0, k % 4), points(k % 3 + 4, 1, 9, 5, k % 6, 5))
    rows = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(k.alias("id"), R.polygon_runs(parts, 10, 6).alias("runs"))
    return rows.select("id", F.array_join(G.bits_of(F.col("runs").cast("array<int>")), "").alias("bits"), R.area(F.col("runs")).alias("area"))
