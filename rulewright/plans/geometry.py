"""Queries over boxes made of parts and over embeddings read as 8 x 8 grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import geometry as G
from rulewright.operators import corpus as K
from rulewright.plans.catalog import query
from rulewright.sources.tables import table

SIDE = 8


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, id, box, score) of every part: 20 parts share an image."""
    k = F.col("p_partkey")
    b = G.from_xywh(F.pmod(k * 37, F.lit(83)), F.pmod(k * 53, F.lit(71)), F.col("p_size") + 3, F.pmod(k, F.lit(17)) + 2)
    return table(spark, sf_dir, "part").select(F.floor(k / 20).alias("image"), k.alias("id"), b.alias("b"), (F.pmod(k * 29, F.lit(101)) / 101).alias("score"), F.col("p_type").alias("kind"))


BOXES_SQL = """b AS (SELECT p_partkey // 20 AS image, p_partkey AS id, (p_partkey * 37 % 83)::DOUBLE AS x0, (p_partkey * 53 % 71)::DOUBLE AS y0,
    (p_partkey * 37 % 83 + p_size + 3)::DOUBLE AS x1, (p_partkey * 53 % 71 + p_partkey % 17 + 2)::DOUBLE AS y1, p_partkey * 29 % 101 / 101 AS score, p_type AS kind FROM part)"""


@query(f"""WITH {BOXES_SQL}, p AS (SELECT a.id AS a, c.id AS b, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (c.x1 - c.x0) * (c.y1 - c.y0) AS sb,
      greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS i,
      (greatest(a.x1, c.x1) - least(a.x0, c.x0)) * (greatest(a.y1, c.y1) - least(a.y0, c.y0)) AS hull FROM b a JOIN b c ON a.image = c.image AND a.id < c.id)
    SELECT a, b, round(i / (sa + sb - i), 9) AS iou, round(i / sa, 9) AS ioa, round(i / least(sa, sb), 9) AS iom, round(i / (sa + sb - i) - (hull - (sa + sb - i)) / hull, 9) AS giou FROM p WHERE i > 0""")
def g1_box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of the boxes of each image, for pairs that meet."""
    rows = part_boxes(spark, sf_dir)
    a, b = rows.select("image", F.col("id").alias("a"), F.col("b").alias("x")), rows.select("image", F.col("id").alias("b"), F.col("b").alias("y"))
    met = a.join(b, "image").filter((F.col("a") < F.col("b")) & (G.intersection(F.col("x"), F.col("y")) > 0))
    x, y = F.col("x"), F.col("y")
    return met.select("a", "b", *[F.round(f(x, y), 9).alias(f.__name__) for f in (G.iou, G.ioa, G.iom, G.giou)])


@query(f"""WITH {BOXES_SQL} SELECT id, round(greatest(0, least(1, x0 / 90)), 9) AS x0, round(greatest(0, least(1, y1 / 60)), 9) AS y1, x0 <= 0 AND y0 <= 0 AND x1 <= 0 AND y1 <= 0 AS zero,
    greatest(90, id % 100) AS side, (greatest(90, id % 100) - 90) // 2 AS left_pad, ((greatest(90, id % 100) - id % 100)) // 2 AS top_pad, round(1 / (1 + exp(-score)), 9) AS p FROM b""")
def g2_box_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as shares of the image, padding to a square, probabilities of scores."""
    unit, pad = G.unit_box(F.col("b"), F.lit(90), F.lit(60)), G.square_padding(F.lit(90), F.pmod("id", F.lit(100)))
    return part_boxes(spark, sf_dir).select(
        "id", F.round(unit["x0"], 9).alias("x0"), F.round(unit["y1"], 9).alias("y1"), G.is_zero_box(F.col("b")).alias("zero"), pad["side"].alias("side"), pad["left"].alias("left_pad"), pad["top"].alias("top_pad"), F.round(G.sigmoid(F.col("score")), 9).alias("p")
    )


@query(f"""WITH {BOXES_SQL} SELECT image, id, row_number() OVER (PARTITION BY image ORDER BY score DESC, id)::INT AS rank FROM b WHERE score > 0.25 QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, id) <= 5""")
def g3_top_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best boxes of each image above a score."""
    from pyspark.sql import Window

    order = [F.col("score").desc(), F.col("id")]
    best = K.capped(part_boxes(spark, sf_dir).filter("score > 0.25"), "image", order, 5)
    return best.select("image", "id", F.row_number().over(Window.partitionBy("image").orderBy(*order)).alias("rank"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, cells, bits): embeddings as grids of 64 cells, and where they are at least 0.05; an embedding of another length is no grid."""
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == SIDE * SIDE)
    cells = F.transform("embedding", lambda x: x.cast("double"))
    return rows.select("vec_id", "label", cells.alias("cells"), G.active(cells, 0.05).alias("bits"))


_GRID = f"""g AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS cells, list_transform(embedding, lambda x: (x::DOUBLE >= 0.05)::INT) AS bits FROM embeddings WHERE len(embedding) = {SIDE * SIDE}),
    u AS (SELECT vec_id, unnest(range({SIDE * SIDE})) AS i, unnest(cells) AS v, unnest(bits) AS b FROM g)"""


@query(f"""WITH {_GRID}, s AS (SELECT vec_id, sum(b)::INT AS n, min(i % 8) FILTER (b = 1) AS x0, min(i // 8) FILTER (b = 1) AS y0, max(i % 8) FILTER (b = 1) AS x1, max(i // 8) FILTER (b = 1) AS y1 FROM u GROUP BY 1)
    SELECT vec_id, n AS active, round(n / 64, 9) AS share, n = 64 AS full_grid, CASE WHEN n > 0 THEN concat_ws(',', x0, y0, x1, y1) END AS box FROM s""")
def g4_grid_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active cells of each grid: number, share, and the box around them."""
    bits = F.col("bits")
    return grids(spark, sf_dir).select("vec_id", F.aggregate(bits, F.lit(0), lambda n, x: n + x).alias("active"), F.round(G.active_share(bits), 9).alias("share"), F.forall(bits, lambda x: x == 1).alias("full_grid"), F.array_join(G.grid_box(bits, SIDE), ",").alias("box"))


@query(f"""WITH {_GRID}, n AS (SELECT a.vec_id, a.i, min(c.b) AS b FROM u a JOIN u c ON a.vec_id = c.vec_id AND abs(a.i % 8 - c.i % 8) <= 1 AND abs(a.i // 8 - c.i // 8) <= 1
      WHERE a.i % 8 BETWEEN 1 AND 6 AND a.i // 8 BETWEEN 1 AND 6 GROUP BY ALL)
    SELECT vec_id, sum(b)::INT AS left_over FROM n GROUP BY vec_id""")
def g5_grid_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active cells that are left after one ring is taken off."""
    return grids(spark, sf_dir).select("vec_id", F.aggregate(G.shrunk(F.col("bits"), SIDE), F.lit(0), lambda n, x: n + x).alias("left_over"))


@query(f"""WITH {_GRID}, k AS (SELECT unnest(range(9)) AS k), p AS (SELECT vec_id, k, avg(v) AS v FROM u JOIN k ON i // 8 BETWEEN (k // 3) * 8 // 3 AND ceil((k // 3 + 1) * 8 / 3) - 1 AND i % 8 BETWEEN (k % 3) * 8 // 3 AND ceil((k % 3 + 1) * 8 / 3) - 1 GROUP BY ALL)
    SELECT vec_id, k::INT AS bin, round(v, 9) AS mean FROM p""")
def g6_grid_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids pooled to 3 x 3 bins that overlap."""
    return grids(spark, sf_dir).select("vec_id", F.posexplode(G.pooled(F.col("cells"), SIDE, 3)).alias("bin", "mean")).select("vec_id", "bin", F.round("mean", 9).alias("mean"))


@query(f"""WITH {_GRID}, c AS (SELECT vec_id, (i % 8) * 8 + i // 8 AS j, b FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY j) - row_number() OVER (PARTITION BY vec_id, b ORDER BY j) AS run FROM c),
    l AS (SELECT vec_id, min(j) AS j, b, count(*) AS n FROM r GROUP BY vec_id, b, run),
    m AS (SELECT vec_id, string_agg(n::VARCHAR, ' ' ORDER BY j) AS runs, arg_min(b, j) AS first, sum(n * b)::INT AS area FROM l GROUP BY vec_id)
    SELECT vec_id, CASE WHEN first = 1 THEN '0 ' ELSE '' END || runs AS runs, area, TRUE AS same FROM m""")
def g7_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column-wise run lengths of the grids, their areas, and whether decoding gives the grid again."""
    bits = G.transposed(F.col("bits"), SIDE)
    rows = grids(spark, sf_dir).select("vec_id", bits.alias("by_column")).select("vec_id", "by_column", G.run_lengths(F.col("by_column")).alias("runs"))
    return rows.select("vec_id", F.array_join("runs", " ").alias("runs"), G.run_area(F.col("runs")).alias("area"), (G.bits_of(F.col("runs")) == F.col("by_column")).alias("same"))


@query(f"""WITH {_GRID}, m AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM u GROUP BY 1), z AS (SELECT vec_id, (v - lo) / (hi - lo + 1e-8) AS z FROM u JOIN m USING (vec_id))
    SELECT vec_id, round(avg(z), 9) AS mean, round(max(z), 6) AS top, count(*) FILTER (z >= 0.5) AS above FROM z GROUP BY 1""")
def g8_grid_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids from 0 to 1: their means and the cells above one half."""
    rows = grids(spark, sf_dir).select("vec_id", G.min_max(F.col("cells")).alias("z"))
    return rows.select("vec_id", F.round(F.aggregate("z", F.lit(0.0), lambda n, x: n + x) / F.size("z"), 9).alias("mean"), F.round(F.array_max("z"), 6).alias("top"), F.size(F.filter("z", lambda x: x >= 0.5)).cast("long").alias("above"))


@query("""SELECT conv_id, count(*) AS n, array_to_string([floor(i * (count(*) / 4) + count(*) / 8)::INT for i in range(4)], ' ') AS frames FROM conversations GROUP BY conv_id""")
def g9_frame_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four evenly spread turns of each conversation, as frames are chosen from a video."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("conv_id", "n", F.array_join(G.frame_sample(F.col("n"), 4), " ").alias("frames"))


@query(f"""WITH {_GRID}, p AS (SELECT vec_id, bits, [(x >= 0)::INT for x in cells] AS other, cells FROM g),
    q AS (SELECT *, [vec_id % 5, 20, vec_id % 9 - 4, 30, vec_id % 40] AS runs FROM p), c AS (SELECT *, [greatest(r, 0) for r in runs] AS plain FROM q)
    SELECT vec_id, round(CASE WHEN list_sum(bits) > 0 THEN list_sum([a * other[i] for a, i in bits]) / list_sum(bits) ELSE 0 END, 9) AS ioa, round(greatest(0, 1 - sqrt((cells[1] - cells[2]) ** 2 + (cells[3] - cells[4]) ** 2) / 0.5), 9) AS similarity,
      greatest(0, least(64 - plain[1], plain[2])) + greatest(0, least(64 - plain[1] - plain[2] - plain[3], plain[4])) AS area, list_min(runs) >= 0 AND list_sum(runs) = 64 AS valid,
      (SELECT count(*) FROM (SELECT unnest(cells[:48]) AS x) t WHERE x >= 0.05)::INT AS square_area, 2 + vec_id % 4 + 1 AS instances FROM c""")
def g10_mask_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of masks, similarity of points, runs on a canvas, masks on squares, numbers of instances."""
    k, cell = F.col("vec_id"), lambda i: F.get("cells", F.lit(i))
    runs = F.array(*[x.cast("int") for x in (k % 5, F.lit(20), k % 9 - 4, F.lit(30), k % 40)])
    total = lambda bits: F.aggregate(bits, F.lit(0), lambda n, x: n + x)
    square = G.square_bits(F.transform(F.slice("cells", 1, 48), lambda x: F.when(x >= 0.05, 200).otherwise(127)), 8, 6)
    sizes = lambda *v: F.array(*[x.cast("int") for x in v])
    shapes = F.array(sizes(F.lit(2), F.lit(8), F.lit(8)), sizes(F.lit(8), F.lit(8)), sizes(F.lit(9)), sizes(k % 4, F.lit(8), F.lit(8)))
    return grids(spark, sf_dir).select(
        "vec_id", F.round(G.mask_ioa(F.col("bits"), G.active(F.col("cells"), 0.0)), 9).alias("ioa"), F.round(G.point_similarity(cell(0), cell(2), cell(1), cell(3), 0.5), 9).alias("similarity"), total(G.canvas_bits(runs, 64)).alias("area"),
        G.valid_runs(runs, 64).alias("valid"), total(square).alias("square_area"), G.instance_count(shapes).alias("instances"),
    )


@query("""WITH d AS (SELECT o_custkey, o_orderkey, list_transform(range(o_orderkey % 6), lambda i: (o_orderkey + i) % 10) AS v FROM orders), w AS (SELECT o_custkey, max(len(v)) AS w FROM d GROUP BY 1)
    SELECT o_orderkey, array_to_string(v || list_transform(range(w - len(v)), lambda x: -1), ' ') AS padded, len(v)::INT AS n FROM d JOIN w USING (o_custkey)""")
def g12_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of different lengths brought to the longest one of their customer."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    values = F.when(k % 6 > 0, F.transform(F.sequence(F.lit(0), (k % 6).cast("int") - 1), lambda i: (k + i) % 10)).otherwise(F.array().cast("array<long>"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", values.alias("v"))
    rows = rows.withColumn("w", F.max(F.size("v")).over(Window.partitionBy("o_custkey")))
    return rows.select("o_orderkey", F.array_join(G.padded(F.col("v"), F.col("w"), F.lit(-1).cast("long")), " ").alias("padded"), F.size("v").alias("n"))
