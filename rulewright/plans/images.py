"""Queries over images, their files and masks; parts, customers and embeddings stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.operators import images as M
from rulewright.operators import mining
from rulewright.operators import scores as S
from rulewright.plans.catalog import query
from rulewright.plans.geometry import _GRID, BOXES_SQL, SIDE, grids, part_boxes
from rulewright.plans.mining import _RULES, baskets_and_rules
from rulewright.sources.tables import table


@query("""WITH l AS (SELECT DISTINCT 'img_' || o_custkey || CASE o_orderkey % 3 WHEN 0 THEN '_mask.png' WHEN 1 THEN '.png' ELSE '.jpg' END AS path FROM orders),
    c AS (SELECT c_custkey, unnest(range(3)) AS rank, 'img_' || c_custkey || unnest(['_mask.png', '.png', '.jpg']) AS found FROM customer),
    h AS (SELECT c_custkey, min(rank) AS rank, arg_min(found, rank) AS found FROM c JOIN l ON path = found GROUP BY 1)
    SELECT c_custkey, found, rank::INT AS rank FROM customer LEFT JOIN h USING (c_custkey)""")
def i1_first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file of each customer's candidate names that a listing has."""
    k = F.col("o_orderkey") % 3
    listing = table(spark, sf_dir, "orders").select(F.concat(F.lit("img_"), "o_custkey", F.when(k == 0, "_mask.png").when(k == 1, ".png").otherwise(".jpg")).alias("path"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.array(*[F.concat(F.lit("img_"), "c_custkey", F.lit(s)) for s in ("_mask.png", ".png", ".jpg")]).alias("names"))
    return M.first_existing(rows, "c_custkey", "names", listing, "path")


@query(f"""WITH {BOXES_SQL}, c AS (SELECT DISTINCT kind FROM b), n AS (SELECT image, kind, array_to_string(list_sort(list(id)), ' ') AS objects FROM b GROUP BY ALL)
    SELECT x.image, c.kind AS category, coalesce(objects, '') AS objects FROM (SELECT DISTINCT image FROM b) x CROSS JOIN c LEFT JOIN n ON n.image = x.image AND n.kind = c.kind""")
def i2_query_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image with every category, empty ones included."""
    rows = part_boxes(spark, sf_dir).select("image", F.col("kind").alias("category"), F.col("id").alias("object"))
    found = M.query_grid(rows.select("image").distinct(), rows, rows, negatives=True)
    return found.select("image", "category", F.array_join("objects", " ").alias("objects"))


@query("""WITH p AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 25), n AS (SELECT DISTINCT user_id, event_type FROM events WHERE value <= 25 EXCEPT FROM p),
    u AS (SELECT 0 AS extra, * FROM p UNION ALL SELECT 1, * FROM n) SELECT user_id, event_type, extra, row_number() OVER (ORDER BY extra, user_id, event_type) AS number FROM u""")
def i3_numbered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of (video, phrase) pairs, negative ones after the positive ones."""
    rows = table(spark, sf_dir, "events")
    return M.numbered_pairs(rows.filter("value > 25"), rows.filter("value <= 25"), ["user_id", "event_type"])


@query("""SELECT doc_id + (SELECT (min(doc_id) = 0)::INT FROM documents) AS doc_id, source FROM documents""")
def i4_from_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that start at 1."""
    return M.from_one(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@query(f"""WITH RECURSIVE {_GRID}, o AS (SELECT vec_id, i FROM u WHERE b = 1 AND i < 56), r AS (SELECT vec_id, i, i AS root FROM o
      UNION SELECT r.vec_id, n.i, r.root FROM r JOIN o n ON n.vec_id = r.vec_id AND abs(n.i % 8 - r.i % 8) <= 1 AND abs(n.i // 8 - r.i // 8) <= 1),
    m AS (SELECT vec_id, i, min(root) AS root FROM r GROUP BY ALL), c AS (SELECT vec_id, root, count(*) AS n FROM m GROUP BY ALL)
    SELECT vec_id, count(*) AS regions, max(n) AS largest, sum(n * n)::BIGINT AS cell_sizes, string_agg((root + 1) || ':' || n, ' ' ORDER BY root) AS labels FROM c GROUP BY 1""")
def i5_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the first seven rows of each grid, joined at corners too: their number, labels and sizes; grids without active cells have no row."""
    cells = grids(spark, sf_dir).select("vec_id", M.regions(F.slice("bits", 1, 56), F.lit(SIDE)).alias("r"))
    cells = cells.select("vec_id", F.explode(F.arrays_zip(F.col("r.labels").alias("label"), F.col("r.sizes").alias("size"))).alias("c")).select("vec_id", "c.*").filter("label > 0")
    each = cells.groupBy("vec_id", "label").agg(F.max("size").alias("n"), F.sum("size").alias("s"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda x: F.concat_ws(":", x["label"], x["n"])), " ")
    return each.groupBy("vec_id").agg(F.count(F.lit(1)).alias("regions"), F.max("n").cast("long").alias("largest"), F.sum("s").alias("cell_sizes"), told.alias("labels"))


@query(f"""WITH {_GRID}, p AS (SELECT a.vec_id AS a, c.vec_id AS b, sum(a.b * c.b) AS i, sum(greatest(a.b, c.b)) AS o FROM u a JOIN u c ON a.vec_id // 8 = c.vec_id // 8 AND a.i = c.i AND a.vec_id < c.vec_id GROUP BY ALL)
    SELECT a, b, round(CASE WHEN o > 0 THEN i / o ELSE 1 END, 9) AS iou FROM p""")
def i6_mask_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of the masks of each image; eight grids share one."""
    rows = grids(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).alias("image"), "vec_id", "bits")
    a, b = rows.select("image", F.col("vec_id").alias("a"), F.col("bits").alias("x")), rows.select("image", F.col("vec_id").alias("b"), F.col("bits").alias("y"))
    return a.join(b, "image").filter("a < b").select("a", "b", F.round(M.bit_overlap(F.col("x"), F.col("y")), 9).alias("iou"))


@query(f"""WITH {_GRID}, m AS (SELECT vec_id // 8 AS image, i, max(b) AS b FROM u GROUP BY ALL) SELECT image, sum(b)::BIGINT AS active FROM m GROUP BY 1""")
def i7_union_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active cells of the union of each image's masks, with the union made cell by cell before it is counted."""
    masks = grids(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).alias("image"), "bits")
    return M.union_masks(masks, "image", "bits").select("image", F.aggregate("bits", F.lit(0), lambda n, x: n + x).cast("long").alias("active"))


@query()
def i8_hash_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose properties' content hash isn't that of a listed one."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    listed = events.filter("event_id < 100").select(M.content_hash("props").alias("hash")).distinct()
    return M.without_hashes(events, "props", listed).select("event_id")


@query("""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'x' END AS before, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE 'y' END AS after, o_orderpriority AS answer FROM orders)
    SELECT o_orderkey, answer, before, after FROM b WHERE lower(before) = lower(answer) AND lower(after) <> lower(answer)""")
def i9_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that one run had right and another one wrong."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("answer"))
    k = F.col("o_orderkey")
    return M.regressions(rows, rows.select("o_orderkey", F.when(k % 3 == 0, F.col("answer")).otherwise("x").alias("text")), rows.select("o_orderkey", F.when(k % 2 == 0, F.lower("answer")).otherwise("y").alias("text")), "o_orderkey")


@query("""WITH e AS (SELECT event_type, sum(value * (user_id % 3)) AS s, sum(user_id % 3) AS w FROM events GROUP BY 1) SELECT round(sum(s) / sum(w), 6) AS weighted, round(avg(s / w) FILTER (w > 0), 6) AS by_class, count(*) FILTER (w > 0) AS classes FROM e""")
def i10_class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted and class-averaged means of partial scores."""
    found = M.class_means(table(spark, sf_dir, "events").withColumn("w", F.col("user_id") % 3), "event_type", "value", "w")
    return found.select(F.round("weighted", 6).alias("weighted"), F.round("by_class", 6).alias("by_class"), "classes")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS s FROM orders) SELECT o_custkey, count(*) AS n, count(*) FILTER (s > 0) AS hits, arg_min(o_orderkey, [-s, o_orderkey::DOUBLE]) AS best FROM r GROUP BY 1""")
def i11_candidate_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, hits and the best row of each image; customers and orders stand for them."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0).alias("s"))
    return M.best_rows(rows, "o_custkey", "s", F.col("o_orderkey"))


@query("""WITH w AS (SELECT conv_id, len(string_split(text, ' ')) AS n FROM conversations) SELECT count(*) AS n, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, max(n)::BIGINT AS most, round(avg((n >= 60)::INT), 6) AS at_limit FROM w""")
def i12_token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the turns: total, mean, longest and the share that reaches a limit."""
    rows = table(spark, sf_dir, "conversations").select(F.size(F.split("text", " ")).alias("n_words"))
    found = S.length_statistics(rows, "n_words", 60)
    return found.select("n", "total", F.round("mean", 6).alias("mean"), "most", F.round("at_limit", 6).alias("at_limit"))


@query(_RULES + """, o AS (SELECT k, answer, list(item) AS items FROM t GROUP BY ALL),
    s AS (SELECT o.k, count(*) FILTER (len(list_filter(r.itemset, lambda i: starts_with(i, 'V_') AND list_contains(o.items, i))) > 0) AS cued,
      count(*) FILTER (len(list_filter(r.itemset, lambda i: starts_with(i, 'V_') AND list_contains(o.items, i))) > 0 AND len(list_filter(r.itemset, lambda i: NOT starts_with(i, 'V_') AND NOT list_contains(o.items, i))) = 0) AS met, count(r.rank) AS answers
      FROM o LEFT JOIN r ON r.answer = o.answer GROUP BY 1)
    SELECT CASE WHEN answers = 0 THEN 'no answer' WHEN cued = 0 THEN 'no candidate' WHEN met = 0 THEN 'no match' ELSE 'matched' END AS stage, count(*) AS n FROM s GROUP BY 1""")
def q8_match_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the orders come in matching: an answer with rules, a candidate by a cue, a match."""
    own, rules = baskets_and_rules(spark, sf_dir)
    return mining.match_stages(own, rules, "o_orderkey").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
