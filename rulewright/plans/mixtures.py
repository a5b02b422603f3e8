"""Queries of mixed packages; parts are training questions, customers the original ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import geometry as G
from rulewright.operators import mixtures as M
from rulewright.plans.catalog import query
from rulewright.plans.geometry import grids
from rulewright.sources.staging import staged
from rulewright.sources.tables import table


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("question_id"), F.col("p_name").alias("question"), F.when(k % 4 == 0, "number").otherwise("other").alias("answer_type"), F.array("p_type", "p_brand").alias("visual_cues")
    )


def _inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = _train(spark, sf_dir)
    train = M.with_backfill(rows.filter("question_id % 13 <> 0"), rows, rows.filter("question_id % 26 = 0"), "question_id")
    ids = rows.select("question_id")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("at"), F.col("c_name").alias("question"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("origin_split"))
    return [train, ids.filter("question_id % 3 <> 0 and question_id % 17 <> 1"), ids.filter("question_id % 3 = 0 or question_id % 19 = 1"), ids.filter("question_id % 5 <> 0"), customers]


_SETS = """t AS (SELECT p_partkey AS id, p_name, p_partkey % 4 = 0 AS number, p_type = 'PROMO' AS coarse FROM part WHERE p_partkey % 13 <> 0 OR p_partkey % 26 = 0),
    k AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 17 <> 1), r AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 19 = 1),
    s AS (SELECT id, true AS keep FROM k UNION ALL SELECT id, false FROM r),
    p AS (SELECT id, p_name AS question, CASE WHEN NOT keep THEN 'train_raw_removed_nomask' {coarse} WHEN id % 5 = 0 THEN 'train_raw_filtered_missingmask_nomask' {number} ELSE 'train_raw_filtered_masked' END AS data_source FROM t JOIN s USING (id)
          UNION ALL SELECT (SELECT max(id) + 1 FROM t) + row_number() OVER (ORDER BY c_custkey) - 1, c_name, 'vqa_original_' || CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE 'unknown' END || '_nomask' FROM customer)"""
_NUMBER, _COARSE = "WHEN number THEN 'train_raw_filtered_number_nomask'", "WHEN coarse THEN 'train_raw_filtered_demoted_nomask'"


@query("WITH " + _SETS.format(number=_NUMBER, coarse="") + " SELECT id AS question_id, question, data_source, CASE WHEN data_source LIKE '%_masked' THEN 'mask' ELSE 'none' END AS mask_supervision FROM p")
def m1_mixed_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of kept, removed and original rows."""
    train, keep, remove, masks, customers = _inputs(spark, sf_dir)
    return M.mixed_package(train, keep, remove, masks, customers, "at")[0].select("question_id", "question", "data_source", "mask_supervision")


@query("WITH " + _SETS.format(number="", coarse=_COARSE) + """, u AS (SELECT id, 'both' AS problem FROM k JOIN r USING (id) UNION ALL SELECT DISTINCT id, 'extra' FROM s WHERE id NOT IN (SELECT id FROM t) AND id NOT IN (SELECT id FROM k JOIN r USING (id))
      UNION ALL SELECT id, 'missing' FROM t WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT id, 'repeated' FROM p GROUP BY id HAVING count(*) > 1)
    SELECT 'problem' AS field, problem AS value, count(*) AS n FROM u GROUP BY problem UNION ALL SELECT 'data_source', data_source, count(*) FROM p GROUP BY 2
    UNION ALL SELECT 'mask_supervision', CASE WHEN data_source LIKE '%_masked' THEN 'mask' ELSE 'none' END, count(*) FROM p GROUP BY 2""")
def m2_package_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a package's ids, and how many rows it has of each kind, coarse cues demoted."""
    train, keep, remove, masks, customers = _inputs(spark, sf_dir)
    package, problems = M.mixed_package(train, keep, remove, masks, customers, "at", coarse=["PROMO"], numbers_masked=True)
    counted = problems.groupBy(F.col("problem").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("field", F.lit("problem"))
    return M.package_summary(package).unionByName(counted)


@query("""WITH t AS (SELECT p_partkey AS id, p_partkey % 4 = 0 AS number, CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE 'mask' END AS m FROM part), a AS (SELECT id, m FROM t WHERE NOT number), b AS (SELECT id, CASE WHEN number THEN 'none' ELSE m END AS m FROM t)
    SELECT 'dropped' AS kind, (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM a WHERE m = 'mask') AS masked, (SELECT count(*) FROM a) AS mask_rows UNION ALL SELECT 'kept', (SELECT count(*) FROM b), (SELECT count(*) FROM b WHERE m = 'mask'), (SELECT count(*) FROM b WHERE m = 'mask')""")
def m3_without_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and mask rows when numbers lose their rows, and when they lose their masks only."""
    rows = _train(spark, sf_dir).withColumn("mask_supervision", F.when(F.col("question_id") % 5 == 0, "none").otherwise("mask"))
    out = None
    for kind, drop in (("dropped", True), ("kept", False)):
        kept, masks = M.without_numbers(rows, rows.select("question_id"), drop)
        one = kept.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("mask_supervision") == "mask", 1)).alias("masked")).crossJoin(masks.agg(F.count(F.lit(1)).alias("mask_rows"))).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE >= -0.6)::INT) AS bits, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS c FROM embeddings WHERE len(embedding) = 64)
    SELECT p_partkey AS question_id, round(CASE WHEN vec_id IS NULL OR p_partkey % 4 = 0 OR list_sum(bits) = 64 THEN 0 ELSE list_sum(c) END, 6) AS total FROM part LEFT JOIN g ON vec_id = p_partkey""")
def m4_with_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's mask as an array of numbers, zeros where there is none to use."""
    cells = F.transform("cells", lambda x: F.abs(x))
    masks = grids(spark, sf_dir).select(F.col("vec_id").alias("question_id"), F.lit(0).alias("ord"), cells.alias("coverage"), F.transform(G.active(F.col("cells"), -0.6), lambda b: b == 1).alias("has_mask"))
    rows = M.with_coverage(_train(spark, sf_dir), masks.unionByName(masks.withColumn("ord", F.lit(1)).withColumn("coverage", F.array(F.lit(9.0)))), 64)
    return rows.select("question_id", F.round(F.aggregate("coverage", F.lit(0.0), lambda n, x: n + x), 6).alias("total"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey ELSE NULL END AS id, c_custkey % 4 IN (0, 1) AND c_custkey < (SELECT count(*) FROM customer) / 2 AS found FROM customer""")
def m5_ids_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in file names, and the rows that they find."""
    k = F.col("c_custkey")
    name = F.element_at(F.array(F.concat(F.lit("a/b/"), k.cast("string"), F.lit("_17.jpg")), F.concat(k.cast("string"), F.lit("_x")), F.lit("a/no.jpg"), F.concat(F.lit("q"), k.cast("string"), F.lit("_1.png"))), (k % 4 + 1).cast("int"))
    named = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    half = table(spark, sf_dir, "customer").agg((F.count(F.lit(1)) / 2).alias("half"))
    rows = table(spark, sf_dir, "customer").crossJoin(F.broadcast(half)).filter("c_custkey < half").select(k.alias("question_id"))
    good, bad = M.by_stem(rows, named, "name")
    told = named.select("c_custkey", "name", M.stem_id(F.col("name")).alias("id"))
    return told.join(good.select("c_custkey", F.lit(True).alias("f")), "c_custkey", "left").select("c_custkey", "id", F.coalesce("f", F.lit(False)).alias("found"))


@query("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS c, list_transform(embedding, lambda x: (x::DOUBLE >= 0.05)::INT) AS bits FROM embeddings WHERE len(embedding) = 64)
    SELECT vec_id, list_sum(bits) > 1e-6 AND 64 - list_sum(bits) > 1e-6 AS both_parts, round(list_sum(list_transform(c, lambda x: 100 * greatest(0, 1 - 3 * x))), 6) AS total FROM g""")
def m6_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids with masked and free cells, and values scaled down where a mask covers them."""
    rows = grids(spark, sf_dir).select("vec_id", M.has_both_parts(F.transform("bits", lambda b: b.cast("double"))).alias("both_parts"), M.suppressed_cells(F.array_repeat(F.lit(100.0), 64), F.transform("cells", lambda x: F.abs(x)), 3.0).alias("v"))
    return rows.select("vec_id", "both_parts", F.round(F.aggregate("v", F.lit(0.0), lambda n, x: n + x), 6).alias("total"))


@query("""SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE (toxic IS NULL OR toxic NOT IN (1)) AND NOT coalesce(starts_with(source, 'src1') OR starts_with(source, 'src3'), false)""")
def m7_without_labels_and_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a dropped label, of sources without a dropped prefix."""
    docs = M.without_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "toxic", [1])
    return M.without_prefixes(docs, "source", ["src1", "src3"]).select("doc_id")


@query("""WITH c AS (SELECT c_custkey, md5(c_custkey || ':7') AS a, md5(c_custkey || ':' || (SELECT count(*) FROM customer)) AS b FROM customer), x AS (SELECT c_custkey FROM c ORDER BY a, c_custkey LIMIT 50), y AS (SELECT c_custkey FROM c ORDER BY b, c_custkey LIMIT 40)
    SELECT 'sampled' AS kind, c_custkey FROM x UNION ALL SELECT 'limited', c_custkey FROM y UNION ALL SELECT 'share', c_custkey FROM customer WHERE c_custkey < greatest(1, floor((SELECT count(*) FROM customer) * 0.13)) UNION ALL SELECT 'first', c_custkey FROM customer WHERE c_custkey < 7""")
def m8_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of fixed sizes and shares: limits are their feature."""
    ids = table(spark, sf_dir, "customer").select("c_custkey")
    parts = {"sampled": M.sampled(ids, "c_custkey", 50, 7, exact=True), "limited": M.limited_ids(ids, "c_custkey", 40), "share": M.first_share(ids, "c_custkey", 0.13), "first": M.first_rows(ids, "c_custkey", 7)}
    out = None
    for kind, rows in parts.items():
        one = staged(rows).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out
