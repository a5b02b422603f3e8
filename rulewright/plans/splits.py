"""Queries that split, shard, shuffle and sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.operators import corpus as K
from rulewright.operators import mixtures as M
from rulewright.plans.catalog import query
from rulewright.sources.tables import table

_ORDER = "md5(o_orderkey::VARCHAR || ':7')"


@query(f"""WITH n AS (SELECT count(*) AS n, n // 11 AS v FROM orders), c AS (SELECT n, v, n * 9 // 11 + (n - n * 9 // 11 - 2 * v > 0)::INT AS train, v + (n - n * 9 // 11 - 2 * v > 1)::INT AS val FROM n),
    r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_ORDER}, o_orderkey) - 1 AS pos FROM orders)
    SELECT o_orderkey, CASE WHEN pos < train THEN 'train' WHEN pos < train + val THEN 'val' ELSE 'test' END AS split FROM r, c""")
def t1_split_9_1_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, validation and test by 9:1:1, what is left to the first ones."""
    return K.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", ("train", "val", "test"), (9, 1, 1), 7)


@query(f"""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_ORDER}, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
    c AS (SELECT *, n * 8 // 10 + CASE WHEN n - n * 8 // 10 - 2 * (n // 10) >= 1 AND (n * 8 % 10 >= n % 10 OR n - n * 8 // 10 - 2 * (n // 10) >= 3) THEN 1 ELSE 0 END AS train FROM r),
    d AS (SELECT *, n // 10 + CASE WHEN n % 10 > n * 8 % 10 THEN (n - n * 8 // 10 - 2 * (n // 10) >= 1)::INT ELSE (n - n * 8 // 10 - 2 * (n // 10) >= 2)::INT END AS val FROM c)
    SELECT o_orderkey, CASE WHEN pos < train THEN 'train' WHEN pos < train + val THEN 'val' ELSE 'test' END AS split FROM d""")
def t2_split_8_1_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits by 8:1:1 within each priority, by the largest remainder."""
    return K.split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", ("train", "val", "test"), (8, 1, 1), 7, True, ["o_orderpriority"]).select("o_orderkey", "split")


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer)
    SELECT c_custkey, CASE WHEN pos < (n % 7) * (n // 7 + 1) THEN pos // (n // 7 + 1) ELSE n % 7 + (pos - (n % 7) * (n // 7 + 1)) // (n // 7) END::INT AS shard, floor(pos / ceil(n / 7))::INT AS chunk, (pos % 7)::INT AS robin, (pos // 64)::INT AS batch FROM r""")
def t3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous shards, chunks rounded up, shards in turn, and batches of 64 rows."""
    rows = K.numbered(table(spark, sf_dir, "customer").select("c_custkey"), [F.col("c_custkey")], "at")
    sized = rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))))
    at, n = F.col("at"), F.col("n")
    return sized.select("c_custkey", K.shard(at, n, 7).alias("shard"), K.chunk(at, n, 7).alias("chunk"), F.pmod(at, F.lit(7)).cast("int").alias("robin"), F.floor(at / 64).cast("int").alias("batch"))


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer)
    SELECT c_custkey, c_mktsegment FROM r WHERE pos < greatest(1, floor(n * 0.25))""")
def t4_prefix_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first quarter of the customers by key, one at least: the limit is the feature."""
    rows = K.numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), [F.col("c_custkey")], "at")
    return M.first_share(rows, "at", 0.25).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part ORDER BY md5(p_partkey::VARCHAR || ':3'), p_partkey LIMIT 100")
def t5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed pseudo-random sample of 100 parts: the limit is the feature."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy(K.shuffled_order(F.col("p_partkey"), 3), "p_partkey").limit(100)


@query("""SELECT l_orderkey, l_partkey, l_extendedprice FROM (SELECT DISTINCT l_orderkey, l_partkey, l_extendedprice FROM lineitem)
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) <= 2""")
def t6_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two dearest distinct lines of each order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").distinct()
    return K.capped(rows, "l_orderkey", [F.col("l_extendedprice").desc(), F.col("l_partkey")], 2)


@query("""WITH m AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS urgent, o_custkey FROM orders)
    SELECT o_custkey, o_orderkey FROM m QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY urgent DESC, md5(o_orderkey::VARCHAR || ':5'), o_orderkey) <= 4""")
def t7_positives_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most four orders of each customer, urgent ones before a pseudo-random choice of others."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return K.capped(rows, "o_custkey", [F.col("urgent").desc(), K.shuffled_order(F.col("o_orderkey"), 5), F.col("o_orderkey")], 4).drop("urgent")
