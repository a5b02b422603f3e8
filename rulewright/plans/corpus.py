"""Queries that join, filter, guard and number the rows of corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.operators import corpus as K
from rulewright.operators import images as M
from rulewright.plans.catalog import query
from rulewright.sources.tables import table


@query("SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1")
def c1_first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each (order, line number)."""
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]
    return K.first_by_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order)


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def c2_last_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type."""
    return K.last_by_key(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("WITH f AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS source_no FROM documents GROUP BY source) SELECT doc_id, source, source_no FROM documents JOIN f USING (source)")
def c3_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the sources by first appearance."""
    return K.dense_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", "source_no")


@query("""WITH m AS (SELECT max(c_custkey) AS top FROM customer), u AS (SELECT 0 AS part, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier)
    SELECT part, name, row_number() OVER (ORDER BY part, id) - 1 AS row_no, CASE WHEN part = 0 THEN id ELSE top + row_number() OVER (PARTITION BY part ORDER BY id) END AS new_id FROM u, m""")
def c4_offset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources one after the other: running numbers, and ids of the second beyond those of the first."""
    a = table(spark, sf_dir, "customer").select(F.lit(0).alias("part"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.lit(1).alias("part"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    both = K.numbered(a.unionByName(b), [F.col("part"), F.col("id")], "row_no")
    sizes = a.agg(F.count(F.lit(1)).alias("first_rows"), F.max("id").alias("top"))
    new = F.when(F.col("part") == 0, F.col("id")).otherwise(F.col("top") + F.col("row_no") - F.col("first_rows") + 1)
    return both.crossJoin(F.broadcast(sizes)).select("part", "name", "row_no", new.alias("new_id"))


@query("""SELECT d.doc_id, quality, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'removed' WHEN quality = 1 THEN 'kept' ELSE 'weak' END AS provenance
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def c5_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the reason why they stay or go; those without labels stay."""
    labels = {"removed": F.col("toxic") == 1, "kept": F.col("quality") == 1}
    rows = K.provenance(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", labels, "unlabelled", "weak")
    return rows.select("doc_id", "quality", "provenance")


@query("""WITH keep AS (SELECT doc_id FROM labels WHERE toxic = 0), remove AS (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)
    SELECT doc_id, 'both' AS problem FROM keep JOIN remove USING (doc_id)
    UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id NOT IN (FROM keep) AND doc_id NOT IN (FROM remove)""")
def c6_keep_remove_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents both kept and removed, or neither."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    keep, remove = labels.filter("toxic = 0"), labels.filter("toxic = 1 or quality = 0")
    return K.disjoint(keep, remove, "doc_id").withColumn("problem", F.lit("both")).unionByName(K.uncovered(docs, [keep, remove], "doc_id"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def c7_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line keys that aren't unique."""
    return K.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH o AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey), t AS (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, min(o_orderkey) LIMIT 3)
    SELECT o_orderkey, c_mktsegment, o_orderpriority FROM o WHERE o_orderpriority IN (FROM t)""")
def c8_frequent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with one of the three most frequent priorities, with their customers."""
    orders = K.most_frequent(table(spark, sf_dir, "orders"), "o_orderpriority", 3, "o_orderkey")
    return orders.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_mktsegment", "o_orderpriority")


@query("""WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS votes, min(o_orderkey) AS f FROM orders GROUP BY 1, 2)
    SELECT o_custkey, o_orderpriority, votes FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, f) = 1""")
def c9_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent priority of each customer's orders, the first seen on ties."""
    return K.majority(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("""SELECT p_partkey, p_brand, p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3""")
def c10_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three parts of each brand, the dearest ones."""
    return K.capped(table(spark, sf_dir, "part"), "p_brand", [F.col("p_retailprice").desc(), F.col("p_partkey")], 3).select("p_partkey", "p_brand", "p_type")


@query("""WITH w AS (SELECT DISTINCT o_custkey AS id FROM orders), u AS (SELECT c_custkey AS id, c_name AS name, 0 AS source_no FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, lower(c_name), 1 FROM customer)
    SELECT id, name, source_no FROM u WHERE id IN (FROM w) QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_no) = 1""")
def c11_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders, from a first source or else from a second one."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    all_ = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_acctbal")
    return K.backfilled(wanted, [all_.filter("c_acctbal > 0").drop("c_acctbal"), all_.select("id", F.lower("name").alias("name"))], "id").select("id", "name", "source_no")


@query("""WITH p AS (SELECT o_orderkey, lower(o_orderpriority) AS rejected, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN lower(o_orderpriority) ELSE ' ' END AS chosen FROM orders)
    SELECT o_orderkey, chosen, rejected, lower(trim(chosen)) <> rejected AS loose FROM p WHERE trim(chosen) <> '' AND trim(chosen) <> trim(rejected)""")
def c12_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of answers that differ, letters' case included, and whether they do without it."""
    k = F.col("o_orderkey") % 3
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lower("o_orderpriority").alias("rejected"), F.when(k == 0, F.col("o_orderpriority")).when(k == 1, F.lower("o_orderpriority")).otherwise(" ").alias("chosen"))
    return K.preference_pairs(rows, "chosen", "rejected", same_case=True).select("o_orderkey", "chosen", "rejected", (F.lower(F.trim("chosen")) != F.col("rejected")).alias("loose"))


@query("""WITH r AS (SELECT event_id, user_id, CASE WHEN value IS NULL THEN 'no value' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'other type' WHEN value < 10 THEN 'small' END AS reason FROM events),
    ok AS (SELECT *, row_number() OVER (PARTITION BY user_id, reason ORDER BY event_id) AS n FROM r)
    SELECT coalesce(reason, CASE WHEN n = 1 THEN 'kept' ELSE 'duplicate' END) AS reason, count(*) AS n FROM ok GROUP BY 1""")
def c13_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why events are skipped, by the first reason that holds; of the valid ones the first of each user stays."""
    reason = F.when(F.col("value").isNull(), "no value").when(~F.col("event_type").isin("click", "view", "purchase"), "other type").when(F.col("value") < 10, "small")
    rows = K.skip_reasons(table(spark, sf_dir, "events"), "user_id", "event_id", reason)
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT p_partkey, array_to_string(list_sort(list(DISTINCT s_name)), '|') AS names, count(DISTINCT s_name) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
    SELECT p_partkey, coalesce(names, '') AS names, n FROM m""")
def c14_object_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct suppliers of each part; parts without any have an empty list."""
    notes = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("l_partkey").alias("p_partkey"), "s_name")
    listed = M.object_lists(notes, "p_partkey", "s_name", table(spark, sf_dir, "part"))
    return listed.select("p_partkey", F.array_join("classes", "|").alias("names"), F.size("scores").cast("long").alias("n"))


@query("""WITH b AS (SELECT item_id, lower(text) AS phrase FROM benchmark) SELECT item_id, count(d.doc_id) AS docs FROM b LEFT JOIN documents d ON contains(' ' || lower(d.text) || ' ', ' ' || phrase || ' ') GROUP BY item_id""")
def c15_phrase_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each benchmark item stands whole, between spaces."""
    return K.phrase_mentions(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")
