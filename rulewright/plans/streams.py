"""Streaming queries over events: extensions of the batch steps that resume and keep state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.operators.joins import spread
from rulewright.plans.catalog import query
from rulewright.plans.geometry import grids
from rulewright.sources.staging import run_dir, staged
from rulewright.streaming import events as E

#: So many files at most are one batch: a batch opens every part of the state, so it has to have work for all.
FILES = 1000


@query("SELECT event_id, user_id, event_type, value FROM events")
def r1_resumed_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events once, by a stream that was run twice."""
    return E.resumed_copy(spark, f"{sf_dir}/events.parquet", ["event_id", "user_id", "event_type", "value"], "event_id")


@query("SELECT user_id, max(value) AS peak, count(*) AS n, max(ts) AS last FROM events GROUP BY 1")
def r2_running_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest value of each user, kept by a stream."""
    return E.running_peaks(spark, f"{sf_dir}/events.parquet", "user_id", "value", "ts")


@query("""WITH d AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT start, event_type, n FROM d WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def r3_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, for days that the watermark has closed."""
    return E.windowed_counts(spark, f"{sf_dir}/events.parquet", "ts", "event_type")


@query("""WITH n AS (SELECT user_id, count(DISTINCT event_type) AS have FROM events GROUP BY 1) SELECT user_id, 4 + user_id % 2 AS items FROM n WHERE have >= 4 + user_id % 2""")
def r4_completed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users for whom enough types of events have come, and how many had come by then."""
    needed = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().select("user_id", (4 + F.col("user_id") % 2).alias("n"))
    return E.completed_keys(spark, f"{sf_dir}/events.parquet", "user_id", "event_type", needed)


@query("""WITH c AS (SELECT vec_id // 4 AS key, vec_id % 4 AS item, list_transform(embedding, lambda x: (x::DOUBLE >= 0.05)::INT) AS bits FROM embeddings WHERE len(embedding) = 64 AND vec_id % 13 <> 0),
    u AS (SELECT key, item, unnest(range(64)) AS i, unnest(bits) AS b FROM c), m AS (SELECT key, i, max(b) AS b FROM u GROUP BY ALL), n AS (SELECT key, count(DISTINCT item) AS items FROM c GROUP BY 1 HAVING count(DISTINCT item) = 4)
    SELECT key, items, sum(b)::BIGINT AS area, string_agg(b::VARCHAR, '' ORDER BY i) AS bits FROM n JOIN m USING (key) GROUP BY key, items""")
def r5_completed_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of four masks each, emitted once all four have come; they come in five parts, in three runs of one stream, some of them twice."""
    base = f"{run_dir(spark)}/unions-{uuid.uuid4().hex}"
    rows = spread(grids(spark, sf_dir), "vec_id").filter("vec_id % 13 <> 0")
    rows = rows.select(F.floor(F.col("vec_id") / 4).alias("key"), (F.col("vec_id") % 4).cast("string").alias("item"), "bits", F.lit(4).cast("long").alias("needed"), F.pmod(F.col("vec_id") * 7, F.lit(5)).cast("int").alias("number"))
    staged_rows = staged(rows)
    for runs in ((3, 0), (4, 0), (1, 2)):
        for number in runs:
            staged_rows.filter(F.col("number") == number).write.mode("append").parquet(f"{base}/in")
        found = E.completed_unions(spark, f"{base}/in", base, FILES)
    return found.select("key", "items", F.aggregate("bits", F.lit(0).cast("long"), lambda n, b: n + b).alias("area"), F.array_join("bits", "").alias("bits"))
