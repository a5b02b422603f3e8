"""How tables that a file's size says little of are joined and dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: So many rows are broadcast at most.
BROADCAST_ROWS = 50_000
#: So many rows go to one part where their count is known.
PART_ROWS = 500_000


def large(rows: DataFrame) -> DataFrame:
    """``rows`` for sort-merge joins: the planner would broadcast millions of rows whose file is small on disk."""
    return rows.hint("merge")


def counted(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` to be broadcast if they are ``most`` at most, which is counted now, else for sort-merge joins."""
    return rows.hint("broadcast") if rows.limit(most + 1).count() <= most else large(rows)


def hashed(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """As ``counted``, but for shuffled hash joins beyond ``most`` rows, so that the far larger other side is never sorted.

    For keys that stand in one row each: a task holds its share of ``rows`` in memory.
    """
    return rows.hint("broadcast" if rows.limit(most + 1).count() <= most else "shuffle_hash")


def spread(rows: DataFrame, *keys: str, count: int = 0) -> DataFrame:
    """``rows`` dealt out by ``keys``, for expressions that take long by row: a file of few bytes is read by few tasks.

    With the ``count`` of the rows, into so many parts that one has about ``PART_ROWS`` at most, so that tasks needn't spill what they sort.
    """
    spark = rows.sparkSession
    parts = -(-count // PART_ROWS) if count else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, 2 * spark.sparkContext.defaultParallelism), *keys)
