"""Exact dedup by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of characters. Distinct blocks are sorted and
numbered, so that equal blocks, and only they, share an integer name; then adjacent pairs of
names are named in the same way, level by level, until one name is left of each text. Two
texts are equal exactly if they have as many blocks and the same last name.

A block is found again by its fingerprint, which need not be free of collisions: while the
blocks are named, all blocks of one fingerprint meet, and if two differ anywhere, the names are
joined by the blocks themselves instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import BLANK, cut, stored

BLOCK_CHARS = 4096


def normalised(text: Column) -> Column:
    """``text`` with each run of blanks as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANK}]+", " ")


def blocks_of(text: Column, chars: int) -> Column:
    """The consecutive blocks of ``chars`` characters; an empty text has one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0)))


def _numbered(rows: DataFrame) -> DataFrame:
    """The distinct rows, sorted within their partitions and numbered without gaps between equal ones."""
    return rows.distinct().sortWithinPartitions(*rows.columns).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, key: str, text: str, chars: int = BLOCK_CHARS, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """A row (key, sha, n, name) for each row of ``docs``: equal (n, name) means equal texts, and only then.

    ``text`` is already normalised and not null; ``sha`` is its SHA-256, n its number of blocks.
    ``fingerprint`` of a block only finds it; it may collide, as shown by the tests.
    """
    pieces = blocks_of(F.col(text), chars)
    parts = (
        docs.select(F.col(key).alias("key"), F.sha2(F.col(text), 256).alias("sha"), pieces.alias("blocks"))
        .select("key", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("at", "block"))
        .withColumn("mark", fingerprint(F.col("block")))
    )
    names = _numbered(parts.select("mark", "block"))
    by_mark = cut(names.select("mark", "name"))
    if by_mark.groupBy("mark").count().filter("count > 1").isEmpty():
        rows = parts.select("key", "sha", "n", "at", "mark").join(by_mark, "mark")
    else:
        rows = parts.join(stored(names), ["mark", "block"])
    rows = cut(rows.select("key", "sha", "n", "at", "name"))

    most = rows.agg(F.max("n")).first()[0] or 1
    level = rows.filter("n > 1")
    for _ in range(int(most - 1).bit_length()):
        pairs = level.groupBy("key", "sha", "n", F.expr("at div 2").alias("at")).agg(
            F.min_by("name", "at").alias("left"), F.when(F.max("at") % 2 == 1, F.max_by("name", "at")).otherwise(-1).alias("right")
        )
        level = cut(pairs.join(_numbered(pairs.select("left", "right")), ["left", "right"]).select("key", "sha", "n", F.col("at").cast("int").alias("at"), "name"))
    heads = rows.filter("at = 0")
    tops = level.select(F.col("key").alias("k"), F.col("sha").alias("s"), F.col("name").alias("top"))
    long = heads.filter("n > 1").join(tops, F.col("key").eqNullSafe(F.col("k")) & (F.col("sha") == F.col("s")))
    return heads.filter("n = 1").select("key", "sha", "n", "name").unionByName(long.select("key", "sha", "n", F.col("top").alias("name")))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: int = BLOCK_CHARS, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Which row stays of each group of equal texts; one row for each row of ``docs``.

    Texts are equal if they are so after each run of blanks became one space; null counts as
    empty, and all empty texts are one group. The smallest doc_id stays; a null one loses against
    any other. Rows that repeat both doc_id and text can't be told apart and stay or go together.
    An empty table gives an empty result; other columns of ``docs`` are ignored, whatever their names.

    Returns doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text in UTF-8).
    """
    plain = docs.select(F.col(doc_id).alias("key"), normalised(F.col(text)).alias("norm"))
    rows = identities(plain, "key", "norm", chars, fingerprint)
    groups = rows.groupBy("n", "name").agg(F.min("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["n", "name"]).select(
        F.col("key").alias("doc_id"), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )
