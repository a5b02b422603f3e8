"""Line dedup over overlapping three-line windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import fresh

WINDOW_LINES = 3


def _windows(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """All runs of ``width`` consecutive lines: key, mark, at (the first line's number) and a 128-bit key (a, b).

    Each line is hashed once, in a projection of its own, and a run from its lines' hashes.
    """
    lines = docs.select(F.col(doc_id).alias("key"), F.xxhash64(text).alias("mark"), F.split(F.col(text), "\n", -1).alias("lines"))
    hashed = lines.select("key", "mark", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"))).alias("h"))

    def run(i: Column) -> Column:
        return F.struct(*[F.xxhash64(*[F.get("h", i + k)[part] for k in range(width)]).alias(part) for part in ("a", "b")])

    runs = F.when(F.size("h") >= width, F.transform(F.sequence(F.lit(0), F.size("h") - width), run))
    return hashed.select("key", "mark", F.posexplode(runs).alias("at", "w")).select("key", "mark", "at", "w.a", "w.b")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW_LINES) -> DataFrame:
    """Lines to remove: (key, mark, covered), with a sorted array of line numbers, for texts that have any.

    A window is ``width`` consecutive lines, hashed to 128 bits. Of equal windows anywhere in the
    table the first stays, by doc_id (null last), the text's hash ``mark`` and line number; the lines
    of the others go, overlapping windows merged.
    """
    windows = _windows(docs, doc_id, text, width)
    place = F.struct(F.col("key").isNull().alias("none"), "key", "mark", "at")
    first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("count")).filter("count > 1").drop("count")
    later = windows.join(first, ["a", "b"]).filter(place != F.col("first"))
    return later.groupBy("key", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + (width - 1)))))).alias("covered"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW_LINES, counts: str | None = None) -> DataFrame:
    """``docs`` with the later occurrences of repeated ``width``-line windows taken out of ``text``.

    All rows and columns stay. With ``counts`` a column of that name is added, a struct of n_lines and
    removed_lines (both 0 for a null text, which stays null); a ValueError is raised if ``docs`` has it.
    Lines end at each newline. A text with fewer lines than ``width`` has no window and stays as it
    is, and so do empty texts; one of which every line goes becomes empty. Within a document a
    window may repeat too. Rows that repeat a doc_id, or have none, are told apart by their texts;
    those with equal doc_id and text are one document, and stay and lose the same.
    """
    if counts is not None and fresh(docs, counts) != counts:
        raise ValueError(f"docs has a column {counts} already")
    key, mark, covered, split = (fresh(docs, f"lines_{x}") for x in ("key", "mark", "covered", "split"))
    gone = repeated_lines(docs, doc_id, text, width).toDF(key, mark, covered)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), covered)
    left = F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")
    joined = docs.join(gone, docs[doc_id].eqNullSafe(F.col(key)) & (F.xxhash64(docs[text]) == F.col(mark)), "left").withColumn(split, F.split(F.col(text), "\n", -1))
    if counts is not None:
        lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).alias("n_lines")
        joined = joined.withColumn(counts, F.struct(lines, F.when(F.col(covered).isNull(), 0).otherwise(F.size(covered)).alias("removed_lines")))
    return joined.withColumn(text, F.when(F.col(covered).isNull(), F.col(text)).otherwise(left)).drop(key, mark, covered, split)
