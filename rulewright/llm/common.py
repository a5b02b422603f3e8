"""What the corpus operators share: checkpoints, word hashes and text batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.sources.staging import run_dir, shared_dir, staged as stored  # noqa: F401

#: Rows of one key that a task gets of a join, and keys or ids that are broadcast at most.
SALT_ROWS, BROADCAST_IDS = 1 << 14, 200_000
#: The white space that separates words, as a Java or Python character class body.
BLANK = r"\x20\x09-\x0D"
_INT64 = np.uint64


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def many_to_one(rows: DataFrame, small: DataFrame, on: list[str], count: str, by: list[str]) -> DataFrame:
    """``rows`` joined with the stored table ``small``, in which ``on`` is a key and ``count`` says how many rows meet it.

    Keys that more than SALT_ROWS rows meet are dealt over several tasks by the columns ``by``. They
    are known from a broadcast list; if it has more than BROADCAST_IDS keys, adaptive execution has to split them.
    """
    deals = F.ceil(F.col(count) / SALT_ROWS).cast("int")
    hot = small.filter(F.col(count) > SALT_ROWS).select(*on, deals.alias("__deals"))
    if not 0 < hot.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return rows.join(small.drop(count), on)
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("__salt", F.when(F.col("__deals").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("__deals"))).cast("int")).drop("__deals")
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(deals, F.lit(1)) - 1))).drop(count)
    return salted.join(copies, [*on, "__salt"]).drop("__salt")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Rows of long texts go to Python in batches of ``rows``, as long as the block lasts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _INT64(30))) * _INT64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _INT64(27))) * _INT64(0x94D049BB133111EB)
        return x ^ (x >> _INT64(31))


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _INT64(0x9E3779B97F4A7C15))
_LOWER_CODES = _BYTE_CODES.copy()
_LOWER_CODES[65:91] = _BYTE_CODES[97:123]
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x5851F42D4C957F2D


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _INT64(_BASE), np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_CHUNK = 1 << 20
POWERS = _powers(_CHUNK + 1)
INVERSES = np.full(_CHUNK + 1, _INT64(pow(_BASE, -1, 1 << 64)), np.uint64)
INVERSES[0] = 1
with np.errstate(over="ignore"):
    INVERSES = np.cumprod(INVERSES, dtype=np.uint64)


def _words_of(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes and 64-bit hashes of the words in at most ``_CHUNK`` bytes."""
    blank = IS_BLANK[data]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER_CODES if lower else _BYTE_CODES)[data] * POWERS[: len(data)], out=sums[1:])
        return starts, mix64((sums[ends] - sums[starts]) * INVERSES[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes | np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words of a whole text of any length, in order.

    Words are the runs between blanks. Long texts are taken in pieces cut at blanks;
    only a word longer than a piece is hashed from the hashes of its parts.
    """
    data = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    if len(data) <= _CHUNK:
        return _words_of(data, lower)[1]
    out, at = [], 0
    while at < len(data):
        end = min(at + _CHUNK, len(data))
        if end < len(data):
            cuts = np.flatnonzero(IS_BLANK[data[at:end]])
            if len(cuts):
                end = at + int(cuts[-1]) + 1
            else:
                part = _words_of(data[at:end], lower)[1]
                while end < len(data) and not IS_BLANK[data[end]]:
                    stop = min(end + _CHUNK, len(data))
                    blanks = np.flatnonzero(IS_BLANK[data[end:stop]])
                    stop = end + int(blanks[0]) if len(blanks) else stop
                    with np.errstate(over="ignore"):
                        part = mix64(part * _INT64(3) + _words_of(data[end:stop], lower)[1])
                    end = stop
                out.append(part)
                at = end
                continue
        out.append(_words_of(data[at:end], lower)[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-word shingles of one text, in order.

    A text of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    if not len(words):
        return words
    k = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - k + 1, _INT64(k), np.uint64)
        for i in range(k):
            out = mix64(out * _INT64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
    return out


def text_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its rows' offsets, without copies; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20, most_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with little text each; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_column(batch, text)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
            end = max(at + 1, min(end, at + most_rows, batch.num_rows))
            yield batch.slice(at, end - at)
            at = end
