"""Incremental versions of batch steps with Structured Streaming: resuming, skipping what is done, running peaks."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rulewright.sources.records import shard_problems
from rulewright.sources.staging import run_dir


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The Parquet files under ``path`` (a file or a folder) as a stream.

    A stream's path has to be a folder unless it is a pattern, so the last letter is made one.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Takes all that is new since the checkpoint into the Parquet folder ``out``, then stops.

    A run that breaks off goes on where its last complete batch ended, with no row lost or twice.
    """
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def resumed_copy(spark: SparkSession, path: str, columns: list[str], key: str) -> DataFrame:
    """The stream's rows, each key once, written by a run and read again; a second run finds nothing left."""
    base = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = stream_of(spark, path).select(*columns).dropDuplicates([key])
    for _ in range(2):
        run_once(rows, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


def running_peaks(spark: SparkSession, path: str, key: str, value: str, time: str) -> DataFrame:
    """The peak of each key at the stream's end, with the number of its rows: an aggregate in update mode.

    Each batch's changed keys are written with the batch's number; the last number of a key counts.
    """
    base = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    peaks = stream_of(spark, path).groupBy(key).agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("n"), F.max(time).alias("last"))
    write = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
    peaks.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return rows.groupBy(key).agg(F.max_by("peak", "batch").alias("peak"), F.max_by("n", "batch").alias("n"), F.max_by("last", "batch").alias("last"))


def windowed_counts(spark: SparkSession, path: str, time: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by time window and key, each once, when the watermark has passed the window's end."""
    base = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    counts = stream_of(spark, path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
    run_once(counts.select(F.col("window.start").alias("start"), key, "n"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


class _Completion(StatefulProcessor):
    """Per key: the items that have come, the union of their masks, and how many are needed; one row when the last one comes.

    All of it is one value, read and written once for a key's rows of a batch: each call of the state goes to another process.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.union = handle.getValueState("union", "items array<string>, bits array<int>, needed long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        items, union, needed, done = self.union.get() or ([], [], None, False)
        if done:
            # later rows of a finished key change nothing
            for _ in rows:
                pass
            return
        have, bits = dict.fromkeys(items), np.asarray(union, np.int32)
        came = None
        for batch in rows:
            for item, own, need, number in zip(batch["item"], batch["bits"], batch["needed"], batch["number"], strict=True):
                if came is not None:
                    continue
                needed = int(need) if pd.notna(need) else needed
                if item is not None and item not in have:
                    have[item] = None
                    own = np.asarray([] if own is None else own, np.int32)
                    wide = max(len(bits), len(own))
                    bits = np.maximum(np.pad(bits, (0, wide - len(bits))), np.pad(own, (0, wide - len(own))))
                if needed is not None and len(have) >= needed:
                    came = pd.DataFrame({"key": [key[0]], "items": [len(have)], "bits": [bits.tolist()], "batch": [number]})
        # what a finished key needs no longer is forgotten
        self.union.update(([], [], needed, True) if came is not None else (list(have), bits.tolist(), needed, False))
        if came is not None:
            yield came

    def close(self) -> None:
        pass


def completions(rows: DataFrame) -> DataFrame:
    """A stream of (key, items, bits, batch): each key once, when all the items that it needs have come, with the union of their masks.

    ``rows`` is a stream of (key, item, bits, needed, number): an item and its mask, an array of 0 and 1 (null for none), and how many different
    items the key needs, which any of its rows may tell; ``number`` is carried into the result by the row that completes the key. Items that come again change
    nothing, and neither does what comes after a key is complete. The state of a key is its items and one union.
    """
    kind = dict(rows.dtypes)
    schema = f"key {kind['key']}, items long, bits array<int>, batch {kind['number']}"
    return rows.groupBy("key").transformWithStateInPandas(_Completion(), schema, "Append", "None")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, as long as the block lasts; a query keeps the one that it was started with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def completed_keys(spark: SparkSession, path: str, key: str, item: str, needed: DataFrame) -> DataFrame:
    """Keys all of whose ``needed`` items (key, n) have come by the stream's end: key, items (how many had come when it was complete).

    Items count once each; a key is written once, by the batch that completes it.
    """
    base = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = stream_of(spark, path).join(needed, key).select(F.col(key).alias("key"), F.col(item).cast("string").alias("item"), F.lit(None).cast("array<int>").alias("bits"), F.col("n").cast("long").alias("needed"), F.lit(0).alias("number"))
    with keyed_state(spark):
        run_once(completions(rows), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select(F.col("key").alias(key), "items")


def completed_unions(spark: SparkSession, path: str, base: str, files_per_batch: int = 1) -> DataFrame:
    """(key, items, bits): takes what is new in the Parquet folder ``path`` of rows as ``completions`` takes them, and returns all keys that are complete by now.

    ``base`` keeps the state and the results; a run that breaks off, or one that comes later, goes on where the last complete batch ended.
    """
    with keyed_state(spark):
        run_once(completions(stream_of(spark, path, files_per_batch)), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("key", "items", "bits")


def after_marker(spark: SparkSession, folder: str, marker: str, expected: dict[str, int], seconds: float = 0.0, every: float = 1.0) -> DataFrame:
    """The shards of ``folder`` (folders of JSON lines by name) as (shard, value), once the file ``marker`` is there and every shard has its ``expected`` lines.

    Waits for the marker, up to ``seconds``: a TimeoutError is raised if it doesn't come, and a ValueError that names the first
    shard whose number of lines, blank ones apart, is another.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{marker}")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    until = time.monotonic() + seconds
    while not files.exists(where):
        if time.monotonic() >= until:
            raise TimeoutError(f"no {marker} in {folder} after {seconds} seconds")
        time.sleep(every)
    wrong = shard_problems(spark, {name: f"{folder}/{name}" for name in expected}, expected).orderBy("shard").first()
    if wrong:
        raise ValueError(f"shard {wrong.shard} has {wrong.found} lines, not {wrong.expected}")
    parts = [spark.read.text(f"{folder}/{name}").filter(F.trim("value") != "").select(F.lit(name).alias("shard"), "value") for name in expected]
    return reduce(DataFrame.unionByName, parts)
