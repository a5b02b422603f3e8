"""Objects of large JSON files, read by as many tasks as a file has splits.

A JSON file is read as text that is cut at every closing brace, which Spark's text reader does in any split of the
file. For each piece three numbers are counted: its quotes and how far it goes down in brackets if it begins
within a string or outside of one. Running sums over the pieces of a split, and over splits, tell where strings
and brackets stand; a piece that closes a brace at the wanted depth ends an object, and the pieces of
one object are put together again. No task holds more than a split's pieces or one object.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulewright.sources.staging import staged

_STRING = r'"(?:[^"\\]|\\.)*"'


def _before(rows: DataFrame, value: Column, order: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all earlier rows of their file: of their block by a window, of earlier blocks by their sums."""
    own = rows.withColumn("__v", value.cast("long"))
    blocks = own.groupBy("path", "block").agg(F.sum("__v").alias("__s"))
    earlier = F.coalesce(F.sum("__s").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("__v").over(Window.partitionBy("path", "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("__inner", inner).join(blocks.select("path", "block", earlier.alias("__earlier")), ["path", "block"]).withColumn(name, F.col("__inner") + F.col("__earlier")).drop("__v", "__inner", "__earlier")


def _pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, id, value, depth, ends): the pieces between closing braces, the depth at which each begins and at which its brace leaves off; null in a string."""
    text = spark.read.option("lineSep", "}").text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    # a brace before a piece can't be escaped, so pairs of a backslash and what follows lie within pieces
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    count = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    down = lambda c: count(outside(c), "{[") - count(outside(c), "]")
    outside = lambda c: F.regexp_replace(c, '"[^"]*("|$)', "")
    measured = text.withColumn("plain", plain).select("path", "block", "id", "value", count(F.col("plain"), '"').alias("quotes"), down(F.col("plain")).alias("down"), down(F.concat(F.lit('"'), "plain")).alias("down_in"))
    placed = _before(staged(measured), F.col("quotes"), "id", "quoted")
    within, after = F.col("quoted") % 2 == 1, (F.col("quoted") + F.col("quotes")) % 2 == 1
    moved = F.when(within, F.col("down_in")).otherwise(F.col("down"))
    told = _before(staged(placed.select("path", "block", "id", "value", moved.alias("moved"), after.alias("after"))), F.col("moved") - F.when(F.col("after"), 0).otherwise(1), "id", "depth")
    return told.select("path", "block", "id", "value", "depth", F.when(~F.col("after"), F.col("depth") + F.col("moved") - 1).alias("ends"))


def _objects(spark: SparkSession, paths: str | list[str], base: Column) -> DataFrame:
    """(path, block, record, depth, value): the texts that end where a brace closes at depth ``base``, with all that stands before them since the last."""
    pieces = staged(_pieces(spark, paths))
    first = pieces.groupBy("path").agg(F.min(F.struct("block", "id", F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1).alias("sign"))).alias("f")).select("path", F.col("f.sign").alias("sign"))
    ended = pieces.join(first, "path").withColumn("last", F.coalesce(F.col("ends") == base, F.lit(False))).drop("sign")
    numbered = _before(ended, F.col("last").cast("int"), "id", "record")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "value"))), lambda x: x["value"])
    whole = numbered.groupBy("path", "record").agg(F.min("block").alias("block"), F.min(F.struct("block", "id", "depth")).alias("f"), F.concat(F.array_join(parts, "}"), F.lit("}")).alias("value"), F.max("last").alias("closed"))
    return whole.filter("closed").select("path", "block", "record", F.col("f.depth").alias("depth"), "value")


def _found(text: str, depth: int, base: int, lists: bool) -> tuple[str | None, int]:
    """The name of what holds the object at a text's end, null if it isn't of the wanted kind, and where the object begins.

    With ``lists`` that is the list at depth ``base`` that holds the object, else the object's own name.
    """
    at, name, opener, held, begin = 0, None, None, None, 0
    strings: dict[int, str] = {}
    while at < len(text):
        c = text[at]
        if c == '"':
            end = at + 1
            while text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            strings[depth] = text[at : end + 1]
            at = end
        elif c in "{[":
            if depth == base:
                begin, name = at, held if lists else strings.get(base)
            depth += 1
            if depth == base:
                opener, held = c, strings.get(base - 1)
                held = held if opener == "[" else None
        elif c in "}]":
            depth -= 1
            if depth < base:
                held = None
        at += 1
    return (None if name is None else json.loads(name)), begin


def _scanned(base: int, lists: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [_found(v, int(d), base, lists) for v, d in zip(batch["value"], batch["depth"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "block": batch["block"], "record": batch["record"], "name": [n for n, _ in told], "value": [v[b:] for v, (_, b) in zip(batch["value"], told, strict=True)]})

    return run


_SCHEMA = "path string, block long, record long, name string, value string"


def json_objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, ord, value): the objects of a list, by file and place, or the one object that a file is; their texts are JSON."""
    rows = _objects(spark, paths, F.when(F.col("sign") == "[", 1).otherwise(0))
    return rows.select("path", F.col("record").alias("ord"), F.regexp_replace("value", r"^[\s,\[]*", "").alias("value"))


def json_members(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, ord, name, value): the members of the object that a file is, those whose values are objects, in the order in which they stand."""
    rows = _objects(spark, paths, F.lit(1))
    head = rf"^[\s,{{]*({_STRING})\s*:\s*(?=\{{)"
    plain = F.regexp_like("value", F.lit(head))
    name = F.get_json_object(F.concat(F.lit('{"n":'), F.regexp_extract("value", head, 1), F.lit("}")), "$.n")
    some = rows.filter(plain).select("path", "record", name.alias("name"), F.regexp_replace("value", head, "").alias("value"))
    more = rows.filter(~plain).mapInPandas(_scanned(1, False), _SCHEMA).select("path", "record", "name", "value")
    return some.unionByName(more).select("path", F.col("record").alias("ord"), "name", "value")


def json_lists(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, ord, value): the objects of all lists that stand right below the object that a file is, by the list's name and their place in it."""
    rows = staged(_objects(spark, paths, F.lit(2)))
    goes_on = F.regexp_like("value", F.lit(r"^\s*,\s*\{"))
    starts = staged(rows.filter(~goes_on).mapInPandas(_scanned(2, True), _SCHEMA))
    some = rows.filter(goes_on).select("path", "block", "record", F.lit(None).cast("string").alias("name"), F.regexp_replace("value", r"^\s*,\s*", "").alias("value"))
    every = starts.withColumn("begins", F.lit(1)).unionByName(some.withColumn("begins", F.lit(0)))
    numbered = _before(every, F.col("begins"), "record", "before").withColumn("list", F.col("before") + F.col("begins"))
    lists = numbered.filter("begins = 1").select("path", "list", "name", F.col("record").alias("first"))
    joined = numbered.drop("name").join(lists, ["path", "list"]).filter("name IS NOT NULL")
    return joined.select("path", "name", (F.col("record") - F.col("first")).alias("ord"), "value")
