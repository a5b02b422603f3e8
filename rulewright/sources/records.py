"""JSON, JSON lines and tab-separated records, and how they are written."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rulewright.operators.corpus import numbered
from rulewright.sources.jsonvalues import json_lists, json_members, json_objects
from rulewright.sources.staging import staged


def json_document(spark: SparkSession, paths: str | list[str], schema: StructType | str, key: str | None = None) -> DataFrame:
    """Records of JSON files: the objects of a list, or with ``key`` of the list under that key; adds ord, the place within its list.

    A file of one object without ``key`` is one record. Files are read by as many tasks as they have splits.
    """
    rows = json_objects(spark, paths) if key is None else json_lists(spark, paths).filter(F.col("name") == key)
    return _parsed(rows, schema, "ord")


def _parsed(rows: DataFrame, schema: StructType | str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.from_json("value", schema).alias("__row")).select(*keep, "__row.*")


def json_lines(spark: SparkSession, paths: str | list[str], schema: StructType | str, strict: bool = False) -> DataFrame:
    """Records of JSON lines, each file once and blank lines left out; a bad line is dropped, or with ``strict`` raises a ValueError that names it."""
    paths = list(dict.fromkeys([paths] if isinstance(paths, str) else paths))
    if strict:
        bad = bad_lines(spark, paths).filter("bad > 0").orderBy("path").first()
        if bad:
            raise ValueError(f"malformed JSON in line {bad.first_bad} of {bad.path}")
    return spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED").schema(schema).json(paths)


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line, value): all lines of text files with their numbers from 1, however the files are split among tasks."""
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("id"))
    text = staged(text)
    blocks = text.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = text.join(blocks.select("path", "block", "first", before.alias("before")), ["path", "block"])
    return placed.select("path", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def bad_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, bad, first_bad): how many lines of each file, blank ones apart, are no JSON, and the number of the first."""
    lines = numbered_lines(spark, paths).filter(F.trim("value") != "")
    bad = F.try_parse_json("value").isNull()
    return lines.groupBy("path").agg(F.count(F.when(bad, 1)).alias("bad"), F.min(F.when(bad, F.col("line"))).alias("first_bad"))


def json_any(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of a file of JSON lines or of one JSON value, by what its first two lines that aren't blank are; an empty file has none.

    Lines are read if the first is a JSON value and another follows, or if it is an object that stands alone.
    """
    head = spark.read.text(path).filter(F.trim("value") != "").limit(2).select(F.trim("value").startswith("{").alias("opens"), F.try_parse_json("value").isNotNull().alias("whole")).collect()
    if head and head[0].whole and (len(head) == 2 or head[0].opens):
        return json_lines(spark, path, schema, strict=True)
    return json_document(spark, path, schema).drop("ord")


def listing(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """(path, name, length) of the files below a folder with one of the suffixes, in order of their paths; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.substring_index("path", "/", -1)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower(name).endswith(s.lower())
    return files.filter(wanted).select("path", name.alias("name"), "length").orderBy("path")


def array_archives(spark: SparkSession, folder: str, ids: str, columns: dict[str, str], names: str = "image_names") -> DataFrame:
    """Rows of NumPy archives: question_id, ord (their place), and an array for each of ``columns``, a name and the kind of its numbers.

    Ids come from the array ``ids``, or where an archive lacks it from the stems of ``names``. Of rows with
    one id the first of its archive counts. An archive is read by one task.
    """
    schema = "question_id long, ord long, " + ", ".join(f"{c} array<{k}>" for c, k in columns.items())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as found:
                    if ids in found:
                        keys = pd.Series(found[ids].astype(np.int64).tolist())
                    else:
                        stems = [str(n).rsplit("/", 1)[-1].rsplit(".", 1)[0].rsplit("_", 1)[0] for n in found[names]]
                        keys = pd.Series([int(s) if s.isdigit() else None for s in stems], dtype="Int64")
                    data = {c: list(found[c].reshape(len(keys), -1)) for c in columns}
                yield pd.DataFrame({"question_id": keys, "ord": range(len(keys)), **data})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder).select("path", "content").repartition("path")
    rows = files.select("content").mapInPandas(read, schema).filter("question_id is not null")
    first = Window.partitionBy("question_id").orderBy("ord")
    return rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def first_answers(questions: DataFrame, annotations: DataFrame) -> DataFrame:
    """(question_id, image_id, question_text, answer) in lower case without blanks at the ends; the answer is the first annotator's, empty without one."""
    clean = lambda c: F.lower(F.trim(c))
    own = annotations.select("question_id", F.get("answers", F.lit(0))["answer"].alias("__answer"))
    return questions.join(own, "question_id", "left").select("question_id", "image_id", clean("question").alias("question_text"), F.coalesce(clean("__answer"), F.lit("")).alias("answer"))


def plain_rules(rules: DataFrame) -> DataFrame:
    """Rules with texts in lower case, empty words left out, and rank by falling confidence and support (ties by rule_id)."""
    words = lambda c: F.transform(F.filter(c, lambda w: w != ""), lambda w: F.lower(F.trim(w)))
    told = rules.select("rule_id", words("text_keywords").alias("text_keywords"), words("visual_cues").alias("visual_cues"), F.lower(F.trim("answer")).alias("answer"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("support", F.lit(0.0)).alias("support"))
    return told.withColumn("rank", F.row_number().over(Window.orderBy(F.col("confidence").desc(), F.col("support").desc(), "rule_id")))


def plain_detections(detections: DataFrame, least: float = 0.3) -> DataFrame:
    """(image_id, classes): classes in lower case with a score of ``least`` or more, or none."""
    both = F.arrays_zip(F.col("classes").alias("c"), F.col("scores").alias("s"))
    kept = F.filter(both, lambda x: (x["s"].isNull() | (x["s"] >= least)) & x["c"].isNotNull())
    return detections.select("image_id", F.transform(kept, lambda x: F.lower(F.trim(x["c"]))).alias("classes"))


def nested_answers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(question_id, image_id, question, answer) of files of questions that stand below their image or by themselves."""
    one = "question_id: bigint, qa_id: bigint, image_id: bigint, question: string, answer: string"
    return unnested(_parsed(json_objects(spark, paths), f"id bigint, {one.replace(':', '')}, qas array<struct<{one}>>"))


def unnested(rows: DataFrame) -> DataFrame:
    """The same of rows (id, question_id, qa_id, image_id, question, answer, qas): a question's image is its own or that of what it stands below."""
    own = rows.select(F.coalesce("image_id", "id").alias("parent"), F.explode(F.coalesce("qas", F.array(F.struct("question_id", "qa_id", "image_id", "question", "answer")))).alias("q"))
    return own.select(F.coalesce("q.question_id", "q.qa_id").alias("question_id"), F.coalesce("q.image_id", "parent").alias("image_id"), "q.question", "q.answer").filter("question is not null")


def keyed_answers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(ord, question_id, image_id, question, answer) of one object of questions by id, in the order of the ids' texts."""
    rows = _parsed(json_members(spark, paths), "imageId string, image_id string, question string, answer string", "name")
    found = rows.select(F.col("name").alias("question_id"), F.coalesce("imageId", "image_id").alias("image_id"), "question", "answer")
    return numbered(found, [F.col("question_id")], "ord")


def annotations_of(spark: SparkSession, path: str, images: DataFrame | None = None) -> DataFrame:
    """(image_id, file_name, id, category, box, area, crowd) of an annotation file, boxes by their corners; with ``images`` (image_id) of those alone."""
    notes, names, files = _annotation_parts(spark, path)
    rows = notes.join(names, "category_id").join(files, "image_id")
    if images is not None:
        rows = rows.join(images.select("image_id").distinct(), "image_id", "left_semi")
    b = F.col("bbox")
    return rows.select("image_id", "file_name", "id", F.col("name").alias("category"), F.array(b[0], b[1], b[0] + b[2], b[1] + b[3]).alias("box"), "area", (F.coalesce("iscrowd", F.lit(0)) == 1).alias("crowd"))


def _annotation_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lists = staged(json_lists(spark, path).filter(F.col("name").isin("annotations", "categories", "images")))
    part = lambda name, schema: _parsed(lists.filter(F.col("name") == name), schema)
    notes = part("annotations", "id bigint, image_id bigint, category_id bigint, bbox array<double>, area double, iscrowd int, score double")
    return notes, part("categories", "id bigint, name string").withColumnRenamed("id", "category_id"), part("images", "id bigint, file_name string").withColumnRenamed("id", "image_id")


def annotated_images(spark: SparkSession, path: str, least_score: float = 0.0) -> DataFrame:
    """(image_id, names): sorted distinct category names of each image of an annotation file; a missing score counts as 1."""
    notes, names, files = _annotation_parts(spark, path)
    kept = notes.filter(F.coalesce("score", F.lit(1.0)) >= least_score).join(names, "category_id").join(files, "image_id")
    return kept.groupBy("image_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def tab_separated(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, a file for each partition; null fields are left out."""
    rows.write.mode("overwrite").json(path)


def write_array(rows: DataFrame, path: str, order: list[Column], key: str | None = None) -> None:
    """One JSON array of the rows in an order, or with ``key`` one object by that column, as a folder with a single file.

    One file is written by one task, row by row; for large tables JSON lines are the better form.
    """
    data = [c for c in rows.columns if c != key]
    body = F.to_json(F.struct(*data)) if key is None else F.concat(F.to_json(F.array(F.col(key).cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(key).cast("string")))) - 2), F.lit(": "), F.to_json(F.struct(*data)))
    placed = numbered(rows.select(*rows.columns, body.alias("__body")), order, "__at")
    comma = F.when(F.col("__at") > 0, ",").otherwise("")
    mark = lambda at, text: placed.sparkSession.createDataFrame([(at, text)], "__at long, value string")
    ends = ("[", "]") if key is None else ("{", "}")
    lines = placed.select("__at", F.concat(comma, "__body").alias("value")).unionByName(mark(-1, ends[0])).unionByName(mark((1 << 63) - 1, ends[1]))
    lines.repartition(1).sortWithinPartitions("__at").select("value").write.mode("overwrite").text(path)


def write_with_summary(rows: DataFrame, path: str, groups: list[str]) -> DataFrame:
    """Writes the rows as Parquet and, beside them, how many each combination of ``groups`` has; returns that summary.

    The counts are taken of the rows that were written, in a second job that reads these columns alone; where the
    combinations are few and known, ``write_with_counts`` counts as it writes.
    """
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    summary = rows.sparkSession.read.parquet(f"{path}/rows").groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return summary


def write_with_counts(rows: DataFrame, path: str, counts: dict[str, Column]) -> dict[str, int]:
    """Writes the rows as Parquet and returns how many there are (``rows``) and for how many each condition holds.

    The counts are observed while the rows are written: there is one job, and nothing is read again. They are also written beside the rows,
    as JSON.
    """
    seen = Observation()
    observed = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(name) for name, c in counts.items()])
    observed.write.mode("overwrite").parquet(f"{path}/rows")
    found = {name: int(n) for name, n in seen.get.items()}
    spark = rows.sparkSession
    spark.createDataFrame([tuple(found.values())], ", ".join(f"`{n}` long" for n in found)).coalesce(1).write.mode("overwrite").json(f"{path}/counts")
    return found


def shard_problems(spark: SparkSession, shards: dict[str, str], expected: dict[str, int]) -> DataFrame:
    """(shard, expected, found): the shards of JSON lines whose number of lines, blank ones apart, isn't the expected one."""
    counts = None
    for name, path in shards.items():
        one = spark.read.text(path).filter(F.trim("value") != "").agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("shard"), "found")
        counts = one if counts is None else counts.unionByName(one)
    wanted = spark.createDataFrame(list(expected.items()), "shard string, expected long")
    joined = wanted if counts is None else wanted.join(counts, "shard", "left")
    found = F.coalesce(F.col("found") if counts is not None else F.lit(None), F.lit(0)).cast("long")
    return joined.select("shard", "expected", found.alias("found")).filter("expected <> found")


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split, as Parquet."""
    rows.write.mode("overwrite").partitionBy(split).parquet(path)


def write_table(rows: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by bars, bars and backslashes within their values stand behind a backslash."""
    escaped = lambda c: F.transform(F.col(c).cast("array<string>"), lambda x: F.regexp_replace(x, r"([|\\])", r"\\$1"))
    flat = [F.array_join(escaped(c), "|").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def submission(questions: DataFrame, predictions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, answer) of every question, empty where nothing was predicted; of repeated predictions the last in ord."""
    last = predictions.groupBy(key).agg(F.max_by(text, "ord").alias("answer"))
    return questions.select(key).join(last, key, "left").select(key, F.coalesce("answer", F.lit("")).alias("answer"))
