"""Images, their files, masks and categories: lookups with fallbacks, grids of queries, ids, labels of regions."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from rulewright.operators.corpus import numbered


#: Categories of a grid of images and categories that are broadcast, at most.
MOST_CATEGORIES = 10_000


def first_existing(rows: DataFrame, key: str, candidates: str, listing: DataFrame, path: str) -> DataFrame:
    """(key, found, rank): the first of each row's candidate paths that the listing has; null if it has none."""
    tried = rows.select(key, F.posexplode(candidates).alias("rank", "found"))
    there = tried.join(listing.select(F.col(path).alias("found")).distinct(), "found").groupBy(key).agg(F.min(F.struct("rank", "found")).alias("x"))
    return rows.select(key).join(there, key, "left").select(key, F.col("x.found").alias("found"), F.col("x.rank").alias("rank"))


def query_grid(images: DataFrame, categories: DataFrame, notes: DataFrame, negatives: bool) -> DataFrame:
    """(image, category, objects): every image with every category and its sorted objects, empty ones only with ``negatives``.

    With negatives there is a row for each image and category: that is the feature. Up to MOST_CATEGORIES
    categories are broadcast, counted first.
    """
    found = notes.groupBy("image", "category").agg(F.array_sort(F.collect_list("object")).alias("objects"))
    if not negatives:
        return found.select("image", "category", "objects")
    # each image asks for each category: few categories go to every task, many are joined in blocks by the planner
    names = categories.select("category").distinct()
    few = names.limit(MOST_CATEGORIES + 1).count() <= MOST_CATEGORIES
    grid = images.select("image").crossJoin(F.broadcast(names) if few else names)
    return grid.join(found, ["image", "category"], "left").select("image", "category", F.coalesce("objects", F.array().cast("array<bigint>")).alias("objects"))


def numbered_pairs(positive: DataFrame, negative: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct key tuples numbered from 1 in their order, those of the second table that the first lacks after them."""
    first = positive.select(*keys).distinct().withColumn("extra", F.lit(0))
    later = negative.select(*keys).distinct().join(positive.select(*keys).distinct(), keys, "left_anti").withColumn("extra", F.lit(1))
    return numbered(first.unionByName(later), [F.col("extra"), *[F.col(k) for k in keys]], "number", 1)


def from_one(rows: DataFrame, key: str) -> DataFrame:
    """The key raised by one if the least one is 0, so that ids start at 1."""
    least = rows.agg(F.min(key).alias("__least"))
    return rows.crossJoin(F.broadcast(least)).withColumn(key, F.col(key) + F.when(F.col("__least") == 0, 1).otherwise(0)).drop("__least")


def labelled_runs(on: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the runs in rows of cells: places in rows that are one cell wider, and each run's region, by its first run's number.

    Runs of adjacent rows join if they share a column, with ``reach`` 1 also if their ends touch at a corner.
    """
    wide = np.pad(on.astype(np.int8), ((0, 0), (0, 1)))
    row, flat = wide.shape[1], wide.ravel()
    edge = np.diff(flat, prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    low, high = np.searchsorted(end, start + row - reach, "right"), np.searchsorted(start, end + row + reach, "left")
    count = np.maximum(high - low, 0)
    upper = np.repeat(np.arange(len(start)), count)
    lower = np.arange(len(upper)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    label = np.arange(len(start))
    while True:
        least = np.minimum(label[upper], label[lower])
        new = label.copy()
        # the roots of both ends hang on the lesser one, then every run on its root's root
        for side in (label[upper], label[lower]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return start, end, label
        label = new


_REGIONS = StructType([StructField("labels", ArrayType(IntegerType())), StructField("sizes", ArrayType(IntegerType()))])


def _regions(eight: bool):
    @F.pandas_udf(_REGIONS)
    def run(bits: pd.Series, width: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"labels": [[] for _ in bits], "sizes": [[] for _ in bits]}, index=bits.index, dtype=object)
        for n, own in bits.dropna().groupby(width):
            grids = [np.asarray(b, bool).reshape(-1, n) for b in own]
            # one grid under the other, with an empty row between
            stack = np.concatenate([np.pad(g, ((0, 1), (0, 0))) for g in grids]) if grids else np.zeros((0, n), bool)
            start, end, first = labelled_runs(stack, int(eight))
            size = np.bincount(first, weights=end - start, minlength=len(start)).astype(int)
            label = np.zeros(stack.shape[0] * (n + 1), int)
            sizes = label.copy()
            cells = np.repeat(start - np.cumsum(end - start) + (end - start), end - start) + np.arange((end - start).sum())
            label[cells], sizes[cells] = np.repeat(start[first] + 1, end - start), np.repeat(size[first], end - start)
            label, sizes = (x.reshape(-1, n + 1)[:, :n] for x in (label, sizes))
            top = 0
            for at, g in zip(own.index, grids, strict=True):
                rows = slice(top, top + len(g))
                place = np.where(g, label[rows] - 1 - top * (n + 1), 0)
                out.at[at, "labels"] = np.where(g, place // (n + 1) * n + place % (n + 1) + 1, 0).ravel().tolist()
                out.at[at, "sizes"] = sizes[rows].ravel().tolist()
                top += len(g) + 1
        return out

    return run


def regions(bits: Column, width: Column, eight: bool = True) -> Column:
    """(labels, sizes) of the cells, by rows, of a canvas ``width`` cells wide: regions of ones that touch, at corners too if ``eight``.

    A cell's label is its region's first cell's number plus one, its size the region's number of cells; both are 0 off
    the mask. A null canvas has neither.
    """
    return _regions(eight)(bits, width)


def union_masks(masks: DataFrame, group: str, bits: str, place: str | None = None) -> DataFrame:
    """(group, bits, n): the union of each group's masks, arrays of 0 and 1 of one length, made cell by cell, and how many masks it has."""
    counts = masks.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    cells = masks.select(group, F.posexplode(bits).alias("__i", "__b")).groupBy(group, "__i").agg(F.max("__b").alias("__b"))
    whole = cells.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__i", "__b"))).alias("__cells")).select(group, F.transform("__cells", lambda c: c["__b"]).alias("bits"))
    return whole.join(counts, group)


def finished_unions(masks: DataFrame, wanted: DataFrame, group: str, bits: str) -> DataFrame:
    """(group, bits, ratio, finished): the union of the masks of each group's cues, its active share, and whether all ``wanted`` cues have come.

    Masks have group, cue and bits, of which one of each cue counts; wanted has group and an array of cues.
    """
    union = union_masks(masks.dropDuplicates([group, "cue"]), group, bits)
    rows = wanted.select(group, F.size(F.array_distinct("cues")).alias("__need")).join(union, group, "left")
    ratio = F.aggregate("bits", F.lit(0), lambda n, x: n + x) / F.size("bits")
    return rows.select(group, "bits", ratio.alias("ratio"), F.coalesce(F.col("n") >= F.col("__need"), F.lit(False)).alias("finished"))


def object_lists(notes: DataFrame, image: str, name: str, images: DataFrame | None = None) -> DataFrame:
    """(image, classes, scores): the sorted distinct names of each image, all with score 1; with ``images`` those without any have none."""
    lists = notes.groupBy(image).agg(F.array_sort(F.collect_set(name)).alias("classes"))
    if images is not None:
        lists = images.select(image).distinct().join(lists, image, "left").withColumn("classes", F.coalesce("classes", F.array().cast("array<string>")))
    return lists.withColumn("scores", F.transform("classes", lambda _: F.lit(1.0)))


def with_detections(questions: DataFrame, detections: DataFrame, least: float) -> DataFrame:
    """Questions with the classes of their image's detections of at least ``least``; a missing score counts as 1, a missing image as none."""
    both = F.arrays_zip(F.col("classes").alias("c"), F.col("scores").alias("s"))
    kept = F.transform(F.filter(both, lambda x: (F.coalesce(x["s"], F.lit(1.0)) >= least) & x["c"].isNotNull()), lambda x: x["c"])
    rows = questions.join(detections.select("image_id", kept.alias("classes")), "image_id", "left")
    return rows.withColumn("classes", F.coalesce("classes", F.array().cast("array<string>")))


def bit_overlap(a: Column, b: Column) -> Column:
    """IoU of two arrays of 0 and 1; 1 if both are empty."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0), lambda n, x: n + x)
    any_ = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x, y)), F.lit(0), lambda n, x: n + x)
    return F.coalesce(F.try_divide(both, any_), F.lit(1.0))


@F.pandas_udf(StringType())
def content_hash(text: pd.Series) -> pd.Series:
    """BLAKE2b of 128 bits, in hex, of a JSON text with sorted keys and no blanks; null for what is no JSON."""

    def one(value: str | None) -> str | None:
        try:
            plain = json.dumps(json.loads(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None
        return hashlib.blake2b(plain.encode(), digest_size=16).hexdigest()

    return text.map(one)


def without_hashes(rows: DataFrame, text: str, hashes: DataFrame) -> DataFrame:
    """Rows whose content hash isn't in ``hashes`` (column hash); rows without a hash stay."""
    return rows.withColumn("__hash", content_hash(text)).join(hashes.select(F.col("hash").alias("__hash")), "__hash", "left_anti").drop("__hash")


def regressions(rows: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows that a first run answered right and a second one wrong: key, answer, before, after."""
    joined = rows.join(before.select(key, F.col("text").alias("before")), key).join(after.select(key, F.col("text").alias("after")), key)
    right = lambda c: F.lower(F.trim(c)) == F.lower(F.trim("answer"))
    return joined.filter(right("before") & ~right("after")).select(key, "answer", "before", "after")


def class_means(rows: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """Weighted mean over all, and the mean of the groups' weighted means, groups of no weight left out."""
    each = rows.groupBy(group).agg(F.sum(F.col(value) * F.col(weight)).alias("s"), F.sum(weight).alias("w"))
    return each.agg(F.try_divide(F.sum("s"), F.sum("w")).alias("weighted"), F.avg(F.when(F.col("w") > 0, F.col("s") / F.col("w"))).alias("by_class"), F.count(F.when(F.col("w") > 0, 1)).alias("classes"))


def best_rows(rows: DataFrame, group: str, score: str, order: Column) -> DataFrame:
    """n, hits (scores above 0) and the best row's order of each group."""
    w = Window.partitionBy(group)
    told = rows.withColumn("__best", F.row_number().over(w.orderBy(F.col(score).desc(), order)))
    return told.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(score) > 0, 1)).alias("hits"), F.max(F.when(F.col("__best") == 1, order)).alias("best"))
