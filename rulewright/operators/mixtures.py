"""Mixed training packages: rows supervised by a mask beside rows that aren't, with guards over the sets of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.operators.corpus import numbered, repeated_keys, shuffled_order

# What the rows of a mixed package are called by where they come from.
MASKED = "train_raw_filtered_masked"
DEMOTED = "train_raw_filtered_demoted_nomask"
NUMBER = "train_raw_filtered_number_nomask"
NO_MASK = "train_raw_filtered_missingmask_nomask"
REMOVED = "train_raw_removed_nomask"
ORIGINAL = "vqa_original_{}_nomask"


def with_backfill(train: DataFrame, wanted: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The training rows, and from a second source those of wanted ids that training lacks."""
    lacking = wanted.select(key).distinct().join(train.select(key), key, "left_anti")
    return train.unionByName(second.join(lacking, key, "left_semi"), allowMissingColumns=True)


def filter_problems(train: DataFrame, keep: DataFrame, remove: DataFrame, key: str) -> DataFrame:
    """(key, problem): ids that are both kept and removed (``both``), or that only the filter (``extra``) or training (``missing``) has."""
    sides = keep.select(key, F.lit(1).alias("k"), F.lit(0).alias("r")).unionByName(remove.select(key, F.lit(0).alias("k"), F.lit(1).alias("r")))
    told = sides.groupBy(key).agg(F.max("k").alias("k"), F.max("r").alias("r")).join(train.select(key).distinct().withColumn("t", F.lit(1)), key, "full")
    problem = F.when((F.col("k") == 1) & (F.col("r") == 1), "both").when(F.col("t").isNull(), "extra").when(F.col("k").isNull(), "missing")
    return told.select(key, problem.alias("problem")).filter("problem is not null")


def mixed_package(
    train: DataFrame, keep: DataFrame, remove: DataFrame, masks: DataFrame, originals: DataFrame, order: str, coarse: list[str] | None = None, numbers_masked: bool = False, masked: str = "mask", unmasked: str = "none"
) -> tuple[DataFrame, DataFrame]:
    """The rows of a mixed package and the problems of its ids: (rows with data_source and mask_supervision, (question_id, problem)).

    Kept rows that have a mask are supervised by it, but for those about a number, and for those with
    a ``coarse`` cue (column visual_cues). Removed rows and ``originals`` stay without a mask; the latter are
    numbered, by ``order``, from beyond the largest training id, and named by their origin_split.
    An id that repeats in the package is the problem ``repeated``.
    """
    key = "question_id"
    sides = keep.select(key, F.lit(True).alias("__keep")).unionByName(remove.select(key, F.lit(False).alias("__keep"))).distinct()
    rows = train.join(sides, key).join(masks.select(key).distinct().withColumn("__mask", F.lit(True)), key, "left")
    source = F.when(~F.col("__keep"), REMOVED)
    if coarse:
        source = source.when(F.arrays_overlap("visual_cues", F.array(*[F.lit(c) for c in coarse])), DEMOTED)
    source = source.when(F.col("__mask").isNull(), NO_MASK)
    if not numbers_masked:
        source = source.when(F.col("answer_type") == "number", NUMBER)
    rows = rows.withColumn("data_source", source.otherwise(MASKED)).withColumn("mask_supervision", F.when(F.col("data_source") == MASKED, masked).otherwise(unmasked)).drop("__keep", "__mask")
    top = train.agg(F.coalesce(F.max(key) + 1, F.lit(1)).alias("__top"))
    name = F.format_string(ORIGINAL.replace("{}", "%s"), F.coalesce("origin_split", F.lit("unknown")))
    more = numbered(originals, [F.col(order)], "__at").crossJoin(F.broadcast(top)).withColumn(key, F.col("__top") + F.col("__at"))
    more = more.drop("__top", "__at").withColumns({"data_source": name, "mask_supervision": F.lit(unmasked)})
    package = rows.unionByName(more, allowMissingColumns=True)
    problems = filter_problems(train, keep, remove, key).unionByName(repeated_keys(package, [key]).select(key, F.lit("repeated").alias("problem")))
    return package, problems


def package_summary(package: DataFrame) -> DataFrame:
    """(field, value, n): how many rows of a package have each data_source and each mask_supervision."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("data_source", "mask_supervision")])
    return package.select(F.explode(fields).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def without_numbers(rows: DataFrame, masks: DataFrame, drop_rows: bool, masked: str = "mask", unmasked: str = "none") -> tuple[DataFrame, DataFrame]:
    """Rows and mask rows without masks on answers that are numbers.

    With ``drop_rows`` such rows go; otherwise they stay unsupervised. Mask rows stay for rows that are supervised.
    """
    number = F.coalesce(F.col("answer_type") == "number", F.lit(False))
    if drop_rows:
        kept = rows.filter(~number)
        return kept, masks.join(kept.select("question_id"), "question_id", "left_semi")
    told = rows.withColumn("mask_supervision", F.when(number & (F.col("mask_supervision") == masked), unmasked).otherwise(F.col("mask_supervision")))
    return told, masks.join(told.filter(F.col("mask_supervision") == masked).select("question_id"), "question_id", "left_semi")


def with_coverage(rows: DataFrame, masks: DataFrame, cells: int, numbers: bool = False) -> DataFrame:
    """Adds coverage, an array of ``cells`` numbers: the row's mask, or zeros.

    ``masks`` has question_id, coverage and has_mask; of repeated ids the first (column ord) counts. Zeros stand
    for rows without a mask, for masks of all cells and, unless ``numbers``, for answers that are numbers.
    """
    first = masks.groupBy("question_id").agg(F.min_by(F.struct("coverage", "has_mask"), "ord").alias("__m"))
    use = F.col("__m").isNotNull() & ~F.forall("__m.has_mask", lambda b: b)
    if not numbers:
        use = use & ~F.coalesce(F.col("answer_type") == "number", F.lit(False))
    return rows.join(first, "question_id", "left").withColumn("coverage", F.when(use, F.col("__m.coverage")).otherwise(F.array_repeat(F.lit(0.0), cells))).drop("__m")


def stem_id(name: Column) -> Column:
    """The question's id before the last underscore of a file name without its folder and ending; null if it isn't digits."""
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.regexp_extract(stem, "^([0-9]+)_[^_]*$", 1).try_cast("long")


def by_stem(rows: DataFrame, named: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Named rows with the row of the id that their file's name has, and the names without one."""
    keyed = named.withColumn("question_id", stem_id(F.col(name)))
    return keyed.join(rows, "question_id"), keyed.join(rows.select("question_id"), "question_id", "left_anti").select(name)


def has_both_parts(mask: Column, least: float = 1e-6) -> Column:
    """Whether a mask's cells, and what they leave free, both sum to more than ``least``."""
    total = F.aggregate(mask, F.lit(0.0), lambda n, x: n + x)
    return (total > least) & (F.size(mask) - total > least)


def suppressed_cells(values: Column, coverage: Column, ratio: float) -> Column:
    """Each cell scaled by 1 less ``ratio`` times its coverage, at least by 0; cells without coverage stay."""
    return F.zip_with(values, coverage, lambda v, c: F.when(c > 0, v * F.greatest(F.lit(0.0), 1 - F.lit(ratio) * c)).otherwise(v))


def without_prefixes(rows: DataFrame, path: str, prefixes: list[str]) -> DataFrame:
    """Rows whose path starts with none of the prefixes; rows without a path stay."""
    bad = F.lit(False)
    for p in prefixes:
        bad = bad | F.col(path).startswith(p)
    return rows.filter(~F.coalesce(bad, F.lit(False)))


def without_labels(rows: DataFrame, labels: DataFrame, key: str, label: str, dropped: list[str]) -> DataFrame:
    """Rows whose label isn't among those dropped; rows without a label stay."""
    told = rows.join(labels.select(key, F.col(label).alias("__label")), key, "left")
    return told.filter(F.col("__label").isNull() | ~F.col("__label").isin(*dropped)).drop("__label")


def sampled(rows: DataFrame, key: str, n: int, seed: int, exact: bool = False) -> DataFrame:
    """``n`` rows, the first in a fixed pseudo-random order, or all if there are fewer; with ``exact`` too few raise a ValueError."""
    found = rows.withColumn("__order", shuffled_order(F.col(key), seed)).orderBy("__order", key).limit(n).drop("__order")
    if exact and found.count() < n:
        raise ValueError(f"fewer than {n} rows to sample from")
    return found


def limited_ids(ids: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` ids in a pseudo-random order that depends on how many there are; all for n <= 0."""
    return ids if n <= 0 else sampled(ids, key, n, seed=ids.count())


def first_share(rows: DataFrame, order: str, share: float) -> DataFrame:
    """The first ``share`` of the rows in an order, rounded down, but one at least; ``order`` counts from 0 without gaps."""
    most = rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(share))).alias("__most"))
    return rows.crossJoin(F.broadcast(most)).filter(F.col(order) < F.col("__most")).drop("__most")


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in an order; all for n <= 0."""
    return rows if n <= 0 else rows.orderBy(order).limit(n)
