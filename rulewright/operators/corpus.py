"""Building corpora: keyed rows, offsets, guards, provenance, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.sources.staging import staged


def first_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def last_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as when later rows overwrite earlier ones."""
    return first_by_key(rows, keys, [F.col(c).desc() for c in order])


def numbered(rows: DataFrame, order: list[Column], out: str, start: Column | int = 0, partitions: int = 0) -> DataFrame:
    """Consecutive numbers in a total order, without bringing all rows to one task.

    Rows are dealt out by ranges of the first order column and numbered within each range; the
    number of rows in the ranges before is added from one small row per range.
    """
    count = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__within", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33))
    ranged = staged(ranged)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    first = start if isinstance(start, Column) else F.lit(start)
    return ranged.join(F.broadcast(before), "__part").withColumn(out, (F.col("__within") + F.col("__before") + first).cast("long")).drop("__part", "__within", "__before")


def dense_ids(rows: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """Numbers the distinct keys from 0 by their first appearance in ``order``."""
    firsts = numbered(rows.groupBy(key).agg(F.min(order).alias("__first")), [F.col("__first"), F.col(key)], out)
    return rows.join(firsts.select(key, out), key)


def shuffled_order(key: Column, seed: int) -> Column:
    """A pseudo-random but fixed order of keys: the hex MD5 of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def split_counts(n: Column, weights: tuple[int, ...], largest_remainder: bool) -> list[Column]:
    """How many of ``n`` rows go to each part.

    Shares are rounded down. What is left goes one each to the first parts, or, by the largest
    remainder, to those that lost most (ties to the larger weight).
    """
    total = sum(weights)
    base = [((n * w - (n * w) % total) / total).cast("long") for w in weights]
    left = n - sum(base[1:], base[0])
    if not largest_remainder:
        return [b + (left > i).cast("int") for i, b in enumerate(base)]
    lost = [(n * w) % total for w in weights]
    before = [sum(((lost[j] > lost[i]) | ((lost[j] == lost[i]) & F.lit((-weights[j], j) < (-weights[i], i)))).cast("int") for j in range(len(weights)) if j != i) for i in range(len(weights))]
    return [b + (left > k).cast("int") for b, k in zip(base, before, strict=True)]


def split(rows: DataFrame, key: str, names: tuple[str, ...], weights: tuple[int, ...], seed: int, largest_remainder: bool = False, strata: list[str] | None = None) -> DataFrame:
    """Adds split: the rows in a fixed pseudo-random order, cut by weight, in all or within strata."""
    order = [shuffled_order(F.col(key), seed), F.col(key)]
    if strata:
        placed = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*strata)))
    else:
        whole = rows.agg(F.count(F.lit(1)).alias("__n"))
        placed = numbered(rows.withColumn("__order", order[0]), [F.col("__order"), F.col(key)], "__at").drop("__order").crossJoin(F.broadcast(whole))
    counts = split_counts(F.col("__n"), weights, largest_remainder)
    name, bound = F.lit(names[-1]), sum(counts[1:-1], counts[0])
    for i in range(len(names) - 2, -1, -1):
        bound = sum(counts[1 : i + 1], counts[0])
        name = F.when(F.col("__at") < bound, names[i]).otherwise(name)
    return placed.withColumn("split", name).drop("__at", "__n")


def shard(order: Column, n: Column | int, shards: int) -> Column:
    """Contiguous shards whose sizes differ by one at most, the larger ones first."""
    n = F.lit(n) if isinstance(n, int) else n
    base, more = F.floor(n / shards), n % shards
    return F.when(order < more * (base + 1), F.floor(order / (base + 1))).otherwise(more + F.floor((order - more * (base + 1)) / F.greatest(base, F.lit(1)))).cast("int")


def chunk(order: Column, n: Column, chunks: int) -> Column:
    """Chunks of one size rounded up; the last may hold fewer rows, or none."""
    return F.floor(order / F.ceil(n / chunks)).cast("int")


def disjoint(keep: DataFrame, remove: DataFrame, key: str) -> DataFrame:
    """Keys in both sets; empty if the guard holds."""
    return keep.select(key).intersect(remove.select(key))


def provenance(rows: DataFrame, evidence: DataFrame, key: str, labels: dict[str, Column], none: str, otherwise: str) -> DataFrame:
    """Rows with the columns of their evidence and ``provenance``: the first label whose condition on them holds, ``otherwise`` if none does, ``none`` without evidence."""
    told = rows.join(evidence.withColumn("__known", F.lit(True)), key, "left")
    label = F.when(F.col("__known").isNull(), none)
    for name, holds in labels.items():
        label = label.when(holds, name)
    return told.withColumn("provenance", label.otherwise(otherwise)).drop("__known")


def uncovered(rows: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """(key, problem): keys of ``rows`` in no part (missing), and keys of parts that rows don't have (extra)."""
    union = parts[0].select(key)
    for p in parts[1:]:
        union = union.union(p.select(key))
    missing = rows.select(key).exceptAll(union.distinct()).withColumn("problem", F.lit("missing"))
    return missing.unionByName(union.distinct().join(rows, key, "left_anti").withColumn("problem", F.lit("extra")))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many; empty if the guard holds."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def backfilled(wanted: DataFrame, sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the wanted keys, from the first source that has the key; adds source_no."""
    union = None
    for i, s in enumerate(sources):
        part = s.join(wanted.select(key), key, "left_semi").withColumn("source_no", F.lit(i))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return first_by_key(union, [key], [F.col("source_no")])


def majority(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value that isn't empty of each key; ties to the first seen."""
    counted = rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("__first"))
    return first_by_key(counted, keys, [F.col("votes").desc(), F.col("__first")]).drop("__first")


def most_frequent(rows: DataFrame, value: str, n: int, order: str) -> DataFrame:
    """Rows whose value is among the ``n`` most frequent ones (ties: first seen); all rows for n <= 0."""
    if n <= 0:
        return rows
    top = rows.groupBy(value).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first")).orderBy(F.col("__n").desc(), "__first").limit(n)
    return rows.join(top.select(value), value, "left_semi")


def capped(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each key, the first ones in an order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def preference_pairs(rows: DataFrame, chosen: str, rejected: str, same_case: bool) -> DataFrame:
    """Rows whose two answers are filled and differ; with ``same_case`` letters of another case differ too."""
    a, b = F.trim(chosen), F.trim(rejected)
    differ = (F.lower(a) != F.lower(b)) if not same_case else (a != b)
    return rows.filter((a != "") & (b != "") & differ)


def phrase_mentions(docs: DataFrame, doc_id: str, items: DataFrame, item_id: str, text: str = "text", anchor: int = 3) -> DataFrame:
    """(item_id, docs): in how many documents each item's text stands, in lower case and between single spaces; items in none count 0.

    Documents meet items by a run of ``anchor`` words (an item's first ones; shorter items by all of theirs), looked for
    only where an item's first word stands, and then by the whole text.
    """
    own = items.select(item_id, F.lower(text).alias("__phrase")).filter("__phrase <> ''").withColumn("__w", F.split("__phrase", " "))
    own = own.select(item_id, "__phrase", F.get("__w", F.lit(0)).alias("__first"), F.least(F.size("__w"), F.lit(anchor)).alias("__n"), F.array_join(F.slice("__w", 1, anchor), " ").alias("__run"))
    sizes = own.select("__first", "__n").distinct()
    words = docs.select(F.col(doc_id).alias("__doc"), F.lower(text).alias("__text")).withColumn("__w", F.split("__text", " "))
    places = words.select("__doc", F.posexplode("__w").alias("__at", "__first")).join(sizes, "__first")
    # one row for each document and place where some item may begin; the run is cut from the document's words once more
    starts = places.groupBy("__doc").agg(F.collect_set(F.struct("__at", "__n")).alias("__s"))
    runs = words.join(starts, "__doc").select("__doc", "__text", F.explode(F.array_distinct(F.transform("__s", lambda s: F.array_join(F.slice("__w", s["__at"] + 1, s["__n"]), " ")))).alias("__run"))
    held = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    hits = runs.join(own, "__run").filter(held(F.col("__text")).contains(held(F.col("__phrase")))).select(item_id, "__doc").distinct()
    counts = hits.groupBy(item_id).agg(F.count(F.lit(1)).alias("docs"))
    return items.select(item_id).join(counts, item_id, "left").select(item_id, F.coalesce("docs", F.lit(0)).alias("docs"))


def skip_reasons(rows: DataFrame, key: str, order: str, reason: Column) -> DataFrame:
    """Adds reason: why a row is skipped, ``duplicate`` for valid ones after the first of their key, null for those that stay."""
    told = rows.withColumn("reason", reason)
    first = F.row_number().over(Window.partitionBy(key, F.col("reason").isNull()).orderBy(order))
    return told.withColumn("__n", first).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("__n") > 1), "duplicate").otherwise(F.col("reason"))).drop("__n")
