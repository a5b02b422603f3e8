"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Every slot of the schedule takes one block of equally many words. Slot j has the golden-ratio
point frac(j * 0.618...); the source whose share of the unit interval holds the point fills the
slot with its next block. A source's blocks are cut from its documents in shuffled order, which
are laid one behind the other as often as a document may be taken; the block of rank r, from word
r * block_words on, fills the source's slot of that rank. So all blocks but the very last are equal.

Positions and ranks are running sums over a source in two steps, within buckets and over the
buckets' totals, so that no task has to hold a whole source.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.common import BLANK, BROADCAST_IDS, fresh, stored

GOLDEN = 0.6180339887498949
#: The same for steps of _STRIDE slots, so that far slots lose no digits of their fraction.
_STRIDE = 1 << 20
_GOLDEN_STRIDE = float(Decimal("0.618033988749894848204586834365638117720309179805762862135") * _STRIDE % 1)
#: By the rank of a source in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_WORDS = 64
_BUCKET_ROWS = 4096
_CELLS = 1024


def word_count(text: Column) -> Column:
    """Number of runs without blanks in ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def running_start(rows: DataFrame, group: str, bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over all rows before a row in its group, by bucket and ``order``."""
    totals = rows.groupBy(group, bucket).agg(F.sum(value).alias("__sum"))
    before = totals.select(
        F.col(group).alias("__g"), F.col(bucket).alias("__b"),
        F.coalesce(F.sum("__sum").over(Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    within = F.sum(value).over(Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return (
        rows.withColumn(out, within)
        .join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col(bucket) == F.col("__b")))
        .withColumn(out, (F.col(out) + F.col("__before")).cast("long"))
        .drop("__g", "__b", "__before")
    )


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of the sources, from rows (source, source_size); one row for each source.

    The sum of all sizes is shared by weight; no source gets more than ``repeats`` times its size,
    and what is above goes to the others by weight. That is the one level L with
    sum(min(repeats * size, weight * L)) = sum(size), found from running sums over the sources in
    the order of repeats * size / weight.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.get(cycle, ((F.row_number().over(in_order) - 1) % len(weights)).cast("int"))).withColumn("most", F.lit(float(repeats)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(upto), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("rest"))
    )
    # the first source, in this order, that the level does not fill up fixes the level for all after it
    rows = rows.withColumn("fixed", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"])
    return rows.select("source", "source_size", "weight", F.least("most", F.coalesce(F.col("weight") * F.col("fixed"), F.col("most"))).alias("target"))


def _chunk(n: Column, size: int) -> Column:
    return F.floor(n / F.lit(size)).cast("long")


def schedule(targets: DataFrame, total_words: int, block_words: int) -> DataFrame:
    """One row for each slot: sid, slot, rank (the slot's place among its source's). ``targets`` has sid and target.
    """
    spark = targets.sparkSession
    every = Window.partitionBy()
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    shares = targets.filter("target > 0").withColumn("high", F.sum("target").over(upto) / F.sum("target").over(every)).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0.0)))
    shares = shares.withColumn("high", F.when(F.lead("sid").over(Window.orderBy("sid")).isNull(), F.lit(1.0)).otherwise(F.col("high")))
    cells = shares.select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * _CELLS), F.least(F.floor(F.col("high") * _CELLS), F.lit(_CELLS - 1)))).alias("cell"))
    x = F.floor(F.col("slot") / _STRIDE) * F.lit(_GOLDEN_STRIDE) % 1 + F.col("slot") % _STRIDE * F.lit(GOLDEN)
    slots = spark.range(max(1, round(total_words / block_words))).withColumnRenamed("id", "slot").withColumn("x", x - F.floor(x))
    placed = slots.withColumn("cell", F.floor(F.col("x") * _CELLS)).join(cells, "cell").filter("x >= low and x < high")
    placed = placed.select("sid", "slot", _chunk(F.col("slot"), 8 * _BUCKET_ROWS).alias("bucket"), F.lit(1).cast("long").alias("one"))
    return running_start(placed, "sid", "bucket", [F.col("slot")], "one", "rank").select("sid", "slot", "rank")


def _place(doc_id: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, text)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 17,
) -> DataFrame:
    """How many words a mix of all rows takes from each document; one row for each row of ``docs``.

    Returns doc_id, source, size (words), source_size, target (its source's) and taken: size times
    the whole passes over the source, and a part of size where the last pass ends within the
    document. No document is taken more than ``repeats`` times. A source's taken words differ from
    its target by a few blocks of ``block_words`` words, whatever the size of the table. Null texts
    have size 0; a null source is a source of its own, last in order. Rows that repeat a doc_id and text stand one behind the other and count each.
    The order within a source depends on ``seed``, doc_id and the text alone, so reruns agree.
    An empty table, or one without words, gives rows with target and taken 0. Other columns are ignored.
    """
    plain = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _place(F.col(doc_id), F.col(text), seed).alias("place")
    )
    plain = stored(plain)
    stats = stored(source_targets(plain.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
                   .withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")))
    total, rows = plain.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()

    small = stats.select(F.col("source").alias("__s"), "sid", "source_size", "target")
    keyed = plain.join(small, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("place", F.lit("bucket")), F.lit(max(1, rows // _BUCKET_ROWS))))
    order = [F.col("place"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    laid = stored(running_start(keyed, "sid", "bucket", order, "size", "start"))

    ranks = stored(schedule(stats.select("sid", "target"), int(total), block_words).select("sid", F.col("rank").alias("block")))
    slots = stored(ranks.groupBy("sid").agg(F.count(F.lit(1)).alias("slots")))
    # each document as often as it may be taken, up to the last word that its source's slots have room for
    few = slots.count() <= BROADCAST_IDS
    laps = laid.filter("size > 0").join(F.broadcast(slots) if few else slots, "sid").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    laps = laps.select("sid", "start", "size", "slots", (F.col("start") + F.col("lap") * F.col("source_size")).alias("first"))
    laps = laps.filter(F.col("first") < F.col("slots") * block_words).withColumn("end", F.least(F.col("first") + F.col("size"), F.col("slots") * block_words))
    pieces = laps.withColumn("block", F.explode(F.sequence(_chunk(F.col("first"), block_words), _chunk(F.col("end") - 1, block_words))))
    words = F.least(F.col("end"), (F.col("block") + 1) * block_words) - F.greatest(F.col("first"), F.col("block") * block_words)
    taken = pieces.join(ranks, ["sid", "block"]).groupBy("sid", "start").agg(F.sum(words).alias("taken")).withColumn("one", F.lit(1))
    full = laid.withColumn("one", F.when(F.col("size") > 0, 1))
    return full.join(taken, ["sid", "start", "one"], "left").select(
        "doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "place"
    )


def mixed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 17,
) -> DataFrame:
    """The mix itself: a row of ``docs`` for each time that it is taken whole, and one with its first words for a part.

    All columns stay, whatever their names. Rows that repeat both doc_id and text share equally what
    the mix takes of them. Rows of which it takes nothing, those without words (null texts among
    them), are left out; a null doc_id or source is a value like any other. An empty table stays empty.
    """
    at, id_, place, size, all_, some = (fresh(docs, f"mix_{x}") for x in ("at", "id", "place", "size", "taken", "words"))
    takes = mix(docs, doc_id, text, source, weights, repeats, block_words, seed).filter("taken > 0")
    takes = takes.groupBy(F.col("doc_id").alias(id_), F.col("place").alias(place)).agg(F.first("size").alias(size), F.floor(F.sum("taken") / F.count(F.lit(1))).alias(all_))
    rows = docs.withColumn(at, _place(F.col(doc_id), F.col(text), seed))
    rows = rows.join(takes, (F.col(at) == F.col(place)) & F.col(doc_id).eqNullSafe(F.col(id_)))
    whole, part = F.floor(F.col(all_) / F.col(size)).cast("int"), F.col(all_) % F.col(size)
    rows = rows.withColumn(some, F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))))
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"[{BLANK}]*[^{BLANK}]+"), F.lit(0))
    rows = rows.withColumn(text, F.when(F.col(some) < 0, F.col(text)).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col(some).cast("int")), "")))
    return rows.drop(at, id_, place, size, all_, some)
