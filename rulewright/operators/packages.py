"""Packages of training and evaluation rows: supervision, drops, labels, merges, regrouping."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.functions.geometry import let
from rulewright.operators.corpus import numbered, shuffled_order
from rulewright.sources.staging import staged


def supervised(rows: DataFrame, shares: DataFrame, key: str, most: float) -> DataFrame:
    """Adds supervision: ``mask`` where the active share is above 0 and at most ``most``, else ``none``; all rows stay."""
    joined = rows.join(shares.select(key, "share"), key, "left")
    return joined.withColumn("supervision", F.when((F.col("share") > 0) & (F.col("share") <= most), "mask").otherwise("none"))


def without_large(rows: DataFrame, shares: DataFrame, key: str, most: float) -> DataFrame:
    """Rows whose share is at most ``most``; rows without a share stay."""
    return rows.join(shares.select(key, "share"), key, "left").filter(F.col("share").isNull() | (F.col("share") <= most)).drop("share")


def parted(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows without the listed ids, and those with them."""
    return rows.join(ids.select(key).distinct(), key, "left_anti"), rows.join(ids.select(key).distinct(), key, "left_semi")


def mentions(text: Column, terms: list[str], excluded: list[str] = ()) -> Column:
    """Whether any term stands in a lower-case text between other characters than letters, excluded phrases left out first."""
    plain = reduce(lambda t, phrase: F.replace(t, F.lit(phrase), F.lit(" ")), excluded, text)
    return reduce(lambda a, b: a | b, [plain.rlike(f"(^|[^a-z]){re.escape(term)}([^a-z]|$)") for term in terms])


def merged_predictions(parts: list[DataFrame], rows: DataFrame, key: str) -> DataFrame:
    """Rows with the predictions of all parts; adds problem: ``missing`` or ``repeated``, null if there is exactly one.

    Of repeated predictions the first part's least text is taken.
    """
    union = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    told = union.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("part", "text"))["text"].alias("text"))
    return rows.join(told, key, "left").withColumn("problem", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")).drop("n")


def first_block(rows: DataFrame, keys: list[str], worker: str) -> DataFrame:
    """All rows of the first worker that has a key; the other workers' rows of that key go as a block."""
    return rows.withColumn("__first", F.min(worker).over(Window.partitionBy(*keys))).filter(F.col(worker) == F.col("__first")).drop("__first")


def renumbered(rows: DataFrame, group: str, number: str, out: str) -> DataFrame:
    """Numbers without gaps from 0 within each group, equal ones staying equal."""
    return rows.withColumn(out, F.dense_rank().over(Window.partitionBy(group).orderBy(number)) - 1)


def counter_examples(rows: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Two rows of each one: for each variant its (question, answer) columns as question and answer."""
    variants = [F.struct(F.lit(v).alias("variant"), F.col(q).alias("question"), F.col(a).alias("answer")) for v, (q, a) in pairs.items()]
    return rows.select(*keys, F.explode(F.array(*variants)).alias("x")).select(*keys, "x.*")


def choice_prompt(question: Column, options: Column) -> Column:
    """The question and its options as "A. text" lines, up to the first that is null or says so."""
    letters = F.array(*[F.lit(c) for c in "ABCDEFGH"])
    bad = F.transform(options, lambda o: o.isNull() | F.lower(o).isin("nan", "none"))
    at = F.array_position(bad, True)
    kept = F.when(at > 0, F.slice(options, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(options)
    return F.concat_ws("\n", question, F.array_join(F.transform(kept, lambda o, i: F.concat(F.get(letters, i), F.lit(". "), o)), "\n"))


def prompt_rounds(rows: DataFrame, question: str, hint: str, options: str, letters: str = "ABCDEFGH") -> DataFrame:
    """A row for each option and round: round, prompt and letters, the options under the letters that they have in that round.

    A hint that isn't null or says so stands before the question. Options end at the first that is null or says so; in each further round
    the first option moves behind the last one.
    """
    nothing = lambda c: c.isNull() | F.lower(c).isin("nan", "none")
    at = F.array_position(F.transform(options, nothing), True)
    kept = F.when(at > 0, F.slice(options, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(F.col(options))
    told = rows.withColumn("__kept", kept).withColumn("round", F.explode(F.when(F.size("__kept") > 0, F.sequence(F.lit(0), F.size("__kept") - 1)).otherwise(F.array(F.lit(0)))))
    n = F.size("__kept")
    turned = F.concat(F.slice("__kept", F.col("round") + 1, n), F.slice("__kept", F.lit(1), F.col("round")))
    names = F.array(*[F.lit(c) for c in letters])
    asked = F.when(nothing(F.col(hint)), F.col(question)).otherwise(F.concat_ws("\n", F.col(hint), F.col(question)))
    lines = F.transform(turned, lambda o, i: F.concat(F.get(names, i), F.lit(". "), o))
    return told.withColumn("prompt", F.concat_ws("\n", asked, F.nullif(F.array_join(lines, "\n"), F.lit("")))).withColumn("letters", F.array_join(turned, "|")).drop("__kept")


def with_shortcuts(rows: DataFrame, shortcuts: DataFrame, key: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with shortcut_answer where a filled one is known (null elsewhere, or with ``strict`` left out), and the keys without one."""
    known = shortcuts.select(key, F.trim("answer").alias("shortcut_answer")).filter("shortcut_answer <> ''")
    lost = rows.join(known, key, "left_anti").select(key)
    return rows.join(known, key, "inner" if strict else "left"), lost


def with_images(rows: DataFrame, masked: str, originals: list[str], listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their image and image_kind: the ``masked`` path if the listing has it, else the first of the ``originals`` that it has; and those without."""
    told = rows
    for i, c in enumerate([masked, *originals]):
        files = listing.select(F.col("path").alias(c)).distinct().withColumn(f"__has{i}", F.lit(True))
        told = told.join(files, c, "left")
    image = F.coalesce(*[F.when(F.col(f"__has{i}"), F.col(c)) for i, c in enumerate([masked, *originals])])
    told = told.withColumn("image", image).withColumn("image_kind", F.when(F.col("__has0"), "masked").when(F.col("image").isNotNull(), "original")).drop(*[f"__has{i}" for i in range(len(originals) + 1)])
    return told.filter("image is not null"), told.filter("image is null").drop("image", "image_kind")


def choices_around_or(tokens: Column, most: int = 4) -> Column:
    """The options of "a or b": up to ``most`` tokens on each side of the first or; empty if there is none or a side is empty."""
    at = F.array_position(tokens, "or").cast("int")
    left = F.slice(tokens, F.greatest(F.lit(1), at - most), F.least(F.greatest(at - 1, F.lit(0)), F.lit(most)))
    right = F.slice(tokens, at + 1, F.lit(most))
    return F.when((at > 1) & (at < F.size(tokens)), F.array(F.array_join(left, " "), F.array_join(right, " "))).otherwise(F.array().cast("array<string>"))


def answer_spans(tokens: Column, most: int) -> Column:
    """All distinct runs of at most ``most`` tokens, joined by spaces."""
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(tokens) - i + 1)), lambda n: F.array_join(F.slice(tokens, i, n), " ")))
    return F.array_distinct(F.flatten(runs))


def merged_shards(parts: list[DataFrame], rows: DataFrame, key: str, place: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all shards in their source's order, by the source's place where a prediction has one and else by its key, and the problems.

    The second result is (place, problem): places that no prediction, or more than one, claims.
    """
    union = reduce(DataFrame.unionByName, parts)
    own = rows.select(F.col(place).alias("__place"), F.col(key).alias("__key"))
    by_key = union.filter(F.col(place).isNull()).join(own, F.col(key) == F.col("__key")).select(F.col("__place").alias(place), "text")
    told = union.filter(F.col(place).isNotNull()).select(place, "text").unionByName(by_key)
    counts = told.groupBy(place).agg(F.count(F.lit(1)).alias("__n"), F.min("text").alias("text"))
    joined = rows.join(counts, place, "left")
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "repeated")
    return joined.drop("__n"), joined.select(place, problem.alias("problem")).filter("problem is not null")


def _least_loaded(shards: int):
    """For lengths in order, the shard that each goes to: the first one of least total length that isn't full."""

    def placed(held: Column, x: Column, at: Column) -> Column:
        count = F.get(held["counts"], at) + 1
        load = F.when(count * shards == x["n"], F.lit(float("inf"))).otherwise(F.get(held["loads"], at) + x["length"])
        changed = lambda values, new: F.transform(values, lambda v, i: F.when(i == at, new).otherwise(v))
        return F.struct(changed(held["loads"], load).alias("loads"), changed(held["counts"], count).alias("counts"), F.concat(held["out"], F.array(at)).alias("out"))

    def step(held: Column, x: Column) -> Column:
        return let(F.array_position(held["loads"], F.array_min(held["loads"])).cast("int") - 1, lambda at: placed(held, x, at))

    begin = F.struct(F.array_repeat(F.lit(0.0), shards).alias("loads"), F.array_repeat(F.lit(0), shards).alias("counts"), F.array().cast("array<int>").alias("out"))
    return lambda lengths: F.aggregate(lengths, begin, step, lambda held: held["out"])


def length_groups(rows: DataFrame, length: str, order: str, shards: int, size: int, seed: int | None = None) -> DataFrame:
    """Adds mega, place and shard: batches of ``shards`` x ``size`` rows that follow in ``order``, each sorted by falling length.

    Within a batch each row goes to the shard of least total length so far that has fewer than its share of the rows; a batch
    that ``shards`` doesn't divide is dealt out in turn. With a ``seed`` the rows are shuffled first, by a hash of the order
    column. A batch is one row's array while it is dealt out. Its rows follow one another by shard and place.
    """
    by = [shuffled_order(F.col(order), seed), F.col(order)] if seed is not None else [F.col(order)]
    told = numbered(rows.withColumn("__by", by[0]), [F.col("__by"), F.col(order)], "__at").drop("__by")
    names = [F.col(c) for c in rows.columns]
    held = told.groupBy(F.floor(F.col("__at") / (shards * size)).alias("mega")).agg(F.array_sort(F.collect_list(F.struct((-F.col(length)).cast("double").alias("__down"), F.col(order).alias("__order"), F.struct(*names).alias("row")))).alias("__rows"))
    n = F.size("__rows")
    lengths = F.transform("__rows", lambda x: F.struct((-x["__down"]).alias("length"), n.alias("n")))
    shard = F.when(n % shards == 0, _least_loaded(shards)(lengths)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i % shards))
    placed = held.select("mega", F.posexplode(F.arrays_zip(F.transform("__rows", lambda x: x["row"]).alias("row"), shard.alias("shard"))).alias("place", "x"))
    return placed.select("x.row.*", "mega", "place", F.col("x.shard").cast("int").alias("shard"))


def modality_groups(rows: DataFrame, length: str, order: str, shards: int, size: int, seed: int = 0) -> DataFrame:
    """Adds mega and place: batches of rows of one modality each, which the sign of ``length`` tells, in a shuffled order.

    Either modality is grouped by the absolute length as ``length_groups`` does, by shard and place within a batch. Batches
    follow one another in the order of a hash; the last one of each modality, which may be short, come together at the end, in the rows'
    order. Rows of one modality alone are grouped by their signed lengths. A length of 0 raises a ValueError.
    """
    signs = {r.sign for r in rows.select(F.signum(F.col(length).cast("double")).alias("sign")).distinct().collect()}
    if 0.0 in signs:
        raise ValueError(f"a row's {length} is 0")
    last = Window.partitionBy("mega")
    if len(signs) < 2:
        alone = length_groups(rows, length, order, shards, size, seed)
        return alone.withColumn("place", F.row_number().over(last.orderBy("shard", "place")) - 1).drop("shard")
    sides = []
    for sign in (1, -1):
        own = rows.filter(F.col(length) * sign > 0).withColumn("__length", F.abs(F.col(length)))
        sides.append(length_groups(own, "__length", order, shards, size, seed).drop("__length").withColumn("__side", F.lit(sign)))
    both = staged(sides[0].unionByName(sides[1]))
    ends = both.groupBy("__side").agg(F.max("mega").alias("__last"))
    kept = both.join(ends, "__side")
    full, rest = kept.filter("mega < __last").drop("__last"), kept.filter("mega = __last")
    batches = numbered(full.select("__side", "mega").distinct().withColumn("__by", F.md5(F.concat_ws(":", "__side", "mega", F.lit(seed)))), [F.col("__by")], "__new").drop("__by")
    placed = full.join(batches, ["__side", "mega"]).drop("mega").withColumnRenamed("__new", "mega").withColumn("place", F.row_number().over(last.orderBy("shard", "place")) - 1)
    end = rest.drop("mega", "__last").withColumn("mega", F.lit(batches.count()).cast("long")).withColumn("place", F.row_number().over(last.orderBy(order)) - 1)
    return placed.unionByName(end).drop("__side", "shard")
