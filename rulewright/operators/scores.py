"""Evaluation aggregates: confusion counts, rates, paired comparisons, summaries, precision curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.operators.joins import large


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(otherwise))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def confusion(rows: DataFrame, label: Column, predicted: Column, groups: list[str]) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall, f1 and yes_ratio, by group and in all; undefined ones are 0.

    The group columns are null in the overall row.
    """
    counts = [_count(label & predicted).alias("tp"), _count(~label & predicted).alias("fp"), _count(~label & ~predicted).alias("tn"), _count(label & ~predicted).alias("fn")]
    found = rows.groupingSets([groups, []], *groups).agg(*counts) if groups else rows.agg(*counts)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return found.select(
        *groups, "tp", "fp", "tn", "fn", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + fp, tp + fp + tn + fn).alias("yes_ratio"),
    )


def edited_pairs(rows: DataFrame) -> DataFrame:
    """Metrics of answers on edited images against their originals, as one row.

    ``rows`` has image, question, gt, answer (yes, no or else), original, removed. Each row is TP,
    TN, FN or FP; an edited row meets the original of its name and question. Where the asked object
    was removed, the two classes tell understanding (tu), ignorance (ig) or bias (sb_plus,
    sb_minus); elsewhere a class that changes its first letter counts as indecision (changed).
    """
    said = F.when(F.col("answer") == "yes", "yes").otherwise("no")
    yes = F.col("gt") == "yes"
    kind = F.when(yes & (said == "yes"), "TP").when((F.col("gt") == "no") & (said == "no"), "TN").when(yes, "FN").otherwise("FP")
    told = rows.withColumn("kind", kind)
    originals = told.filter("original").select(F.col("image").alias("base"), F.col("question").alias("q"), F.col("kind").alias("before"))
    edited = told.filter("not original").withColumn("base", F.regexp_replace("image", r"_[0-9]{2}\.(png|jpg)$", ".jpg"))
    met = edited.join(originals, (edited["base"] == originals["base"]) & (edited["question"] == originals["q"]), "left")
    pair = F.concat("before", "kind")
    both, gone = F.col("before").isNotNull(), F.col("removed")
    sums = met.agg(
        _count(both & gone).alias("removed_pairs"), _count(both & ~gone).alias("other_pairs"), _count(~both).alias("missing"), *[_count(both & gone & (pair == p)).alias(n) for n, p in (("tu", "TPTN"), ("ig", "FNFP"), ("sb_plus", "TPFP"), ("sb_minus", "FNTN"))],
        _count(both & ~gone & (F.substring("before", 1, 1) != F.substring("kind", 1, 1))).alias("changed"),
    )
    counts = told.agg(*[_count(F.col("kind") == k).alias(k.lower()) for k in ("TP", "FP", "TN", "FN")], _count(~F.col("answer").isin("yes", "no")).alias("invalid"))
    tu, steady = 100 * ratio(F.col("tu"), F.col("removed_pairs")), 100 - 100 * ratio(F.col("changed"), F.col("other_pairs"))
    return counts.crossJoin(sums).withColumn("f1_tu_id", ratio(2 * tu * steady, tu + steady))


def soft_accuracy(matches: Column) -> Column:
    """Accuracy of an answer that ``matches`` of ten annotators gave: the mean over leaving one of them out."""
    capped = lambda k: F.least(F.lit(1.0), k / 3)
    return (matches * capped(matches - 1) + (10 - matches) * capped(matches)) / 10


def anls(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, 0 below one half; two empty texts count 1."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    share = 1 - F.coalesce(F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b))), F.lit(0.0))
    return F.when(share >= 0.5, share).otherwise(0.0)


def summary(rows: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """n, mean, median, p10, p90 (exact, between neighbours), least, most and population deviation."""
    p = F.expr(f"percentile({value}, array(0.1, 0.5, 0.9))")
    found = rows.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), p.alias("__p"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_pop(value).alias("deviation"))
    return found.select(*groups, "n", "mean", F.col("__p")[0].alias("p10"), F.col("__p")[1].alias("median"), F.col("__p")[2].alias("p90"), "least", "most", "deviation")


def advantages(rows: DataFrame, group: str, reward: str, least_deviation: float = 1e-4) -> DataFrame:
    """Adds advantage: the reward less its group's mean, over the deviation plus 1e-4; 0 in groups that hardly vary."""
    w = Window.partitionBy(group)
    mean, deviation = F.avg(reward).over(w), F.stddev_pop(reward).over(w)
    return rows.withColumn("advantage", F.when(deviation < least_deviation, 0.0).otherwise((F.col(reward) - mean) / (deviation + 1e-4)))


def compared(rows: DataFrame, a: str, b: str, groups: list[str]) -> DataFrame:
    """Mean difference of two paired values, and in how many rows a is above, below or (within 1e-12) equal."""
    d = F.col(a) - F.col(b)
    same = F.abs(d) < 1e-12
    return rows.groupBy(*groups).agg(F.avg(d).alias("mean_difference"), _count(~same & (d > 0)).alias("above"), _count(~same & (d < 0)).alias("below"), _count(same).alias("equal"))


def average_precision(rows: DataFrame, group: str, score: str, order: str, hit: str, positives: DataFrame, steps: int = 100) -> DataFrame:
    """Average precision of each group: the mean over recalls 0, 1/steps, ..., 1 of the best precision from there on.

    ``positives`` has the group and its number of positives. Hits are counted from the highest
    score down (ties by ``order``), so a group's rows are ranked together.
    """
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), order)
    run = rows.select(group, F.sum(F.col(hit).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tp"), F.row_number().over(w).alias("n"), F.col(hit).alias("hit"))
    # a recall begins at its first hit, so only hits matter; the best precision from a hit on is a running maximum, taken from the
    # last hit up: a frame that ends with the group is read anew for each row, one that begins with it is not
    hits = run.filter("hit").join(large(positives), group).withColumn("precision", F.col("tp") / F.col("n"))
    best = hits.withColumn("best", F.max("precision").over(Window.partitionBy(group).orderBy(F.col("tp").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    # recalls in ((tp - 1) / positives, tp / positives], and recall 0 with the first
    upto = lambda k: F.floor(k * steps / F.col("positives"))
    points = upto(F.col("tp")) - F.when(F.col("tp") == 1, F.lit(-1)).otherwise(upto(F.col("tp") - 1))
    sums = best.groupBy(group).agg(F.sum(F.col("best") * points).alias("s"))
    return positives.join(sums, group, "left").select(group, "positives", (F.coalesce("s", F.lit(0.0)) / (steps + 1)).alias("ap"))


def cg_f1(images: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Classification-gated F1 from rows (tp, fp, fn) of each image, as one row.

    Micro F1 over images with ground truth, times the Matthews correlation of having any
    prediction with having any ground truth.
    """
    truth, said = (F.col("tp") + F.col("fn")) > 0, (F.col("tp") + F.col("fp")) > 0
    sums = images.agg(
        *[F.sum(F.when(truth, F.col(c)).otherwise(0)).cast("double").alias(c) for c in ("tp", "fp", "fn")],
        *[_count(x & y).cast("double").alias(n) for n, x, y in (("il_tp", truth, said), ("il_fp", ~truth, said), ("il_fn", truth, ~said), ("il_tn", ~truth, ~said))],
    )
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn") + eps)
    a, b, c, d = (F.col(f"il_{k}") for k in ("tp", "fp", "fn", "tn"))
    mcc = (a * d - b * c) / (F.sqrt((a + b) * (a + c)) * F.sqrt((d + b) * (d + c)) + eps)
    return sums.select(f1.alias("positive_f1"), mcc.alias("mcc"), (f1 * mcc).alias("cg_f1"))


def accuracy_by(rows: DataFrame, group: str, correct: str, whole: str = "all") -> DataFrame:
    """(group, n, accuracy): the share of correct rows in percent, by group and in all."""
    found = rows.groupingSets([[group], []], group).agg(F.grouping(group).alias("__all"), F.count(F.lit(1)).alias("n"), (100 * F.avg(F.col(correct).cast("int"))).alias("accuracy"))
    return found.select(F.when(F.col("__all") == 1, whole).otherwise(F.col(group)).alias(group), "n", "accuracy")


def review_means(rows: DataFrame, group: str, first: str, second: str, whole: str = "all") -> DataFrame:
    """(group, first, second, relative): mean scores of two answers and the second's in percent of the first's, by group and in all."""
    found = rows.groupingSets([[group], []], group).agg(F.grouping(group).alias("__all"), F.avg(first).alias("first"), F.avg(second).alias("second"))
    return found.select(F.when(F.col("__all") == 1, whole).otherwise(F.col(group)).alias(group), "first", "second", (100 * F.try_divide("second", "first")).alias("relative"))


def top_values(rows: DataFrame, value: str, n: int) -> DataFrame:
    """The ``n`` most frequent values and their counts, ties by value."""
    return counted(rows, [value]).orderBy(F.col("n").desc(), value).limit(n)


def counted(rows: DataFrame, groups: list[str]) -> DataFrame:
    """How many rows each value, or combination of values, has: groups, n."""
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))


def length_statistics(rows: DataFrame, length: str, limit: int) -> DataFrame:
    """n, total, mean, most and at_limit, the share of rows whose length reaches the limit, as one row."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("total"), F.avg(length).alias("mean"), F.max(length).cast("long").alias("most"), F.avg((F.col(length) >= limit).cast("int")).alias("at_limit"))


def positional_scores(labels: DataFrame, answers: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, f1 and yes_ratio of answers against the labels at the same place, as one row.

    Rows have ord; labels other than no count as yes, and an answer is no if its first sentence has No, not or no between single
    spaces. Scores without anything to divide by are null.
    """
    from rulewright.functions import text as T

    rows = labels.join(answers.select("ord", F.col("text").alias("__text")), "ord")
    said, true = T.yes_no_exact_words(F.col("__text")) == "yes", F.col("label") != "no"
    found = rows.agg(_count(said & true).alias("tp"), _count(said & ~true).alias("fp"), _count(~said & ~true).alias("tn"), _count(~said & true).alias("fn"))
    return _plain_scores(found, F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))


def contained_scores(rows: DataFrame) -> DataFrame:
    """The same by whether the lower-case text contains its label; rows with other labels count in all and as unknown."""
    from rulewright.functions import text as T

    kind = T.yes_no_contained(F.lower(F.trim("label")), F.trim(F.col("text")))
    found = rows.withColumn("__kind", kind).agg(*[_count(F.coalesce(F.col("__kind") == k, F.lit(False))).alias(k.lower()) for k in ("TP", "FP", "TN", "FN")], _count(F.col("__kind").isNull()).alias("unknown"))
    whole = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") + F.col("unknown")
    return _plain_scores(found, whole).withColumn("unknown", F.try_divide("unknown", whole))


def _plain_scores(found: DataFrame, whole: Column) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return found.withColumns({"accuracy": F.try_divide(tp + tn, whole), "precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r), "yes_ratio": F.try_divide(tp + fp, whole)})


def question_key_matches(predictions: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions with the question that their image and prompt name, and those that name none.

    A prompt of a known layout gives its question in lower case; questions are compared in lower case.
    """
    from rulewright.functions import text as T

    asked = predictions.withColumn("__q", T.prompt_question(F.col("prompt")))
    known = questions.withColumn("__q", F.lower("question"))
    keys = ["image_id", "__q"]
    return asked.join(known, keys).drop("__q"), asked.join(known, keys, "left_anti").drop("__q")


def _grams(tokens: Column, most: int) -> Column:
    """(n, gram) of all runs of up to ``most`` tokens, joined by blanks."""
    some = lambda n: F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(tokens, i, n), " ").alias("gram")))
    none = F.array().cast("array<struct<n:int,gram:string>>")
    return F.concat(*[F.when(F.size(tokens) >= n, some(n)).otherwise(none) for n in range(1, most + 1)])


def bleu(rows: DataFrame, key: str, found: str = "found", truths: str = "truths", by: list[str] | None = None, most: int = 4) -> DataFrame:
    """Corpus scores bleu_1 to bleu_4, for each combination of ``by``: geometric means of clipped shares of runs of tokens, times a penalty for brevity.

    ``found`` is an array of tokens without blanks, ``truths`` an array of such arrays, of which a run counts as often as in the
    one that has it most. The length to reach is, row by row, that of the truth nearest in length, the shorter one of two. Sums are
    taken over all rows before shares. Null tokens count as none; a row without truths has length 0 to reach.
    """
    by = by or []
    blank = F.array().cast("array<string>")
    own = large(rows).select(key, *by, F.coalesce(found, blank).alias("f"), F.transform(F.coalesce(truths, F.array().cast("array<array<string>>")), lambda t: F.coalesce(t, blank)).alias("t"))
    count = F.count(F.lit(1))
    said = own.select(key, *by, F.explode(_grams(F.col("f"), most)).alias("g")).groupBy(key, *by, "g").agg(count.alias("c"))
    true = own.select(key, F.posexplode("t").alias("which", "one")).select(key, "which", F.explode(_grams(F.col("one"), most)).alias("g"))
    true = true.groupBy(key, "g", "which").agg(count.alias("m")).groupBy(key, "g").agg(F.max("m").alias("m"))
    clipped = said.join(true, [key, "g"], "left").groupBy(*by).agg(*[F.sum(F.when(F.col("g.n") == n, F.least("c", F.coalesce("m", F.lit(0))))).alias(f"right_{n}") for n in range(1, most + 1)])
    size = F.size("f")
    near = F.array_min(F.transform("t", lambda t: F.struct(F.abs(F.size(t) - size).alias("apart"), F.size(t).alias("size"))))["size"]
    sizes = own.groupBy(*by).agg(F.sum(size).alias("size"), F.sum(F.coalesce(near, F.lit(0))).alias("wanted"), *[F.sum(F.greatest(F.lit(0), size - (n - 1))).alias(f"all_{n}") for n in range(1, most + 1)])
    told = sizes.join(clipped, by, "left") if by else sizes.join(clipped, F.lit(True), "left")
    ratio_ = (F.col("size") + 1e-15) / (F.col("wanted") + 1e-9)
    short = F.when(ratio_ < 1, F.exp(1 - 1 / ratio_)).otherwise(1.0)
    product, out = F.lit(1.0), []
    for n in range(1, most + 1):
        product = product * (F.coalesce(F.col(f"right_{n}"), F.lit(0)) + 1e-15) / (F.col(f"all_{n}") + 1e-9)
        out.append((F.pow(product, F.lit(1.0 / n)) * short).alias(f"bleu_{n}"))
    return told.select(*by, *out)
