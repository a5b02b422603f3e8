"""Whether a question can still be answered when part of its image is masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.geometry import let
from rulewright.operators.joins import counted, large, spread
from rulewright.sources.staging import staged


def mentioned_categories(questions: DataFrame, categories: DataFrame) -> DataFrame:
    """(question_id, category): categories whose name, or its plural with s or es, stands in a question between word boundaries.

    Questions meet categories by a word that a mention has to begin with, and only those pairs are matched by a pattern.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9_]+"), lambda w: w != "")
    dealt = spread(questions.select("question_id", "question"), "question_id")
    asked = dealt.select("question_id", F.lower("question").alias("__q"), F.explode(F.array_distinct(words(F.col("question")))).alias("__word"))
    first, single = F.get(words(F.col("category")), F.lit(0)), F.size(words(F.col("category"))) == 1
    forms = F.when(single, F.array(first, F.concat(first, F.lit("s")), F.concat(first, F.lit("es")))).otherwise(F.array(first))
    names = categories.select("category").distinct().select("category", F.explode(forms).alias("__word"))
    pattern = F.concat(F.lit(r"\b\Q"), F.lower("category"), F.lit(r"\E(s|es)?\b"))
    return large(asked).join(counted(names), "__word").filter(F.regexp(F.col("__q"), pattern)).select("question_id", "category").distinct()


def mask_matches(masks: DataFrame, objects: DataFrame) -> DataFrame:
    """(question_id, category, coverage, iou, share, object): the object of each category that a mask covers best.

    ``masks`` has question_id, image_id and bits, ``objects`` image_id, object, category and bits of the same length. The
    best one has the highest coverage, then IoU, then share of the mask, then the least object. Empty objects don't count.
    """
    pairs = masks.select("question_id", "image_id", F.col("bits").alias("m")).join(large(objects).select("image_id", "object", "category", F.col("bits").alias("o")), "image_id")
    total = lambda bits: F.aggregate(bits, F.lit(0), lambda n, x: n + x)
    both = total(F.zip_with("m", "o", lambda x, y: x * y))
    told = pairs.withColumns({"n": total(F.col("o")), "k": total(F.col("m")), "both": both}).filter("n > 0")
    told = told.select("question_id", "category", "object", (F.col("both") / F.col("n")).alias("coverage"), (F.col("both") / F.greatest(F.lit(1), F.col("n") + F.col("k") - F.col("both"))).alias("iou"), (F.col("both") / F.greatest(F.lit(1), F.col("k"))).alias("share"))
    best = F.max_by(F.struct("coverage", "iou", "share", "object"), F.struct("coverage", "iou", "share", -F.col("object")))
    return told.groupBy("question_id", "category").agg(best.alias("x")).select("question_id", "category", "x.*")


def answerability(question: Column, mentions: Column, coverage: Column, iou: Column, ratio: Column, answer_type: Column) -> Column:
    """(label, reasons) of a question: likely_answerable, borderline or likely_unanswerable.

    ``mentions`` counts the categories that the question names, ``coverage`` and ``iou`` are the highest of their
    objects (null if the image has none of them), ``ratio`` is the mask's share of the image. Every question counts as one about an
    attribute or relation, and any text with "many" in it as one that counts, as the labels are defined.
    """
    low = F.lower(question)
    strong, partly = (coverage >= 0.7) & (iou >= 0.15), (coverage >= 0.35) & (iou >= 0.05)
    seen = F.when(coverage.isNull(), F.lit(None)).when(strong, "question_object_strongly_masked").when(partly, "question_object_partially_masked").otherwise("question_object_mostly_visible")
    counts = low.contains("how many") | low.contains("number of") | low.contains("many")
    reasons = F.filter(F.array(
        F.when(mentions == 0, "no_explicit_coco_object_in_question"), F.when(ratio > 0.45, "large_mask"), seen, F.when(counts, "count_question"), F.lit("attribute_or_relation_question")
    ), lambda r: r.isNotNull())
    label = (
        F.when(seen == "question_object_strongly_masked", "likely_unanswerable").when(seen == "question_object_partially_masked", "borderline").when(seen == "question_object_mostly_visible", "likely_answerable")
        .when((mentions == 0) & (ratio < 0.25), "likely_answerable").when((ratio > 0.45) & ~F.coalesce(answer_type == "yes/no", F.lit(False)), "borderline").otherwise("likely_answerable")
    )
    return F.struct(label.alias("label"), reasons.alias("reasons"))


def masks_of_cues(cues: DataFrame, objects: DataFrame, images: DataFrame) -> DataFrame:
    """(question_id, image_id, bits, instances): the union of all objects of a question's image whose category is one of its cues, and how many they are.

    ``cues`` has question_id, image_id and an array of cues, of which repeated ones count once; ``objects`` image_id, category and bits; ``images`` image_id and
    cells, the size of its canvas. A question whose image has none of them has an empty mask; one without an image in ``images`` has no row.
    """
    named = cues.select("question_id", "image_id", F.explode(F.array_distinct("cues")).alias("category"))
    met = large(named).join(objects.select("image_id", "category", "bits"), ["image_id", "category"]).groupBy("question_id").agg(F.collect_list("bits").alias("all"))
    rows = large(cues).select("question_id", "image_id").join(images.select("image_id", "cells"), "image_id").join(large(met), "question_id", "left")
    union = F.aggregate(F.coalesce("all", F.array().cast("array<array<int>>")), F.array_repeat(F.lit(0), F.col("cells").cast("int")), lambda m, o: F.zip_with(m, o, lambda x, y: F.greatest(x, y)))
    return rows.select("question_id", "image_id", union.alias("bits"), F.coalesce(F.size("all"), F.lit(0)).alias("instances"))


def labelled(questions: DataFrame, masks: DataFrame, objects: DataFrame, categories: DataFrame) -> DataFrame:
    """(question_id, mentions, mask_ratio, coverage, iou, label, reasons) of the questions that have a mask."""
    named = staged(mentioned_categories(questions, categories))
    met = large(mask_matches(masks, objects)).join(named, ["question_id", "category"]).groupBy("question_id").agg(F.max("coverage").alias("coverage"), F.max("iou").alias("iou"))
    counts = named.groupBy("question_id").agg(F.count(F.lit(1)).alias("mentions"))
    ratio = F.aggregate("bits", F.lit(0), lambda n, x: n + x) / F.size("bits")
    rows = large(questions).select("question_id", "question", "answer_type").join(masks.select("question_id", ratio.alias("mask_ratio")), "question_id").join(large(counts), "question_id", "left").join(large(met), "question_id", "left")
    rows = rows.withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    told = answerability(F.col("question"), F.col("mentions"), F.col("coverage"), F.col("iou"), F.col("mask_ratio"), F.col("answer_type"))
    return rows.withColumn("x", told).select("question_id", "mentions", "mask_ratio", "coverage", "iou", "x.label", "x.reasons")


def darkened(before: Column, after: Column, drop: float = 40.0, black: int = 30) -> Column:
    """Pixels, as arrays of channels, that became darker by more than ``drop`` on average, or are below ``black`` in all channels: an array of 0 and 1."""
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda n, x: n + x) / F.size(p)
    return F.zip_with(before, after, lambda a, b: ((mean(a) - mean(b) > drop) | (F.array_max(b) < black)).cast("int"))


def blackened(before: Column, after: Column, drop: int = 25, black: int = 30) -> Column:
    """Pixels of which some channel fell by ``drop`` or more and all channels are at most ``black``: an array of 0 and 1."""
    fell = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0))))
    return F.zip_with(before, after, lambda a, b: ((fell(a, b) >= drop) & (F.array_max(b) <= black)).cast("int"))


def boundary_f(truth: Column, truth_wide: Column, found: Column, found_wide: Column) -> Column:
    """F measure of two boundaries (arrays of 0 and 1), each matched within the other's widened one.

    A side without a boundary has nothing to miss; two empty ones agree.
    """
    total = lambda bits: F.aggregate(bits, F.lit(0), lambda n, x: n + x)
    both = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    n, m = total(truth), total(found)
    precision = F.when(m > 0, F.when(n > 0, both(found, truth_wide) / m).otherwise(0.0)).otherwise(1.0)
    recall = F.when(n > 0, F.when(m > 0, both(truth, found_wide) / n).otherwise(0.0)).otherwise(1.0)
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def widened(bits: Column, side: int) -> Column:
    """A square grid's active cells and all their eight neighbours."""

    def one(bits: Column, i: Column) -> Column:
        r, c = F.floor(i / side).cast("int"), i % side
        near = [F.when((r + a).between(0, side - 1) & (c + b).between(0, side - 1), F.get(bits, (r + a) * side + c + b)).otherwise(0) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        return F.array_max(F.array(*near))

    return let(bits, lambda own: F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: one(own, i)))


def boundary(bits: Column, side: int) -> Column:
    """The active cells of a square grid that touch its edge or an inactive cell above, below or beside them."""

    def one(bits: Column, i: Column) -> Column:
        r, c = F.floor(i / side).cast("int"), i % side
        near = [F.when((r + a).between(0, side - 1) & (c + b).between(0, side - 1), F.get(bits, (r + a) * side + c + b)).otherwise(0) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]
        return F.when((F.get(bits, i) == 1) & (F.array_min(F.array(*near)) == 0), 1).otherwise(0)

    return let(bits, lambda own: F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: one(own, i)))
