"""Evaluation of detected boxes: classification-gated F1 at several thresholds, precision and recall by area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.functions import runs as R
from rulewright.operators import tracks
from rulewright.operators.corpus import capped
from rulewright.operators.joins import large
from rulewright.operators.scores import average_precision

#: IoU thresholds by step: 0.5 to 0.95.
THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]
EPS = 1e-4


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = tp / (tp + fp + EPS), tp / (tp + fn + EPS)
    return 2 * p * r / (p + r + EPS)


def image_counts(images: DataFrame, truth: DataFrame, found: DataFrame, least_score: float = 0.5) -> DataFrame:
    """A row for each image and step: image, step, n_truth, n_found, tp, fp, fn, f1, mean_iou.

    Found boxes of at least ``least_score`` are matched with the truth for the most total IoU; pairs that
    reach a step's threshold are true. f1 is null where image has neither truth nor found boxes.
    mean_iou is over all matches, those without overlap too.
    """
    said = found.filter(F.col("score") >= least_score)
    count = lambda rows, name: rows.groupBy("image").agg(F.count(F.lit(1)).alias(name))
    pairs = tracks.matched(truth, said, "image", 0.0)
    reach = [F.count(F.when(F.col("iou") >= t - 1e-12, 1)) for t in THRESHOLDS]
    met = pairs.groupBy("image").agg(F.array(*reach).alias("tps"), F.sum("iou").alias("iou"))
    rows = images.select("image").distinct().join(count(truth, "n_truth"), "image", "left").join(count(said, "n_found"), "image", "left").join(met, "image", "left")
    zeros = F.array_repeat(F.lit(0).cast("long"), len(THRESHOLDS))
    rows = rows.select("image", F.coalesce("n_truth", F.lit(0)).alias("n_truth"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.posexplode(F.coalesce("tps", zeros)).alias("step", "tp"), F.coalesce("iou", F.lit(0.0)).alias("iou"))
    rows = rows.withColumns({"fp": F.col("n_found") - F.col("tp"), "fn": F.col("n_truth") - F.col("tp")})
    any_ = (F.col("n_truth") > 0) | (F.col("n_found") > 0)
    return rows.select(
        "image", "step", "n_truth", "n_found", "tp", "fp", "fn", F.when(any_, _f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f1"),
        F.try_divide("iou", F.least("n_truth", "n_found")).alias("mean_iou"),
    )


def best_truths(counts: DataFrame) -> DataFrame:
    """Of several ground truths (column truth) the rows of the best one of each image: by mean f1, then the least number.

    A truth that leaves nothing to count on both sides is perfect.
    """
    mean = counts.groupBy("image", "truth").agg(F.coalesce(F.avg("f1"), F.lit(2.0)).alias("mean"))
    order = Window.partitionBy("image").orderBy(F.col("mean").desc(), "truth")
    best = mean.withColumn("n", F.row_number().over(order)).filter("n = 1").select("image", "truth")
    return counts.join(best, ["image", "truth"])


def gated_f1(counts: DataFrame) -> DataFrame:
    """Scores by step from ``image_counts``: step, micro_f1, positive_micro_f1, positive_macro_f1, mcc, cg_f1 (micro), cg_f1_macro and more.

    Positive false boxes are those of images with truth. The correlation is between having any found
    box and having any truth. positive_macro_f1 and cg_f1_macro are over the images with truth and found boxes, those named ``_w0dt`` over
    all images with truth; the rates ``perfect_positive`` and ``perfect_negative``
    are of images with and without truth on which nothing is wrong, ``mean_iou`` is over images with matches.
    """
    truth, said = F.col("n_truth") > 0, F.col("n_found") > 0
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("double")
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    right = (F.col("fp") == 0) & (F.col("fn") == 0)
    sums = counts.groupBy("step").agg(
        F.sum("tp").cast("double").alias("tp"), F.sum("fp").cast("double").alias("fp"), F.sum("fn").cast("double").alias("fn"), total("fp", truth & said).alias("pfp"), F.coalesce(F.avg(F.when(truth, F.col("f1"))), F.lit(0.0)).alias("macro"),
        F.coalesce(F.avg(F.when(truth & said, F.col("f1"))), F.lit(0.0)).alias("macro_said"),
        n(truth & said).alias("a"), n(~truth & said).alias("b"), n(truth & ~said).alias("c"), n(~truth & ~said).alias("d"), n(truth & right).alias("pp"), n(~truth & ~said).alias("pn"), F.avg("mean_iou").alias("mean_iou"),
    )
    tp, fp, fn, pfp, a, b, c, d = (F.col(x) for x in ("tp", "fp", "fn", "pfp", "a", "b", "c", "d"))
    mcc = (a * d - b * c) / (F.sqrt((a + b) * (a + c) * (d + b) * (d + c)) + 1e-6)
    told = sums.select("step", _f1(tp, fp, fn).alias("micro_f1"), _f1(tp, pfp, fn).alias("positive_micro_f1"), F.col("macro_said").alias("positive_macro_f1"), F.col("macro").alias("positive_w0dt_macro_f1"), mcc.alias("mcc"), (F.col("pp") / (a + c + 1e-9)).alias("perfect_positive"), (F.col("pn") / (b + d + 1e-9)).alias("perfect_negative"), "mean_iou")
    gate = F.col("mcc")
    return told.withColumns({"cg_f1": F.col("positive_micro_f1") * gate, "cg_f1_macro": F.col("positive_macro_f1") * gate, "cg_f1_w0dt": F.col("positive_w0dt_macro_f1") * gate})


#: Area ranges of boxes and of tracks: all, small, medium, large.
BOX_RANGES = [(0.0, 1e10), (0.0, 32.0**2), (32.0**2, 96.0**2), (96.0**2, 1e10)]
TRACK_RANGES = [(0.0, 1e10), (0.0, 128.0**2), (128.0**2, 256.0**2), (256.0**2, 1e10)]


def precision_and_recall(truth: DataFrame, found: DataFrame, ranges: list[tuple[float, float]] = BOX_RANGES, most: int = 100, by_category: bool = True, masks: bool = False, recalls: tuple[int, ...] = ()) -> DataFrame:
    """(category, range, ap, ap50, ap75, ar): the means over ten thresholds, and precision at two of them, of each category and area range.

    At most ``most`` boxes of an image and category count, the best ones (the limit is the measure's); for each number k
    in ``recalls`` a column ar_k has the recall of the best k only. A category without truth in a range has no row.
    Without ``by_category`` all boxes are one category; with ``masks`` both tables have run lengths (``runs``) in the place of boxes.
    """
    if not by_category:
        truth, found = truth.withColumn("category", F.lit(0)), found.withColumn("category", F.lit(0))
    keyed = found.withColumn("__group", F.struct("image", "category"))
    order = [F.col("score").desc(), F.col("id")]
    kept = capped(keyed, "__group", order, most).drop("__group")
    place = kept.select("image", "category", "id", "score", F.row_number().over(Window.partitionBy("image", "category").orderBy(*order)).alias("place"))
    told = tracks.greedy_matches(truth, kept, ["image", "category"], THRESHOLDS, ranges, masks).join(large(place), ["image", "category", "id"])
    return summarised(told, truth, ranges, recalls)


def summarised(told: DataFrame, truth: DataFrame, ranges: list[tuple[float, float]], recalls: tuple[int, ...] = ()) -> DataFrame:
    """As ``precision_and_recall``, from graded rows (category, id, score, hit, ignored, with ``recalls`` place) and truth (category, area, crowd)."""
    k = len(ranges)
    place = ["place"] if recalls else []
    flat = told.select("category", "id", "score", *place, F.posexplode(F.arrays_zip("hit", "ignored")).alias("at", "x")).filter(~F.col("x.ignored"))
    flat = flat.select(F.struct("category", F.floor(F.col("at") / k).cast("int").alias("step"), (F.col("at") % k).alias("range")).alias("cell"), "id", "score", *place, F.col("x.hit").alias("hit"))
    inside = F.array(*[(F.col("area") >= low) & (F.col("area") <= high) for low, high in ranges])
    own = truth.filter(~F.col("crowd")).select("category", F.posexplode(inside).alias("range", "in")).filter("in").groupBy("category", "range").agg(F.count(F.lit(1)).alias("positives"))
    cells = own.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(THRESHOLDS) - 1)))).select(F.struct("category", "step", "range").alias("cell"), "positives")
    ap = average_precision(flat, "cell", "score", "id", "hit", cells)
    hits = flat.filter("hit").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("place") <= r, 1)).alias(f"n_{r}") for r in recalls])
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("positives")
    rows = ap.join(hits, "cell", "left").select("cell.category", "cell.range", "cell.step", "ap", share("n").alias("recall"), *[share(f"n_{r}").alias(f"ar_{r}") for r in recalls])
    at = lambda step: F.max(F.when(F.col("step") == step, F.col("ap")))
    return rows.groupBy("category", "range").agg(F.avg("ap").alias("ap"), at(0).alias("ap50"), at(5).alias("ap75"), F.avg("recall").alias("ar"), *[F.avg(f"ar_{r}").alias(f"ar_{r}") for r in recalls])


def mask_agreement(images: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """(image, n_matches, j, f, jf): mean IoU and mean boundary F of each image's matched masks, and the mean of both.

    Masks have image, id, runs, and the runs of their ``boundary`` and of the widened one (``wide``). They are matched for the most
    total IoU, as many as there are on the smaller side: what overlaps nothing is paired in the order of ids. Images without masks on
    either side have nulls.
    """
    pairs = tracks.mask_pairs(truth, found, ["image"]).select("image", "a", "b", (F.col("shared") / (F.col("sa") + F.col("size") - F.col("shared"))).alias("iou"))
    side = lambda rows, mark: rows.select("image", F.col("id").alias(mark), F.col("boundary").alias(f"{mark}_edge"), F.col("wide").alias(f"{mark}_wide"))
    a, b = side(truth, "a"), side(found, "b")
    matches = tracks.completed(tracks.assigned(pairs, ["image"]), a, b, ["image"]).join(a, ["image", "a"]).join(b, ["image", "b"])
    edges = R.boundary_f(*[F.col(c) for c in ("a_edge", "a_wide", "b_edge", "b_wide")])
    own = matches.groupBy("image").agg(F.count(F.lit(1)).alias("n_matches"), F.avg("iou").alias("j"), (F.sum(edges) / (F.count(F.lit(1)) + 1e-9)).alias("f"))
    rows = images.select("image").distinct().join(own, "image", "left")
    return rows.select("image", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "j", "f", ((F.col("j") + F.col("f")) / 2).alias("jf"))


def track_precision(truth: DataFrame, found: DataFrame, overlaps: DataFrame, by_category: bool = True) -> DataFrame:
    """As ``precision_and_recall`` for tracks: (video, category, id, area) with scores, and their overlaps (video, category, a, b, iou).

    Area ranges are cut at 128 x 128 and 256 x 256.
    """
    if not by_category:
        truth, found, overlaps = (x.withColumn("category", F.lit(0)) for x in (truth, found, overlaps))
    steps = F.transform(F.array(*[F.lit(t) for t in THRESHOLDS]), lambda t: F.col("iou") >= t - 1e-12)
    inside = lambda area: F.array(*[(area >= low) & (area <= high) for low, high in TRACK_RANGES])
    # from the best score down each track takes the free truth that it overlaps most; graded one step at a time
    pairs = overlaps.join(large(found).select("video", "category", F.col("id").alias("b"), "score"), ["video", "category", "b"]).withColumn("reach", steps)
    graded = tracks.by_groups(pairs.drop("reach"), ["video", "category"], [F.col("score").desc(), F.col("b"), F.col("iou").desc(), F.col("a")], _graded_tracks, "video long, category long, id long, step int, a long")
    area = truth.select("video", "category", F.col("id").alias("a"), F.col("area").alias("truth_area"))
    hits = graded.join(large(area), ["video", "category", "a"]).groupBy("video", "category", "id").agg(F.collect_list(F.struct("step", inside(F.col("truth_area")).alias("in"))).alias("met"))
    rows = found.select("video", "category", "id", "score", "area").join(large(hits), ["video", "category", "id"], "left")
    cells = F.sequence(F.lit(0), F.lit(len(THRESHOLDS) * len(TRACK_RANGES) - 1))
    k = len(TRACK_RANGES)
    met = lambda c: F.filter(F.coalesce("met", F.array()), lambda m: m["step"] == F.floor(c / k).cast("int"))
    hit = F.transform(cells, lambda c: F.exists(met(c), lambda m: F.get(m["in"], c % k)))
    own = inside(F.col("area"))
    ignored = F.transform(cells, lambda c: F.when(F.size(met(c)) > 0, F.exists(met(c), lambda m: ~F.get(m["in"], c % k))).otherwise(~F.get(own, c % k)))
    told = rows.select("category", "id", "score", hit.alias("hit"), ignored.alias("ignored"))
    return summarised(told, truth.withColumn("crowd", F.lit(False)), TRACK_RANGES)


def _graded_tracks(block):
    import pandas as pd

    out = []
    for (video, category), rows in block.groupby(["video", "category"], sort=False):
        for step, least in enumerate(THRESHOLDS):
            taken, done = set(), set()
            for a, b, iou in zip(rows["a"], rows["b"], rows["iou"], strict=True):
                if iou >= least - 1e-12 and b not in done and a not in taken:
                    taken.add(a)
                    done.add(b)
                    out.append((video, category, b, step, a))
    return pd.DataFrame(out, columns=["video", "category", "id", "step", "a"])


def score_counts(found: DataFrame, least: float) -> DataFrame:
    """(image, n): how many found boxes of each image score above ``least``; images without any count 0."""
    return found.groupBy("image").agg(F.count(F.when(F.col("score") > least, 1)).alias("n"))
