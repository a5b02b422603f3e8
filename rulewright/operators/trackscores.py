"""Tracking scores, HOTA and TETA, as sums by video, class and threshold, and how such sums combine.

The parts of a score are sums: counts, and for each threshold the associations of the pairs of tracks that
met. Sums of videos, of classes, or of anything else add up before fields are derived of them, which weighs
associations by true positives; averages over classes are taken of fields. Only overlapping pairs
of boxes are looked at, and only their assignment within a frame is done in Python.

Boxes are dealt out by video: all lists, windows and sums are within a video and stay in its task, both sides stand in
one table, since a join would shuffle them again, and a match is repeated for the thresholds that it
reaches within that task only. So a video's boxes are one task's work; what it sorts may spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.operators.joins import spread
from rulewright.operators.tracks import BOX, overlapping_sides, with_chosen
from rulewright.sources.staging import staged

#: IoU thresholds by step: HOTA's 0.05 to 0.95, TETA's 0 to 0.95, of which class counts begin at the tenth.
HOTA_STEPS, TETA_STEPS, CLASS_STEP = range(1, 20), range(20), 10
SUMS = ("association", "association_re", "association_pr")
HOTA_PARTS = ("tp", "fn", "fp", *SUMS, "located")
TETA_PARTS = ("loc_tp", "loc_fn", "loc_fp", *SUMS, "cls_tp", "cls_fn", "cls_fp")
#: The errors of a class with those on boxes that match nothing, beside ``cls_fp``.
EXHAUSTIVE = "cls_fp_exhaustive"


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("double").alias(name)


def _top(iou: Column) -> Column:
    """The last step whose threshold an IoU reaches, 19 at most."""
    near, reached = F.floor(iou * 20).cast("int"), lambda step: iou >= step * 0.05 - 1e-12
    return F.least(F.when(reached(near + 1), near + 1).when(reached(near), near).otherwise(near - 1), F.lit(TETA_STEPS.stop - 1))


def _boxes(truth: DataFrame, found: DataFrame, groups: list[str], *more: str) -> DataFrame:
    """The boxes of both sides, (groups, frame, id, truth, more, box), dealt out by ``groups``; ``n`` counts those of the same groups, side and id."""
    side = lambda rows, which: rows.select(*groups, "frame", F.col("track").alias("id"), F.lit(which).alias("truth"), *more, *BOX)
    rows = spread(side(truth, True).unionByName(side(found, False)), *groups)
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*groups, "truth", "id")))


def aligned_matches(pairs: DataFrame, groups: list[str], na: str = "na", nb: str = "nb") -> DataFrame:
    """All pairs (groups, frame, a, b, iou, ...) with ``chosen``: whether their frame's assignment takes them.

    Tracks are aligned over all frames first: a pair's IoU in a frame counts by its share of all that
    its two boxes overlap there, and the sum, over the frames that either track has (the columns ``na`` and ``nb``),
    is the alignment. In each frame the assignment of most alignment times IoU is chosen.
    """
    over = lambda *keys: Window.partitionBy(*groups, *keys)
    shared = pairs.withColumn("__of", F.sum("iou").over(over("frame", "a")) + F.sum("iou").over(over("frame", "b")) - F.col("iou"))
    shared = shared.withColumn("__s", F.sum(F.col("iou") / F.col("__of")).over(over("a", "b"))).filter("a IS NOT NULL AND b IS NOT NULL")
    weighed = shared.withColumn("__weight", F.col("__s") / (F.col(na) + F.col(nb) - F.col("__s")) * F.col("iou")).drop("__of", "__s")
    return with_chosen(weighed, [*groups, "frame"], "__weight")


def _associations(m: str) -> list[Column]:
    """The sums of association: a pair of tracks that meets in m frames adds m times its share of the frames of either, of the truth and of the found track."""
    share = lambda n: F.sum(F.col(m) * F.col(m) / F.greatest(F.lit(1), n))
    return [share(n).alias(c) for c, n in zip(SUMS, (F.col("na") + F.col("nb") - F.col(m), F.col("na"), F.col("nb")), strict=True)]


def _sizes(truth: DataFrame, found: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, n, m): how many boxes the truth and the found tracks have in each group of either side."""
    rows = truth.select(*groups, F.lit(True).alias("__t")).unionByName(found.select(*groups, F.lit(False).alias("__t")))
    return spread(rows, groups[0]).groupBy(*groups).agg(F.count_if("__t").alias("n"), F.count_if(~F.col("__t")).alias("m"))


def hota_parts(truth: DataFrame, found: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Sums at each of 19 IoU thresholds: groups, step (1 to 19), tp, fn, fp, association (and _re, _pr), located.

    Rows have the columns ``groups`` (video, unless a class is named too), frame, track and a box. A
    group on one side only has all its boxes missed or false.
    """
    groups = groups or ["video"]
    boxes = _boxes(truth, found, groups).withColumns({"na": F.col("n"), "nb": F.col("n")})
    matches = aligned_matches(overlapping_sides(boxes, [*groups, "frame"], (["na"], ["nb"])), groups).filter("chosen").drop("frame", "chosen")
    rows = spread(matches.unionByName(_sizes(truth, found, groups), allowMissingColumns=True), *groups)
    last = F.when(F.col("a").isNull(), HOTA_STEPS.stop - 1).otherwise(_top(F.col("iou")))
    steps = rows.withColumn("step", F.explode(F.sequence(F.lit(0), last))).filter(F.col("step") >= HOTA_STEPS.start)
    most = lambda *names: [F.max(c).alias(c) for c in names]
    met = steps.groupBy(*groups, "step", "a", "b").agg(F.count("a").alias("k"), F.sum("iou").alias("located"), *most("na", "nb", "n", "m"))
    sums = met.groupBy(*groups, "step").agg(F.sum("k").alias("tp"), F.sum("located").alias("located"), *_associations("k"), *most("n", "m"))
    missed = lambda n, name: (_zero(n) - _zero("tp")).alias(name)
    return sums.select(*groups, "step", _zero("tp"), missed("n", "fn"), missed("m", "fp"), *[_zero(c) for c in (*SUMS, "located")])


def _counted_pairs(truth: DataFrame, found: DataFrame, near: float) -> DataFrame:
    """(video, cls, frame, a, b, na, top, counts, chosen): the overlaps of each class's truth with the tracks that count for it, as ``teta_parts`` tells.

    ``counts`` tells whether the found box counts by this truth, ``chosen`` whether the class's assignment takes the pair.
    """
    flag = lambda c, *by: F.max(F.coalesce(c, F.lit(False))).over(Window.partitionBy(*by))
    own, close = ["video", "cls"], F.col("iou") >= near
    boxes = _boxes(truth, found, ["video"], "cls").withColumns({"all_a": F.col("n"), "nb": F.col("n"), "na": F.count(F.lit(1)).over(Window.partitionBy(*own, "truth", "id"))})
    pairs = overlapping_sides(boxes, ["video", "frame"], (["cls", "all_a", "na"], ["nb"])).withColumn("__near", flag(close, "video", "b")).filter("__near").drop("__near")
    # Python's rows aren't known to be dealt out
    pairs = spread(aligned_matches(pairs, ["video"], "all_a").drop("all_a"), "video")
    of = F.max(F.when(F.col("chosen") & (F.col("iou") >= 0.5 - 1e-12), F.col("cls"))).over(Window.partitionBy("video", "frame", "b"))
    pairs = pairs.withColumn("__of", of).withColumn("counts", close & (F.col("__of").isNull() | (F.col("__of") == F.col("cls")))).drop("__of", "chosen")
    pairs = pairs.filter("cls IS NOT NULL").withColumn("__takes_part", flag(F.col("counts"), *own, "b")).filter("__takes_part").drop("__takes_part")
    return aligned_matches(pairs, own).select(*own, "frame", "a", "b", "na", _top(F.col("iou")).alias("top"), "counts", "chosen")


def _settled(pairs: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """Each class's found boxes (video, cls, frame, b, said, nb) with what they meet: a, na, top, and ``counts``; and rows (video, cls, n, m) of ``_sizes``.

    A class's found boxes are those of the tracks that count for it, in all their frames. What the overlaps leave over
    on both sides of a frame is paired in order.
    """
    over = lambda *keys: Window.partitionBy("video", *keys)
    by_frame, pair, true, box, size = ("cls", "frame"), *[F.col("kind") == k for k in range(4)]
    sides = [pairs, truth.select("video", *by_frame, F.col("track").alias("a")).filter("a IS NOT NULL"), found.select("video", "frame", F.col("track").alias("b"), F.col("cls").alias("said"))]
    sides.append(_sizes(truth, found, ["video", "cls"]))
    first, *others = [rows.withColumn("kind", F.lit(k)) for k, rows in enumerate(sides)]
    for rows in others:
        first = first.unionByName(rows, allowMissingColumns=True)
    rows = spread(first, "video")
    rows = rows.withColumns({"nb": F.count(F.when(box, 1)).over(over("b")), "__classes": F.collect_set(F.when(pair, F.col("cls"))).over(over("b"))})
    rows = rows.withColumn("na", F.coalesce("na", F.count(F.when(true, 1)).over(over("cls", "a"))))
    rows = rows.withColumn("cls", F.explode(F.when(box, F.col("__classes")).otherwise(F.array("cls")))).drop("__classes")
    hit = pair & F.col("chosen")
    matched = lambda c: F.max(F.when(hit, F.col(c))).over(over(*by_frame, "b"))
    rows = rows.withColumns({"__a": matched("a"), "__na": matched("na"), "__top": matched("top"), "counts": F.coalesce(F.max("counts").over(over(*by_frame, "b")), F.lit(False))})
    rows = rows.withColumn("__taken", F.coalesce(F.max(hit).over(over(*by_frame, "a")), F.lit(False))).filter(~pair & ~(true & F.col("__taken")))
    rows = rows.withColumn("__free", true | F.col("__a").isNull())
    rows = rows.withColumn("__k", F.row_number().over(over(*by_frame, "kind", "__free").orderBy("a", "b")))
    spare = lambda c: F.max(F.when(true, F.col(c))).over(over(*by_frame, "__free", "__k"))
    rows = rows.withColumns({"a": F.coalesce("__a", spare("a")), "na": F.coalesce("__na", spare("na"))}).filter(box | size)
    rows = rows.withColumns({c: F.when(box, F.col(c)) for c in ("a", "na", "nb", "counts")})
    return rows.withColumn("top", F.when(F.col("a").isNotNull(), F.coalesce("__top", F.lit(0)))).select("video", *by_frame, "a", "b", "na", "nb", "top", "said", "counts", "n", "m")


def teta_sums(truth: DataFrame, found: DataFrame, near: float = 0.5) -> DataFrame:
    """As ``teta_parts``, with cls_fp for both of its ways: ``cls_fp`` and ``cls_fp_exhaustive``."""
    own = ["video", "cls"]
    rows = _settled(staged(_counted_pairs(truth, found, near)), truth, found).filter("a IS NOT NULL OR counts OR n IS NOT NULL")
    # a box that counts is told at each step, a match at those that it reaches, one of the wrong class there for the class that was found as well
    right, every = F.col("said").eqNullSafe(F.col("cls")), F.lit(TETA_STEPS.stop - 1)
    last = F.when(F.col("counts") | F.col("n").isNotNull(), every).otherwise(F.col("top"))
    box = F.struct("cls", last.alias("last"), "top", "a", "b", "na", "nb", "counts", right.alias("right"), F.lit(None).cast(truth.schema["cls"].dataType).alias("by"), "n", "m")
    none = lambda *names: [F.lit(None).alias(c) for c in names]
    wrong = F.struct(F.col("said").alias("cls"), F.col("top").alias("last"), *none("top", "a", "b", "na", "nb", "counts", "right"), F.col("cls").alias("by"), *none("n", "m"))
    both = F.array_compact(F.array(box, F.when((F.col("top") >= CLASS_STEP) & ~right & F.col("said").isNotNull(), wrong)))
    steps = rows.select("video", F.explode(both).alias("x")).select("video", "x.*").withColumn("step", F.explode(F.sequence(F.lit(0), F.col("last"))))
    n = lambda c, name: F.count_if(c).alias(name)
    hit, high, by = F.coalesce(F.col("step") <= F.col("top"), F.lit(False)), F.col("step") >= CLASS_STEP, F.col("by")
    met = steps.groupBy(*own, "step", "a", "b").agg(
        n(hit, "k"), n(hit & high & F.col("right"), "cls_tp"), n(hit & high & ~F.col("right"), "cls_fn"), n(high & by.isNotNull(), "cls_fp"), n(high & (by > F.col("cls")), "__above"),
        n(F.col("counts") & ~hit, "loc_fp"), n("counts", "__counted"), n(F.col("counts") & F.col("right"), "__right"), *[F.max(c).alias(c) for c in ("na", "nb", "n", "m")],
    )
    total = [F.sum(c).alias(c) for c in ("cls_tp", "cls_fn", "cls_fp", "__above", "loc_fp", "__counted", "__right")]
    sums = met.groupBy(*own, "step").agg(F.sum("k").alias("loc_tp"), *total, *_associations("k"), F.max("n").alias("n"), F.max("m").alias("m"))
    known = lambda c: F.when(F.col("video").isNotNull() & F.col("cls").isNotNull(), c).otherwise(0.0)
    other = F.when(F.col("step") >= CLASS_STEP, _zero("m") - _zero("__right")).otherwise(0.0)
    exhaustive = F.when(_zero("__counted") > 0, _zero("cls_fp")).otherwise(_zero("__above")) + other
    return sums.select(*own, "step", _zero("loc_tp"), (known(_zero("n")) - _zero("loc_tp")).alias("loc_fn"), *[_zero(c) for c in TETA_PARTS[2:]], known(exhaustive).alias(EXHAUSTIVE))


def teta_parts(truth: DataFrame, found: DataFrame, near: float = 0.5, exhaustive: bool = False) -> DataFrame:
    """Sums at each of 20 IoU thresholds: video, cls, step (0 to 19), loc_tp, loc_fn, loc_fp, association (and _re, _pr), cls_tp, cls_fn, cls_fp.

    Rows have video, frame, track, cls and a box; classes are those of either side. First all truth is
    matched with the tracks that come ``near`` any of it; then, class by class, a found box counts where it is near truth of the class
    and isn't matched, at 0.5 or more, with truth of another class, and a track takes part in all its frames if
    it counts in one. A frame's matches are as many as boxes allow: what the overlaps leave over is paired in the order of
    track numbers, with an IoU of 0, so it counts at threshold 0 alone. A box that counts and isn't matched is a
    false location. Class counts begin at a threshold of 0.5; a match of the wrong class is missed for its truth and
    false for the class that was found.

    With ``exhaustive`` every box of a class that doesn't count for it is false for the class as well; for a class
    without any that counts in a video, the errors that smaller classes make on it there are left out.
    """
    return told(teta_sums(truth, found, near), exhaustive)


def told(sums: DataFrame, exhaustive: bool) -> DataFrame:
    """The parts of ``teta_sums`` with one of its two counts of errors."""
    return sums.withColumn("cls_fp", F.col(EXHAUSTIVE) if exhaustive else F.col("cls_fp")).drop(EXHAUSTIVE)


def combined(parts: DataFrame, by: list[str]) -> DataFrame:
    """The sums of parts of the same ``by`` and step: over videos, over classes, or over both."""
    names = [c for c in (*HOTA_PARTS, *TETA_PARTS, EXHAUSTIVE) if c in parts.columns]
    return parts.groupBy(*by, "step").agg(*[F.sum(c).alias(c) for c in dict.fromkeys(names)])


def _share(hits: str, *others: str) -> Column:
    whole = F.col(hits)
    for c in others:
        whole = whole + F.col(c)
    return F.col(hits) / F.greatest(F.lit(1.0), whole)


def _per_hit(name: str, hits: str) -> Column:
    return F.col(name) / F.greatest(F.lit(1.0), F.col(hits))


def hota_fields(sums: DataFrame) -> DataFrame:
    """``sums`` with the fields of each row: det_a, det_re, det_pr, ass_a, ass_re, ass_pr, loc_a, hota, owta; loc_a is 1 without hits."""
    rows = sums.withColumns({"det_a": _share("tp", "fn", "fp"), "det_re": _share("tp", "fn"), "det_pr": _share("tp", "fp"), "loc_a": F.greatest(F.lit(1e-10), F.col("located")) / F.greatest(F.lit(1e-10), F.col("tp"))})
    rows = rows.withColumns({f: _per_hit(c, "tp") for f, c in zip(("ass_a", "ass_re", "ass_pr"), SUMS, strict=True)})
    return rows.withColumns({"hota": F.sqrt(F.col("det_a") * F.col("ass_a")), "owta": F.sqrt(F.col("det_re") * F.col("ass_a"))})


HOTA_FIELDS = ("hota", "det_a", "ass_a", "det_re", "det_pr", "ass_re", "ass_pr", "loc_a", "owta")


def teta_fields(sums: DataFrame) -> DataFrame:
    """``sums`` with the fields of each row: loc_a, loc_re, loc_pr, assoc_a, assoc_re, assoc_pr, and from 0.5 on cls_a, cls_re, cls_pr (else null)."""
    rows = sums
    for k in ("loc", "cls"):
        fields = {"a": _share(f"{k}_tp", f"{k}_fn", f"{k}_fp"), "re": _share(f"{k}_tp", f"{k}_fn"), "pr": _share(f"{k}_tp", f"{k}_fp")}
        rows = rows.withColumns({f"{k}_{f}": c if k == "loc" else F.when(F.col("step") >= CLASS_STEP, c) for f, c in fields.items()})
    return rows.withColumns({f: _per_hit(c, "loc_tp") for f, c in zip(("assoc_a", "assoc_re", "assoc_pr"), SUMS, strict=True)})


TETA_FIELDS = ("loc_a", "assoc_a", "cls_a", "loc_re", "loc_pr", "assoc_re", "assoc_pr", "cls_re", "cls_pr")


def _means(fields: DataFrame, names: tuple[str, ...], boxes: tuple[str, ...], by: list[str], classes: bool, ignore_empty: bool) -> DataFrame:
    any_box = sum((F.col(c) for c in boxes[1:]), F.col(boxes[0]))
    keys = [*by, "cls"] if classes else by
    own = fields.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names], F.max(any_box).alias("__boxes"))
    if classes:
        own = (own.filter("__boxes > 0") if ignore_empty else own).groupBy(*by).agg(*[F.avg(c).alias(c) for c in names])
    return own.select(*by, *names)


def hota(parts: DataFrame, by: list[str] | None = None, classes: bool = False, ignore_empty: bool = False) -> DataFrame:
    """Each field's mean over the thresholds, from the parts summed by ``by``.

    With ``classes`` parts have cls, and the fields of each class are averaged; ``ignore_empty`` leaves out classes without any box.
    """
    by = by or []
    return _means(hota_fields(combined(parts, [*by, "cls"] if classes else by)), HOTA_FIELDS, ("tp", "fn", "fp"), by, classes, ignore_empty)


def hota_at_first(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The scores at the first threshold: by, hota_0, loc_a_0, and their product hota_loc_a_0."""
    first = hota_fields(combined(parts.filter(F.col("step") == HOTA_STEPS.start), by or []))
    return first.select(*(by or []), F.col("hota").alias("hota_0"), F.col("loc_a").alias("loc_a_0"), (F.col("hota") * F.col("loc_a")).alias("hota_loc_a_0"))


def teta(parts: DataFrame, by: list[str] | None = None, classes: bool = True, ignore_empty: bool = True) -> DataFrame:
    """Each field's mean over its thresholds, from the parts summed by ``by``, and teta, the mean of loc_a, assoc_a and cls_a.

    With ``classes`` the fields of each class are averaged, those of classes without located, missed or false boxes only if
    ``ignore_empty`` is off; else all classes' parts are summed.
    """
    by = by or []
    rows = _means(teta_fields(combined(parts, [*by, "cls"] if classes else by)), TETA_FIELDS, ("loc_tp", "loc_fn", "loc_fp"), by, classes, ignore_empty)
    return rows.withColumn("teta", (F.col("loc_a") + F.col("assoc_a") + F.col("cls_a")) / 3)
