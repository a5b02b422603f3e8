"""Overlaps of boxes by joins, and the choices among them that need an order or an optimum.

Which boxes overlap is found by a join; boxes that overlap no other never leave Spark's expressions.
Only the overlapping pairs of a group (an image, a frame) go to Python, many groups in one batch, and
within a group each connected set of pairs is settled by itself. All sums over frames, tracks
and videos are aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.functions import runs as R
from rulewright.operators.joins import large, spread

BOX = ["x0", "y0", "x1", "y1"]


def overlapping(a: DataFrame, b: DataFrame, group: list[str], of_smaller: bool = False, cell: float | None = None) -> DataFrame:
    """(group, a, b, iou) of the boxes (group, id, x0, y0, x1, y1) of two tables that share area in one group.

    ``of_smaller`` divides by the smaller area. In groups with very many boxes ``cell``, the side of a grid's
    cells, joins by group and cell, and a pair counts in the cell of its common part's corner.
    """
    sides = []
    for rows, mark in ((a, "a"), (b, "b")):
        side = large(rows.select(*group, F.col("id").alias(mark), *[F.col(c).cast("double").alias(f"{mark}_{c}") for c in BOX]))
        if cell:
            at = {k: F.explode(F.sequence(F.floor(F.col(f"{mark}_{k}0") / cell), F.floor(F.col(f"{mark}_{k}1") / cell))) for k in "xy"}
            side = side.withColumn("__cx", at["x"]).withColumn("__cy", at["y"])
        sides.append(side)
    pairs = sides[0].join(sides[1], [*group, "__cx", "__cy"] if cell else group)
    if cell:
        low = lambda c: F.greatest(f"a_{c}", f"b_{c}")
        pairs = pairs.filter((F.floor(low("x0") / cell) == F.col("__cx")) & (F.floor(low("y0") / cell) == F.col("__cy")))
    return _sharing(pairs, [*group, "a", "b"], of_smaller)


def _sharing(pairs: DataFrame, keep: list[str], of_smaller: bool = False) -> DataFrame:
    """(keep, iou) of the pairs whose boxes (columns a_x0, b_x0 and so on) share area."""
    low, high = (lambda c: F.greatest(f"a_{c}", f"b_{c}")), (lambda c: F.least(f"a_{c}", f"b_{c}"))
    w, h = high("x1") - low("x0"), high("y1") - low("y0")
    size = {m: (F.col(f"{m}_x1") - F.col(f"{m}_x0")) * (F.col(f"{m}_y1") - F.col(f"{m}_y0")) for m in "ab"}
    whole = F.least(size["a"], size["b"]) if of_smaller else size["a"] + size["b"] - w * h
    return pairs.filter((w > 0) & (h > 0)).select(*keep, F.try_divide(w * h, whole).alias("iou"))


def overlapping_sides(boxes: DataFrame, group: list[str], own: tuple[list[str], list[str]]) -> DataFrame:
    """As ``overlapping`` from one table of both sides' boxes, (group, id, truth, own, box), of which rows with ``truth`` are the a: (group, a, b, own, iou).

    Both sides of a group meet as two lists; boxes that are dealt out by some of the group's keys aren't shuffled for it.
    """
    side = lambda which, columns: F.collect_list(F.when(which, F.struct("id", *columns, *[F.col(c).cast("double").alias(c) for c in BOX])))
    lists = boxes.dropna(subset=group).groupBy(*group).agg(side(F.col("truth"), own[0]).alias("__a"), side(~F.col("truth"), own[1]).alias("__b"))
    met = lists.filter((F.size("__a") > 0) & (F.size("__b") > 0)).select(*group, F.explode("__a").alias("__a"), "__b").select(*group, "__a", F.explode("__b").alias("__b"))
    corners = [F.col(f"__{m}.{c}").alias(f"{m}_{c}") for m in "ab" for c in BOX]
    rows = met.select(*group, *[F.col(f"__{m}.id").alias(m) for m in "ab"], *[F.col(f"__{m}.{c}") for m, columns in zip("ab", own, strict=True) for c in columns], *corners)
    return _sharing(rows, [*group, "a", "b", *own[0], *own[1]])


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by ``keys``, cut anew so that no group lies in two of them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        same = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
        start = int(np.argmax(same))
        goes_on = held and (batch[keys].iloc[0] == held[-1][keys].iloc[-1]).all()
        if start or (held and not goes_on):
            # the last group of the batch may go on in the next one
            done = [*held, batch.iloc[:start]] if start else held
            yield pd.concat(done, ignore_index=True)
            held = []
        held.append(batch.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


def by_groups(rows: DataFrame, keys: list[str], order: list[Column], each: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``each`` of blocks of whole groups, sorted by keys and order: many small groups share one call.

    The number of parts is given: pairs are few bytes, and the planner would send them all to one or two tasks.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in whole_groups(batches, keys):
            yield each(block)

    return spread(rows, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the one-to-one assignment of least cost, by augmenting shortest paths."""
    if cost.shape[0] > cost.shape[1]:
        columns, rows = assignment(cost.T)
        order = np.argsort(rows)
        return rows[order], columns[order]
    n, m = cost.shape
    nearest = cost.argmin(axis=1)
    if len(np.unique(nearest)) == n:
        # every row can have its own best column
        return np.arange(n), nearest
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, used, back = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while owner[at]:
            used[at] = True
            row = owner[at]
            free = ~used[1:]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better], back[1:][better] = reduced[better], at
            nearest = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            step = least[nearest]
            u[owner[used]] += step
            v[used] -= step
            least[1:][free] -= step
            at = nearest
        while at:
            owner[at], at = owner[back[at]], back[at]
    columns = np.flatnonzero(owner[1:])
    rows = owner[1:][columns] - 1
    order = np.argsort(rows)
    return rows[order], columns[order]


def chosen_pairs(group: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the sparse pairs are in their group's one-to-one assignment of most total weight.

    Pairs whose ends meet no other pair are taken at once; each other connected set is a small dense problem.
    """
    ends = [np.unique(np.stack((group, x), axis=1), axis=0, return_inverse=True, return_counts=True) for x in (a, b)]
    (_, ia, na), (_, ib, nb) = ends
    ia, ib = ia.reshape(-1), ib.reshape(-1)
    chosen = (na[ia] == 1) & (nb[ib] == 1)
    open_ = np.flatnonzero(~chosen)
    if not len(open_):
        return chosen
    # connected sets: the least pair number spreads over both ends until nothing changes
    label = open_.copy()
    while True:
        new = label
        for index in (ia[open_], ib[open_]):
            least = np.full(index.max() + 1, len(a))
            np.minimum.at(least, index, new)
            new = least[index]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        rows = open_[part]
        ua, x = np.unique(ia[rows], return_inverse=True)
        ub, y = np.unique(ib[rows], return_inverse=True)
        gain = np.zeros((len(ua), len(ub)))
        gain[x, y] = weight[rows]
        row, column = assignment(-gain)
        taken = np.zeros(gain.shape, bool)
        taken[row, column] = True
        chosen[rows] = taken[x, y]
    return chosen


def assigned(pairs: DataFrame, group: list[str], weight: str = "iou") -> DataFrame:
    """The pairs (group, a, b, ...) of each group's one-to-one assignment of most total ``weight``; pairs not listed weigh 0."""
    fields = pairs.schema

    def each(block: pd.DataFrame) -> pd.DataFrame:
        codes = block.groupby(group, sort=False).ngroup().to_numpy()
        return block[chosen_pairs(codes, block["a"].to_numpy(), block["b"].to_numpy(), block[weight].to_numpy(float))]

    return by_groups(pairs, group, [F.col("a"), F.col("b")], each, fields)


def with_chosen(pairs: DataFrame, group: list[str], weight: str = "iou") -> DataFrame:
    """All ``pairs`` (group, a, b, ...), without ``weight`` and with ``chosen``: whether ``assigned`` would take the pair.

    Pairs that are dealt out by some of the group's keys aren't shuffled for it.
    """
    own = [c for c in pairs.columns if c not in (*group, "a", "b", weight)]

    @F.pandas_udf("array<boolean>")
    def chosen(a: pd.Series, b: pd.Series, w: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=object)
        sizes = a.map(len).to_numpy()
        taken = chosen_pairs(np.repeat(np.arange(len(a)), sizes), *[np.concatenate(x.to_list()) for x in (a, b)], np.concatenate(w.to_list()).astype(float))
        return pd.Series(np.split(taken, np.cumsum(sizes)[:-1]))

    lists = pairs.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("a", "b", F.col(weight).alias("__w"), *own))).alias("__l"))
    told = lists.withColumn("__chosen", chosen(*[F.col(f"__l.{c}") for c in ("a", "b", "__w")]))
    rows = told.select(*group, F.explode(F.arrays_zip("__l", "__chosen")).alias("__r"))
    return rows.select(*group, *[F.col(f"__r.__l.{c}").alias(c) for c in ("a", "b", *own)], F.col("__r.__chosen").alias("chosen"))


def suppressed(boxes: DataFrame, group: str, key: str, most: float, at_most: bool = True, of_smaller: bool = False, cell: float | None = None) -> DataFrame:
    """(group, key) of the boxes that stay: from the best score down (ties by key), one that overlaps none kept too much.

    ``at_most`` keeps an overlap equal to ``most``; without it such a box goes. ``of_smaller``
    compares the intersection over the smaller area; ``cell`` is as for ``overlapping``.
    """
    return suppressed_pairs(boxes, overlapping(*[boxes.withColumnRenamed(key, "id")] * 2, [group], of_smaller, cell), group, key, most, at_most)


def suppressed_pairs(rows: DataFrame, pairs: DataFrame, group: str, key: str, most: float, at_most: bool = True) -> DataFrame:
    """As ``suppressed`` from given overlaps (group, a, b, iou) of boxes, masks or tracks, each pair in any or both orders."""
    both = pairs.select(group, "a", "b", "iou").unionByName(pairs.select(group, F.col("b").alias("a"), F.col("a").alias("b"), "iou")).filter("a <> b")
    score = rows.select(group, F.col(key).alias("a"), F.col("score").cast("double").alias("sa"))
    other = score.select(group, F.col("a").alias("b"), F.col("sa").alias("sb"))
    too_much = F.col("iou") > most if at_most else F.col("iou") >= most
    better = (F.col("sb") > F.col("sa")) | ((F.col("sb") == F.col("sa")) & (F.col("b") < F.col("a")))
    beaten = both.filter(too_much).join(large(score), [group, "a"]).join(large(other), [group, "b"]).filter(better)
    beaten = beaten.select(group, "a", "b", "sa").distinct()
    kinds = dict(rows.dtypes)

    def each(block: pd.DataFrame) -> pd.DataFrame:
        gone: set[tuple] = set()
        for g, a, b in zip(block[group], block["a"], block["b"], strict=True):
            # boxes come from the best score down, so those that beat this one are settled
            if (g, b) not in gone:
                gone.add((g, a))
        return pd.DataFrame(sorted(gone), columns=[group, key])

    dropped = by_groups(beaten, [group], [F.col("sa").desc(), F.col("a")], each, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}")
    return rows.select(group, key).join(large(dropped), [group, key], "left_anti")


def matched(truth: DataFrame, found: DataFrame, group: str, least: float, cell: float | None = None) -> DataFrame:
    """(group, truth_id, found_id, iou): the one-to-one matching of most total IoU in each group, pairs under ``least`` left out."""
    pairs = assigned(overlapping(truth, found, [group], cell=cell), [group]).filter(F.col("iou") >= least)
    return pairs.select(group, F.col("a").alias("truth_id"), F.col("b").alias("found_id"), "iou")


def associated(detections: DataFrame, pairs: DataFrame, tracks: DataFrame, group: str, least: float, least_track: float, new_score: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New detections, unmatched tracks, and all (detection, track) pairs of at least ``least``, from overlaps (group, a, b, iou).

    A detection (a) is new if it overlaps no track by ``least`` and scores ``new_score`` or more; a track (b) is
    unmatched if the best one-to-one assignment gives it no detection with ``least_track``. A group
    without tracks has all its detections as new, whatever they score; one without detections has no unmatched tracks.
    """
    close = pairs.filter(F.col("iou") >= least).select(group, "a", "b")
    has = lambda rows, name: rows.select(group).distinct().withColumn(name, F.lit(True))
    open_ = detections.join(close.select(group, F.col("a").alias("id")).distinct(), [group, "id"], "left_anti").join(has(tracks, "__tracks"), group, "left")
    new = open_.filter(F.col("__tracks").isNull() | (F.col("score") >= new_score)).select(group, "id")
    met = assigned(pairs, [group]).filter(F.col("iou") >= least_track).select(group, F.col("b").alias("id"))
    lost = tracks.join(has(detections, "__any"), group, "left_semi").join(met, [group, "id"], "left_anti").select(group, "id")
    return new, lost, close


def track_overlaps(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(video, truth_track, found_track, iou): the sum of intersections over the sum of unions of all frames.

    Rows are (video, frame, track, x0, y0, x1, y1); a frame in which only one track is counts its
    whole area in the union.
    """
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    total = lambda x, name: x.groupBy("video", "track").agg(F.sum(size).alias(f"{name}_area")).withColumnRenamed("track", f"{name}_track")
    a = truth.select("video", "frame", F.col("track").alias("truth_track"), *[F.col(c).alias(f"a_{c}") for c in BOX])
    b = found.select("video", "frame", F.col("track").alias("found_track"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    w = F.greatest(F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0"), F.lit(0.0))
    h = F.greatest(F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"), F.lit(0.0))
    both = a.join(large(b), ["video", "frame"]).groupBy("video", "truth_track", "found_track").agg(F.sum(w * h).alias("shared"))
    joined = both.filter("shared > 0").join(large(total(truth, "truth")), ["video", "truth_track"]).join(large(total(found, "found")), ["video", "found_track"])
    return joined.select("video", "truth_track", "found_track", (F.col("shared") / (F.col("truth_area") + F.col("found_area") - F.col("shared"))).alias("iou"))


def completed(matches: DataFrame, truth: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """Matches (group, a, b, iou) and, at an IoU of 0, pairs of what they leave over on both sides of a group: the first a with the first b, and so on."""
    left = lambda rows, side: rows.select(*group, side).join(large(matches), [*group, side], "left_anti").withColumn("__k", F.row_number().over(Window.partitionBy(*group).orderBy(side)))
    rest = left(truth, "a").join(large(left(found, "b")), [*group, "__k"])
    return matches.select(*group, "a", "b", "iou").unionByName(rest.select(*group, "a", "b", F.lit(0.0).alias("iou")))


def masklet_overlaps(truth: DataFrame, found: DataFrame) -> DataFrame:
    """As ``track_overlaps`` for masks: rows are (video, frame, track, runs), runs of one canvas by video.

    A frame that one track lacks counts the other's area in the union. Two tracks of the same video that are empty throughout agree.
    """
    sized = lambda rows, name: rows.select("video", "frame", F.col("track").alias(f"{name}_track"), F.col("runs").alias(name), R.area(F.col("runs")).alias("area"))
    a, b = sized(truth, "truth"), sized(found, "found")
    total = lambda rows, name: rows.groupBy("video", f"{name}_track").agg(F.sum("area").alias(f"{name}_area"))
    ta, tb = total(a, "truth"), total(b, "found")
    met = a.filter("area > 0").drop("area").join(b.filter("area > 0").drop("area"), ["video", "frame"])
    shared = met.groupBy("video", "truth_track", "found_track").agg(F.sum(R.shared_area(F.col("truth"), F.col("found"))).alias("shared")).filter("shared > 0")
    iou = F.col("shared") / (F.col("truth_area") + F.col("found_area") - F.col("shared"))
    some = shared.join(ta, ["video", "truth_track"]).join(tb, ["video", "found_track"]).select("video", "truth_track", "found_track", iou.alias("iou"))
    none = ta.filter("truth_area = 0").join(tb.filter("found_area = 0"), "video").select("video", "truth_track", "found_track", F.lit(1.0).alias("iou"))
    return some.unionByName(none)


def mean_track_area(areas: Column) -> Column:
    """The mean of a track's areas by frame, null and zero ones left out; 0 if none is left."""
    some = F.filter(areas, lambda x: x.isNotNull() & (x != 0))
    return F.coalesce(F.try_divide(F.aggregate(some, F.lit(0.0), lambda n, x: n + x), F.size(some)), F.lit(0.0))


def mask_pairs(truth: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """(group, a, b, shared, sa, size): the masks (group, id, runs) of two tables that share cells in one group, and all three areas."""
    side = lambda rows, mark, size: rows.select(*group, F.col("id").alias(mark), F.col("runs").alias(f"__{mark}"), R.area(F.col("runs")).alias(size)).filter(F.col(size) > 0)
    both = side(truth, "a", "sa").join(large(side(found, "b", "size")), group).withColumn("shared", R.shared_area(F.col("__a"), F.col("__b")))
    return both.filter("shared > 0").drop("__a", "__b")


def _box_pairs(truth: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    sized = lambda rows, mark, name: rows.select(*group, F.col("id").alias(mark), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias(name))
    pairs = overlapping(truth, found, group).join(large(sized(truth, "a", "sa")), [*group, "a"]).join(large(sized(found, "b", "size")), [*group, "b"])
    return pairs.withColumn("shared", F.col("iou") * (F.col("sa") + F.col("size")) / (1 + F.col("iou"))).drop("iou")


def graded_boxes(block: pd.DataFrame, group: list[str], limits: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
    """(group, id, hit, ignored) of the found boxes of whole groups of sorted pairs (group, score falling, b, a), as ``greedy_matches`` tells.

    In each round all groups grade their next box, so the rounds are as many as the most boxes of one group.
    """
    code = lambda *names: block.groupby(list(names), sort=False).ngroup().to_numpy()
    box, truth, of = code(*group, "b"), code(*group, "a"), code(*group)
    outside = lambda x: (x[:, None] < bounds[:, 0]) | (x[:, None] > bounds[:, 1])
    iou, crowd = block["iou"].to_numpy(float), block["crowd"].to_numpy(bool)
    ignore, near = outside(block["area"].to_numpy(float)) | crowd[:, None], iou[:, None] >= limits - 1e-12
    first = np.flatnonzero(np.diff(box, prepend=-1))
    # a box's place in its group, whose boxes stand together
    own = of[first]
    place = np.arange(len(first)) - np.flatnonzero(np.diff(own, prepend=-1))[own]
    shape = (len(first), len(limits), len(bounds))
    hit, skipped, taken = np.zeros(shape, bool), np.repeat(outside(block["size"].to_numpy(float)[first])[:, None], len(limits), axis=1), np.zeros((truth.max() + 1, *shape[1:]), bool)
    order = np.argsort(place[box], kind="stable")
    t, r = np.arange(len(limits))[None, :, None], np.arange(len(bounds))[None, None, :]
    for rows in np.split(order, np.flatnonzero(np.diff(place[box][order])) + 1):
        starts = np.flatnonzero(np.diff(box[rows], prepend=-1))
        at = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(rows)))
        can = near[rows][:, :, None] & (~taken[truth[rows]] | crowd[rows][:, None, None])
        worth = np.where(can, iou[rows][:, None, None] + 2 * ~ignore[rows][:, None, :], -1)
        most = np.maximum.reduceat(worth, starts, axis=0)
        # the first of equal ones
        best = rows[np.minimum.reduceat(np.where(worth == most[at], np.arange(len(rows))[:, None, None], len(rows)), starts, axis=0)]
        got, boxes = most >= 0, box[rows[starts]]
        taken[truth[best], t, r] |= got
        passed = ignore[best, r]
        hit[boxes], skipped[boxes] = got & ~passed, np.where(got, passed, skipped[boxes])
    found = block.iloc[first][[*group, "b"]].rename(columns={"b": "id"}).reset_index(drop=True)
    return found.assign(hit=list(hit.reshape(len(first), -1)), ignored=list(skipped.reshape(len(first), -1)))


def greedy_matches(truth: DataFrame, found: DataFrame, group: list[str], thresholds: list[float], ranges: list[tuple[float, float]], masks: bool = False) -> DataFrame:
    """For each found box two arrays over threshold and area range, ``hit`` and ``ignored``: (group, id, hit, ignored).

    From the best score down (ties by id) a found box takes the truth that it overlaps most among
    those that are free and reach the threshold, one that counts before one that doesn't. Truths are ignored where
    their area lies outside the range or they are crowds, which any number of boxes may take and which are measured by
    the found box's area. An unmatched box outside the range is ignored too. truth has id, area, crowd and a box, found id, score
    and a box; with ``masks`` both have run lengths (``runs``) in the place of boxes.
    """
    size = R.area(F.col("runs")) if masks else (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    keyed = found.withColumn("__size", size.cast("double"))
    pairs = (mask_pairs if masks else _box_pairs)(truth, found, group)
    pairs = pairs.join(large(truth).select(*group, F.col("id").alias("a"), F.col("area").cast("double").alias("area"), "crowd"), [*group, "a"])
    pairs = pairs.join(large(keyed).select(*group, F.col("id").alias("b"), F.col("score").cast("double").alias("score")), [*group, "b"])
    whole = F.when(F.col("crowd"), F.col("size")).otherwise(F.col("sa") + F.col("size") - F.col("shared"))
    pairs = pairs.select(*group, "a", "b", "area", "crowd", "score", F.col("size").cast("double").alias("size"), (F.col("shared") / whole).alias("iou"))
    limits, bounds = np.array(thresholds), np.array(ranges)

    def each(block: pd.DataFrame) -> pd.DataFrame:
        return graded_boxes(block, group, limits, bounds)

    kinds = dict(found.select(*group, "id").dtypes)
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", hit array<boolean>, ignored array<boolean>"
    met = by_groups(pairs, group, [F.col("score").desc(), F.col("b"), F.col("a")], each, schema)
    none = F.array_repeat(F.lit(False), len(limits) * len(bounds))
    own_range = F.array(*[(F.col("__size") < low) | (F.col("__size") > high) for low, high in ranges])
    rows = keyed.select(*group, "id", "__size").join(large(met), [*group, "id"], "left")
    return rows.select(*group, "id", F.coalesce("hit", none).alias("hit"), F.coalesce("ignored", F.flatten(F.array_repeat(own_range, len(limits)))).alias("ignored"))
