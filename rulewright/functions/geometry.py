"""Boxes, run lengths and square grids of values as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    none = F.lit(0.0)
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, none) * F.greatest(h, none)


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    return _share(both, area(a) + area(b) - both)


def ioa(a: Column, b: Column) -> Column:
    """Intersection over the area of ``a``."""
    return _share(intersection(a, b), area(a))


def iom(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    return _share(intersection(a, b), F.least(area(a), area(b)))


def giou(a: Column, b: Column) -> Column:
    """IoU less the share of the enclosing box that neither covers."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    hull = (F.greatest(a["x1"], b["x1"]) - F.least(a["x0"], b["x0"])) * (F.greatest(a["y1"], b["y1"]) - F.least(a["y0"], b["y0"]))
    return _share(both, union) - _share(hull - union, hull)


def unit_box(b: Column, width: Column, height: Column) -> Column:
    """Coordinates as shares of the sides, kept within 0 and 1."""
    within = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return box(within(b["x0"] / width), within(b["y0"] / height), within(b["x1"] / width), within(b["y1"] / height))


def is_zero_box(b: Column) -> Column:
    return (b["x0"] <= 0) & (b["y0"] <= 0) & (b["x1"] <= 0) & (b["y1"] <= 0)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, even where ``use`` names it often or within lambdas."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def run_lengths(bits: Column) -> Column:
    """Lengths of the runs of an array of 0 and 1, the first one of zeros (0 if it starts with 1)."""
    return let(bits, _run_lengths)


def _run_lengths(bits: Column) -> Column:
    places = F.sequence(F.lit(0), F.size(bits) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get(bits, i) != F.get(bits, i - 1)))
    runs = let(starts, lambda own: F.zip_with(own, F.concat(F.slice(own, F.lit(2), F.size(own)), F.array(F.size(bits))), lambda a, b: b - a))
    return F.concat(F.when(F.get(bits, F.lit(0)) == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), runs)


def run_area(runs: Column) -> Column:
    """Number of ones: every second run."""
    return F.aggregate(F.filter(runs, lambda _, i: i % 2 == 1), F.lit(0), lambda n, r: n + r)


def bits_of(runs: Column) -> Column:
    """The array of 0 and 1 that has these runs."""
    return F.flatten(F.transform(runs, lambda r, i: F.array_repeat((i % 2).cast("int"), r)))


def transposed(cells: Column, side: int) -> Column:
    """A square grid by columns instead of rows."""
    return let(cells, lambda own: F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.get(own, (i % side) * side + F.floor(i / side).cast("int"))))


def active(cells: Column, least: float) -> Column:
    return F.transform(cells, lambda x: (x >= least).cast("int"))


def active_share(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda n, x: n + x) / F.size(bits)


def min_max(cells: Column) -> Column:
    """Values from 0 to 1: less the least one, over the range plus 1e-8."""
    low, high = F.array_min(cells), F.array_max(cells)
    return F.transform(cells, lambda x: (x - low) / (high - low + 1e-8))


def pooled(cells: Column, side: int, to: int) -> Column:
    """Adaptive average: bin i of ``to`` covers rows floor(i * side / to) to ceil((i + 1) * side / to)."""
    bins = [(i * side // to, -(-(i + 1) * side // to)) for i in range(to)]
    means = []
    for r0, r1 in bins:
        for c0, c1 in bins:
            own = [F.get(cells, F.lit(r * side + c)) for r in range(r0, r1) for c in range(c0, c1)]
            means.append(sum(own[1:], own[0]) / len(own))
    return F.array(*means)


def shrunk(bits: Column, side: int) -> Column:
    """One ring less: a cell stays if all nine cells around it are there and active."""

    def inner(bits: Column, i: Column) -> Column:
        r, c = F.floor(i / side).cast("int"), i % side
        inside = r.between(1, side - 2) & c.between(1, side - 2)
        return F.when(inside, F.array_min(F.array(*[F.get(bits, (r + dr) * side + c + dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]))).otherwise(0)

    return let(bits, lambda own: F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: inner(own, i)))


def grid_box(bits: Column, side: int) -> Column:
    """(x0, y0, x1, y1) of the active cells, the last ones included; null if none is active."""
    at = F.filter(F.transform(bits, lambda b, i: F.when(b == 1, i)), lambda i: i.isNotNull())
    xs, ys = F.transform(at, lambda i: i % side), F.transform(at, lambda i: F.floor(i / side).cast("int"))
    return F.when(F.size(at) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def square_padding(width: Column, height: Column) -> Column:
    """(side, left, top) that center an image in a square, offsets rounded down."""
    side = F.greatest(width, height)
    return F.struct(side.alias("side"), F.floor((side - width) / 2).alias("left"), F.floor((side - height) / 2).alias("top"))


def frame_sample(n: Column, k: int) -> Column:
    """``k`` of ``n`` frame numbers at the middles of equal gaps."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n / k) + n / k / 2).cast("int"))


def padded(values: Column, to: int | Column, fill: Column) -> Column:
    """An array followed by as many ``fill`` as bring it to a length; a longer one stays."""
    to = to if isinstance(to, Column) else F.lit(to)
    return F.concat(values, F.array_repeat(fill, F.greatest(F.lit(0), to - F.size(values))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mask_ioa(a: Column, b: Column) -> Column:
    """The share of ``a``'s active cells that ``b`` has too; 0 if it has none. Both are arrays of 0 and 1."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0), lambda n, x: n + x)
    return _share(both, F.aggregate(a, F.lit(0), lambda n, x: n + x))


def point_similarity(ax: Column, ay: Column, bx: Column, by: Column, zero_distance: float = 2.0) -> Column:
    """1 for equal points, falling with their distance to 0 at ``zero_distance``."""
    return F.greatest(F.lit(0.0), 1 - F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / zero_distance)


def canvas_bits(runs: Column, size: int) -> Column:
    """As ``bits_of`` on a canvas of ``size`` cells: negative runs count as none, what runs past the end is cut, and what they leave is 0."""
    bits = F.slice(bits_of(F.transform(runs, lambda r: F.greatest(r, F.lit(0)))), F.lit(1), F.lit(size))
    return padded(bits, size, F.lit(0))


def valid_runs(runs: Column, size: int) -> Column:
    """Whether no run is negative and together they fill the canvas."""
    return F.forall(runs, lambda r: r >= 0) & (F.aggregate(runs, F.lit(0), lambda n, r: n + r) == size)


def square_bits(values: Column, width: int, height: int, least: int = 128) -> Column:
    """Values of at least ``least`` as 1, others as 0, on a square canvas with the image in its middle (offsets rounded down)."""
    side = max(width, height)
    left, top = (side - width) // 2, (side - height) // 2

    def one(i: Column) -> Column:
        r, c = F.floor(i / side).cast("int") - top, i % side - left
        inside = r.between(0, height - 1) & c.between(0, width - 1)
        return F.when(inside, (F.get(values, r * width + c) >= least).cast("int")).otherwise(0)

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), one)


def instance_count(shapes: Column) -> Column:
    """How many masks a list of results holds, by their shapes: one of three or more sides holds as many as its first, one of two is one, others none."""
    return F.coalesce(F.aggregate(shapes, F.lit(0), lambda n, s: n + F.when(F.size(s) >= 3, s[0]).when(F.size(s) == 2, 1).otherwise(0)), F.lit(0))
