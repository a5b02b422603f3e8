"""Masks as run lengths: areas, overlaps, unions, boxes and polygons from runs alone, without decoding to cells.

A mask is an array of run lengths over a canvas's cells in one fixed order, the first run one of zeros
(0 long if the mask starts with a one). Work grows with the number of runs, not with the canvas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulewright.functions.geometry import let

_NONE = "array<struct<a:bigint,b:bigint>>"
#: How far a crossing may lie from a cell's centre that an edge goes through, by rounding.
_NEAR = 1e-9


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _total(values: Column) -> Column:
    return F.aggregate(values, _long(0), lambda n, x: n + x)


def area(runs: Column) -> Column:
    """Number of ones: every second run."""
    return _total(F.filter(runs, lambda _, i: i % 2 == 1))


def intervals(runs: Column) -> Column:
    """(a, b) of each run of ones that isn't empty, by cell numbers, b exclusive."""
    return let(runs, _intervals)


def _intervals(runs: Column) -> Column:
    begin = F.struct(_long(0).alias("at"), F.array().cast(_NONE).alias("out"))

    def step(held: Column, i: Column) -> Column:
        end = held["at"] + F.get(runs, i)
        one = F.array(F.struct(held["at"].alias("a"), end.alias("b")))
        return F.struct(end.alias("at"), F.when((i % 2 == 1) & (end > held["at"]), F.concat(held["out"], one)).otherwise(held["out"]).alias("out"))

    return F.when(F.size(runs) > 0, F.aggregate(F.sequence(F.lit(0), F.size(runs) - 1), begin, step, lambda held: held["out"])).otherwise(F.array().cast(_NONE))


def of_intervals(spans: Column, cells: Column) -> Column:
    """The runs over ``cells`` cells whose ones are the cells of any interval (a, b); they may overlap and stand in any order."""
    begin = F.struct(_long(0).alias("end"), F.array().cast("array<bigint>").alias("runs"))

    def step(held: Column, x: Column) -> Column:
        end, runs = held["end"], held["runs"]
        goes_on = (x["a"] <= end) & (F.size(runs) > 0)
        longer = F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.element_at(runs, F.lit(-1)) + F.greatest(x["b"] - end, _long(0))))
        return F.struct(F.greatest(end, x["b"]).alias("end"), F.when(goes_on, longer).otherwise(F.concat(runs, F.array(x["a"] - end, x["b"] - x["a"]))).alias("runs"))

    held = F.aggregate(F.array_sort(F.filter(spans, lambda x: x["b"] > x["a"])), begin, step)
    return let(F.struct(held.alias("held"), cells.cast("bigint").alias("cells")), _closed)


def _closed(x: Column) -> Column:
    rest = x["cells"] - x["held"]["end"]
    return F.when(rest > 0, F.concat(x["held"]["runs"], F.array(rest))).otherwise(x["held"]["runs"])


def united(masks: Column) -> Column:
    """The runs of the union of an array of masks of one canvas; null for no mask."""
    return let(masks, lambda own: F.when(F.size(own) > 0, of_intervals(F.flatten(F.transform(own, _intervals)), _total(F.get(own, F.lit(0))))))


def shared_area(a: Column, b: Column) -> Column:
    """Number of cells that are ones in both masks: the ends of both are merged in order."""
    begin = F.struct(_long(0).alias("at"), F.lit(0).alias("on"), _long(0).alias("shared"))
    ends = lambda runs: F.flatten(F.transform(intervals(runs), lambda x: F.array(F.struct(x["a"].alias("at"), F.lit(1).alias("by")), F.struct(x["b"].alias("at"), F.lit(-1).alias("by")))))

    def step(held: Column, e: Column) -> Column:
        more = F.when(held["on"] == 2, e["at"] - held["at"]).otherwise(_long(0))
        return F.struct(e["at"].alias("at"), (held["on"] + e["by"]).alias("on"), (held["shared"] + more).alias("shared"))

    return F.aggregate(F.array_sort(F.concat(ends(a), ends(b))), begin, step, lambda held: held["shared"])


def overlap(a: Column, b: Column) -> Column:
    """IoU of two masks; 0 if both are empty."""
    return let(shared_area(a, b), lambda both: F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0)))


def boundary_f(truth: Column, truth_wide: Column, found: Column, found_wide: Column) -> Column:
    """F measure of two boundaries given as runs, each matched within the other's widened one.

    A side without a boundary has nothing to miss; two empty ones agree.
    """
    n, m = area(truth), area(found)
    precision = F.when(m > 0, F.when(n > 0, shared_area(found, truth_wide) / m).otherwise(0.0)).otherwise(1.0)
    recall = F.when(n > 0, F.when(m > 0, shared_area(truth, found_wide) / n).otherwise(0.0)).otherwise(1.0)
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def by_columns(cells: Column, width: int, height: int) -> Column:
    """A grid's cells by columns instead of rows."""
    return let(cells, lambda own: F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.get(own, (i % height) * width + F.floor(i / height).cast("int"))))


def polygon_runs(parts: Column, width: int, height: int) -> Column:
    """Runs, by rows, of the cells whose centre (at whole numbers) lies in or on any of the polygons x0, y0, x1, y1, ....

    Each row is one scan line: where it crosses a polygon's edges, sorted, gives the ends of its runs, two
    by two; edges and corners on the line itself count as inside. Work grows with rows times edges. Parts of fewer
    than three points are empty.
    """

    def edges(points: Column) -> Column:
        n = F.floor(F.size(points) / 2).cast("int")
        at = lambda i, k: F.get(points, 2 * (i % n) + k).cast("double")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i, 0).alias("ax"), at(i, 1).alias("ay"), at(i + 1, 0).alias("bx"), at(i + 1, 1).alias("by")))

    def span(row: Column, low: Column, high: Column) -> Column:
        # cells from low to high, both included, within the canvas
        a = F.greatest(F.ceil(low - _NEAR), _long(0))
        b = F.least(F.floor(high + _NEAR), _long(width - 1)) + 1
        return F.struct((row * width + a).alias("a"), (row * width + b).alias("b"))

    def of_row(own: Column, row: Column) -> Column:
        y = row.cast("double")
        spans = F.filter(own, lambda e: (e["ay"] > y) != (e["by"] > y))
        crossed = F.array_sort(F.transform(spans, lambda e: e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])))
        pairs = lambda own: F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / 2).cast("int") - 1), lambda i: span(row, F.get(own, 2 * i), F.get(own, 2 * i + 1)))
        inside = let(crossed, lambda own: F.when(F.size(own) > 1, pairs(own)).otherwise(F.array().cast(_NONE)))
        flat = F.transform(F.filter(own, lambda e: (e["ay"] == y) & (e["by"] == y)), lambda e: span(row, F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])))
        corners = F.transform(F.filter(own, lambda e: e["ay"] == y), lambda e: span(row, e["ax"], e["ax"]))
        return F.concat(inside, flat, corners)

    rows = F.sequence(F.lit(0), F.lit(height - 1))
    of_part = lambda points: F.when(F.size(points) >= 6, let(edges(points), lambda own: F.flatten(F.transform(rows, lambda r: of_row(own, r))))).otherwise(F.array().cast(_NONE))
    return of_intervals(F.flatten(F.transform(parts, of_part)), _long(width * height))
