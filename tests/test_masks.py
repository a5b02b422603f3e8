"""Run lengths, regions and polygons against plain cells."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rulewright.functions import geometry as G
from rulewright.functions import runs as R
from rulewright.operators import images


def runs_of(bits):
    out, last = [], 0
    for b, own in itertools.groupby(bits):
        if not out and b:
            out.append(0)
        out.append(len(list(own)))
        last = b
    return out


def masks(seed, n, size):
    rng = random.Random(seed)
    return [[int(rng.random() < share) for _ in range(size)] for share in [0.0, 1.0, *[rng.random() for _ in range(n)]]]


def test_areas_overlaps_and_unions_of_runs(spark):
    rows = [(a, b, c, runs_of(a), runs_of(b), runs_of(c)) for a, b, c in itertools.product(masks(1, 4, 23), masks(2, 4, 23), masks(3, 1, 23))]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, c array<int>, ra array<int>, rb array<int>, rc array<int>")
    got = df.select("a", "b", "c", R.area(F.col("ra")).alias("area"), R.shared_area(F.col("ra"), F.col("rb")).alias("shared"), R.overlap(F.col("ra"), F.col("rb")).alias("iou"), R.united(F.array("ra", "rb", "rc")).alias("u")).collect()
    assert len(got) == len(rows)
    for r in got:
        both, any_ = sum(x & y for x, y in zip(r.a, r.b, strict=True)), sum(x | y for x, y in zip(r.a, r.b, strict=True))
        assert (r.area, r.shared, round(r.iou, 9)) == (sum(r.a), both, round(both / any_ if any_ else 0, 9))
        assert r.u == runs_of([x | y | z for x, y, z in zip(r.a, r.b, r.c, strict=True)])


def test_runs_with_empty_ones(spark):
    row = spark.createDataFrame([([0, 2, 0, 3, 1, 0, 2], [])], "a array<int>, b array<int>").select(R.area(F.col("a")), R.shared_area(F.col("a"), F.col("a")), R.overlap(F.col("b"), F.col("b")), R.united(F.array("a")), R.intervals(F.col("b"))).first()
    assert (row[0], row[1], row[2], row[3], row[4]) == (5, 5, 0.0, [0, 5, 3], [])


def flooded(bits, width, eight):
    """(labels, sizes) by flood fill."""
    labels, sizes = [0] * len(bits), [0] * len(bits)
    for first, b in enumerate(bits):
        if b and not labels[first]:
            region, todo = {first}, [first]
            while todo:
                i = todo.pop()
                for dy, dx in itertools.product((-1, 0, 1), repeat=2):
                    x, k = i % width + dx, i + dy * width + dx
                    if (eight or not dy or not dx) and 0 <= x < width and 0 <= k < len(bits) and bits[k] and k not in region:
                        region.add(k)
                        todo.append(k)
            for i in region:
                labels[i], sizes[i] = first + 1, len(region)
    return labels, sizes


@pytest.mark.parametrize("eight", [True, False])
def test_regions_by_flood_fill(spark, eight):
    rng = random.Random(6)
    rows = [(w, [int(rng.random() < share) for _ in range(w * h)]) for w, h in ((1, 1), (1, 9), (9, 1), (5, 4), (12, 17)) for share in (0.0, 0.3, 0.5, 0.7, 1.0) for _ in range(3)]
    spiral = ["1111111", "0000001", "1111101", "1000101", "1011101", "1000001", "1111111"]
    rows += [(7, [int(c) for c in "".join(spiral)]), (3, [1, 0, 1, 0, 1, 0, 1, 0, 1]), (4, [])]
    got = spark.createDataFrame([*rows, (3, None)], "w int, bits array<int>").repartition(2).select("w", "bits", images.regions(F.col("bits"), F.col("w"), eight).alias("r")).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.r.labels, r.r.sizes) == (flooded(r.bits, r.w, eight) if r.bits else ([], []))


def inside(points, px, py):
    """Whether a point lies in a polygon or on its edge, by crossings of a ray."""
    corners = list(zip(points[::2], points[1::2], strict=True))
    odd = False
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        if cross == 0 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by):
            return True
        if (ay > py) != (by > py) and (cross > 0) == (by > ay):
            odd = not odd
    return odd


def test_polygons_by_crossings(spark):
    rng = random.Random(4)
    parts = [[[float(rng.randint(-3, 14)) for _ in range(2 * rng.randint(3, 7))] for _ in range(rng.randint(1, 3))] for _ in range(60)]
    parts += [[[0.0, 0.0, 4.0, 4.0]], [], [[2.0, 2.0, 2.0, 2.0, 2.0, 2.0]], [[1.5, 0.5, 8.25, 0.5, 8.25, 6.5, 1.5, 6.5]], [[0.0, 3.0, 9.0, 3.0, 4.0, 3.0]]]
    got = spark.createDataFrame([(p,) for p in parts], "parts array<array<double>>").select("parts", G.bits_of(R.polygon_runs(F.col("parts"), 11, 8).cast("array<int>")).alias("bits")).collect()
    for r in got:
        assert r.bits == [int(any(len(p) >= 6 and inside(p, i % 11, i // 11) for p in r.parts)) for i in range(88)], r.parts
