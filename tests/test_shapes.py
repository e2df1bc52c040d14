"""Watershed, distances, outlines, hulls and edges against plain loops."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import edges, flooding, morphology, outlines, regions
from tessera.plans import fourier, hulls

SIDES = ((0, 1), (1, 0), (0, -1), (-1, 0))


def flooded(values, markers):
    """Plain flooding: the lightest link out of the marked pixels, again and again."""
    number = lambda p: p[0] * morphology.STRIDE + p[1]
    out, queue = dict(markers), []

    def push(p):
        for dy, dx in SIDES:
            r = p[0] + dy, p[1] + dx
            if r in values and r not in out:
                weight = max(abs(a - b) for a, b in zip(values[p], values[r], strict=True))
                heapq.heappush(queue, (weight, min(number(p), number(r)), max(number(p), number(r)), r, out[p]))

    for p in markers:
        push(p)
    while queue:
        *_, p, name = heapq.heappop(queue)
        if p not in out:
            out[p] = name
            push(p)
    return out


def test_flood_by_plain_flooding(spark):
    rng = random.Random(1)
    values = {(y, x): (rng.randrange(6), rng.randrange(9)) for y in range(64) for x in range(64)}
    for p in [(y, 30) for y in range(64)] + [(y, 31) for y in range(64)]:
        values.pop(p)  # a gap that no water crosses
    markers = {p: i for i, p in enumerate(rng.sample([p for p in values if p[1] < 30], 30))}
    rows = [(1, y, x, b, a, markers.get((y, x))) for (y, x), (b, a) in values.items()]
    df = spark.createDataFrame(rows, "tile long, y int, x int, b int, a int, marker long")
    got = {(r.y, r.x): r.basin for r in flooding.flood(df, flooding.apart(["b", "a"])).collect()}
    want = flooded(values, markers)
    assert len(got) == len(values) and {p: b for p, b in got.items() if b is not None} == want
    assert flooding.flood(df.limit(0), flooding.apart(["b", "a"])).count() == 0


def test_lines_part_basins_and_close_at_corners(spark):
    basins = ["aab", "aab", "ccc"]
    df = spark.createDataFrame([(1, y, x, ord(c)) for y, row in enumerate(basins) for x, c in enumerate(row)], "tile long, y int, x int, basin long")
    assert sorted((r.y, r.x) for r in flooding.lines(df).filter("line").collect()) == [(0, 2), (1, 2), (2, 0), (2, 1), (2, 2)]
    bare = ["..x..", ".x...", "x...."]
    df = spark.createDataFrame([(1, y, x, 1, c == "x") for y, row in enumerate(bare) for x, c in enumerate(row)], "tile long, y int, x int, basin long, line boolean")
    closed = {(r.y, r.x) for r in flooding.closed_lines(df).filter("line").collect()}
    assert closed == {(0, 2), (1, 1), (2, 0), (1, 2), (2, 1)}


def test_distance_in_a_wide_disc(spark):
    n, radius = 1024, 480
    at = lambda c: (F.col("id") / n).cast("int") if c == "y" else (F.col("id") % n).cast("int")
    on = (F.pow(at("y") - n // 2, 2) + F.pow(at("x") - n // 2, 2)) <= radius * radius
    df = spark.range(n * n).select(F.lit(1).cast("long").alias("tile"), at("y").alias("y"), at("x").alias("x"), on.alias("on"))
    t = morphology.squared_distance(df).toArrow()
    got = np.zeros((n, n), np.int64)
    got[t.column("y").to_numpy(), t.column("x").to_numpy()] = t.column("d2").to_numpy()
    y, x = np.mgrid[:n, :n] - n // 2
    off = y * y + x * x > radius * radius
    # the nearest off pixel of a column, then the least over the columns of a row
    column = np.where(off, np.arange(n)[:, None], -(10**6))
    above = np.arange(n)[:, None] - np.maximum.accumulate(column, axis=0)
    below = np.minimum.accumulate(np.where(off, np.arange(n)[:, None], 10**6)[::-1], axis=0)[::-1] - np.arange(n)[:, None]
    g2 = np.minimum(above, below).astype(np.int64) ** 2
    steps = (np.arange(n)[:, None] - np.arange(n)[None]) ** 2
    for row in range(0, n, 37):
        assert (got[row] == (steps + g2[row][None]).min(axis=1)).all()
    assert t.num_rows == n * n and got.max() == got[n // 2, n // 2]


def noise(spark, seed, size=20, share=0.6):
    rng = random.Random(seed)
    on = {(y, x) for y in range(size) for x in range(size) if rng.random() < share}
    return on, spark.createDataFrame([(1, y, x, (y, x) in on) for y in range(size) for x in range(size)], "tile long, y int, x int, on boolean")


@pytest.mark.parametrize("conn", [4, 8])
def test_outlines(spark, conn):
    """Areas with holes are the pixel counts, holes those of the Euler number, and polygons lead back to the pixels."""
    _, mask = noise(spark, conn)
    labels = regions.label(mask, conn).persist()
    counts = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    rings = outlines.measures(labels, conn).collect()
    areas, holes = dict.fromkeys(counts, 0), dict.fromkeys(counts, 0)
    for r in rings:
        areas[r.label] += -r.area if r.hole else r.area
        holes[r.label] += r.hole
    assert areas == counts
    assert {r.label: 1 - r.euler for r in hulls.euler(labels, conn).collect()} == holes
    back = outlines.covered(outlines.polygons(labels, conn)).collect()
    assert sorted((r.label, r.y, r.x) for r in back) == sorted((r.label, r.y, r.x) for r in labels.collect())
    labels.unpersist()


def test_corners_are_in_order(spark):
    on = ["1111", "1001", "1111"]
    labels = spark.createDataFrame([(1, y, x, 0) for y, row in enumerate(on) for x, c in enumerate(row) if c == "1"], "tile long, y int, x int, label long")
    by = {r.hole: r.polygon for r in outlines.polygons(labels, dx=10, dy=20).collect()}
    assert sorted(by) == [False, True]
    corners = [tuple(map(int, c.split(","))) for c in by[False].split(";")]
    assert set(corners) == {(10, 20), (14, 20), (14, 23), (10, 23)}
    assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(corners, corners[1:] + corners[:1], strict=True))
    assert outlines.rings(labels.limit(0)).count() == 0 and outlines.areas(labels).first().filled == 12
    assert outlines.by_filled_area(labels, 12).count() == 10 and outlines.by_filled_area(labels, 13).count() == 0


def test_hulls(spark):
    on, mask = noise(spark, 9, 14, 0.5)
    labels = regions.label(mask, 8)
    pixels = {}
    for r in labels.collect():
        pixels.setdefault(r.label, []).append((r.y, r.x))

    def area(points):
        """Gift wrapping."""
        points = sorted({(x + a, y + b) for y, x in points for a in (0, 1) for b in (0, 1)})
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        hull, p = [], points[0]
        while p not in hull:
            hull.append(p)
            q = next(r for r in points if r != p)
            for r in points:
                t = turn(p, q, r)
                if t < 0 or (t == 0 and math.dist(p, r) > math.dist(p, q)):
                    q = r
            p = q
        return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, hull[1:] + hull[:1], strict=True))) / 2

    got = {r.label: r for r in hulls.measures(labels).collect()}
    assert {k: r.convex_area for k, r in got.items()} == {k: area(v) for k, v in pixels.items()}
    assert all(r.solidity <= 1 and r.area == len(pixels[k]) for k, r in got.items())


def test_edges_by_plain_loops(spark):
    rng = random.Random(4)
    n = 18
    v = {(y, x): (200 if (y - 9) ** 2 + (x - 8) ** 2 < 30 else 40) + rng.randrange(30) for y in range(n) for x in range(n)}
    df = spark.createDataFrame([(1, y, x, g) for (y, x), g in v.items()], "tile long, y int, x int, gray int")
    held = lambda y, x: v[min(max(y, 0), n - 1), min(max(x, 0), n - 1)]
    for aperture, low, high in ((3, 75, 300), (5, 700, 900)):
        diff, smooth = edges.KERNELS[aperture]
        r = aperture // 2
        steps = range(-r, r + 1)
        d = {(y, x): tuple(sum((diff[b + r] * smooth[a + r] if k == 0 else diff[a + r] * smooth[b + r]) * held(y + a, x + b) for a in steps for b in steps) for k in (0, 1)) for y, x in v}
        m = {p: abs(a) + abs(b) for p, (a, b) in d.items()}
        thin = set()
        for (y, x), (dx, dy) in d.items():
            at = lambda a, b: m.get((y + a, x + b), 0)  # noqa: E731, B023
            ax, ay = abs(dx), abs(dy) << 15
            if ay < ax * edges.TANGENT:
                good = m[y, x] > at(0, -1) and m[y, x] >= at(0, 1)
            elif ay > ax * edges.TANGENT + (ax << 16):
                good = m[y, x] > at(-1, 0) and m[y, x] >= at(1, 0)
            else:
                s = -1 if (dx < 0) != (dy < 0) else 1
                good = m[y, x] > at(-1, -s) and m[y, x] > at(1, s)
            if good and m[y, x] > low:
                thin.add((y, x))
        todo = [p for p in thin if m[p] > high]
        want = set(todo)
        while todo:
            y, x = todo.pop()
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & thin - want
            want |= near
            todo += near
        assert {(e.y, e.x) for e in edges.canny(df, "gray", low, high, aperture).collect()} == want and want


def test_descriptors_of_a_turned_and_grown_outline(spark):
    """A square outline in small and in large, with colinear points, has the same descriptors as numpy's transform."""
    square = [(0, 0), (2, 0), (4, 0), (4, 4), (0, 4)]
    rows = [(k, i, (1 + k) * x, (1 + k) * y) for k in range(2) for i, (x, y) in enumerate(square)]
    got = {r.k: r.descriptors for r in fourier.descriptors(spark.createDataFrame(rows, "k int, ord long, x int, y int"), ["k"], 16, (2, 4)).collect()}
    angle = np.repeat([0, math.pi / 2, math.pi, -math.pi / 2], 4)
    e = np.abs(np.fft.fft(angle - angle[0])) ** 2
    want = [e[0:2].sum() / e.sum(), e[1:4].sum() / e.sum(), e[3:16].sum() / e.sum()]
    assert np.allclose(got[0], want) and np.allclose(got[1], want)
