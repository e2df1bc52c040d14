"""Objects, normalization and basins on small tiles, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import pixels as px
from tessera.operators import basins
from tessera.plans import normalize, objects


def test_square(spark):
    labels = spark.createDataFrame([(1, y, x, 9) for y in range(3) for x in range(4)], "tile long, y int, x int, label long")
    r = objects.morphometry(labels).first()
    assert (r.area, r.min_x, r.max_x, r.extent, r.centroid_x) == (12, 0, 3, 1.0, 1.5)
    assert r.perimeter == pytest.approx(2 * 2 + 2 * 3 + 4 * 0.70710678118)  # ten window sides and four corners
    assert r.major_axis == pytest.approx(16 / 12**0.5) and r.minor_axis == pytest.approx(12 / 12**0.5)


def test_moments_of_a_flat_group_and_of_an_empty_one(spark):
    h = objects.histogram(spark.createDataFrame([(1, 5)] * 4, "k int, v int"), ["k"], "v")
    r = objects.moments(h, ["k"]).first()
    assert (r.total, r.mean, r.std, r.entropy, r.energy, r.skewness, r.kurtosis) == (4, 5.0, 0.0, 0.0, 1.0, None, None)
    assert objects.moments(h.limit(0), ["k"]).count() == 0


def test_opponent_colours_and_back(spark):
    df = spark.createDataFrame([(i, 255 - i, (i * 7) % 256) for i in range(5, 250, 9)] + [(0, 0, 0)], "b int, g int, r int")
    back = px.from_opponent(*px.to_opponent(*(F.col(c) / 255.0 for c in "bgr")))
    for r in df.select("b", "g", "r", *(v.alias("n" + c) for c, v in zip("bgr", back))).collect():
        assert max(abs(r.b - r.nb), abs(r.g - r.ng), abs(r.r - r.nr)) <= 1


def test_normalizing_to_its_own_figures_changes_little(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(1, y, x, rng.randrange(60, 120), rng.randrange(20, 90), rng.randrange(90, 160)) for y in range(8) for x in range(8)], "tile long, y int, x int, b int, g int, r int")
    own = normalize.statistics(normalize.opponent(df, strict=True), []).first().asDict()
    new = normalize.normalize(df, own, strict=True).join(df.select("y", "x", *(F.col(c).alias("o" + c) for c in "bgr")), ["y", "x"])
    assert new.count() == 64 and new.filter(" or ".join(f"abs({c} - o{c}) > 1" for c in "bgr")).count() == 0


def test_shallow_minima(spark):
    rng = random.Random(7)
    v = {(y, x): rng.randrange(40) for y in range(7) for x in range(7)}
    near = lambda p: [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (p[0] + a, p[1] + b) in v]
    want, old = {p: -v[p] - 9 for p in v}, None
    while want != old:
        old = want
        want = {p: min(-v[p], max(old[q] for q in near(p))) for p in v}
    df = spark.createDataFrame([(1, y, x, c) for (y, x), c in v.items()], "tile long, y int, x int, v int")
    assert {(r.y, r.x): r.value for r in basins.drop_shallow_minima(df, "v", 9).collect()} == {p: -w for p, w in want.items()}


def test_lines_part_the_basins(spark):
    df = spark.createDataFrame([(1, y, x, abs(x - 2) if x < 5 else abs(x - 8)) for y in range(4) for x in range(11)], "tile long, y int, x int, v int")
    found = basins.basins(df, "v")
    assert {r.basin for r in found.collect()} == {2, 8}
    assert {(r.y, r.x) for r in basins.dividing_lines(found).collect()} == {(y, 6) for y in range(4)}  # the ridge at 5 goes to the lesser name, 2
