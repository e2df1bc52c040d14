"""Regions and morphology on small tiles, against plain loops."""

import random

from pyspark.sql import functions as F

from tessera.operators import basins, morphology, regions, staging
from tessera.plans import objects, vectors

TILE = ["11000011", "10100001", "00011100", "01110100", "01010100", "01110001", "00000010", "10000001"]


def mask(spark, tile=TILE):
    return spark.createDataFrame([(7, y, x, c == "1") for y, row in enumerate(tile) for x, c in enumerate(row)], "tile long, y int, x int, on boolean")


def flood(on, conn):
    left, out = set(on), {}
    while left:
        first = min(left)
        left.discard(first)
        todo = [first]
        while todo:
            y, x = todo.pop()
            out[y, x] = first[0] * regions.STRIDE + first[1]
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if conn == 8 or not a * b} & left
            left -= near
            todo += near
    return out


def test_label(spark):
    on = {(y, x) for y, row in enumerate(TILE) for x, c in enumerate(row) if c == "1"}
    for conn in (4, 8):
        assert {(r.y, r.x): r.label for r in regions.label(mask(spark), conn).collect()} == flood(on, conn)
    assert regions.label(mask(spark).limit(0)).count() == 0
    assert regions.label(mask(spark, ["000"])).count() == 0


def test_holes(spark):
    got = {(r.y, r.x) for r in regions.fill_holes(mask(spark, ["0000", "0111", "0101", "0111"])).collect()}
    assert (2, 2) in got and len(got) == 9


def test_distance_of_a_tile_without_off_pixels_is_null(spark):
    assert {r.d2 for r in morphology.squared_distance(mask(spark, ["11", "11"])).collect()} == {None}


def test_reconstruct(spark):
    rng = random.Random(3)
    m = {(y, x): rng.randrange(10) for y in range(9) for x in range(9)}
    k = {p: v - rng.randrange(6) for p, v in m.items()}
    want, old = dict(k), None
    while want != old:
        old = want
        want = {(y, x): min(m[y, x], max(old.get((y + a, x + b), -99) for a in (-1, 0, 1) for b in (-1, 0, 1))) for y, x in m}
    df = spark.createDataFrame([(1, y, x, m[y, x], k[y, x]) for y, x in m], "tile long, y int, x int, m int, k int")
    assert {(r.y, r.x): r.value for r in morphology.reconstruct(df, "m", "k").collect()} == want


def _grid(spark, rng, height, width, top):
    v = {(y, x): (rng.randrange(top), rng.randrange(top)) for y in range(height) for x in range(width)}
    return v, spark.createDataFrame([(1, y, x, a, b) for (y, x), (a, b) in v.items()], "tile long, y int, x int, m int, k int")


def test_reconstruction_by_repeated_dilation(spark):
    rng = random.Random(3)
    for conn, top in ((8, 6), (4, 40)):
        v, df = _grid(spark, rng, 9, 14, top)
        want, old = {p: min(a, b - top // 3) for p, (a, b) in v.items()}, None
        while want != old:
            old = want
            near = lambda y, x: [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (conn == 8 or not a * b) and (y + a, x + b) in v]  # noqa: B023, E731
            want = {p: min(v[p][0], max(old[q] for q in near(*p))) for p in v}
        got = {(r.y, r.x): r.value for r in morphology.reconstruct(df.selectExpr("tile", "y", "x", "m", f"k - {top // 3} as k"), "m", "k", conn).collect()}
        assert got == want
    assert morphology.reconstruct(df.limit(0), "m", "k").count() == 0


def test_kernels_of_any_form(spark):
    v, df = _grid(spark, random.Random(5), 7, 11, 90)
    for offsets in (morphology.octagon(3, 4), [(0, -2), (0, 2), (1, 0), (-3, 1), (-3, 2)]):
        for f, least in ((morphology.dilate, max), (morphology.erode, min)):
            sign = 1 if least is max else -1
            want = {}
            for y, x in v:
                got = [v[y - sign * a, x - sign * b][0] for a, b in offsets if (y - sign * a, x - sign * b) in v]
                want[y, x] = least(got) if got else None
            found = {(r.y, r.x): r.m for r in f(df, "m", offsets).collect()}
            assert {p: found.get(p) for p in v} == want


def test_gray_holes_by_repeated_erosion(spark):
    """A pit is filled to its lowest rim; repeated erosion from the border above the pixels."""
    v, df = _grid(spark, random.Random(9), 8, 11, 30)
    at = {p: a for p, (a, _) in v.items()}
    want, old = {(y, x): a if y in (0, 7) or x in (0, 10) else 99 for (y, x), a in at.items()}, None
    while want != old:
        old = want
        want = {(y, x): max(at[y, x], min(old[y + a, x + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (y + a, x + b) in at)) for y, x in at}
    assert {(r.y, r.x): r.value for r in basins.fill_gray_holes(df, "m").collect()} == want


def _broadcasts(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_tables_between_rounds_are_not_broadcast(spark):
    """A table of pixels is many times its file, so joins with it shuffle, also once it is projected or grouped."""
    found = staging.cut(mask(spark))
    try:
        assert not _broadcasts(found.join(found.groupBy("tile", "y").agg(F.max("x").alias("x")), ["tile", "y", "x"]))
        labels = regions.label(mask(spark), 8)
        for df in (labels, regions.boxes(regions.by_area(labels, 3, 30)), regions.relabel(labels), regions.fill_holes(mask(spark)), basins.regional(mask(spark).withColumn("v", F.col("on").cast("int")), "v"), labels.join(mask(spark), ["tile", "y", "x"])):
            assert not _broadcasts(df)
        low = basins.regional(mask(spark).withColumn("v", F.col("on").cast("int")), "v")
        assert not _broadcasts(mask(spark).join(low, ["tile", "y", "x"], "left"))
    finally:
        staging.drop(found)


def _counted(monkeypatch):
    """A list that grows with every labelling that needs rounds of joins."""
    seen, rounds = [], regions._by_rounds
    monkeypatch.setattr(regions, "_by_rounds", lambda nodes, links: seen.append(links.count()) or rounds(nodes, links))
    return seen


def test_small_tiles_are_labelled_without_rounds(spark, monkeypatch):
    """Also where a batch ends inside a tile, and for tiles named by a struct."""
    seen = _counted(monkeypatch)
    monkeypatch.setattr(regions, "cut", lambda df: df)  # rounds would not end in time
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        on = {(y, x) for y, row in enumerate(TILE) for x, c in enumerate(row) if c == "1"}
        many = mask(spark).crossJoin(spark.range(40).withColumnRenamed("id", "copy")).withColumn("tile", F.struct("tile", "copy"))
        got = regions.label(many, 8).collect()
        assert len({r.tile for r in got}) == 40 and len(got) == 40 * len(on)
        assert all(flood(on, 8)[r.y, r.x] == r.label for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not seen


def test_regions_beyond_a_task(spark, monkeypatch):
    """Bands of two rows and parts of nine links: regions meet again by rounds."""
    seen = _counted(monkeypatch)
    rng = random.Random(11)
    tile = ["".join("1" if rng.random() < 0.55 else "0" for _ in range(30)) for _ in range(30)]
    on = {(y, x) for y, row in enumerate(tile) for x, c in enumerate(row) if c == "1"}
    stars = regions._stars

    monkeypatch.setattr(regions, "_stars", lambda batches: stars(b.slice(k, 4) for b in batches for k in range(0, b.num_rows, 4)))
    monkeypatch.setattr(regions, "BAND", 2)
    monkeypatch.setattr(regions, "MOST", 9)  # the replaced function takes its values along to the tasks
    for conn in (4, 8):
        assert {(r.y, r.x): r.label for r in regions.label(mask(spark, tile), conn).collect()} == flood(on, conn)
    assert len(seen) == 2


def test_objects_are_not_broadcast(spark):
    labels = regions.label(mask(spark), 8)
    extent = mask(spark).groupBy("tile").agg(*(f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))))
    colours = mask(spark).select("tile", "y", "x", *(F.col("on").cast("int").alias(c) for c in "bgr"))
    assert not _broadcasts(objects.ring(labels, extent, 2))
    assert not _broadcasts(vectors.object_vectors(labels, colours, 2))
