"""Segmentation of tiles with planted discs."""

from tessera.plans import segment


def test_planted_objects(spark):
    discs = [(20, 20, 7), (20, 45, 7), (20, 55, 7), (48, 15, 1), (48, 40, 7)]  # alone, two that touch, too small, a red cell
    rows = []
    for y in range(64):
        for x in range(64):
            hit = [k for k, (v, u, r) in enumerate(discs) if (y - v) ** 2 + (x - u) ** 2 <= r * r]
            rows.append((1, y, x, *((90, 60, 70) if hit and hit[0] < 4 else (10, 10, 90) if hit else (180, 180, 200))))
            rows.append((2, y, x, 250, 250, 250))
            rows.append((3, y, x, 180, 180, 200))
    df = spark.createDataFrame(rows, "tile long, y int, x int, b int, g int, r int").repartition(4)
    labels, status = segment.segment(df)
    assert {r.tile: r.status for r in status.collect()} == {1: segment.SUCCESS, 2: segment.BACKGROUND, 3: segment.NO_CANDIDATES}
    objects = sorted((r.min_x + r.max_x) / 2 for r in labels.groupBy("label").agg({"x": "min"}).join(segment.regions.boxes(labels), "label").collect())
    assert len(objects) == 3 and all(abs(a - b) <= 2 for a, b in zip(objects, (20, 44, 56), strict=True))
