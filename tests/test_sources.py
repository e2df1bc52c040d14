"""Images, names and text output."""

from pyspark.sql import functions as F

from tessera.sources import features, tiles


def test_pixels_of_images(spark, tmp_path):
    (tmp_path / "a-0000000012-0000000007.ppm").write_bytes(b"P6\n# note\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6]))
    (tmp_path / "b.pgm").write_bytes(b"P5 1 3 255\n" + bytes([7, 8, 9]))
    (tmp_path / "c.pgm").write_bytes(b"P5 9 9 255\n" + bytes([7]))
    (tmp_path / "d.pgm").write_bytes(b"")
    x, y = tiles.position(tiles.file_name(F.col("path")))
    got = {(r.path[-5:], r.tx, r.ty, r.y, r.x, r.b, r.g, r.r) for r in tiles.read_pixels(spark, str(tmp_path)).withColumns({"tx": x, "ty": y}).collect()}
    assert got == {("7.ppm", 12, 7, 0, 0, 3, 2, 1), ("7.ppm", 12, 7, 0, 1, 6, 5, 4)} | {("b.pgm", None, None, i, 0, 7 + i, 7 + i, 7 + i) for i in range(3)}
    assert tiles.list_files(spark, str(tmp_path), ".pgm").count() == 2  # not the empty one


def test_report(spark):
    points = "array(named_struct('x', 0, 'y', 0), named_struct('x', 1, 'y', 0), named_struct('x', 2, 'y', 0), named_struct('x', 2, 'y', 2))"
    df = spark.range(1).selectExpr("'s' as slide", "10 as tile_x", "20 as tile_y", "1.5D as centroid_x", "0.5D as centroid_y", "array(1.0D, 2.5D) as features", f"{points} as vertices")
    assert features.report(df).first().value == "s\t11.5\t20.5\t{1.0, 2.5}\t10,20; 12,20; 12,22"


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("i", 100, 200, 1, 2, 3, 4, 0.5)], "image_name string, tile_x int, tile_y int, min_x int, max_x int, min_y int, max_y int, extent double")
    features.write_table(df, str(tmp_path / "t"), "\t")
    assert spark.read.csv(str(tmp_path / "t"), header=True, sep="\t").first().asDict() == {"image_name": "i", "min_x": "101", "max_x": "102", "min_y": "203", "max_y": "204", "extent": "0.5"}
    for _ in range(2):
        features.append(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    order = spark.range(1).select(features.in_order(F.sequence(F.lit(0), F.lit(73))).alias("o")).first().o
    assert order[:23] == list(range(23)) and order[23:] == [*range(40, 74), *range(23, 40)]
