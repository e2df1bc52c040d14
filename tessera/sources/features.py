"""Feature tables: schema, upgrade of older layouts, and text output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Leading metadata columns of the older layouts, and the blocks of the feature vector (first, length).
META = ("bbox_x", "bbox_y", "bbox_w", "bbox_h", "centroid_x", "centroid_y")
BLOCKS = {"nuclear": (1, 23), "g": (24, 17), "h": (41, 17), "e": (58, 17)}


def upgrade(data: DataFrame, column: str = "data") -> DataFrame:
    """Rows whose array holds the six metadata values and then the features: the values as columns, the rest as
    `features`. Other columns stay."""
    meta = [F.try_element_at(F.col(column), F.lit(i + 1)).alias(n) for i, n in enumerate(META)]
    rest = F.slice(column, len(META) + 1, F.greatest(F.size(column) - len(META), F.lit(0)))
    return data.select(*(c for c in data.columns if c != column), *meta, rest.alias("features"))


def in_order(features: Column, order: tuple[str, ...] = ("nuclear", "h", "e", "g")) -> Column:
    """The blocks of a stored vector (nuclear, g, h, e) in the given order."""
    return F.concat(*(F.slice(features, *BLOCKS[b]) for b in order))


def outline(vertices: Column) -> Column:
    """`x,y; x,y` of an array of points (x, y)."""
    return F.array_join(F.transform(vertices, lambda v: F.concat_ws(",", v["x"].cast("string"), v["y"].cast("string"))), "; ")


def without_straight(vertices: Column) -> Column:
    """A closed outline without points on the straight line between the points before and after them."""
    n = F.size(vertices)
    at = lambda i: F.get(vertices, F.pmod(i, n))

    def bends(v: Column, i: Column) -> Column:
        a, c = at(i - 1), at(i + 1)
        return (v["x"] - a["x"]) * (c["y"] - v["y"]) != (v["y"] - a["y"]) * (c["x"] - v["x"])

    return F.when(n < 3, vertices).otherwise(F.filter(vertices, bends))


def report(objects: DataFrame) -> DataFrame:
    """One line (`value`) per object: slide, centre in slide coordinates, features and outline, tab-separated. objects:
    slide, tile_x, tile_y, centroid_x, centroid_y, features and vertices (points within the tile)."""
    moved = F.transform(without_straight(F.col("vertices")), lambda v: F.struct((v["x"] + F.col("tile_x")).alias("x"), (v["y"] + F.col("tile_y")).alias("y")))
    numbers = F.concat(F.lit("{"), F.array_join(F.transform("features", lambda v: v.cast("string")), ", "), F.lit("}"))
    return objects.select(F.concat_ws("\t", "slide", (F.col("centroid_x") + F.col("tile_x")).cast("string"), (F.col("centroid_y") + F.col("tile_y")).cast("string"), numbers, outline(moved)).alias("value"))


def write_table(features: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Flat features as text with a header, boxes moved by the tile's place if there is one; sep is a comma or a tab."""
    out = features
    if {"tile_x", "tile_y"} <= set(features.columns):
        out = out.withColumns({c: F.col(c) + F.col("tile_" + c[-1]) for c in ("min_x", "max_x", "min_y", "max_y") if c in out.columns}).drop("tile_x", "tile_y")
    out.write.csv(path, header=True, sep=sep, mode=mode)


def append(features: DataFrame, path: str) -> None:
    """Features added to a table, one folder an image."""
    features.write.partitionBy("image_name").mode("append").parquet(path)
