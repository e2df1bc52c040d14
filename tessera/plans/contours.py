"""Measures of closed outlines given as rows: keys, ord (the order of the points), x, y."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def measures(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per outline: points, area (shoelace), pixels (Pick's rule, for outlines on whole points), arc length, compactness
    (length squared over area, less 4 pi), equivalent diameter and bending energy (sum of the angles of the sides; sides
    straight up or down count a right angle). One window per outline, closed by its first point."""
    order = Window.partitionBy(*keys).orderBy("ord")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).cast("double")
    p = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), after("x").alias("nx"), after("y").alias("ny"))
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    bend = F.when(dx != 0, F.atan(dy / F.when(dx != 0, dx))).otherwise(F.signum(dy) * F.acos(F.lit(-1.0)) / 2.0)
    s = p.groupBy(*keys).agg(F.count("*").alias("points"), (F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2.0).alias("area"), F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"),
                             F.sum(F.greatest(F.abs(dx), F.abs(dy))).alias("edge"), F.sum(bend).alias("bending"))
    some = F.when(F.col("area") > 0, F.col("area"))
    return s.select(*keys, "points", "area", (F.col("area") + F.col("edge") / 2.0 + 1.0).alias("pixels"), "length", (F.col("length") * F.col("length") / some - 4.0 * F.acos(F.lit(-1.0))).alias("compactness"), (2.0 * F.sqrt(some / F.acos(F.lit(-1.0)))).alias("diameter"), "bending")
