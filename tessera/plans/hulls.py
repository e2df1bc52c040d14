"""Convex hulls of objects and what is measured with them, by aggregation and a fold over an object's rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turn(o: Column, a: Column, b: Column) -> Column:
    """Twice the signed area of the triangle."""
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _chain(points: Column, sign: int) -> Column:
    """The hull's left (sign 1) or right side over points from top to bottom. A new point ends the chain after the last place
    where the chain still turns toward it; in a convex chain these places come first, so counting them tells where."""

    def add(chain: Column, p: Column) -> Column:
        places = F.sequence(F.lit(2), F.size(chain))
        bends = F.filter(places, lambda i: sign * _turn(F.element_at(chain, i - 1), F.element_at(chain, i), p) < 0)
        kept = F.when(F.size(chain) < 2, chain).otherwise(F.slice(chain, 1, 1 + F.size(bends)))
        return F.concat(kept, F.array(p))

    return F.aggregate(points, F.slice(points, 1, 0), add)


def hulls(labels: DataFrame) -> DataFrame:
    """tile, label, hull: corners of the convex hull of an object's pixels (as squares), down its left side and up its right
    one. Only the first and last pixel of each row go on, so an object brings two points a row to its fold."""
    rows = labels.groupBy("tile", "label", "y").agg(F.min("x").alias("first"), (F.max("x") + 1).alias("last"))
    at = rows.select("tile", "label", "first", "last", F.explode(F.array(F.col("y"), F.col("y") + 1)).alias("y"))
    at = at.groupBy("tile", "label", "y").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    point = lambda c: F.struct(F.col("y").cast("long").alias("y"), F.col(c).cast("long").alias("x"))
    sides = at.groupBy("tile", "label").agg(F.sort_array(F.collect_list(point("first"))).alias("left"), F.sort_array(F.collect_list(point("last"))).alias("right"))
    return sides.select("tile", "label", F.concat(_chain(F.col("left"), 1), F.reverse(_chain(F.col("right"), -1))).alias("hull"))


def hull_area(hull: Column) -> Column:
    """Area of a closed list of corners."""
    n = F.size(hull)
    cross = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(hull, i)["x"] * F.element_at(hull, i % n + 1)["y"] - F.element_at(hull, i)["y"] * F.element_at(hull, i % n + 1)["x"])
    return F.abs(F.aggregate(cross, F.lit(0).cast("long"), lambda s, v: s + v)) / 2.0


def euler(labels: DataFrame, conn: int = 8) -> DataFrame:
    """tile, label, euler: regions less holes, from how many 2 x 2 windows hold one, three or two crosswise pixels."""
    votes = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(bit).alias("bit")) for dy, dx, bit in ((0, 0, 1), (0, -1, 2), (-1, -1, 4), (-1, 0, 8))))
    w = labels.select("tile", "label", "y", "x", F.explode(votes).alias("v")).groupBy("tile", "label", (F.col("y") + F.col("v.dy")).alias("wy"), (F.col("x") + F.col("v.dx")).alias("wx")).agg(F.sum("v.bit").alias("bits"))
    cross = -2 if conn == 8 else 2
    part = F.when(F.col("bits").isin(1, 2, 4, 8), 1).when(F.col("bits").isin(7, 11, 13, 14), -1).when(F.col("bits").isin(5, 10), cross).otherwise(0)
    return w.groupBy("tile", "label").agg((F.sum(part) / 4).cast("long").alias("euler"))


def measures(labels: DataFrame, conn: int = 8) -> DataFrame:
    """Per object: area, convex_area, solidity, convex_deficiency, euler, diameter of the circle of equal area, orientation
    (degrees from the x axis, counted upward) and elongation (1 less the minor over the major axis of equal moments)."""
    s = labels.groupBy("tile", "label").agg(F.count("*").alias("area"), (F.var_pop("x") + 1.0 / 12.0).alias("mxx"), (F.var_pop("y") + 1.0 / 12.0).alias("myy"), F.covar_pop("x", "y").alias("mxy"))
    d = F.sqrt((F.col("mxx") - F.col("myy")) * (F.col("mxx") - F.col("myy")) + 4.0 * F.col("mxy") * F.col("mxy"))
    minor = F.sqrt(F.greatest(F.col("mxx") + F.col("myy") - d, F.lit(0.0)) / (F.col("mxx") + F.col("myy") + d))
    # a moment of rounding is no slope
    slope = F.when(F.abs("mxy") > 1e-9, F.negative("mxy")).otherwise(0.0)
    angle = F.degrees(F.atan2(2.0 * slope, F.col("mxx") - F.col("myy")) / 2.0)
    round_one = d < 1e-9
    h = hulls(labels).select("tile", "label", hull_area(F.col("hull")).alias("convex_area"))
    all_ = s.withColumns({"orientation": F.when(round_one, 0.0).otherwise(angle), "elongation": 1.0 - minor}).join(h, ["tile", "label"]).join(euler(labels, conn), ["tile", "label"])
    return all_.select("tile", "label", "area", "convex_area", (F.col("area") / F.col("convex_area")).alias("solidity"), (F.col("convex_area") - F.col("area")).alias("convex_deficiency"), "euler", (2.0 * F.sqrt(F.col("area") / math.pi)).alias("diameter"), "orientation", "elongation")
