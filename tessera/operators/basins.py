"""Regional extremes, shallow-minimum removal and watershed basins on pixel tables (tile, y, x and a value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .morphology import disc, reconstruct, square
from .regions import plateaus
from .staging import cut, drop, shuffled


def _neighbours(flat: DataFrame, conn: int) -> DataFrame:
    """tile, label, value, other, level: plateaus that touch, both ways."""
    offsets = [o for o in (square(1) if conn == 8 else disc(1)) if o != (0, 0)]
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets))
    ask = flat.select("tile", "label", "value", "y", "x", F.explode(steps).alias("s")).select("tile", "label", "value", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    there = flat.select("tile", "y", "x", F.col("label").alias("other"), F.col("value").alias("level"))
    return ask.join(there, ["tile", "y", "x"]).filter("label != other").select("tile", "label", "value", "other", "level").distinct()


def regional(pixels: DataFrame, value: str, conn: int = 8, maxima: bool = True) -> DataFrame:
    """tile, y, x, label of the plateaus without a greater neighbour (or, for minima, a smaller one)."""
    flat = cut(plateaus(pixels, value, conn))
    beaten = _neighbours(flat, conn).filter("level > value" if maxima else "level < value").select("tile", "label").distinct()
    return shuffled(flat.join(beaten, ["tile", "label"], "left_anti").select("tile", "y", "x", "label"))


def drop_shallow_minima(pixels: DataFrame, value: str, depth: float, conn: int = 8) -> DataFrame:
    """tile, y, x, value: minima less deep than `depth` are filled up; the others lose that depth."""
    up = pixels.select("tile", "y", "x", F.negative(value).alias("m"), (F.negative(value) - depth).alias("k"))
    return reconstruct(up, "m", "k", conn).select("tile", "y", "x", F.negative("value").alias("value"))


def fill_gray_holes(pixels: DataFrame, value: str, conn: int = 8) -> DataFrame:
    """tile, y, x, value: dark places that no way leads out of, but over brighter pixels, are raised to the least height that
    leads to the tile's border. A row for every pixel of a tile."""
    edge = pixels.groupBy("tile").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max(value).alias("top"))
    up = pixels.select("tile", "y", "x", F.negative(value).alias("m")).join(edge, "tile")
    marker = F.when(F.col("x").isin(F.col("x0"), F.col("x1")) | F.col("y").isin(F.col("y0"), F.col("y1")), F.col("m")).otherwise(F.negative("top"))
    return reconstruct(up.select("tile", "y", "x", "m", marker.alias("k")), "m", "k", conn).select("tile", "y", "x", F.negative("value").alias("value"))


def basins(pixels: DataFrame, value: str, conn: int = 8) -> DataFrame:
    """tile, y, x, basin: every pixel goes down to a regional minimum, whose first pixel names the basin.

    A plateau moves as a whole to its lowest neighbour (ties: the lesser label). Pointers are then doubled, so the rounds
    grow with the logarithm of the longest way down."""
    flat = cut(plateaus(pixels, value, conn))
    down = _neighbours(flat, conn).filter("level < value").groupBy("tile", "label").agg(F.min(F.struct("level", "other")).alias("to"))
    to = flat.select("tile", "label").distinct().join(down, ["tile", "label"], "left").select("tile", "label", F.coalesce("to.other", "label").alias("to"))
    made = cut(to)
    to = made
    while True:
        on = to.select("tile", F.col("label").alias("to"), F.col("to").alias("next"))
        new = cut(to.join(on, ["tile", "to"]).select("tile", "label", "to", "next"))
        drop(made)
        made, to = new, new.select("tile", "label", F.col("next").alias("to"))
        if new.filter("to != next").isEmpty():
            out = cut(flat.join(to, ["tile", "label"]).select("tile", "y", "x", F.col("to").alias("basin")))
            drop(flat, made)
            return out


def dividing_lines(found: DataFrame, conn: int = 8) -> DataFrame:
    """tile, y, x of the pixels that touch a basin with a lesser name: basins are apart once these are taken away."""
    offsets = [o for o in (square(1) if conn == 8 else disc(1)) if o != (0, 0)]
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets))
    told = found.select("tile", F.col("basin").alias("near"), F.explode(steps).alias("s"), "y", "x").select("tile", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "near")
    least = told.groupBy("tile", "y", "x").agg(F.min("near").alias("near"))
    return found.join(least, ["tile", "y", "x"]).filter("near < basin").select("tile", "y", "x")
