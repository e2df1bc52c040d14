"""Colour normalization of tiles: the foreground's opponent colours get the mean and deviation of a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px

CHANNELS = ("l", "alpha", "beta")


def opponent(pixels: DataFrame, strict: bool = False) -> DataFrame:
    """Pixels (b, g, r from 0 to 255) with `fg` and, on the foreground, l, alpha, beta and `valid`. Strictly valid are
    colours with a logarithm; otherwise (the usual rule) those whose three values have a positive product."""
    lab = px.to_opponent(*(F.col(c) / 255.0 for c in "bgr"))
    fg = px.is_foreground(F.col("b"), F.col("g"), F.col("r"))
    rows = pixels.withColumn("fg", fg).withColumns({c: F.when(fg, v) for c, v in zip(CHANNELS, lab)})
    known = F.col("l").isNotNull() if strict else F.coalesce(F.col("l") * F.col("alpha") * F.col("beta") > 0, F.lit(False))
    return rows.withColumn("valid", F.col("fg") & known)


def statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Population mean and deviation of the valid pixels, per key (a tile, or none for a target)."""
    aggs = [f(c).alias(f"{n}_{c}") for c in CHANNELS for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return rows.filter("valid").groupBy(*keys).agg(*aggs)


def normalize(pixels: DataFrame, target: dict[str, float], strict: bool = False) -> DataFrame:
    """tile, y, x, b, g, r: valid foreground moved to the target's mean and deviation (names as `statistics` gives them);
    other pixels stay. A channel without spread in a tile gets the target's mean."""
    rows = opponent(pixels, strict)

    def moved(c: str) -> Column:
        spread = F.when(F.col(f"std_{c}") > 0, target[f"std_{c}"] / F.col(f"std_{c}")).otherwise(0.0)
        return (F.col(c) - F.col(f"mean_{c}")) * spread + target[f"mean_{c}"]

    new = px.from_opponent(*(moved(c) for c in CHANNELS))
    out = rows.join(statistics(rows, ["tile"]), "tile", "left")
    return out.select("tile", "y", "x", *(F.when(F.col("fg"), n).otherwise(F.col(c)).cast("int").alias(c) for c, n in zip("bgr", new)))
