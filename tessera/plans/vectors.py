"""The vector of an object: 23 figures of its nucleus and 17 of the ring around it in each of three channels, in fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..operators import edges
from ..operators.staging import cut, shuffled
from . import objects

# The names and their order; the channels of the ring (gray, and the stains), in the order they are stored in.
SHAPE = ("area", "perimeter", "eccentricity", "circularity", "major_axis", "minor_axis", "extent")
INTENSITY = ("mean", "highest", "lowest", "std", "entropy", "energy", "skewness", "kurtosis")
RING_INTENSITY = ("mean", "mean_less_median", "highest", "lowest", "std", "entropy", "energy", "skewness", "kurtosis")
GRADIENT = ("mean", "std", "entropy", "energy", "skewness", "kurtosis")
EDGES = ("canny_area", "mean_canny")
CHANNELS = ("g", "h", "e")
LOW, HIGH, APERTURE = 75, 100, 3
NAMES = (
    *(f"nucleus_{n}" for n in SHAPE), *(f"nucleus_{n}" for n in INTENSITY), *(f"nucleus_gradient_{n}" for n in GRADIENT), *(f"nucleus_{n}" for n in EDGES),
    *(f"ring_{c}_{n}" for c in CHANNELS for n in (*RING_INTENSITY, *(f"gradient_{g}" for g in GRADIENT), *EDGES)),
)


def gradient(grid: DataFrame, value: str) -> Column:
    """Size of the central differences along rows and columns (one-sided at the tile's border), as a byte."""
    row, column = Window.partitionBy("tile", "y").orderBy("x"), Window.partitionBy("tile", "x").orderBy("y")
    v = F.col(value)

    def along(w) -> Column:
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        return F.coalesce(F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2.0), F.lit(0)).cast("double")

    dx, dy = along(row), along(column)
    return px.to_u8(F.sqrt(dx * dx + dy * dy))


def planes(grid: DataFrame) -> DataFrame:
    """tile, y, x, channel, v (its value), d (its gradient) and edge (1 where an edge runs, else null), of colour pixels. A channel
    of a tile is a tile of its own, so all are seen to at once."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    h, e = px.unmix(b, g, r, px.unmixing())
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), v.cast("int").alias("v")) for c, v in zip(CHANNELS, (px.gray(b, g, r), h, e), strict=True))))
    p = cut(grid.select("tile", "y", "x", each.alias("c")).select(F.struct("tile", "c.channel").alias("tile"), "y", "x", "c.v"))
    found = edges.canny(p, "v", LOW, HIGH, APERTURE).withColumn("edge", F.lit(1))
    out = p.withColumn("d", gradient(p, "v").cast("int")).join(found, ["tile", "y", "x"], "left")
    return out.select("tile.tile", "y", "x", "tile.channel", "v", "d", "edge")


def _figures(pixels: DataFrame, median: bool) -> DataFrame:
    """Per tile, label and channel: statistics of values, of gradients (gradient_...) and of edges."""
    keys = ["tile", "label", "channel"]
    long = cut(pixels)
    values, slopes = objects.histogram(long, keys, "v"), objects.histogram(long, keys, "d")
    out = objects.moments(values, keys)
    if median:
        out = out.join(objects.median_mean(values, keys), keys).withColumn("mean_less_median", F.col("mean") - F.col("median"))
    slopes = objects.moments(slopes, keys).select(*keys, *(F.col(n).alias(f"gradient_{n}") for n in GRADIENT))
    lines = long.groupBy(*keys).agg(F.count("edge").cast("double").alias("canny_area"), (255.0 * F.count("edge") / F.count("*")).alias("mean_canny"))
    return out.join(slopes, keys).join(lines, keys)


def object_vectors(labels: DataFrame, grid: DataFrame, radius: int = 8) -> DataFrame:
    """tile, label and features: the figures of NAMES, in order, as doubles. labels: tile, y, x, label; grid: tile, y, x, b, g, r,
    a row for every pixel. A figure that isn't defined (of a ring without pixels, or the skewness of equal values) is null."""
    keys = ["tile", "label"]
    p = cut(planes(grid))
    extent = grid.groupBy("tile").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    own = _figures(labels.select(*keys, "y", "x").join(p.filter(F.col("channel") == CHANNELS[0]), ["tile", "y", "x"]), False).drop("channel")
    around = _figures(objects.ring(labels, extent, radius).join(p, ["tile", "y", "x"]), True)
    names = (*RING_INTENSITY, *(f"gradient_{n}" for n in GRADIENT), *EDGES)
    wide = around.groupBy(*keys).agg(*(F.max(F.when(F.col("channel") == c, F.col(n))).alias(f"ring_{c}_{n}") for c in CHANNELS for n in names))
    shape = objects.morphometry(labels).select(*keys, *(F.col(n).alias(f"nucleus_{n}") for n in SHAPE))
    nucleus = own.select(*keys, *(F.col(n).alias(f"nucleus_{n}") for n in (*INTENSITY, *(f"gradient_{g}" for g in GRADIENT), *EDGES)))
    return shape.join(shuffled(nucleus), keys).join(shuffled(wide), keys, "left").select(*keys, F.array(*(F.col(n).cast("double") for n in NAMES)).alias("features"))
