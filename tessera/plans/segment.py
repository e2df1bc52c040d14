"""Segmentation of nuclei: from the pixels of colour tiles (tile, y, x, b, g, r; a row for every pixel) to labelled objects
and an outcome for each tile.

A tile that is mostly background is left out. In the others, valleys of red (inverted red less its opening reconstructed) are
taken from a high limit on and widened to a low one; red cells go; holes are filled and thin parts opened; large objects are
parted where the distance to their edge has several deep basins; and what has the area of a nucleus is labelled.

Dividing lines are taken from the basin of the greater name; the tile's border doesn't count as background for the distance.
An empty table gives no objects and no outcomes; ties and repeated rows don't arise, as a pixel has one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..operators import basins, flooding, regions
from ..operators.morphology import dilate, disc, octagon, opened, reconstruct, squared_distance
from ..operators.staging import cut, drop

# Outcomes of a tile.
SUCCESS, BACKGROUND, BACKGROUND_LIKELY, NO_CANDIDATES = 0, 1, 2, 3

_AT = ["tile", "y", "x"]


@dataclass(frozen=True)
class Limits:
    """Background shares, red over green (seed and mask), red valleys (seed and mask), areas (from, below), kernel of the opening."""

    background: float = 0.99
    background_likely: float = 0.9
    red_seed: float = 5.0
    red_mask: float = 4.0
    valley_seed: int = 80
    valley_mask: int = 45
    candidate: tuple[int, int] = (11, 1000)
    large: int = 30
    nucleus: tuple[int, int] = (21, 1000)
    kernel: tuple[int, int] = (9, 14)


def outcomes(pixels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """tile, ratio, status of the background test; null for tiles that go on."""
    share = pixels.groupBy("tile").agg(F.avg(px.is_background(F.col("b"), F.col("g"), F.col("r")).cast("double")).alias("ratio"))
    return share.withColumn("status", F.when(F.col("ratio") >= limits.background, BACKGROUND).when(F.col("ratio") >= limits.background_likely, BACKGROUND_LIKELY))


def two_levels(pixels: DataFrame, low, high, conn: int = 8) -> DataFrame:
    """tile, y, x, label of the regions of pixels above the low limit (a condition) that hold a pixel above the high one."""
    labels = regions.label(pixels.select(*_AT, low.alias("on")), conn)
    return regions.select_seeded(labels, pixels.filter(high))


def red_cells(pixels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """tile, y, x of red blood cells: more red than green, in regions with a much redder pixel, and more red than blue."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    tiny = 1.1920928955078125e-07
    found = two_levels(pixels, r / (g + tiny) > limits.red_mask, r / (g + tiny) > limits.red_seed)
    return found.join(pixels.filter(r / (b + tiny) > 1.0), _AT, "left_semi").select(*_AT)


def valleys(pixels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """tile, y, x, depth: how much darker in red a pixel is than what surrounds it, at the scale of the kernel."""
    rc = pixels.select(*_AT, px.invert(F.col("r")).cast("int").alias("rc"))
    wide = opened(rc, "rc", octagon(*limits.kernel)).withColumnRenamed("rc", "marker")
    both = cut(rc.join(wide, _AT))
    out = both.join(reconstruct(both, "rc", "marker", 8), _AT).select(*_AT, (F.col("rc") - F.col("value")).alias("depth"))
    return out


def _on(grid: DataFrame, found: DataFrame) -> DataFrame:
    """The grid's pixels with a flag: whether the pixel is in the table."""
    return grid.select(*_AT).join(found.select(*_AT, F.lit(True).alias("on")), _AT, "left").withColumn("on", F.coalesce("on", F.lit(False)))


def candidates(pixels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """tile, y, x of the pixels that may belong to nuclei, red cells left out."""
    depth = cut(valleys(pixels, limits))
    seeds = regions.fill_holes(depth.select(*_AT, (F.col("depth") > limits.valley_seed).alias("on")), 8)
    seeds = regions.by_area(regions.label(seeds.withColumn("on", F.lit(True)), 8), *limits.candidate)
    wide = regions.select_seeded(regions.label(depth.select(*_AT, (F.col("depth") > limits.valley_mask).alias("on")), 8), seeds)
    return wide.select(*_AT).join(red_cells(pixels, limits), _AT, "left_anti")


def separate(pixels: DataFrame, mask: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """tile, y, x: the mask's large objects, widened by a pixel, flooded from their deep basins and parted along the lines
    between these. The colours flood (where they are equal, along the middle of the objects first), and what lies around an object is background with no colour, so a line runs along its
    edge too and takes the pixel again."""
    large = regions.by_area(regions.label(mask.select(*_AT, F.lit(True).alias("on")), 8), limits.large)
    big = cut(dilate(_on(pixels, large).select(*_AT, F.col("on").cast("int").alias("v")), "v", disc(1)).select(*_AT, (F.col("v") == 1).alias("on")))
    far = squared_distance(big).join(big.filter("on"), _AT, "left_semi").select(*_AT, F.sqrt(F.coalesce("d2", F.lit(1)).cast("double")).alias("d"), "d2")
    # basins less deep than a pixel are filled; pixels that touch the background keep their height
    far = cut(far.select(*_AT, "d", F.when(F.col("d2") <= 2, F.col("d")).otherwise(F.col("d") - 1.0).alias("less")))
    flat = cut(reconstruct(far, "d", "less", 8).select(*_AT, F.negative("value").alias("v")))
    deep = basins.regional(flat, "v", 8, maxima=False).select(*_AT, F.col("label").alias("marker"))
    # background pixels beside an object are roots of one name; others can't reach an object but through these
    edge = dilate(big.select(*_AT, F.col("on").cast("int").alias("v")), "v", disc(1)).filter("v = 1").drop("v").join(big, _AT)
    colours = [F.when(F.col("on"), F.col(c)).otherwise(0).alias(c) for c in "bgr"]
    marked = edge.join(pixels, _AT).join(deep, _AT, "left").join(flat, _AT, "left").select(*_AT, *colours, "v", F.when(F.col("on"), F.col("marker")).otherwise(F.lit(flooding.BACKGROUND)).alias("marker"))
    lined = flooding.closed_lines(flooding.lines(flooding.flood(marked, flooding.ordered(flooding.apart(["b", "g", "r"]), flooding.higher("v")))))
    out = cut(lined.filter((F.col("basin") != flooding.BACKGROUND) & ~F.col("line")).select(*_AT))
    drop(big, far, flat)
    return out


def segment(pixels: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """The objects (tile, y, x, label) and the outcome of every tile (tile, ratio, status)."""
    first = cut(outcomes(pixels, limits))
    going = cut(pixels.join(first.filter("status is null").select("tile"), "tile", "left_semi"))
    found = cut(candidates(going, limits))
    whole = regions.fill_holes(_on(going, found), 8)
    smooth = opened(_on(going, whole).select(*_AT, F.col("on").cast("int").alias("v")), "v", disc(1)).filter("v = 1")
    apart = separate(going, cut(smooth.select(*_AT)), limits)
    kept = regions.by_area(regions.label(apart.withColumn("on", F.lit(True)), 4), *limits.nucleus)
    final = regions.fill_holes(_on(going, kept), 8).withColumn("on", F.lit(True))
    labels = cut(regions.label(final, 8))
    drop(going, found)
    has = labels.select("tile").distinct().withColumn("some", F.lit(SUCCESS))
    status = first.join(has, "tile", "left").select("tile", "ratio", F.coalesce("status", "some", F.lit(NO_CANDIDATES)).alias("status"))
    return labels, status


def segment_objects(pixels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """tile, label, area and box of the objects."""
    return regions.boxes(segment(pixels, limits)[0])
