"""Features of objects: pixels with labels (tile, y, x, label) give one row per object, by aggregation alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.morphology import disc
from ..operators.regions import STRIDE
from ..operators.staging import shuffled


def shape(labels: DataFrame) -> DataFrame:
    """Per object: area, box, centre of the box, axes and eccentricity of the ellipse of equal second moments (with a
    pixel's own 1/12), and extent."""
    g = labels.groupBy("tile", "label").agg(
        F.count("*").alias("area"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        (F.var_pop("x") + 1.0 / 12.0).alias("mxx"), (F.var_pop("y") + 1.0 / 12.0).alias("myy"), F.covar_pop("x", "y").alias("mxy"),
    )
    delta = F.sqrt((F.col("mxx") - F.col("myy")) * (F.col("mxx") - F.col("myy")) + 4.0 * F.col("mxy") * F.col("mxy"))
    axis = lambda sign: math.sqrt(8.0) * F.sqrt(F.greatest(F.col("mxx") + F.col("myy") + sign * delta, F.lit(0.0)))
    box = (F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1)
    g = g.withColumns({"major_axis": axis(1), "minor_axis": axis(-1), "extent": F.col("area") / box, "centroid_x": (F.col("min_x") + F.col("max_x")) / 2.0, "centroid_y": (F.col("min_y") + F.col("max_y")) / 2.0})
    ecc = F.sqrt(F.abs(F.col("major_axis") * F.col("major_axis") - F.col("minor_axis") * F.col("minor_axis"))) / F.col("major_axis")
    return g.withColumn("eccentricity", ecc).drop("mxx", "myy", "mxy")


def perimeter(labels: DataFrame) -> DataFrame:
    """tile, label, perimeter: over all 2 x 2 windows, those outside the tile included, one or three pixels of the object
    count half a diagonal, two side by side one, two across the corner a diagonal. Each pixel votes in its four windows."""
    votes = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(bit).alias("bit")) for dy, dx, bit in ((0, 0, 1), (0, -1, 2), (-1, -1, 4), (-1, 0, 8))))
    w = labels.select("tile", "label", "y", "x", F.explode(votes).alias("v")).groupBy("tile", "label", (F.col("y") + F.col("v.dy")).alias("wy"), (F.col("x") + F.col("v.dx")).alias("wx")).agg(F.sum("v.bit").alias("bits"), F.count("*").alias("n"))
    half = 0.70710678118
    length = F.when(F.col("n").isin(1, 3), half).when(F.col("bits").isin(5, 10), math.sqrt(2.0)).when(F.col("n") == 2, 1.0).otherwise(0.0)
    return w.groupBy("tile", "label").agg(F.sum(length).alias("perimeter"))


def morphometry(labels: DataFrame) -> DataFrame:
    """Shape with perimeter and circularity (4 pi area over the perimeter's square)."""
    return shape(labels).join(perimeter(labels), ["tile", "label"]).withColumn("circularity", 4.0 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter")))


def histogram(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, bin, n."""
    return pixels.groupBy(*keys, F.col(value).alias("bin")).agg(F.count("*").alias("n"))


def moments(hist: DataFrame, keys: list[str], sample: bool = False) -> DataFrame:
    """Statistics of histograms: total, mean, least and greatest bin, deviation (population, or with `sample` over n - 1),
    entropy in bits, energy, population skewness, kurtosis (3 for a normal), and the pixels above bin 0. One aggregation:
    entropy is log2 N - sum(n log2 n) / N."""
    b, n = F.col("bin").cast("double"), F.col("n").cast("double")
    s = hist.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.min("bin").alias("lowest"), F.max("bin").alias("highest"), F.sum(n * F.log2(n)).alias("nlog"), F.sum(n * n).alias("nn"),
        F.sum(F.when(F.col("bin") != 0, F.col("n")).otherwise(0)).alias("nonzero"), *(F.sum(n * _power(b, k)).alias(f"s{k}") for k in range(1, 5)),
    )
    t = F.col("total").cast("double")
    m, e2, e3, e4 = (F.col(f"s{k}") / t for k in range(1, 5))
    var = F.greatest(e2 - m * m, F.lit(0.0))
    third = e3 - 3.0 * m * e2 + 2.0 * m * m * m
    fourth = e4 - 4.0 * m * e3 + 6.0 * m * m * e2 - 3.0 * m * m * m * m
    flat = var > 1e-9
    spread = F.sqrt(var * t / F.when(t > 1, t - 1.0)) if sample else F.sqrt(var)
    return s.select(*keys, "total", m.alias("mean"), "lowest", "highest", spread.alias("std"), (F.log2(t) - F.col("nlog") / t).alias("entropy"), (F.col("nn") / (t * t)).alias("energy"),
                    F.when(flat, third / (var * F.sqrt(var))).alias("skewness"), F.when(flat, fourth / (var * var)).alias("kurtosis"), "nonzero")


def _power(x: Column, k: int) -> Column:
    out = x
    for _ in range(k - 1):
        out = out * x
    return out


def median_mean(hist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median: the mean of the two middle pixels, rounded half up (the plain middle one for odd totals)."""
    flat = hist.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("total"))  # at most 256 bins a group

    def nth(k: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("int").alias("bin"))
        step = lambda a, e: F.struct((a["c"] + e["n"]).alias("c"), F.when(a["bin"].isNull() & (a["c"] + e["n"] >= k), e["bin"]).otherwise(a["bin"]).alias("bin"))
        return F.aggregate("h", zero, step)["bin"]

    low, high = nth(F.floor((F.col("total") + 1) / 2)), nth(F.floor(F.col("total") / 2) + 1)
    return flat.select(*keys, F.floor((low + high) / 2.0 + 0.5).cast("int").alias("median"))


#: Steps to the other pixel of a pair, by angle.
ANGLES = {0: (0, 1), 45: (-1, 1), 90: (-1, 0), 135: (-1, -1)}


def cooccurrence(pixels: DataFrame, keys: list[str], value: str, levels: int = 8) -> DataFrame:
    """keys, angle, i, j, n: pairs of gray levels (from 1) of neighbours at four angles; both pixels have the same keys."""
    level = F.floor(F.col(value) * (levels - 1.0) / 255.0 + 1.5).cast("int")
    p = pixels.select(*keys, "y", "x", level.alias("i"))
    steps = F.array(*(F.struct(F.lit(a).alias("angle"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for a, (dy, dx) in ANGLES.items()))
    ask = p.select(*keys, "i", "y", "x", F.explode(steps).alias("s")).select(*keys, F.col("s.angle").alias("angle"), "i", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    return ask.join(p.select(*keys, "y", "x", F.col("i").alias("j")), [*keys, "y", "x"]).groupBy(*keys, "angle", "i", "j").agg(F.count("*").alias("n"))


def texture(pairs: DataFrame, keys: list[str], distance: int = 1) -> DataFrame:
    """Texture of pair counts per key and angle: inertia, energy, entropy, homogeneity, greatest probability, cluster shade
    and prominence (about the pixel distance in place of i)."""
    keys = [*keys, "angle"]
    n = F.col("n").cast("double")
    i, j = F.col("i") - 1.0, F.col("j") - 1.0
    d = i - j
    s = pairs.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(n * n).alias("nn"), F.sum(n * F.log2(n)).alias("nlog"), F.max("n").alias("top"), F.sum(n * d * d).alias("dd"), F.sum(n / (1.0 + d * d)).alias("near"),
                                 F.sum(n * i).alias("mx"), *(F.sum(n * _power(j, k)).alias(f"j{k}") for k in range(1, 5)))
    t = F.col("t").cast("double")
    e1, e2, e3, e4 = (F.col(f"j{k}") / t for k in range(1, 5))
    c = float(distance) - F.col("mx") / t - e1  # the shift added to each j
    shade = e3 + 3.0 * c * e2 + 3.0 * c * c * e1 + c * c * c
    prominence = e4 + 4.0 * c * e3 + 6.0 * c * c * e2 + 4.0 * c * c * c * e1 + c * c * c * c
    return s.select(*keys, (F.col("dd") / t).alias("inertia"), (F.col("nn") / (t * t)).alias("energy"), (F.log2(t) - F.col("nlog") / t).alias("entropy"), (F.col("near") / t).alias("homogeneity"),
                    (F.col("top") / t).alias("max_probability"), shade.alias("cluster_shade"), prominence.alias("cluster_prominence"))


def ring(labels: DataFrame, extent: DataFrame, radius: int = 8) -> DataFrame:
    """tile, label, y, x of the pixels within the radius of an object and not of it, inside the tile's extent (tile, x0,
    x1, y0, y1). Only pixels on an object's edge are spread: the nearest pixel of an object is one of these. Pixels of
    other objects belong to the ring."""
    own = labels.select("tile", "label", "y", "x")
    sides = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))))
    told = own.select("tile", "label", F.explode(sides).alias("s"), "y", "x").select("tile", "label", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    inner = told.groupBy("tile", "label", "y", "x").agg(F.count("*").alias("n")).filter("n = 4")
    edge = own.join(inner, ["tile", "label", "y", "x"], "left_anti")
    around = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc(radius)))
    spread = edge.select("tile", "label", "y", "x", F.explode(around).alias("s")).select("tile", "label", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct()
    return shuffled(spread.join(own, ["tile", "label", "y", "x"], "left_anti")).join(extent, "tile").filter("x between x0 and x1 and y between y0 and y1").select("tile", "label", "y", "x")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Which objects of two labellings share pixels: tile, label_a, label_b, n."""
    return a.select("tile", "y", "x", F.col("label").alias("label_a")).join(b.select("tile", "y", "x", F.col("label").alias("label_b")), ["tile", "y", "x"]).groupBy("tile", "label_a", "label_b").agg(F.count("*").alias("n"))


def vector(features: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, features: the named columns in order as an array of floats."""
    return features.select(*keys, F.array(*(F.col(n).cast("float") for n in names)).alias("features"))


def first_pixel(label: Column) -> tuple[Column, Column]:
    """y and x of an object's first pixel, from its label."""
    return F.floor(label / STRIDE).cast("int"), (label % STRIDE).cast("int")
