"""Edges of gray tiles (a row for every pixel): derivatives by windows, thinning across the edge, two limits.

The derivative along an axis is a kernel of differences along it and a binomial kernel across it; beyond the tile's border
the border's value goes on. A pixel is an edge if its magnitude (the sum of both derivatives' sizes) is over the low limit
and greatest across the edge, in one of four directions, and its 8-connected edge has a pixel over the high limit. All
steps are windows along rows and columns; only the last is a labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .regions import label, select_seeded
from .staging import cut, drop

# Kernels (difference, smoothing) by aperture; the tangent of 22.5 degrees in 1 / 32768.
KERNELS = {3: ((-1, 0, 1), (1, 2, 1)), 5: ((-1, -2, 0, 2, 1), (1, 4, 6, 4, 1))}
TANGENT = 13573


def _row() -> WindowSpec:
    return Window.partitionBy("tile", "y").orderBy("x")


def _column() -> WindowSpec:
    return Window.partitionBy("tile", "x").orderBy("y")


def _held(c: str, w, d: int) -> Column:
    """The value d steps on, or the border's."""
    step = (lambda k: F.lag(c, -k).over(w)) if d < 0 else (lambda k: F.lead(c, k).over(w))
    return F.coalesce(*(step(k) for k in (range(d, 0) if d < 0 else range(d, 0, -1))), F.col(c)) if d else F.col(c)


def _kernel(c: str, w, weights: tuple[int, ...]) -> Column:
    r = len(weights) // 2
    terms = [_held(c, w, d - r) * k for d, k in enumerate(weights) if k]
    return sum(terms[1:], terms[0])


def derivatives(gray: DataFrame, value: str, aperture: int = 3) -> DataFrame:
    """tile, y, x, dx, dy: whole numbers."""
    difference, smoothing = KERNELS[aperture]
    g = gray.select("tile", "y", "x", F.col(value).cast("long").alias("v"))
    along = g.select("tile", "y", "x", _kernel("v", _row(), difference).alias("d"), _kernel("v", _row(), smoothing).alias("s"))
    return along.select("tile", "y", "x", _kernel("d", _column(), smoothing).alias("dx"), _kernel("s", _column(), difference).alias("dy"))


def thinned(gray: DataFrame, value: str, low: float, aperture: int = 3) -> DataFrame:
    """tile, y, x, m, on: the magnitude, and whether it is over the low limit and greatest across the edge. Beyond the tile it
    is 0; of two equal ones the first along the row, or else the upper one, counts."""
    d = derivatives(gray, value, aperture).withColumn("m", F.abs("dx") + F.abs("dy"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    d = d.withColumns({"left": zero(F.lag("m").over(_row())), "right": zero(F.lead("m").over(_row()))})
    up = {f"up_{c}": zero(F.lag(c).over(_column())) for c in ("m", "left", "right")}
    down = {f"down_{c}": zero(F.lead(c).over(_column())) for c in ("m", "left", "right")}
    d = d.withColumns(up | down)
    m, ax, ay = F.col("m"), F.abs("dx"), F.abs("dy") * 32768
    flat, steep = ay < ax * TANGENT, ay > ax * TANGENT + ax * 65536
    falling = (F.col("dx") < 0) != (F.col("dy") < 0)
    across = F.when(falling, (m > F.col("up_right")) & (m > F.col("down_left"))).otherwise((m > F.col("up_left")) & (m > F.col("down_right")))
    greatest = F.when(flat, (m > F.col("left")) & (m >= F.col("right"))).when(steep, (m > F.col("up_m")) & (m >= F.col("down_m"))).otherwise(across)
    return d.select("tile", "y", "x", "m", ((m > low) & greatest).alias("on"))


def canny(gray: DataFrame, value: str, low: float, high: float, aperture: int = 3) -> DataFrame:
    """tile, y, x of the edge pixels."""
    thin = cut(thinned(gray, value, low, aperture).filter("on"))
    out = select_seeded(label(thin, 8), thin.filter(F.col("m") > high)).select("tile", "y", "x")
    out = cut(out)
    drop(thin)
    return out


def sobel(gray: DataFrame, value: str, aperture: int = 3) -> DataFrame:
    """tile, y, x, m: both derivatives' sizes as bytes, averaged."""
    byte = lambda c: F.least(F.abs(c), F.lit(255))
    return derivatives(gray, value, aperture).select("tile", "y", "x", ((byte("dx") + byte("dy")) / 2).alias("m"))


def edge_features(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Per object (tile, label): canny_area, its edge pixels, and mean_canny, the mean of 255 on edges and 0 elsewhere."""
    seen = labels.join(edges.select("tile", "y", "x", F.lit(1).alias("edge")), ["tile", "y", "x"], "left")
    return seen.groupBy("tile", "label").agg(F.count("edge").alias("canny_area"), (255.0 * F.count("edge") / F.count("*")).alias("mean_canny"))
