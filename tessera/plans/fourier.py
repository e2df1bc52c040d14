"""Fourier descriptors of outlines: keys, ord, x, y (closed by their first point)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resampled(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, j (0 to k), x, y: the outline at equal lengths of arc. Running sums of the sides tell each side which of the places
    it holds, so no place is sought; outlines without length are left out."""
    order = Window.partitionBy(*keys).orderBy("ord")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).cast("double")
    s = points.select(*keys, "ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), after("x").alias("nx"), after("y").alias("ny"), F.lead("ord").over(order).isNull().alias("ends"))
    s = s.withColumn("length", F.sqrt((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y"))))
    s = s.withColumns({"to": F.sum("length").over(order), "total": F.sum("length").over(whole)}).filter("total > 0 and length > 0")
    at = (F.col("to") - F.col("length")) / F.col("total") * k
    end = F.when(F.col("ends"), k).otherwise(F.ceil(F.col("to") / F.col("total") * k - 1e-9) - 1)
    begin = F.ceil(at - 1e-9)
    some = s.withColumns({"at": at, "begin": begin, "end": end}).filter("begin <= end").withColumn("j", F.explode(F.sequence("begin", "end")))
    part = (F.col("j") - F.col("at")) * F.col("total") / k / F.col("length")
    return some.select(*keys, F.col("j").cast("int").alias("j"), (F.col("x") + (F.col("nx") - F.col("x")) * part).alias("x"), (F.col("y") + (F.col("ny") - F.col("y")) * part).alias("y"))


def energies(angles: Column, k: int) -> Column:
    """Squared sizes of the transform of k values, one for each frequency from 0; by a table of k phases."""
    cos = F.array(*(F.lit(math.cos(2 * math.pi * i / k)) for i in range(k)))
    sin = F.array(*(F.lit(math.sin(2 * math.pi * i / k)) for i in range(k)))
    part = lambda phases, f: F.aggregate(F.transform(angles, lambda a, j: a * F.element_at(phases, (f * j % k + 1).cast("int"))), F.lit(0.0), lambda s, v: s + v)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.pow(part(cos, f), 2) + F.pow(part(sin, f), 2))


def descriptors(points: DataFrame, keys: list[str], k: int = 32, borders: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """keys, descriptors: shares of the spectral energy of the outline's cumulative angle in bands between borders (places from
    1, both ends in; 1 and k are added). The angle is the direction of each of k sides less that of the first. An outline
    without spectral energy has none. k numbers of an outline meet in a row."""
    edges = [1, *(b for b in borders if b != 1)]
    edges += [k] if edges[-1] != k // 2 else []
    p = resampled(points, keys, k)
    order = Window.partitionBy(*keys).orderBy("j")
    turn = F.atan2(F.round(F.lead("y").over(order) - F.col("y"), 9), F.round(F.lead("x").over(order) - F.col("x"), 9))
    a = p.select(*keys, "j", turn.alias("angle")).filter(F.col("j") < k)
    rows = a.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "angle"))), lambda s: s["angle"]).alias("angles"))
    cumulative = F.transform("angles", lambda v: v - F.element_at("angles", 1))
    e = rows.select(*keys, energies(cumulative, k).alias("e")).withColumn("all", F.aggregate("e", F.lit(0.0), lambda s, v: s + v))
    band = lambda lo, hi: F.aggregate(F.slice("e", lo, hi - lo + 1), F.lit(0.0), lambda s, v: s + v) / F.when(F.col("all") > 0, F.col("all"))
    return e.select(*keys, F.array(*(band(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False))).alias("descriptors"))
