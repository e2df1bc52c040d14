"""Feature rollups: mergeable partial sums per tile, then per image and per data set.

A feature table has one row per object with an array of features; in the driver's tables, embeddings play that part:
label is the image and vec_id % 8 the tile. Bad values (NaN, infinite, null) are counted and kept out of the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def features_long(df: DataFrame, keys: list[str], features: str = "features") -> DataFrame:
    """One row per object and feature: the keys, feature_idx and value (double)."""
    return df.select(*keys, F.posexplode(features).alias("feature_idx", "v")).select(*keys, "feature_idx", F.col("v").cast("double").alias("value"))


def tile_sum(long: DataFrame, keys: list[str]) -> DataFrame:
    """Partial sums per keys and feature_idx: nu_count, bad_count, nu_sum, nu_sum_square."""
    good = F.when(~is_bad(F.col("value")), F.col("value"))
    return long.groupBy(*keys, "feature_idx").agg(
        F.count("*").alias("nu_count"), F.sum(is_bad(F.col("value")).cast("long")).alias("bad_count"),
        F.sum(good).alias("nu_sum"), F.sum(good * good).alias("nu_sum_square"),
    )


def merge_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Partial sums of finer groups added up to coarser ones."""
    return sums.groupBy(*keys, "feature_idx").agg(*(F.sum(c).alias(c) for c in ("nu_count", "bad_count", "nu_sum", "nu_sum_square")))


def finalize(sums: DataFrame, ignore_bad: bool = False, digits: int = 9) -> DataFrame:
    """Mean and population deviation; over the good values, or over all rows with ignore_bad. None if there are none."""
    n = F.col("nu_count") if ignore_bad else F.col("nu_count") - F.col("bad_count")
    n = F.when(n > 0, n)
    mean = F.col("nu_sum") / n
    var = F.col("nu_sum_square") / n - mean * mean
    return sums.withColumn("nu_mean", F.round(mean, digits)).withColumn("nu_stdev", F.round(F.sqrt(F.greatest(var, F.lit(0.0))), digits))


def mean_vector(long: DataFrame, keys: list[str]) -> DataFrame:
    """The average of every feature over the good values of a group's objects, as one array in the order of feature_idx."""
    means = finalize(tile_sum(long, keys), digits=15)
    return means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("feature_idx", "nu_mean"))).alias("v")).select(*keys, F.col("v.nu_mean").alias("features"))


def longest_feature(long: DataFrame, normalise: bool = False) -> DataFrame:
    """The feature with the largest 2-norm over all rows (of equal ones the first), and the norm; or the norm over the root of
    the number of rows."""
    sums = tile_sum(long, []).withColumn("norm", F.sqrt(F.col("nu_sum_square") / (F.col("nu_count") if normalise else F.lit(1))))
    return sums.orderBy(F.desc("norm"), "feature_idx").limit(1).select("feature_idx", "norm")
