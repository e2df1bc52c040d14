"""Ranks of many columns at once: quantile normalization; and the silhouette of clusters from sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import cut, drop
from .learning import squared_distance

#: Rows that a range of a column's values has on average.
RANGE_ROWS = 50_000


def ranked(long: DataFrame, column: str, value: str, order: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows with `rank`, from 1 in each column by value, then `order`. A column is cut into ranges at values that its own
    rows give (approximate quantiles), whose counts are added up first; a window sorts one range only. Rows with one value
    that fill many ranges are dealt by `order` (a number) within that value, so no range grows with them."""
    rows = cut(long)
    sizes = rows.groupBy(column).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // range_rows))
    ends = [i / parts for i in range(1, parts)]
    if ends:
        # approximate quantiles differ from run to run, so rows and counts read the same ones from a written table
        borders = cut(rows.groupBy(column).agg(F.sort_array(F.percentile_approx(value, ends, 10 * parts)).alias("ends")))
        # the borders below the value, found by halving: borders rise
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(ends).bit_length()))))
        at = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get("ends", n + step - 1) < F.col(value), n + step).otherwise(n))
        dealt = rows.join(borders, column).withColumn("part", at).drop("ends")
        same = dealt.groupBy(column, "part").agg(F.count("*").alias("n"), F.min(order).alias("o0"), F.max(order).alias("o1"), F.countDistinct(value).alias("kinds"))
        # a range of one value is split evenly along the order
        cuts = F.when((F.col("kinds") == 1) & (F.col("n") > 2 * range_rows), F.ceil(F.col("n") / range_rows)).otherwise(1)
        dealt = dealt.join(same.select(column, "part", "o0", "o1", cuts.alias("cuts")), [column, "part"])
        sub = F.least(F.floor((F.col(order) - F.col("o0")) / (F.col("o1") - F.col("o0") + 1) * F.col("cuts")), F.col("cuts") - 1)
        dealt = dealt.withColumn("sub", F.coalesce(sub, F.lit(0)).cast("long")).drop("o0", "o1", "cuts")
    else:
        dealt = rows.withColumn("part", F.lit(0)).withColumn("sub", F.lit(0).cast("long"))
    dealt = cut(dealt)
    drop(rows, *([borders] if ends else []))
    counts = dealt.groupBy(column, "part", "sub").agg(F.count("*").alias("n"))
    before = Window.partitionBy(column).orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(column, "part", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(column, "part", "sub").orderBy(value, order))
    return dealt.withColumn("inside", inside).join(offsets, [column, "part", "sub"]).withColumn("rank", F.col("inside") + F.col("before")).drop("part", "sub", "inside", "before")


def quantile_normalized(long: DataFrame, column: str = "feature_idx", value: str = "value", order: str = "id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows with `normal` in place of their value: the mean, over all columns, of the values of the same rank, so that all
    columns get one distribution. Columns have equally many rows; rows of equal value get the mean of their ranks' means.
    Nulls are left out by the caller."""
    r = cut(ranked(long.select(column, order, value), column, value, order, range_rows))
    means = r.groupBy("rank").agg(F.avg(value).alias("at_rank"))
    placed = cut(r.join(means, "rank").select(column, order, value, "at_rank"))
    drop(r)
    ties = placed.groupBy(column, value).agg(F.avg("at_rank").alias("normal"))
    return placed.select(column, order, value).join(ties, [column, value]).select(column, order, "normal")


def silhouette(rows: DataFrame, cluster: str, id_col: str = "id", features: str = "features") -> DataFrame:
    """id, cluster, silhouette (squared Euclidean): (b - a) / max(a, b), where a is a row's mean squared distance to the others
    of its cluster, and b the least mean one to another cluster; 0 in a cluster of one, null with one cluster. A cluster's
    count, sum and sum of squares give every mean distance, so no pairs are made. The clusters' sums, one row each, come to
    the driver; clusters are a model's, not data."""
    f = F.col(features).cast("array<double>")
    held = rows.select(F.col(id_col).alias("id"), F.col(cluster).alias("cluster"), f.alias("f"))
    dims = held.select(F.size("f")).first()
    if dims is None:
        return held.select("id", "cluster", F.lit(None).cast("double").alias("silhouette"))
    square = F.aggregate("f", F.lit(0.0), lambda s, v: s + v * v)
    found = held.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(square).alias("q"), *(F.sum(F.col("f")[i]).alias(f"s{i}") for i in range(dims[0]))).collect()  # one row a cluster

    def mean_to(r) -> Column:
        """Sum of squared distances to all rows of the cluster."""
        centre = F.array(*(F.lit(r[f"s{i}"] / r["n"]) for i in range(dims[0])))
        inner = r["q"] - sum(r[f"s{i}"] ** 2 for i in range(dims[0])) / r["n"]
        return squared_distance(F.col("f"), centre) * r["n"] + max(inner, 0.0)

    own = F.coalesce(*(F.when(F.col("cluster").eqNullSafe(F.lit(r["cluster"])), mean_to(r) / (r["n"] - 1) if r["n"] > 1 else F.lit(0.0)) for r in found))
    alone = F.coalesce(*(F.when(F.col("cluster").eqNullSafe(F.lit(r["cluster"])), F.lit(r["n"] == 1)) for r in found))
    others = [F.when(~F.col("cluster").eqNullSafe(F.lit(r["cluster"])), mean_to(r) / r["n"]) for r in found]
    near = F.least(*others) if len(others) > 1 else F.lit(None).cast("double")
    s = held.select("id", "cluster", own.alias("a"), near.alias("b"), alone.alias("alone"))
    return s.select("id", "cluster", F.when(F.col("alone") & F.col("b").isNotNull(), 0.0).when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).when(F.col("b").isNotNull(), 0.0).alias("silhouette"))
