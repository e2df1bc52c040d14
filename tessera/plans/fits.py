"""Maximum-likelihood fits without a closed form, gamma and Weibull, by Newton rounds on sums made in the tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import cut, drop
from .learning import fit_distributions

#: Steps by which the argument of the gamma function's series is moved up, and Newton steps that settle any start.
SHIFT, STEPS = 8, 60


def _shifted(x: Column, term) -> Column:
    """Sum of a term over x, x + 1, ... below the series' argument."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(0.0), lambda s, k: s + term(x + k))


def digamma(x: Column) -> Column:
    y = x + float(SHIFT)
    i = 1.0 / (y * y)
    return F.log(y) - 0.5 / y - i * (1 / 12.0 - i * (1 / 120.0 - i * (1 / 252.0 - i * (1 / 240.0 - i / 132.0)))) - _shifted(x, lambda v: 1.0 / v)


def trigamma(x: Column) -> Column:
    y = x + float(SHIFT)
    i = 1.0 / (y * y)
    return 1.0 / y + i / 2.0 + i / y * (1 / 6.0 - i * (1 / 30.0 - i * (1 / 42.0 - i / 30.0))) + _shifted(x, lambda v: 1.0 / (v * v))


def log_gamma(x: Column) -> Column:
    y = x + float(SHIFT)
    i = 1.0 / (y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12.0 - i * (1 / 360.0 - i * (1 / 1260.0 - i / 1680.0))) / y - _shifted(x, F.log)


def _held(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys in one column, so that none clashes with a figure, and the value."""
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull()).select(F.struct(*keys).alias("_key"), v.alias("_v"))


def gamma_fit(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, distribution, n, p1 (shape), p2 (scale), nll. The shape depends on the means of the values and of their logs
    alone, so one aggregation does, and Newton's steps are a fold over a group's row. Values must be above 0 and differ."""
    s = _held(df, keys, value).groupBy("_key").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.avg("_v").alias("m"), F.avg(F.when(F.col("_v") > 0, F.log("_v"))).alias("lm"))
    s = s.filter("lo > 0 and hi > lo").withColumn("t", F.log("m") - F.col("lm")).filter("t > 1e-12")
    guess = (3.0 - F.col("t") + F.sqrt((F.col("t") - 3.0) * (F.col("t") - 3.0) + 24.0 * F.col("t"))) / (12.0 * F.col("t"))
    s = s.withColumn("guess", guess)
    # Newton on 1/shape: it settles from this guess in a few steps
    step = lambda a: 1.0 / (1.0 / a + (F.log(a) - digamma(a) - F.col("t")) / (a * a * (1.0 / a - trigamma(a))))
    s = s.withColumn("a", F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.col("guess"), lambda a, _: step(a)))
    a, n = F.col("a"), F.col("n").cast("double")
    scale = F.col("m") / a
    nll = n * (log_gamma(a) + a * F.log(scale) - (a - 1.0) * F.col("lm") + a)
    return s.select("_key.*", F.lit("gamma").alias("distribution"), "n", a.alias("p1"), scale.alias("p2"), nll.alias("nll"))


def weibull_fit(df: DataFrame, keys: list[str], value: str, stop: float = 1e-12) -> DataFrame:
    """keys, distribution, n, p1 (shape), p2 (scale), nll. A round sums x^k, x^k log x and x^k log^2 x per group for that group's
    shape k; the tasks add them up, and each group takes a Newton step, until no shape moves. Values must be above 0 and
    differ; they are taken over their group's greatest, so no power overflows. Group rows are joined, not broadcast."""
    rows = _held(df, keys, value)
    log = F.when(F.col("_v") > 0, F.log("_v"))
    s = rows.groupBy("_key").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.avg(log).alias("lm"), F.stddev_pop(log).alias("ls"))
    s = s.filter("lo > 0 and hi > lo and ls > 0").withColumns({"k": 1.2825498301618641 / F.col("ls"), "moved": F.lit(1.0)})
    state = cut(s)
    kept = cut(rows.join(state.select("_key", "hi"), "_key").select("_key", F.log(F.col("_v") / F.col("hi")).alias("l")))
    for _ in range(STEPS):
        if state.filter(F.col("moved") > stop).isEmpty():
            break
        power = F.exp(F.col("k") * F.col("l"))
        sums = kept.join(state.select("_key", "k"), "_key").groupBy("_key").agg(F.sum(power).alias("s0"), F.sum(power * F.col("l")).alias("s1"), F.sum(power * F.col("l") * F.col("l")).alias("s2"))
        off = F.col("s1") / F.col("s0") - 1.0 / F.col("k") - (F.col("lm") - F.log("hi"))
        slope = (F.col("s2") * F.col("s0") - F.col("s1") * F.col("s1")) / (F.col("s0") * F.col("s0")) + 1.0 / (F.col("k") * F.col("k"))
        near = F.greatest(F.col("k") - off / slope, F.col("k") / 4.0)
        new = state.join(sums, "_key").withColumn("near", near).withColumn("moved", F.abs(F.col("near") / F.col("k") - 1.0)).withColumn("k", F.col("near"))
        new = cut(new.select(*state.columns))
        drop(state)
        state = new
    power = F.exp(F.col("k") * F.col("l"))
    last = kept.join(state.select("_key", "k"), "_key").groupBy("_key").agg(F.avg(power).alias("mean_power"))
    n, k = F.col("n").cast("double"), F.col("k")
    scale = F.col("hi") * F.pow("mean_power", 1.0 / k)
    nll = -n * (F.log(k) - k * F.log(scale) + (k - 1.0) * F.col("lm") - 1.0)
    out = cut(state.join(last, "_key").select("_key.*", F.lit("weibull").alias("distribution"), "n", k.alias("p1"), scale.alias("p2"), nll.alias("nll")))
    drop(state, kept)
    return out


def fit_all(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """fit_distributions() with gamma and Weibull among them; the columns and the order are the same."""
    more = gamma_fit(df, keys, value).unionByName(weibull_fit(df, keys, value))
    two = more.withColumns({"bic": 2.0 * F.col("nll") + 2.0 * F.log(F.col("n").cast("double")), "aic": 2.0 * F.col("nll") + 4.0})
    both = fit_distributions(_held(df, keys, value), ["_key"], "_v").drop("place").select("_key.*", *(c for c in two.columns if c not in keys)).unionByName(two)
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("bic", "distribution")))  # six rows a group
