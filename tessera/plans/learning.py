"""Clustering, classification and selection over feature tables. Only models go through the driver: k centres, or one mean
and covariance per class; their size depends on the features, never on the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _nearest(features: Column, centers: list[list[float]]) -> Column:
    """The index and squared distance of the nearest centre (ties: the lesser index)."""
    tried = [F.struct(squared_distance(features, F.array(*(F.lit(float(v)) for v in c))).alias("d"), F.lit(i).alias("center")) for i, c in enumerate(centers)]
    return F.least(*tried) if len(tried) > 1 else tried[0]


def zscore(long: DataFrame, keys: list[str], figures: DataFrame) -> DataFrame:
    """Long features (keys, feature_idx, value) less nu_mean, over nu_stdev (figures: one row a feature); None where a
    feature has no spread."""
    z = (F.col("value") - F.col("nu_mean")) / F.when(F.col("nu_stdev") > 0, F.col("nu_stdev"))
    return long.join(F.broadcast(figures.select("feature_idx", "nu_mean", "nu_stdev")), "feature_idx").select(*keys, "feature_idx", z.alias("z"))  # one row per feature


def furthest_first(df: DataFrame, k: int, id_col: str = "id", features: str = "features") -> list[list[float]]:
    """k starting centres: the row of the least id, then again and again the row furthest from all centres so far."""
    centers = [df.select(F.min_by(features, id_col)).first()[0]]
    while len(centers) < k:
        far = df.select(id_col, features, _nearest(F.col(features), centers)["d"].alias("d"))
        centers.append(far.select(F.max_by(features, F.struct("d", F.negative(id_col)))).first()[0])
    return [list(map(float, c)) for c in centers]


def kmeans(df: DataFrame, centers: list[list[float]], threshold: float = 0.0, rounds: int = 100, id_col: str = "id", features: str = "features") -> tuple[list[list[float]], DataFrame]:
    """Lloyd's rounds from the given centres, until at most the share `threshold` of rows changes centre. An empty cluster
    keeps its centre, and one without a value of some feature that feature of it. Returns the centres and the rows' id, center and d (squared distance to the centre that each was
    given in the last round).

    A round is one pass that ends in k rows: rows find their centre of this round and of the one before anew, so neither
    assignments nor features are written or shuffled. Tasks work on whole Arrow batches."""
    dims = len(centers[0])
    held = df.select(id_col, F.col(features).cast("array<double>").alias("f"))
    before = None
    for _ in range(rounds):
        found = held.select("f").mapInArrow(_Round(centers, before), "center int, n long, changed long, known array<long>, total array<double>")
        sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("known", "total") for i in range(dims)]
        found = found.groupBy("center").agg(F.sum("n").alias("n"), F.sum("changed").alias("changed"), *sums).collect()  # at most k rows
        given_by, before, centers = centers, centers, [list(c) for c in centers]
        for r in found:
            centers[r["center"]] = [r[f"total{i}"] / r[f"known{i}"] if r[f"known{i}"] else centers[r["center"]][i] for i in range(dims)]
        if sum(r["changed"] for r in found) <= threshold * sum(r["n"] for r in found):
            break
    given = held.select(id_col, _nearest(F.col("f"), given_by).alias("n"))
    return centers, given.select(id_col, "n.center", "n.d")


class _Round:
    """A task's part of a round of Lloyd's: per centre, its rows, those whose centre of the round before was another, and the
    count and sum of each feature. A row with a missing feature, or of another length, has no distance and goes to centre 0."""

    def __init__(self, centers: list[list[float]], before: list[list[float]] | None) -> None:
        self.centers, self.before = (np.array(c, float) if c else None for c in (centers, before))

    @staticmethod
    def nearest(x: np.ndarray, whole: np.ndarray, centers: np.ndarray) -> np.ndarray:
        d = np.column_stack([((x - c) ** 2).sum(axis=1) for c in centers])
        return np.where(whole, np.where(np.isnan(d), np.inf, d).argmin(axis=1), 0)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = self.centers.shape
        n, changed = np.zeros(k, np.int64), np.zeros(k, np.int64)
        known, total = np.zeros((k, dims), np.int64), np.zeros((k, dims))
        for batch in batches:
            lists = batch.column("f")
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x, there = np.full((len(sizes), dims), np.nan), np.zeros((len(sizes), dims), bool)
            inside = place < dims
            x[row[inside], place[inside]] = flat.to_numpy(zero_copy_only=False)[inside]
            there[row[inside], place[inside]] = flat.is_valid().to_numpy(zero_copy_only=False)[inside]
            whole = there.all(axis=1) & (sizes == dims)
            center = self.nearest(x, whole, self.centers)
            was = self.nearest(x, whole, self.before) if self.before is not None else np.full(len(x), -1)
            n += np.bincount(center, minlength=k)
            changed += np.bincount(center[was != center], minlength=k)
            for c in range(k):
                mine = center == c
                known[c] += there[mine].sum(axis=0)
                total[c] += np.where(there[mine], x[mine], 0.0).sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(changed[some]), pa.array(list(known[some]), pa.list_(pa.int64())), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["center", "n", "changed", "known", "total"])


def class_figures(df: DataFrame, label: str, features: str = "features") -> dict:
    """Count, mean and sample covariance per class. Each task folds its rows into one sum of outer products per class, so
    what is shuffled grows with the tasks, and not with the rows."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for c, g in b.groupby("c"):
                x = np.vstack(g["f"].to_numpy()).astype(float)
                n, s, o = sums.get(c, (0, 0.0, 0.0))
                sums[c] = (n + len(x), s + x.sum(0), o + x.T @ x)
        if sums:
            yield pd.DataFrame([(c, n, s.tolist(), o.ravel().tolist()) for c, (n, s, o) in sums.items()], columns=["c", "n", "s", "o"])

    rows = df.select(F.col(label).cast("long").alias("c"), F.col(features).cast("array<double>").alias("f")).dropna()
    parts = rows.mapInPandas(fold, "c long, n long, s array<double>, o array<double>")
    add = lambda name: F.posexplode(name)
    counts = {r["c"]: r["n"] for r in parts.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    sums = parts.select("c", F.lit("s").alias("kind"), add("s")).unionByName(parts.select("c", F.lit("o").alias("kind"), add("o"))).groupBy("c", "kind", "pos").agg(F.sum("col").alias("v"))
    grown = sums.groupBy("c", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("v")).collect()  # two rows a class
    got = {(r["c"], r["kind"]): np.array(r["v"]) for r in grown}
    out = {}
    for c, n in counts.items():
        mean = got[c, "s"] / n
        d = len(mean)
        out[c] = (n, mean, (got[c, "o"].reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1))
    return out


def quadratic_discriminant(df: DataFrame, figures: dict, features: str = "features", reject: float | None = None, ridge: float = 1e-6, priors: bool = True) -> DataFrame:
    """The rows with `predicted` and `posterior` (of that class): Gaussian classes with their own covariances. Rows whose
    greatest posterior is under `reject` get no class; rows without features none either."""
    classes = sorted(figures)
    total = sum(figures[c][0] for c in classes)
    model = []
    for c in classes:
        n, mean, cov = figures[c]
        cov = cov + ridge * np.eye(len(mean))
        model.append((mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1], np.log(n / total) if priors else 0.0))

    @F.pandas_udf("predicted long, posterior double")
    def decide(f: pd.Series) -> pd.DataFrame:
        known = f.notna().to_numpy()
        out = pd.DataFrame({"predicted": pd.array([None] * len(f), dtype="Int64"), "posterior": np.full(len(f), np.nan)})
        if known.any():
            x = np.vstack(f[known].to_numpy()).astype(float)
            score = np.column_stack([p - 0.5 * (ld + np.einsum("ij,jk,ik->i", x - m, inv, x - m)) for m, inv, ld, p in model])
            score = np.exp(score - score.max(axis=1, keepdims=True))
            score /= score.sum(axis=1, keepdims=True)
            best = score.argmax(axis=1)
            top = score[np.arange(len(best)), best]
            out.loc[known, "predicted"] = [classes[b] if reject is None or t >= reject else None for b, t in zip(best, top)]
            out.loc[known, "posterior"] = top
        return out

    return df.withColumn("_d", decide(F.col(features))).select(*df.columns, "_d.predicted", "_d.posterior")


def folds(df: DataFrame, k: int, id_col: str = "id", seed: int = 0) -> DataFrame:
    """The rows with `fold`, 0 to k - 1, by a seeded hash of the id."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(k)).cast("int"))


def cross_validated(df: DataFrame, label: str, k: int = 5, id_col: str = "id", features: str = "features", seed: int = 0) -> DataFrame:
    """Each row with its class as predicted by a quadratic discriminant learnt from the other folds."""
    parted = folds(df, k, id_col, seed)
    out = None
    for i in range(k):
        got = quadratic_discriminant(parted.filter(F.col("fold") == i), class_figures(parted.filter(F.col("fold") != i), label, features), features)
        out = got if out is None else out.unionByName(got)
    return out


def confusion(predicted: DataFrame, label: str, guess: str = "predicted") -> DataFrame:
    """label, predicted, n and rate (the share of that label's rows)."""
    per = predicted.groupBy(F.col(label).alias("label"), F.col(guess).alias("predicted")).agg(F.count("*").alias("n"))
    total = per.groupBy("label").agg(F.sum("n").alias("total"))
    return per.join(total, "label").select("label", "predicted", "n", (F.col("n") / F.col("total")).alias("rate"))


def select_forward(names: list[str], score: Callable[[list[str]], float], most: int, floating: bool = False) -> list[tuple[list[str], float]]:
    """Forward selection: the best set of each size up to `most`, with its score (a Spark job per call of `score`). Ties go
    to the later feature. With `floating`, features are taken back as long as that beats the best set of the lesser size."""
    best: dict[int, tuple[float, list[str]]] = {}
    chosen: list[str] = []
    while len(chosen) < min(most, len(names)):
        top, _, name = max((score([*chosen, n]), i, n) for i, n in enumerate(names) if n not in chosen)
        chosen = [*chosen, name]
        if len(chosen) not in best or top > best[len(chosen)][0]:
            best[len(chosen)] = (top, chosen)
        while floating and len(chosen) > 2:
            less, _, gone = max((score([c for c in chosen if c != n]), i, n) for i, n in enumerate(chosen))
            if less <= best[len(chosen) - 1][0]:
                break
            chosen = [c for c in chosen if c != gone]
            best[len(chosen)] = (less, chosen)
    return [(best[k][1], best[k][0]) for k in sorted(best)]


def percent_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, pct: |a - b| over the greater of |a| and |b|, in percent; 0 where both are 0."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys)
    top = F.greatest(F.abs("a"), F.abs("b"))
    return both.select(*keys, F.when(top > 0, F.abs(F.col("a") - F.col("b")) / top * 100.0).otherwise(0.0).alias("pct"))


def principal_components(df: DataFrame, k: int, features: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """The k main directions (rows) and their variances, from the covariance of all rows. A direction's largest entry is
    positive."""
    _, _, cov = class_figures(df.select(F.lit(0).alias("all"), features), "all", features)[0]
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    rows = vectors[:, order].T
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])
    return rows * signs[:, None], values[order]


def project(features: Column, mean: list[float], rows: np.ndarray) -> Column:
    """Features less the mean, along each row, as an array."""
    centred = F.zip_with(features, F.array(*(F.lit(float(m)) for m in mean)), lambda x, m: x - m)
    along = lambda r: F.aggregate(F.zip_with(centred, F.array(*(F.lit(float(v)) for v in r)), lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)
    return F.array(*(along(r) for r in rows))


def fit_distributions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distributions with closed maximum-likelihood fits, best first by BIC: keys, distribution, n, p1, p2, nll (negative
    log likelihood), bic, aic, place. Normal (mean, deviation), exponential (mean), lognormal (mean, deviation of the log)
    and uniform (ends). Exponential needs values of 0 or more, lognormal ones above 0. Nulls are left out; a group without
    spread has none of those with a density of infinity. One aggregation, whatever the number of rows."""
    v = F.col(value).cast("double")
    log = F.when(v > 0, F.log(v))
    s = df.filter(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(log).alias("lm"), F.stddev_pop(log).alias("ls"))
    n, c = F.col("n").cast("double"), F.col
    half = 0.5 * float(np.log(2 * np.pi)) + 0.5
    fits = (
        ("normal", 2, c("m"), c("s"), F.when(c("s") > 0, n * (F.log("s") + half))),
        ("exponential", 1, c("m"), F.lit(None).cast("double"), F.when((c("lo") >= 0) & (c("m") > 0), n * (F.log("m") + 1.0))),
        ("lognormal", 2, c("lm"), c("ls"), F.when((c("lo") > 0) & (c("ls") > 0), n * (F.log("ls") + half + c("lm")))),
        ("uniform", 2, c("lo"), c("hi"), F.when(c("hi") > c("lo"), n * F.log(c("hi") - c("lo")))),
    )
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("distribution"), F.lit(k).alias("k"), p1.alias("p1"), p2.alias("p2"), nll.alias("nll")) for name, k, p1, p2, nll in fits)))
    out = s.select(*keys, "n", rows.alias("f")).select(*keys, "n", "f.*").filter("nll is not null")
    out = out.withColumns({"bic": 2.0 * F.col("nll") + F.col("k") * F.log(F.col("n").cast("double")), "aic": 2.0 * F.col("nll") + 2.0 * F.col("k")}).drop("k")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("bic", "distribution")))  # four rows a group
