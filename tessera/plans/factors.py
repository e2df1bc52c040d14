"""Sparse principal components and non-negative factors. Rows stay in the tasks; the driver holds matrices whose size
depends on the features and the number of components alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import cut, drop
from .learning import class_figures


def sparse_components(df: DataFrame, k: int, penalty: float, features: str = "features", stop: float = 1e-4, rounds: int = 1000) -> tuple[np.ndarray, list[int]]:
    """The loadings (k rows of features, each of length 1 or all 0) and the rounds that each took.

    One pass sums the gram matrix of the centred features. A round multiplies the loadings with it, scales by the length of
    what they explain, and sets to 0 each feature whose squared share isn't over the penalty, until the gain is under
    `stop`. It begins with the feature of the greatest variance (ties: the first). What a component explains is then taken
    off the matrix. Rows without features are left out; no rows give no components."""
    figures = class_figures(df.select(F.lit(0).alias("all"), features), "all", features)
    if not figures:
        return np.zeros((0, 0)), []
    n, mean, cov = figures[0]
    gram = cov * max(n - 1, 1)
    out, took = np.zeros((k, len(mean))), []
    for c in range(k):
        first = int(np.argmax(np.diag(gram)))
        if gram[first, first] <= 1e-9:  # nothing is left to explain
            took.append(0)
            continue
        share = gram[first] / np.sqrt(gram[first, first])
        gain, t = np.maximum(share**2 - penalty, 0).sum(), 0
        while t < rounds:
            t += 1
            z = np.where(share**2 > penalty, share, 0.0)
            size = np.sqrt(z @ gram @ z)
            if size <= 0:
                break
            share = gram @ z / size
            before, gain = gain, np.maximum(share**2 - penalty, 0).sum()
            if gain - before < stop * before:
                break
        z = np.where(share**2 > penalty, share, 0.0)
        length = np.sqrt(z @ z)
        out[c] = z / length if length > 0 else z
        took.append(t)
        gram = gram - np.outer(share, share)
    return out, took


def nonnegative_factors(df: DataFrame, start: np.ndarray, rounds: int, id_col: str = "id", features: str = "features", first: float = 1.0) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Rows V as factors W H of k parts, all at least 0, by multiplicative updates of the squared loss: the rows' factors (id,
    w), H, and the loss before each round and at the end.

    `start` is H at first (k rows of features, above 0) and `first` the rows' factors, each `first` times its place over k.
    In a round every task updates its rows' factors and sums W'V and W'W, k x features and k x k numbers a task, which Spark adds
    up; only H goes back out. Values under 0 count as 0; rows without features are left out."""
    k, m = start.shape
    eps = 1e-12
    rows = df.select(F.col(id_col).alias("id"), F.col(features).cast("array<double>").alias("v")).filter("v is not null")
    initial = F.array(*(F.lit(first * (j + 1) / k) for j in range(k)))
    # every row begins differently, or all factors stay alike
    digest = lambda j: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), j.cast("string"))), 1, 4), 16, 10).cast("double")
    spread = F.transform(initial, lambda x, j: x * (1.0 + digest(j) / 65536.0))
    state = cut(rows.select("id", "v", spread.alias("w")))

    def matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        v = np.maximum(np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False)).reshape(-1, m), 0.0)
        return v, np.asarray(batch.column("w").flatten().to_numpy(zero_copy_only=False)).reshape(-1, k)

    def update(h: np.ndarray):
        hh = h @ h.T

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v, w = matrices(batch)
                w = w * (v @ h.T) / (w @ hh + eps)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(list(w), pa.list_(pa.float64()))], names=["id", "v", "w"])

        return run

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v, w = matrices(batch)
                part = np.concatenate([(w.T @ v).ravel(), (w.T @ w).ravel(), [(v * v).sum()]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["at", "x"])

    def added(of: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
        got = of.mapInArrow(sums, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow().sort_by("at").column("x").to_numpy()
        got = got if len(got) else np.zeros(k * m + k * k + 1)
        return got[: k * m].reshape(k, m), got[k * m : -1].reshape(k, k), float(got[-1])

    def loss(wv: np.ndarray, ww: np.ndarray, vv: float) -> float:
        return float(vv - 2.0 * (wv * h).sum() + (ww * (h @ h.T)).sum())

    h, losses = start.astype(float), []
    schema = f"id {dict(state.dtypes)['id']}, v array<double>, w array<double>"
    for _ in range(rounds):
        if not losses:
            losses.append(loss(*added(state)))
        new = cut(state.mapInArrow(update(h), schema))
        drop(state)
        state = new
        wv, ww, vv = added(state)
        h = h * wv / (ww @ h + eps)
        losses.append(loss(wv, ww, vv))
    return state.select("id", "w"), h, losses
