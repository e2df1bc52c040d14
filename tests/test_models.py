"""Factors, ranks and fits against numpy; throughput and runs over slices against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import factors, fits, logs, ranks
from tessera.sources import tiles


def frame(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, features array<double>").repartition(3)


def test_sparse_components_on_all_features(spark):
    """The published iteration on the data matrix itself, in numpy."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64)) + np.outer(rng.normal(size=300), np.r_[np.ones(9), np.zeros(55)] * 3)
    got, took = factors.sparse_components(frame(spark, x), 2, 100.0)
    a = x - x.mean(0)
    for c in range(2):
        column = np.argmax((a * a).sum(0))
        s = a[:, column] / np.linalg.norm(a[:, column])
        gain, rounds = np.maximum((a.T @ s) ** 2 - 100, 0).sum(), 0
        while True:
            rounds += 1
            share = a.T @ s
            s = a @ (share * (share**2 > 100))
            s /= np.linalg.norm(s)
            now = np.maximum((a.T @ s) ** 2 - 100, 0).sum()
            if now - gain < 1e-4 * gain or rounds > 500:
                break
            gain = now
        share = a.T @ s
        z = share * (share**2 > 100)
        assert np.allclose(np.abs(got[c]), np.abs(z / np.linalg.norm(z)), atol=1e-8) and took[c] == rounds
        a = a - np.outer(s, share)
    assert (got[0] != 0).sum() == 9
    assert factors.sparse_components(frame(spark, x[:0]), 1, 1.0)[1] == []


def test_factors_equal_numpy_and_the_loss_falls(spark):
    rng = np.random.default_rng(3)
    x = rng.random((80, 6))
    start = rng.random((2, 6)) + 0.1
    w, h, losses = factors.nonnegative_factors(frame(spark, x), start, 6)
    got = {r.id: r.w for r in w.collect()}
    assert all(a >= b - 1e-9 for a, b in zip(losses, losses[1:], strict=False)) and len(losses) == 7
    assert math.isclose(losses[-1], ((x - np.array([got[i] for i in range(80)]) @ h) ** 2).sum(), rel_tol=1e-6)
    w1, _, _ = factors.nonnegative_factors(frame(spark, x), start, 1)
    w0, _, _ = factors.nonnegative_factors(frame(spark, x), start, 0)
    w0 = {r.id: np.array(r.w) for r in w0.collect()}
    for r in w1.collect():
        assert np.allclose(r.w, w0[r.id] * (x[r.id] @ start.T) / (w0[r.id] @ (start @ start.T)))


@pytest.mark.parametrize("rows", [7, 1000])
def test_quantiles_with_ties_and_ranges(spark, rows):
    rng = random.Random(1)
    v = {(c, i): (5.0 if rng.random() < 0.6 else rng.random() * 10) for c in range(3) for i in range(120)}
    df = spark.createDataFrame([(c, i, x) for (c, i), x in v.items()], "feature_idx int, id long, value double")
    got = {(r.feature_idx, r.id): r.normal for r in ranks.quantile_normalized(df, range_rows=rows).collect()}
    columns = [sorted(x for (c, _), x in v.items() if c == k) for k in range(3)]
    means = np.mean(columns, axis=0)
    for (c, i), x in v.items():
        at = [k for k, y in enumerate(columns[c]) if y == x]
        assert math.isclose(got[c, i], means[at].mean())
    r = {(r.feature_idx, r["rank"]) for r in ranks.ranked(df, "feature_idx", "value", "id", rows).collect()}
    assert r == {(c, k + 1) for c in range(3) for k in range(120)}
    assert ranks.quantile_normalized(df.limit(0)).count() == 0


def test_silhouette_by_pairs(spark):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(40, 3)), [*rng.integers(0, 3, 39).tolist(), 9]
    df = spark.createDataFrame([(i, int(k), row.tolist()) for i, (row, k) in enumerate(zip(x, c, strict=True))], "id long, c int, features array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    for r in ranks.silhouette(df, "c").collect():
        own = [j for j in range(40) if c[j] == c[r.id] and j != r.id]
        b = min(d[r.id, [j for j in range(40) if c[j] == k]].mean() for k in set(c) - {c[r.id]})
        a = d[r.id, own].mean() if own else None
        assert math.isclose(r.silhouette, 0.0 if a is None else (b - a) / max(a, b), abs_tol=1e-9)
    assert {r.silhouette for r in ranks.silhouette(df.filter("c = 1"), "c").collect()} == {None}
    assert ranks.silhouette(df.limit(0), "c").count() == 0


def test_fits_are_the_optimum(spark):
    rng = np.random.default_rng(6)
    samples = {"a": rng.gamma(2.5, 3.0, 400), "b": 7.0 * rng.weibull(1.7, 400), "same": np.full(9, 2.0), "zero": np.array([0.0, 1.0, 2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, s in samples.items() for v in s] + [("a", None)], "k string, v double")
    got = {(r.k, r.distribution): r for r in fits.fit_all(df, ["k"], "v").collect()}
    loss = {
        "gamma": lambda x, a, s: (math.lgamma(a) * len(x) + a * math.log(s) * len(x) - (a - 1) * np.log(x).sum() + x.sum() / s),
        "weibull": lambda x, k, s: -(len(x) * (math.log(k) - k * math.log(s)) + (k - 1) * np.log(x).sum() - ((x / s) ** k).sum()),
    }
    for k in ("a", "b"):
        for name, f in loss.items():
            r = got[k, name]
            best = f(samples[k], r.p1, r.p2)
            assert math.isclose(r.nll, best, rel_tol=1e-9)
            assert all(f(samples[k], r.p1 * a, r.p2 * b) >= best - 1e-9 for a in (0.999, 1, 1.001) for b in (0.999, 1, 1.001))
    assert got["a", "gamma"].place == 1 and got["b", "weibull"].place == 1
    assert not any(k in ("same", "zero") and d in loss for k, d in got)


def test_throughput_over_slices(spark):
    rng = random.Random(7)
    data = {(k, rng.randrange(1, 60)): rng.random() for k in range(2) for _ in range(25)}
    df = spark.createDataFrame([(k, b, v) for (k, b), v in data.items()], "eventType int, bucket long, value double")
    last = max(b for _, b in data)
    for span, size in ((5, 7), (4, 3), (1, 4096)):
        got = {r.eventType: r for r in logs.throughput(df, 1, span=span, slice_buckets=size).collect()}
        for k in range(2):
            rate = [sum(data.get((k, j), 0.0) for j in range(b - (span - 1 - span // 2), b + span // 2 + 1)) / 2**30 for b in range(1, last + 1)]
            assert math.isclose(got[k].peak, max(rate)) and math.isclose(got[k]["mean"], np.mean(rate)) and math.isclose(got[k]["std"], np.std(rate, ddof=1))


def test_runs_and_samples_over_slices(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(2), t, t + 3, "click" if rng.random() < 0.3 else "view", t) for t in rng.sample(range(500), 90)]
    df = spark.createDataFrame(rows, "pid int, startT long, endT long, eventName string, seq long")
    want, island = {}, {0: 0, 1: 0}
    for pid, start, end, name, _ in sorted(rows, key=lambda r: r[1]):
        island[pid] += name == "click"
        a, b, _, n = want.get((pid, island[pid]), (start, end, name, 0))
        want[pid, island[pid]] = (a, max(b, end), name, n + 1)
    got = {(r.pid, r.island): (r.startT, r.endT, r.last_event, r.n_events) for r in logs.collapse_runs(df, F.col("eventName") == "click", width=40).collect()}
    assert got == want
    taken = tiles.sample(df, 2, 7, ["pid"], "startT", 50)
    assert taken.columns == df.columns
    for pid in (0, 1):
        of = sorted(r[1] for r in rows if r[0] == pid)
        assert sorted(r.startT for r in taken.filter(F.col("pid") == pid).collect()) == [t for i, t in enumerate(of, 1) if i * 2 // 7 > (i - 1) * 2 // 7]


def test_ranks_hold_if_approximate_borders_differ_from_run_to_run(spark, monkeypatch):
    """Merged in another order, approximate quantiles are others; each evaluation draws new borders here,
    as each reader of a shuffle does that merges for itself."""
    monkeypatch.setattr(ranks.F, "percentile_approx", lambda value, ends, accuracy: drawn(F.count(value) * 0 + len(ends)))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    drawn = F.udf(lambda n: [random.SystemRandom().uniform(0, 10) for _ in range(n)], "array<double>").asNondeterministic()
    df = spark.createDataFrame([(c, i, float(i * 7 % 10)) for c in range(2) for i in range(150)], "feature_idx int, id long, value double")
    got = [(r.feature_idx, r.value, r.id, r["rank"]) for r in ranks.ranked(df, "feature_idx", "value", "id", 10).collect()]
    spark.conf.unset("spark.sql.exchange.reuse")
    assert [r[3] for r in sorted(got)] == [*range(1, 151)] * 2
