"""Queries of factor models, ranks and fits; embeddings play the feature vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import factors, fits, ranks, rollup
from .learning import _rows

# Sparse components, their penalty and the most rounds; parts and rounds of the factors.
COMPONENTS, PENALTY, ROUNDS = 2, 1.0, 30
PARTS, UPDATES = 3, 5


def ml_sparse_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings of sparse components over all features; of size, as a direction has no sign."""
    loadings, _ = factors.sparse_components(_rows(spark, sf_dir), COMPONENTS, PENALTY, rounds=ROUNDS)
    rows = [(c, i, float(abs(v))) for c, row in enumerate(loadings) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, "component int, feature_idx int, loading double").withColumn("loading", F.round("loading", 4))


def ml_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss of non-negative factors round by round (values below 0 count as 0)."""
    rows = _rows(spark, sf_dir)
    m = rows.select(F.size("features")).first()[0]
    start = (np.arange(PARTS * m).reshape(PARTS, m) * 7 % 11 + 1) / 11.0
    _, _, losses = factors.nonnegative_factors(rows, start, UPDATES)
    return spark.createDataFrame(list(enumerate(losses)), "round int, loss double").withColumn("loss", F.round("loss", 3))


def ml_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features brought to one distribution."""
    long = rollup.features_long(_rows(spark, sf_dir), ["id"])
    return ranks.quantile_normalized(long, range_rows=100).select("id", "feature_idx", F.round("normal", 6).alias("normal"))


def ml_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.silhouette(_rows(spark, sf_dir), "label").select("id", "cluster", F.round("silhouette", 5).alias("silhouette"))


def ml_newton_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gamma and Weibull fits of order prices (in thousands) per priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", (F.col("o_totalprice").cast("double") / 1000.0).alias("price"))
    f = fits.gamma_fit(o, ["o_orderpriority"], "price").unionByName(fits.weibull_fit(o, ["o_orderpriority"], "price"))
    return f.select("o_orderpriority", "distribution", "n", *(F.round(c, 4).alias(c) for c in ("p1", "p2", "nll")))


QUERIES = {f.__name__: f for f in (ml_sparse_pca, ml_factors, ml_quantile, ml_silhouette, ml_newton_fits)}

_E = "with recursive e as materialized (select vec_id as id, label, embedding::double[] as f from embeddings), u as materialized (select id, label, generate_subscripts(f, 1) - 1 as k, unnest(f) as v from e)"
_DOT = "list_dot_product({0}, {1})"
#: A state is [gain, then the shares]; a round leaves it alone once the gain is small. The gram matrix is a list of rows.
_GAIN = lambda s: f"list_sum(list_transform({s}, lambda q: greatest(q * q - {PENALTY}, 0)))"
_THIN = lambda s: f"list_transform({s}, lambda q: case when q * q > {PENALTY} then q else 0 end)"


def _component(c: int) -> str:
    """SQL for component c of gram matrix g{c}, and the matrix without it. A state: [stopped, gain, shares...]."""
    start = "list_transform(g[p], lambda q: q / sqrt(g[p][p]))"
    z = _THIN("s[3:]")
    y = f"list_transform(g, lambda row: list_dot_product(row, {z}) / sqrt(list_dot_product({z}, list_transform(g, lambda r2: list_dot_product(r2, {z})))))"
    return f""", p{c} as (select g, list_position(list_transform(range(1, len(g) + 1), lambda i: g[i][i]), list_max(list_transform(range(1, len(g) + 1), lambda i: g[i][i]))) as p from g{c}),
  i{c} as materialized (select g, list_prepend(0.0::double, list_prepend({_GAIN(start)}, {start})) as s, 0 as t from p{c}),
  w{c} as (select g, s, t from i{c} union all select g, list_prepend(case when {_GAIN('n')} - s[2] < 1e-4 * s[2] then 1.0::double else 0.0::double end, list_prepend({_GAIN('n')}, n)), t + 1 from (select g, s, t, {y} as n from w{c} where s[1] = 0 and t < {ROUNDS})),
  l{c} as materialized (select g, arg_max(s, t)[3:] as y from w{c} group by g),
  g{c + 1} as materialized (select list_transform(g, lambda row, i: list_transform(row, lambda q, j: q - y[i] * y[j])) as g from l{c}),
  o{c} as (select {c} as component, unnest(range(len(y)))::int as feature_idx, unnest(list_transform({_THIN('y')}, lambda q: abs(q) / sqrt(list_dot_product({_THIN('y')}, {_THIN('y')})))) as loading from l{c})"""


def _factors() -> str:
    """SQL for the losses: w and h of every round, unrolled."""
    out = [_E, f"v as materialized (select id, k, greatest(v, 0) as v from u), w0 as materialized (select id, j, 1.0::double * (j + 1) / {PARTS} * (1 + cast('0x' || substr(md5(id || ':' || j), 1, 4) as int) / 65536.0::double) as w from e, range(0, {PARTS}) r(j))",
           f"h0 as materialized (select j, k, ((j * (select max(len(f)) from e) + k) * 7 % 11 + 1) / 11.0::double as h from range(0, {PARTS}) r(j), (select distinct k from v))"]
    for t in range(UPDATES):
        out.append(f"""hh{t} as materialized (select a.j as i, b.j, sum(a.h * b.h) as x from h{t} a join h{t} b using (k) group by all),
  n{t} as materialized (select id, j, sum(v.v * h) as x from v join h{t} using (k) group by all), d{t} as materialized (select w.id, hh.j, sum(w.w * hh.x) as x from w{t} w join hh{t} hh on hh.i = w.j group by all),
  w{t + 1} as materialized (select w.id, w.j, w.w * n.x / (d.x + 1e-12) as w from w{t} w join n{t} n using (id, j) join d{t} d using (id, j)),
  wv{t} as materialized (select w.j, v.k, sum(w.w * v.v) as x from w{t + 1} w join v using (id) group by all), ww{t} as materialized (select a.j as i, b.j, sum(a.w * b.w) as x from w{t + 1} a join w{t + 1} b using (id) group by all),
  wh{t} as materialized (select ww.i as j, h.k, sum(ww.x * h.h) as x from ww{t} ww join h{t} h on h.j = ww.j group by all),
  h{t + 1} as materialized (select h.j, h.k, h.h * wv.x / (wh.x + 1e-12) as h from h{t} h join wv{t} wv using (j, k) join wh{t} wh using (j, k))""")
    losses = [f"select {t} as round, round(sum(pow(v.v - p.x, 2)), 3) as loss from v join (select w.id, h.k, sum(w.w * h.h) as x from w{t} w join h{t} h on h.j = w.j group by all) p using (id, k)" for t in range(UPDATES + 1)]
    return ", ".join(out) + " " + " union all ".join(losses)


_SHIFTED = lambda x, term: " + ".join(term(f"({x} + {k})") for k in range(fits.SHIFT))
_Y = lambda x: f"({x} + {fits.SHIFT}.0::double)"
_DIGAMMA = lambda x: f"(ln({_Y(x)}) - 0.5 / {_Y(x)} - (1 / 12.0::double - (1 / 120.0::double - (1 / 252.0::double - 1 / 240.0::double / pow({_Y(x)}, 2)) / pow({_Y(x)}, 2)) / pow({_Y(x)}, 2)) / pow({_Y(x)}, 2) - ({_SHIFTED(x, lambda v: f'1.0::double / {v}')}))"
_TRIGAMMA = lambda x: f"(1.0::double / {_Y(x)} + 0.5 / pow({_Y(x)}, 2) + (1 / 6.0::double - (1 / 30.0::double - 1 / 42.0::double / pow({_Y(x)}, 2)) / pow({_Y(x)}, 2)) / pow({_Y(x)}, 3) + {_SHIFTED(x, lambda v: f'1.0::double / ({v} * {v})')})"
ORACLE_SQL = {
    "ml_sparse_pca": _E + """, m as (select k, avg(v) as m from u group by k), d as materialized (select id, k, v - m as v from u join m using (k)),
      gg as (select a.k as i, b.k as j, sum(a.v * b.v) as x from d a join d b on a.id = b.id group by all), gr as (select i, list(x order by j) as row from gg group by i), g0 as materialized (select list(row order by i) as g from gr)"""
    + "".join(_component(c) for c in range(COMPONENTS)) + " " + " union all ".join(f"select component, feature_idx, round(loading, 4) as loading from o{c}" for c in range(COMPONENTS)),
    "ml_factors": _factors(),
    "ml_quantile": _E + """, r as materialized (select id, k, v, row_number() over (partition by k order by v, id) as rank from u), a as (select rank, avg(v) as at_rank from r group by rank)
      select id, k as feature_idx, round(avg(at_rank) over (partition by k, v), 6) as normal from r join a using (rank)""",
    "ml_silhouette": _E + """, q as materialized (select a.id, a.label, b.label as other, sum(pow(list_distance(a.f, b.f), 2)) as total, count(*) as n from e a join e b on true group by all),
      w as (select id, label as cluster, max(case when label = other then total / nullif(n - 1, 0) end) as a, min(case when label != other then total / n end) as b from q group by all)
      select id, cluster, round(case when b is null then null when a is null then 0 else (b - a) / greatest(a, b) end, 5) as silhouette from w""",
    "ml_newton_fits": f"""with recursive o as materialized (select o_orderpriority, o_totalprice::double / 1000.0::double as v from orders),
      s as materialized (select o_orderpriority, count(*) as n, avg(v) as m, avg(ln(v)) as lm, stddev_pop(ln(v)) as ls, max(v) as hi from o group by all),
      g(o_orderpriority, a, i) as (select o_orderpriority, (3 - (ln(m) - lm) + sqrt(pow(ln(m) - lm - 3, 2) + 24 * (ln(m) - lm))) / (12 * (ln(m) - lm)), 0 from s
        union all select g.o_orderpriority, 1 / (1 / a + (ln(a) - {_DIGAMMA('a')} - (ln(m) - lm)) / (a * a * (1 / a - {_TRIGAMMA('a')}))), i + 1 from g join s using (o_orderpriority) where i < 12),
      w(o_orderpriority, k, i) as (select o_orderpriority, 1.2825498301618641::double / ls, 0 from s
        union all select o_orderpriority, k - (s1 / s0 - 1 / k - (lm - ln(hi))) / ((s2 * s0 - s1 * s1) / (s0 * s0) + 1 / (k * k)), i + 1
          from (select w.o_orderpriority, k, i, any_value(lm) as lm, any_value(hi) as hi, sum(pow(v / hi, k)) as s0, sum(pow(v / hi, k) * ln(v / hi)) as s1, sum(pow(v / hi, k) * pow(ln(v / hi), 2)) as s2
            from w join s on s.o_orderpriority = w.o_orderpriority join o on o.o_orderpriority = w.o_orderpriority where i < 30 group by w.o_orderpriority, k, i)),
      f as (select o_orderpriority, arg_max(k, i) as k from w group by all), h as (select o_orderpriority, k, any_value(hi) * pow(avg(pow(v / hi, k)), 1 / k) as c from f join s using (o_orderpriority) join o using (o_orderpriority) group by o_orderpriority, k)
      select o_orderpriority, 'gamma' as distribution, n, round(a, 4) as p1, round(m / a, 4) as p2, round(n * (lgamma(a) + a * ln(m / a) - (a - 1) * lm + a), 4) as nll from (select o_orderpriority, arg_max(a, i) as a from g group by all) join s using (o_orderpriority)
      union all select o_orderpriority, 'weibull', n, round(k, 4), round(c, 4), round(-n * (ln(k) - k * ln(c) + (k - 1) * lm - 1), 4) from h join s using (o_orderpriority)""",
}
