"""Queries of learning and of cohort comparison; embeddings play the feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import contours, learning, rollup

# Rows that start the clusters, rounds.
STARTS, ROUNDS = (0, 1, 2, 3), 3


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))


def ml_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of each row after three rounds from fixed rows."""
    rows = _rows(spark, sf_dir)
    starts = {r.id: list(r.features) for r in rows.filter(F.col("id").isin(*STARTS)).collect()}
    _, given = learning.kmeans(rows, [starts[i] for i in STARTS], threshold=-1.0, rounds=ROUNDS)
    return given.select("id", F.col("center").alias("center"), F.round("d", 4).alias("d"))


def ml_furthest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres started far apart, and the rows' clusters on convergence."""
    rows = _rows(spark, sf_dir)
    _, given = learning.kmeans(rows, learning.furthest_first(rows, 5), threshold=0.001)
    return given.groupBy("center").agg(F.count("*").alias("n"), F.round(F.avg(F.sqrt("d")), 4).alias("mean_distance"), F.round(F.avg("d"), 4).alias("mean_square"))


def ml_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = rollup.features_long(_rows(spark, sf_dir), ["id"])
    figures = rollup.finalize(rollup.tile_sum(long, []), digits=15)
    return learning.zscore(long, ["id"], figures).select("id", "feature_idx", F.round("z", 5).alias("z"))


def ml_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of five-fold predictions from the first four features."""
    few = _rows(spark, sf_dir).withColumn("features", F.slice("features", 1, 4))
    return learning.confusion(learning.cross_validated(few, "label"), "label").withColumn("rate", F.round("rate", 6))


def agg_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation per image and feature, set against those of all rows (bad values not taken out of the count)."""
    long = rollup.features_long(_rows(spark, sf_dir), ["label"])
    sums = rollup.tile_sum(long, ["label"])
    own = rollup.finalize(sums, ignore_bad=True, digits=15)
    all_rows = rollup.finalize(rollup.merge_sums(sums, []), ignore_bad=True, digits=15).select("feature_idx", F.col("nu_mean").alias("m"), F.col("nu_stdev").alias("s"))
    out = own.join(F.broadcast(all_rows), "feature_idx")  # one row per feature
    return out.select("label", "feature_idx", F.round((F.col("nu_mean") - F.col("m")) / F.col("s"), 5).alias("mean_z"), F.round(F.col("nu_stdev") / F.col("s"), 5).alias("std_ratio"))


def agg_percent_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rollup.features_long(_rows(spark, sf_dir), ["label", "id"])
    half = lambda k: rollup.finalize(rollup.tile_sum(e.filter(F.col("id") % 2 == k), ["label"]), digits=15)
    return learning.percent_difference(half(0), half(1), ["label", "feature_idx"], "nu_stdev").withColumn("pct", F.round("pct", 4))


def join_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose name starts with no listed prefix. Prefixes are cut from the names by the lengths that occur, so the
    exclusion is an equality join."""
    listed = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("Customer#"), F.lpad((F.col("n_nationkey") * 3).cast("string"), 8, "0")).alias("prefix"))
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    return without_prefixes(names, "c_name", listed).select("c_custkey")


def without_prefixes(rows: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    lengths = [r[0] for r in listed.select(F.length("prefix")).distinct().collect()]  # at most the longest prefix
    for n in lengths:
        rows = rows.join(listed.filter(F.length("prefix") == n), F.substring(column, 1, n) == F.col("prefix"), "left_anti")
    return rows


def ml_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = learning.fit_distributions(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", (F.col("value") + 0.001).alias("v")), ["event_type"], "v")
    return got.select("event_type", "distribution", "n", F.round("nll", 2).alias("nll"), F.round("bic", 2).alias("bic"), "place")


def fea_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order play the points of an outline."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("x"), (F.col("l_partkey") % 50).alias("y"), "l_suppkey", "l_partkey")
    m = contours.measures(li.withColumn("ord", F.struct("ord", "l_suppkey", "l_partkey")), ["l_orderkey"])
    return m.select("l_orderkey", "points", *(F.round(c, 5).alias(c) for c in ("area", "pixels", "length", "compactness", "diameter")), (F.round("bending", 5) + 0.0).alias("bending"))


QUERIES = {f.__name__: f for f in (ml_kmeans, ml_furthest_first, ml_zscore, ml_quadratic, agg_patients, agg_percent_difference, join_excluded, ml_distributions, fea_contours)}


def _lloyd() -> str:
    sql = """with x as materialized (select vec_id as id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as k from embeddings),
      c0 as materialized (select id as center, k, v as c from x where id in (0, 1, 2, 3))"""
    for i in range(ROUNDS):
        sql += f""", d{i} as (select id, center, sum((v - c) * (v - c)) as d from x join c{i} using (k) group by all), g{i} as materialized (select id, arg_min(center, (d, center)) as center, min(d) as d from d{i} group by id),
      c{i + 1} as materialized (select center, k, avg(v) as c from x join g{i} using (id) group by all)"""
    return sql + f" select id, center::int as center, round(d, 4) as d from g{ROUNDS - 1}"


_X = "with x as (select vec_id as id, label, unnest(embedding)::double as v, cast(generate_subscripts(embedding, 1) - 1 as int) as feature_idx from embeddings), g as (select feature_idx, avg(v) as m, stddev_pop(v) as s from x group by 1) "
ORACLE_SQL = {
    "ml_distributions": """with s as (select event_type, count(*) as n, avg(v) as m, stddev_pop(v) as s, min(v) as lo, max(v) as hi, avg(case when v > 0 then ln(v) end) as lm, stddev_pop(case when v > 0 then ln(v) end) as ls
        from (select event_type, value + 0.001::double as v from events) group by 1),
      f as (select event_type, n, 'normal' as distribution, 2 as k, n * (ln(s) + 0.5::double * ln(2 * pi()) + 0.5::double) as nll from s where s > 0
        union all select event_type, n, 'exponential', 1, n * (ln(m) + 1) from s where lo >= 0 and m > 0
        union all select event_type, n, 'lognormal', 2, n * (ln(ls) + 0.5::double * ln(2 * pi()) + 0.5::double + lm) from s where lo > 0 and ls > 0
        union all select event_type, n, 'uniform', 2, n * ln(hi - lo) from s where hi > lo)
      select event_type, distribution, n, round(nll, 2) as nll, round(2 * nll + k * ln(n), 2) as bic, row_number() over (partition by event_type order by 2 * nll + k * ln(n), distribution)::int as place from f""",
    "fea_contours": """with p as (select l_orderkey, l_quantity as x, (l_partkey % 50)::double as y, row_number() over w as i, count(*) over (partition by l_orderkey) as c from lineitem window w as (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey)),
      e as (select a.l_orderkey, a.x, a.y, b.x as nx, b.y as ny, b.x - a.x as dx, b.y - a.y as dy from p a join p b on a.l_orderkey = b.l_orderkey and b.i = a.i % a.c + 1),
      s as (select l_orderkey, count(*) as points, abs(sum(x * ny - nx * y)) / 2 as area, sum(sqrt(dx * dx + dy * dy)) as length, sum(greatest(abs(dx), abs(dy))) as edge,
        sum(case when dx != 0 then atan(dy / dx) else sign(dy) * pi() / 2 end) as bending from e group by 1)
      select l_orderkey, points, round(area, 5) as area, round(area + edge / 2 + 1, 5) as pixels, round(length, 5) as length, round(case when area > 0 then length * length / area - 4 * pi() end, 5) as compactness,
       round(case when area > 0 then 2 * sqrt(area / pi()) end, 5) as diameter, round(bending, 5) + 0.0 as bending from s""",
    "ml_kmeans": _lloyd(),
    "ml_zscore": _X + "select id, feature_idx, round((v - m) / s, 5) as z from x join g using (feature_idx)",
    "agg_patients": _X + "select label, feature_idx, round((avg(v) - any_value(m)) / any_value(s), 5) as mean_z, round(stddev_pop(v) / any_value(s), 5) as std_ratio from x join g using (feature_idx) group by label, feature_idx",
    "agg_percent_difference": _X + """, h as (select label, feature_idx, id % 2 as k, stddev_pop(v) as s from x group by all)
      select a.label, a.feature_idx, round(case when greatest(a.s, b.s) > 0 then abs(a.s - b.s) / greatest(a.s, b.s) * 100 else 0 end, 4) as pct from h a join h b on a.label = b.label and a.feature_idx = b.feature_idx and a.k = 0 and b.k = 1""",
    "join_excluded": "select c_custkey from customer where not exists (select 1 from nation where starts_with(c_name, 'Customer#' || lpad((n_nationkey * 3)::varchar, 8, '0')))",
}
