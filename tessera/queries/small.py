"""Queries of the small relational operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..plans import rollup, tables
from .learning import _X, _rows
from .pixels import _PX, _gray


def prj_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed and mask of two gray levels, the mask of a label plane without its border, and gray over red."""
    seed, mask = px.seed_and_mask(F.col("gray"))
    label = tables.label_to_mask(F.when(mask, F.col("tile") + 1).otherwise(0), F.col("x"), F.col("y"), 8, 8, border=False)
    return _gray(spark, sf_dir).select("tile", "y", "x", seed.alias("seed"), mask.alias("mask"), label.alias("label_mask"), F.round(px.divide(F.col("gray"), F.col("r")), 6).alias("over_red"))


def join_hash_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of every nation, as sorted lists."""
    a = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("key"), "n_name")
    b = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("key"), "s_suppkey")
    return tables.match_indices(a, b, "key", "s_suppkey").select("n_name", F.size("matches").alias("n"), F.array_join("matches", ",").alias("matches"))


def set_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of light pixels and of red ones, combined and counted per tile."""
    g = _gray(spark, sf_dir)
    got = tables.combine_masks(g.filter("gray > 128"), g.filter("r > g"), ["tile", "y", "x"])
    return got.groupBy("tile").agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in ("both", "either", "one", "first")))


def prj_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted fields, of which one doesn't exist, less one."""
    return tables.without(tables.project(spark.read.parquet(f"{sf_dir}/part.parquet"), ["p_brand", "p_partkey", "p_colour", "p_size"]), ["p_brand"])


def agg_tile_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("tile", F.col("id") % 8)
    means = rollup.mean_vector(rollup.features_long(rows, ["label", "tile"]), ["label", "tile"])
    return means.select("label", "tile", F.posexplode("features").alias("feature_idx", "v")).select("label", "tile", "feature_idx", F.round("v", 6).alias("mean"))


def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.distinct_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], ["user_id", "value"])


def srt_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten customers with most orders."""
    return tables.largest_groups(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", 10)


def srt_longest_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.longest_feature(rollup.features_long(_rows(spark, sf_dir), []), True).select("feature_idx", F.round("norm", 6).alias("norm"))


QUERIES = {f.__name__: f for f in (prj_levels, join_hash_match, set_masks, prj_fields, agg_tile_mean, agg_distinct, srt_images, srt_longest_feature)}
ORACLE_SQL = {
    "prj_levels": _PX + """select tile, y, x, gray > 80 as seed, gray > 45 as mask, cast(case when gray > 45 and x between 1 and 6 and y between 1 and 6 then 255 else 0 end as int) as label_mask,
      round(case when r != 0 then gray::double / r end, 6) as over_red from q""",
    "join_hash_match": "select n_name, cast(count(s_suppkey) as int) as n, coalesce(string_agg(s_suppkey::varchar, ',' order by s_suppkey), '') as matches from nation left join supplier on s_nationkey = n_nationkey group by n_nationkey, n_name",
    "set_masks": _PX + """select tile, count(*) filter (where gray > 128 and r > g) as both, count(*) as either, count(*) filter (where (gray > 128) != (r > g)) as one, count(*) filter (where gray > 128 and not r > g) as first
      from q where gray > 128 or r > g group by tile""",
    "prj_fields": "select p_partkey, p_size from part",
    "agg_tile_mean": _X + "select label, id % 8 as tile, feature_idx, round(avg(v), 6) as mean from x group by all",
    "agg_distinct": "select event_type, count(distinct user_id) as n_user_id, count(distinct value) as n_value from events group by 1",
    "srt_images": "select o_custkey, count(*) as n from orders group by 1 order by n desc, o_custkey limit 10",
    "srt_longest_feature": _X + "select feature_idx, round(sqrt(sum(v * v) / count(*)), 6) as norm from x group by 1 order by sqrt(sum(v * v)) desc, feature_idx limit 1",
}
