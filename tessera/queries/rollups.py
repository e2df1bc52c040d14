"""Queries of the feature rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rollup import features_long, finalize, merge_sums, tile_sum


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return features_long(e.select(F.col("label").alias("image"), (F.col("vec_id") % 8).cast("int").alias("tile"), "embedding"), ["image", "tile"], "embedding")


def agg_tile_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_sum(_long(spark, sf_dir), ["image", "tile"]).withColumns({c: F.round(c, 6) for c in ("nu_sum", "nu_sum_square")})


def agg_image_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = merge_sums(tile_sum(_long(spark, sf_dir), ["image", "tile"]), ["image"])
    return finalize(sums).select("image", "feature_idx", "nu_count", "bad_count", F.round("nu_mean", 6).alias("nu_mean"), F.round("nu_stdev", 6).alias("nu_stdev"))


def agg_dataset_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = merge_sums(merge_sums(tile_sum(_long(spark, sf_dir), ["image", "tile"]), ["image"]), [])
    return finalize(sums).select("feature_idx", "nu_count", "bad_count", F.round("nu_mean", 6).alias("nu_mean"), F.round("nu_stdev", 6).alias("nu_stdev"))


_LONG = """with l as (select label as image, cast(vec_id % 8 as int) as tile, unnest(embedding)::double as v,
  cast(generate_subscripts(embedding, 1) - 1 as int) as feature_idx from embeddings) """
_FINAL = """count(*) as nu_count, cast(0 as bigint) as bad_count, round(avg(v), 6) as nu_mean, round(stddev_pop(v), 6) as nu_stdev from l """

QUERIES = {"agg_tile_sum": agg_tile_sum, "agg_image_rollup": agg_image_rollup, "agg_dataset_rollup": agg_dataset_rollup}
ORACLE_SQL = {
    "agg_tile_sum": _LONG + "select image, tile, feature_idx, count(*) as nu_count, cast(0 as bigint) as bad_count, round(sum(v), 6) as nu_sum, round(sum(v * v), 6) as nu_sum_square from l group by all",
    "agg_image_rollup": _LONG + "select image, feature_idx, " + _FINAL + "group by image, feature_idx",
    "agg_dataset_rollup": _LONG + "select feature_idx, " + _FINAL + "group by feature_idx",
}
