"""Queries of grids, pairing, re-tiling and feature layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import features, tiles
from .pixels import _PX, _gray


def src_tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts play slides with four levels."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("slide"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"), "p_size")
    side = lambda k: F.floor(F.col("p_size") * k / F.pow(F.lit(2.0), "level")).cast("int")
    levels = p.select("slide", "level", (40.0 / F.pow(F.lit(2.0), "level")).alias("magnification"), side(100).alias("width"), side(60).alias("height"))
    return tiles.grid(levels, 18.0, 512)


def src_retile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles side by side, cut anew into tiles of 12."""
    p = _gray(spark, sf_dir).select((F.col("tile") * 8 + F.col("x")).alias("gx"), F.col("y").cast("long").alias("gy"), "gray")
    return tiles.retile(p, 12).groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"), F.sum("gray").alias("total"), F.max("x").alias("x"), F.max("y").alias("y"))


def join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders play masks, customers images with one of several endings."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("m/s"), F.col("o_custkey").cast("string"), F.lit("-"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".mask.png")).alias("path"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    kind = F.element_at(F.array(*(F.lit(e) for e in ("png", "tiff", "tif", "jpg"))), F.col("k") + 1)
    images = c.filter("(c_custkey + k) % 2 = 0").select(F.concat(F.lit("i/s"), F.col("c_custkey").cast("string"), F.lit("-"), (F.col("c_custkey") % 3).cast("string"), F.lit("."), kind).alias("path"))
    return tiles.pair(o, images)


def snk_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("data"))
    up = features.upgrade(e)
    return up.select("vec_id", *features.META, F.size("features").alias("n"), F.round(F.aggregate("features", F.lit(0.0), lambda s, v: s + v), 9).alias("total"))


QUERIES = {f.__name__: f for f in (src_tile_grid, src_retile, join_pairs, snk_upgrade)}
ORACLE_SQL = {
    "src_tile_grid": """with l as (select p_partkey as slide, level::int as level, 40 / pow(2.0::double, level) as mag, cast(floor(p_size * 100 / pow(2.0::double, level)) as int) as width, cast(floor(p_size * 60 / pow(2.0::double, level)) as int) as height
      from part, generate_series(0, 3) g(level)), b as (select * from l qualify row_number() over (partition by slide order by abs(mag - 18), level) = 1),
      t as (select slide, level, width, height, unnest(generate_series(0, width - 1, 512))::int as x from b where width > 0 and height > 0), u as (select *, unnest(generate_series(0, height - 1, 512))::int as y from t)
      select slide, level, x, y, least(512, width - x) as w, least(512, height - y) as h from u""",
    "src_retile": _PX + """, p2 as (select tile * 8 + x as gx, y::bigint as gy, gray from q)
      select gx // 12 * 12 as tile_x, gy // 12 * 12 as tile_y, count(*) as n, sum(gray)::bigint as total, max(gx % 12) as x, max(gy % 12) as y from p2 group by 1, 2""",
    "join_pairs": """with m as (select 'm/s' || o_custkey || '-' || (o_orderkey % 3) || '.mask.png' as mask, 's' || o_custkey || '-' || (o_orderkey % 3) as stem from orders),
      i as (select 's' || c_custkey || '-' || (c_custkey % 3) as stem, (['png', 'tiff', 'tif', 'jpg'])[k + 1] as kind from customer, generate_series(0, 3) g(k) where (c_custkey + k) % 2 = 0),
      b as (select stem, kind from i where kind != 'jpg' qualify row_number() over (partition by stem order by case kind when 'tif' then 1 when 'tiff' then 2 else 3 end) = 1)
      select mask, 'i/' || stem || '.' || kind as image, stem from m join b using (stem)""",
    "snk_upgrade": "select vec_id, " + ", ".join(f"embedding[{i + 1}]::double as {n}" for i, n in enumerate(features.META)) + ", cast(len(embedding) - 6 as int) as n, round(list_sum(list_transform(embedding[7:], lambda v: v::double)), 9) as total from embeddings",
}
