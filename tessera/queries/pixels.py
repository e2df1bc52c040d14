"""Queries over pixels; three embeddings in a row play the blue, green and red planes of an 8 x 8 tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..operators.staging import fresh
from ..sources import images, tiles


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    value = px.to_u8((F.col("v").cast("double") + 0.5) * 255.0)
    plane = lambda k: F.max(F.when(F.col("vec_id") % 3 == k, value))
    tiles = e.groupBy(F.floor(F.col("vec_id") / 3).alias("tile"), "pos").agg(plane(0).alias("b"), plane(1).alias("g"), plane(2).alias("r"))
    return tiles.filter("b is not null and g is not null and r is not null").select("tile", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), "b", "g", "r")


_PX = """with e as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
 t as (select cast(vec_id // 3 as bigint) as tile, pos, max(case when vec_id % 3 = 0 then u end) as b, max(case when vec_id % 3 = 1 then u end) as g, max(case when vec_id % 3 = 2 then u end) as r
  from (select *, cast(least(greatest(floor((v + 0.5) * 255.0 + 0.5), 0), 255) as int) as u from e) group by 1, 2),
 p as (select tile, cast(pos // 8 as int) as y, cast(pos % 8 as int) as x, b, g, r from t where b is not null and g is not null and r is not null),
 q as (select *, cast(least(greatest(floor(b * 0.114020904255103::double + g * 0.587043074451121::double + r * 0.298936021293776::double + 0.5), 0), 255) as int) as gray from p) """


_PLACED = _PX + ", pl as materialized (select 'slide' || (tile % 3) as image, (tile // 3 % 4 * 8)::int as tile_x, (tile // 12 * 8)::int as tile_y, y, x, b, g, r from p) "


def _gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("gray", px.gray(F.col("b"), F.col("g"), F.col("r")))


def prj_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    return _gray(spark, sf_dir).select("tile", "y", "x", "gray", px.invert(r).alias("inverted"), px.green_fraction(b, g, r).alias("green"), F.round(px.density(g), 6).alias("density"), px.is_foreground(b, g, r).alias("foreground"))


def flt_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.avg(px.is_background(F.col("b"), F.col("g"), F.col("r")).cast("double"))
    out = pixels(spark, sf_dir).groupBy("tile").agg(ratio.alias("ratio"))
    return out.select("tile", F.round("ratio", 6).alias("ratio"), F.when(F.col("ratio") >= 0.99, "BACKGROUND").when(F.col("ratio") >= 0.9, "BACKGROUND_LIKELY").otherwise("CONTINUE").alias("status"))


def agg_histogram_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = _gray(spark, sf_dir).groupBy("tile", "gray").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("tile"))
    p = bins.withColumn("p", F.col("n") / total)
    m = p.groupBy("tile").agg(F.sum(F.col("p") * F.col("gray")).alias("mean"), F.sum(F.col("p") * F.col("gray") * F.col("gray")).alias("sq"), F.min("gray").alias("lowest"), F.max("gray").alias("highest"), F.negative(F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.sum(F.col("p") * F.col("p")).alias("energy"))
    return m.select("tile", F.round("mean", 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0))), 5).alias("std"), "lowest", "highest", F.round("entropy", 6).alias("entropy"), F.round("energy", 6).alias("energy"))


def win_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = _gray(spark, sf_dir).groupBy("tile", "gray").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tile")
    cum = bins.withColumn("cum", F.sum("n").over(w.orderBy("gray").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    at = lambda k: F.min(F.when(F.col("cum") >= F.expr(k), F.col("gray")))
    return cum.groupBy("tile").agg(at("total div 4").alias("q1"), at("total div 2").alias("median"), at("3 * total div 4").alias("q3"))


def agg_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = _gray(spark, sf_dir).withColumn("i", F.floor(F.col("gray") * 7.0 / 255.0 + 1.5).cast("int"))
    right = level.withColumn("j", F.lead("i").over(Window.partitionBy("tile", "y").orderBy("x")))
    return right.filter("j is not null").groupBy("tile", "i", "j").agg(F.count("*").alias("n"))


def win_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    wx, wy = Window.partitionBy("tile", "y").orderBy("x"), Window.partitionBy("tile", "x").orderBy("y")
    diff = lambda w: F.when(F.lag("gray").over(w).isNull(), F.lead("gray").over(w) - F.col("gray")).when(F.lead("gray").over(w).isNull(), F.col("gray") - F.lag("gray").over(w)).otherwise((F.lead("gray").over(w) - F.lag("gray").over(w)) / 2.0).cast("double")
    return _gray(spark, sf_dir).select("tile", "y", "x", diff(wx).alias("dx"), diff(wy).alias("dy")).select("tile", "y", "x", px.to_u8(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("magnitude"))


def win_systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id")
    return tiles.sample(e, 3, 10, ["label"], "vec_id", 100)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles as parts of images of four by any number of tiles."""
    p = pixels(spark, sf_dir)
    return p.select(F.concat(F.lit("slide"), F.col("tile") % 3).alias("image"), (F.floor(F.col("tile") / 3) % 4 * 8).alias("tile_x"), (F.floor(F.col("tile") / 12) * 8).alias("tile_y"), "y", "x", "b", "g", "r")


def src_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles written as PNG and read back, within a box of one image."""
    path = fresh(spark)
    images.write(_placed(spark, sf_dir), path)
    return images.read(spark, path, box=(4, 5, 30, 45), image="slide1")


def snk_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles put together, written as TIFF pieces of 20 x 20 and read back."""
    path = fresh(spark)
    images.write(images.mosaic(_placed(spark, sf_dir), 20), path, kind="tif")
    return images.read(spark, path)


def src_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty names drawn, the same ones on every run."""
    return tiles.shuffled(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name"), "c_name", 30)


def join_prefix_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return o.groupBy(F.substring("c_name", 1, 15).alias("patient")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.stddev_pop("c_acctbal"), 4).alias("std"))


def prj_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract(u, "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract(u, "([^/]*)$", 1).alias("file"), F.regexp_extract(u, r"\.([^./]*)$", 1).alias("ext"), u.startswith("https://").alias("secure"))


def ml_nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    centers = e.select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("c"))
    x = e.select("vec_id", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))
    d = x.join(centers, "k").groupBy("vec_id", "label").agg(F.round(F.sum((F.col("v") - F.col("c")) * (F.col("v") - F.col("c"))), 8).alias("d"))
    return d.groupBy("vec_id").agg(F.min(F.struct("d", "label")).alias("m")).select("vec_id", F.col("m.label").alias("center"), F.round("m.d", 5).alias("distance"))


QUERIES = {f.__name__: f for f in (prj_pixels, flt_background, agg_histogram_moments, win_quartiles, agg_cooccurrence, win_gradient, win_systematic_sample, src_png, src_shuffled, snk_mosaic, join_prefix_patients, prj_paths, ml_nearest_center)}
ORACLE_SQL = {
    "prj_pixels": _PX + """select tile, y, x, gray, 255 - r as inverted, cast(floor(g / (b + g + r + 2.220446049250313e-16) * 255.0::double) as int) as green, round(255.0::double - 255.0::double * ln(g + 1.0::double) / ln(255.0::double), 6) as density,
      (r * -0.154::double + g * 0.035::double + b * 0.549::double - 45.718::double) < (r * -0.057::double + g * -0.817::double + b * 1.170::double - 49.887::double) as foreground from q""",
    "flt_background": _PX + ", s as (select tile, avg((b > 220 and g > 220 and r > 220)::int::double) as ratio from p group by tile) select tile, round(ratio, 6) as ratio, case when ratio >= 0.99 then 'BACKGROUND' when ratio >= 0.9 then 'BACKGROUND_LIKELY' else 'CONTINUE' end as status from s",
    "agg_histogram_moments": _PX + """, h as (select tile, gray, count(*) as n from q group by all), m as (select *, n / sum(n) over (partition by tile)::double as p from h)
      select tile, round(sum(p * gray), 6) as mean, round(sqrt(greatest(sum(p * gray * gray) - sum(p * gray) * sum(p * gray), 0)), 5) as std, min(gray) as lowest, max(gray) as highest, round(-sum(p * log2(p)), 6) as entropy, round(sum(p * p), 6) as energy from m group by tile""",
    "src_shuffled": "select c_name from customer order by md5('0:' || c_name), c_name limit 30",
    "src_png": _PLACED + "select image, tile_x, tile_y, y, x, b, g, r from pl where image = 'slide1' and tile_x + x >= 4 and tile_x + x < 30 and tile_y + y >= 5 and tile_y + y < 45",
    "snk_mosaic": _PLACED + """, c as (select image, max(tile_x + x) as w, max(tile_y + y) as h from pl group by image),
      g as (select image, gx, gy from c, range(0, 4096) a(gx), range(0, 65536) b(gy) where gx <= w and gy <= h)
      select g.image, (gx // 20 * 20)::int as tile_x, (gy // 20 * 20)::int as tile_y, (gy % 20)::int as y, (gx % 20)::int as x, coalesce(b, 255) as b, coalesce(pl.g, 255) as g, coalesce(r, 255) as r
      from g left join pl on pl.image = g.image and pl.tile_x + pl.x = gx and pl.tile_y + pl.y = gy""",
    "win_quartiles": _PX + """, h as (select tile, gray, count(*) as n from q group by all), c as (select *, sum(n) over (partition by tile order by gray) as cum, sum(n) over (partition by tile) as total from h)
      select tile, min(case when cum >= total // 4 then gray end) as q1, min(case when cum >= total // 2 then gray end) as median, min(case when cum >= 3 * total // 4 then gray end) as q3 from c group by tile""",
    "agg_cooccurrence": _PX + ", l as (select *, cast(floor(gray * 7.0::double / 255.0::double + 1.5) as int) as i from q), j as (select *, lead(i) over (partition by tile, y order by x) as j from l) select tile, i, j, count(*) as n from j where j is not null group by all",
    "win_gradient": _PX + """, d as (select tile, y, x, coalesce((lead(gray) over wx - lag(gray) over wx) / 2.0::double, lead(gray) over wx - gray, gray - lag(gray) over wx)::double as dx,
      coalesce((lead(gray) over wy - lag(gray) over wy) / 2.0::double, lead(gray) over wy - gray, gray - lag(gray) over wy)::double as dy from q window wx as (partition by tile, y order by x), wy as (partition by tile, x order by y))
      select tile, y, x, cast(least(greatest(floor(sqrt(dx * dx + dy * dy) + 0.5), 0), 255) as int) as magnitude from d""",
    "win_systematic_sample": "select label, vec_id from (select label, vec_id, row_number() over (partition by label order by vec_id) as rn from embeddings) where (rn * 3) // 10 > ((rn - 1) * 3) // 10",
    "join_prefix_patients": "select substr(c_name, 1, 15) as patient, count(*) as n, round(avg(c_acctbal), 4) as mean, round(stddev_pop(c_acctbal), 4) as std from customer group by 1",
    "prj_paths": r"select page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) as dir, regexp_extract(url, '([^/]*)$', 1) as file, regexp_extract(url, '\.([^./]*)$', 1) as ext, starts_with(url, 'https://') as secure from pages",
    "ml_nearest_center": """with x as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as k from embeddings), c as (select label, k, avg(v) as c from x group by all),
      d as (select x.vec_id, c.label, round(sum((v - c) * (v - c)), 8) as d from x join c using (k) group by all) select vec_id, arg_min(label, (d, label)) as center, round(min(d), 5) as distance from d group by vec_id""",
}
