"""Queries of object features and colour normalization over the 8 x 8 tiles of the pixel queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..operators import regions
from ..operators.morphology import disc
from ..plans import normalize, objects, segment, vectors
from .pixels import _PX, _gray, pixels
from .regions import _ON, _mask, _reach

# A target for normalization.
TARGET = {"mean_l": -0.6, "std_l": 0.3, "mean_alpha": -0.05, "std_alpha": 0.1, "mean_beta": 0.01, "std_beta": 0.05}


def _rounded(df: DataFrame, keys: tuple[str, ...], digits: int = 5) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.label(_mask(spark, sf_dir), 8)


def fea_morphometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(objects.morphometry(_labels(spark, sf_dir)), ("tile", "label"), 4)


def fea_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labels(spark, sf_dir).join(_gray(spark, sf_dir).select("tile", "y", "x", "gray"), ["tile", "y", "x"])
    m = objects.moments(objects.histogram(labelled, ["tile", "label"], "gray"), ["tile", "label"])
    return _rounded(m.drop("skewness", "kurtosis"), ("tile", "label"), 4)


def agg_tile_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = objects.histogram(_gray(spark, sf_dir), ["tile"], "gray")
    return _rounded(objects.moments(h, ["tile"], sample=True).join(objects.median_mean(h, ["tile"]), "tile"), ("tile",), 4)


def fea_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(objects.texture(objects.cooccurrence(_gray(spark, sf_dir), ["tile"], "gray"), ["tile"]), ("tile",), 6)


def fea_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    extent = pixels(spark, sf_dir).groupBy("tile").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return objects.ring(_labels(spark, sf_dir), extent, 2).groupBy("tile", "label").agg(F.count("*").alias("n"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"))


def fea_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of the objects, a row each: of nucleus and ring (two pixels wide), in the vector's order."""
    v = vectors.object_vectors(_labels(spark, sf_dir), pixels(spark, sf_dir), 2).select("tile", "label", F.posexplode("features").alias("feature_idx", "value"))
    return v.select("tile", "label", "feature_idx", F.round(F.col("value") + 1e-9, 4).alias("value"))


def join_label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.overlaps(_labels(spark, sf_dir), regions.label(_mask(spark, sf_dir), 4))


def prj_stains(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, e = px.unmix(F.col("b"), F.col("g"), F.col("r"), px.unmixing())
    return pixels(spark, sf_dir).select("tile", "y", "x", h.alias("h"), e.alias("e"))


def prj_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, r = F.col("g"), F.col("r")
    return pixels(spark, sf_dir).select("tile", "y", "x", px.modulo(g, 7).alias("m"), px.replace(g, 128, 0).alias("p"), px.within(g, 100, 150, True, False).alias("w"), px.masked(g, r > 128, 255).alias("k"), px.is_red_cell(F.col("b"), g, r, 1.5).alias("red"))


def prj_opponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = px.to_opponent(*(F.col(c) / 255.0 for c in "bgr"))
    return pixels(spark, sf_dir).select("tile", "y", "x", *(F.round(v, 7).alias(n) for n, v in zip(normalize.CHANNELS, lab)))


def nrm_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(normalize.statistics(normalize.opponent(pixels(spark, sf_dir), strict=True), ["tile"]), ("tile",), 6)


def nrm_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean colour per tile after normalization."""
    new = normalize.normalize(pixels(spark, sf_dir), TARGET, strict=True)
    return new.groupBy("tile").agg(*(F.round(F.avg(c), 1).alias(c) for c in "bgr"))


def seg_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations play tiles of 64 x 64, their suppliers nuclei; every fifth nation's tile is blank, and every fifth supplier a red cell."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").cast("long").alias("tile"), "s_suppkey")
    s = s.select("tile", (F.col("s_suppkey") * 17 % 52 + 6).cast("int").alias("cy"), (F.col("s_suppkey") * 29 % 52 + 6).cast("int").alias("cx"), (F.col("s_suppkey") % 5 == 0).alias("red"))
    d = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc(5))))
    drawn = s.filter("tile % 5 != 4").select("tile", "cy", "cx", "red", d.alias("d")).groupBy("tile", (F.col("cy") + F.col("d.dy")).alias("y"), (F.col("cx") + F.col("d.dx")).alias("x")).agg(F.max("red").alias("red"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("y"))
    grid = n.select("tile", "y", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x")).join(drawn, ["tile", "y", "x"], "left")
    shade = lambda nucleus, cell, ground: F.when(F.col("tile") % 5 == 4, 250).when(F.col("red").isNull(), ground).when(F.col("red"), cell).otherwise(nucleus)
    labels, status = segment.segment(grid.select("tile", "y", "x", shade(90, 10, 180).alias("b"), shade(60, 10, 180).alias("g"), shade(70, 90, 200).alias("r")))
    sums = labels.groupBy("tile").agg(F.countDistinct("label").alias("n_objects"), F.count("*").alias("n_pixels"))
    return status.join(sums, "tile", "left").select("tile", F.round("ratio", 6).alias("ratio"), "status", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_objects", "n_pixels")))


QUERIES = {f.__name__: f for f in (seg_status, fea_morphometry, fea_intensity, agg_tile_moments, fea_texture, fea_ring, fea_vector, join_label_overlap, prj_stains, prj_simple, prj_opponent, nrm_target, nrm_tiles)}

_L = _reach(_ON, 8)
_MOMENTS = "round(avg(gray), 4) as mean, min(gray) as lowest, max(gray) as highest"
_CONE = lambda w: f"({w[0]}::double * (r / 255.0::double) + {w[1]}::double * (g / 255.0::double) + {w[2]}::double * (b / 255.0::double))"
_LAB = _PX + ", c as (select *, " + ", ".join(f"log10(nullif({_CONE(w)}, 0)) as c{k}" for k, w in enumerate(px.CONES)) + """ from p),
 lab as (select *, (c0 + c1 + c2) / sqrt(3.0::double) as l, (c0 + c1 - 2 * c2) / sqrt(6.0::double) as alpha, (c0 - c1) / sqrt(2.0::double) as beta,
  (r * -0.154::double + g * 0.035::double + b * 0.549::double - 45.718::double) < (r * -0.057::double + g * -0.817::double + b * 1.170::double - 49.887::double) as fg from c),
 st as (select tile, """ + ", ".join(f"avg({c}) as mean_{c}, stddev_pop({c}) as std_{c}" for c in normalize.CHANNELS) + " from lab where fg and l is not null group by tile) "
_MOVED = ", ".join(f"case when fg then ({c} - mean_{c}) * (case when std_{c} > 0 then {TARGET['std_' + c]}::double / std_{c} else 0 end) + {TARGET['mean_' + c]}::double end as n_{c}" for c in normalize.CHANNELS)
_BACK = ", ".join(f"coalesce(pow(10.0::double, n_l / sqrt(3.0::double) + n_alpha / sqrt(6.0::double) * {a} + n_beta / sqrt(2.0::double) * {b}), 0) as k{i}" for i, (a, b) in enumerate(((1, 1), (1, -1), (-2, 0))))
_U8 = lambda e: f"least(greatest(floor(({e}) + 0.5), 0), 255)"
_RGB = ", ".join(f"round(avg(case when fg then {_U8('(' + ' + '.join(f'k{i} * {v}::double' for i, v in enumerate(w)) + ') * 255.0::double')} else {c} end), 1) as {c}" for c, w in zip("rgb", px.COLOURS))
_Q = px.unmixing()
_D = lambda c: f"(255.0::double - 255.0::double * ln({c} + 1.0::double) / ln(255.0::double))"
_STAIN = ", ".join("cast(" + _U8(f"exp(({_D('r')} * {w[0]!r}::double + {_D('g')} * {w[1]!r}::double + {_D('b')} * {w[2]!r}::double - 255.0::double) * -(ln(255.0::double) / 255.0::double))") + f" as int) as {n}" for n, w in zip("he", _Q))
_PAIRS = " union all ".join(f"select a.tile, {angle} as angle, a.i, b.i as j from v a join v b on a.tile = b.tile and b.y = a.y + {dy} and b.x = a.x + {dx}" for angle, (dy, dx) in objects.ANGLES.items())
ORACLE_SQL = {
    "fea_morphometry": _L + """, s as (select tile, label, count(*) as area, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, var_pop(x) + 1 / 12.0::double as mxx, var_pop(y) + 1 / 12.0::double as myy, covar_pop(x, y) as mxy from l group by all),
      a as (select *, sqrt(8.0::double) * sqrt(mxx + myy + sqrt((mxx - myy) * (mxx - myy) + 4 * mxy * mxy)) as major_axis, sqrt(8.0::double) * sqrt(greatest(mxx + myy - sqrt((mxx - myy) * (mxx - myy) + 4 * mxy * mxy), 0)) as minor_axis from s),
      w as (select l.tile, l.label, l.y + d.dy as wy, l.x + d.dx as wx, count(*) as n, bool_or(d.dy = 0) and bool_or(d.dy = -1) and count(distinct d.dx) = 2 as across
        from l, (values (0, 0), (0, -1), (-1, -1), (-1, 0)) d(dy, dx) group by all),
      pm as (select tile, label, sum(case when n in (1, 3) then 0.70710678118::double when n = 2 and across then sqrt(2.0::double) when n = 2 then 1 else 0 end) as perimeter from w group by all)
      select tile, label, area, min_x, max_x, min_y, max_y, round(major_axis, 4) as major_axis, round(minor_axis, 4) as minor_axis, round(area / ((max_x - min_x + 1) * (max_y - min_y + 1))::double, 4) as extent,
       round((min_x + max_x) / 2.0::double, 4) as centroid_x, round((min_y + max_y) / 2.0::double, 4) as centroid_y,
       round(sqrt(abs(major_axis * major_axis - minor_axis * minor_axis)) / major_axis, 4) as eccentricity, round(perimeter, 4) as perimeter, round(4 * pi() * area / (perimeter * perimeter), 4) as circularity from a join pm using (tile, label)""",
    "fea_intensity": _L + f""", h as (select tile, label, gray, count(*) as n from l group by all), hp as (select *, n / sum(n) over (partition by tile, label)::double as p from h),
      en as (select tile, label, round(-sum(p * log2(p)) + 0.0, 4) as entropy, round(sum(p * p), 4) as energy from hp group by all)
      select * from (select tile, label, count(*) as total, {_MOMENTS}, round(stddev_pop(gray), 4) as std, count(*) filter (gray != 0) as nonzero from l group by all) join en using (tile, label)""",
    "agg_tile_moments": _PX + f""", h as (select tile, gray, count(*) as n from q group by all), hp as (select *, n / sum(n) over (partition by tile)::double as p from h),
      en as (select tile, round(-sum(p * log2(p)) + 0.0, 4) as entropy, round(sum(p * p), 4) as energy from hp group by all),
      c as (select tile, avg(gray) as m, var_pop(gray) as v from q group by tile),
      k as (select q.tile, case when any_value(v) > 1e-9 then round(avg((gray - m) * (gray - m) * (gray - m)) / (any_value(v) * sqrt(any_value(v))), 4) end as skewness,
        case when any_value(v) > 1e-9 then round(avg((gray - m) * (gray - m) * (gray - m) * (gray - m)) / (any_value(v) * any_value(v)), 4) end as kurtosis from q join c on q.tile = c.tile group by q.tile)
      select * from (select tile, count(*) as total, {_MOMENTS}, round(stddev_samp(gray), 4) as std, count(*) filter (gray != 0) as nonzero, cast(floor(median(gray) + 0.5) as int) as median from q group by tile) join en using (tile) join k using (tile)""",
    "fea_texture": _PX + f""", v as (select tile, y, x, cast(floor(gray * 7.0::double / 255.0::double + 1.5) as int) - 1 as i from q), g as ({_PAIRS}),
      n as (select tile, angle, i, j, count(*) as n from g group by all), pp as materialized (select *, n / sum(n) over (partition by tile, angle)::double as p from n),
      m as (select tile, angle, sum(i * p) as mx, sum(j * p) as my from pp group by all)
      select tile, angle, round(sum((i - j) * (i - j) * p), 6) as inertia, round(sum(p * p), 6) as energy, round(-sum(p * log2(p)) + 0.0, 6) as entropy, round(sum(p / (1 + (i - j) * (i - j))), 6) as homogeneity, round(max(p), 6) as max_probability,
       round(sum(pow(1 - mx + j - my, 3) * p), 6) as cluster_shade, round(sum(pow(1 - mx + j - my, 4) * p), 6) as cluster_prominence from pp join m using (tile, angle) group by all""",
    "fea_ring": _L + """, r as (select distinct l.tile, l.label, q.y, q.x from l join q on l.tile = q.tile and (l.y - q.y) * (l.y - q.y) + (l.x - q.x) * (l.x - q.x) <= 4)
      select tile, label, count(*) as n, sum(y)::bigint as sum_y, sum(x)::bigint as sum_x from (from r anti join l using (tile, label, y, x)) group by all""",
    "join_label_overlap": _L + f""", n4 as materialized (select a.tile, a.node as p, b.node as r from o a join o b on a.tile = b.tile and abs(a.y - b.y) + abs(a.x - b.x) <= 1),
      reach4 as (select tile, node as p, node as r from o union select n4.tile, reach4.p, n4.r from reach4 join n4 on n4.tile = reach4.tile and n4.p = reach4.r),
      l4 as (select tile, p, min(r) as label_b from reach4 group by all)
      select l.tile, l.label as label_a, l4.label_b, count(*) as n from l join l4 on l4.tile = l.tile and l4.p = l.y::bigint * {regions.STRIDE} + l.x group by all""",
    "prj_stains": _PX + f"select tile, y, x, {_STAIN} from p",
    "prj_simple": _PX + """select tile, y, x, g % 7 as m, case when g = 128 then 0 else g end as p, g >= 100 and g < 150 as w, case when r > 128 then g else 255 end as k,
      (r / (g + 1.1920928955078125e-07::double) > 1.5) and (r / (b + 1.1920928955078125e-07::double) > 1.0) as red from p""",
    "prj_opponent": _LAB + "select tile, y, x, round(l, 7) as l, round(alpha, 7) as alpha, round(beta, 7) as beta from lab",
    "nrm_target": _LAB + "select tile, " + ", ".join(f"round({a}_{c}, 6) as {a}_{c}" for c in normalize.CHANNELS for a in ("mean", "std")) + " from st",
    "nrm_tiles": _LAB + f", mv as (select tile, b, g, r, fg, {_MOVED} from lab left join st using (tile)), bk as (select *, {_BACK} from mv) select tile, {_RGB} from bk group by tile",
}

_WX, _WY = "(partition by tile, ch, y order by x)", "(partition by tile, ch, x order by y)"
_SLOPE = lambda w: f"coalesce(case when lag(v) over {w} is null then lead(v) over {w} - v when lead(v) over {w} is null then v - lag(v) over {w} else (lead(v) over {w} - lag(v) over {w}) / 2.0::double end, 0)::double"
_MO = lambda c, pre: ", ".join(
    [f"avg({c}) as {pre}mean", f"max({c}) as {pre}highest", f"min({c}) as {pre}lowest", f"stddev_pop({c}) as {pre}std", f"floor(median({c}) + 0.5) as {pre}median",
     f"case when var_pop({c}) > 1e-9 then (avg(pow({c}::double, 3)) - 3 * avg({c}) * avg(pow({c}::double, 2)) + 2 * pow(avg({c}), 3)) / pow(var_pop({c}), 1.5) end as {pre}skewness",
     f"case when var_pop({c}) > 1e-9 then (avg(pow({c}::double, 4)) - 4 * avg({c}) * avg(pow({c}::double, 3)) + 6 * pow(avg({c}), 2) * avg(pow({c}::double, 2)) - 3 * pow(avg({c}), 4)) / pow(var_pop({c}), 2) end as {pre}kurtosis"])
_HIST = lambda c, pre: f"hist_{c} as (select tile, label, part, ch, -sum(n / t * log2(n / t)) + 0.0 as {pre}entropy, sum(pow(n / t, 2)) as {pre}energy from (select *, sum(n) over (partition by tile, label, part, ch)::double as t from (select tile, label, part, ch, {c}, count(*) as n from ob group by all)) group by all)"
_SHAPES = ORACLE_SQL["fea_morphometry"].partition("select tile, label, area, min_x")[0].partition(" s as (")[2]
_VECTOR = [*(f"shape.{n}" for n in ("area", "perimeter", "eccentricity", "circularity", "major_axis", "minor_axis", "extent")), *(f"n.{n}" for n in (*vectors.INTENSITY, *(f"d_{g}" for g in vectors.GRADIENT), *vectors.EDGES)),
           *(f"{c}.{'mean - ' + c + '.median' if n == 'mean_less_median' else n}" for c in ("cg", "ch", "ce") for n in (*vectors.RING_INTENSITY, *(f"d_{g}" for g in vectors.GRADIENT), *vectors.EDGES))]
ORACLE_SQL["fea_vector"] = _L + f""", s as ({_SHAPES},
  shape as (select tile, label, area, perimeter, sqrt(abs(major_axis * major_axis - minor_axis * minor_axis)) / major_axis as eccentricity, 4 * pi() * area / (perimeter * perimeter) as circularity, major_axis, minor_axis,
    area / ((max_x - min_x + 1) * (max_y - min_y + 1))::double as extent from a join pm using (tile, label)),
  sta as (select tile, y, x, {_STAIN} from p),
  pl as materialized (select tile, y, x, 'g' as ch, gray as v from q union all select tile, y, x, 'h', h from sta union all select tile, y, x, 'e', e from sta),
  d1 as materialized (select *, {_SLOPE(_WX)} as sx, {_SLOPE(_WY)} as sy, coalesce(lead(v) over {_WX}, v) - coalesce(lag(v) over {_WX}, v) as d, coalesce(lag(v) over {_WX}, v) + 2 * v + coalesce(lead(v) over {_WX}, v) as sm from pl),
  d2 as materialized (select tile, y, x, ch, v, cast({_U8("sqrt(sx * sx + sy * sy)")} as int) as gd, coalesce(lag(d) over {_WY}, d) + 2 * d + coalesce(lead(d) over {_WY}, d) as dx, coalesce(lead(sm) over {_WY}, sm) - coalesce(lag(sm) over {_WY}, sm) as dy from d1),
  d3 as materialized (select *, abs(dx) + abs(dy) as m from d2), d4 as materialized (select *, coalesce(lag(m) over {_WX}, 0) as lf, coalesce(lead(m) over {_WX}, 0) as rt from d3),
  d5 as materialized (select *, coalesce(lag(m) over {_WY}, 0) as um, coalesce(lag(lf) over {_WY}, 0) as ul, coalesce(lag(rt) over {_WY}, 0) as ur, coalesce(lead(m) over {_WY}, 0) as dm, coalesce(lead(lf) over {_WY}, 0) as dl, coalesce(lead(rt) over {_WY}, 0) as dr from d4),
  th as materialized (select * from d5 where m > {vectors.LOW} and case when abs(dy) * 32768 < abs(dx) * 13573 then m > lf and m >= rt when abs(dy) * 32768 > abs(dx) * 13573 + abs(dx) * 65536 then m > um and m >= dm
    when (dx < 0) != (dy < 0) then m > ur and m > dl else m > ul and m > dr end),
  kept as (select tile, ch, y, x from th where m > {vectors.HIGH} union select th.tile, th.ch, th.y, th.x from kept k join th on th.tile = k.tile and th.ch = k.ch and abs(th.y - k.y) <= 1 and abs(th.x - k.x) <= 1),
  rg as (from (select distinct l.tile, l.label, q.y, q.x from l join q on l.tile = q.tile and (l.y - q.y) * (l.y - q.y) + (l.x - q.x) * (l.x - q.x) <= 4) z anti join l using (tile, label, y, x)),
  rows_of as (select tile, label, y, x, 'n' as part from l union all select tile, label, y, x, 'c' from rg),
  ob as materialized (select o.tile, o.label, o.part, d2.ch, d2.v, d2.gd, kept.tile is not null as edge from rows_of o join d2 on d2.tile = o.tile and d2.y = o.y and d2.x = o.x left join kept on kept.tile = o.tile and kept.ch = d2.ch and kept.y = o.y and kept.x = o.x),
  {_HIST('v', '')}, {_HIST('gd', 'd_')},
  st as materialized (select * from (select tile, label, part, ch, {_MO('v', '')}, {_MO('gd', 'd_')}, count(*) filter (where edge) as canny_area, 255.0::double * count(*) filter (where edge) / count(*) as mean_canny from ob group by all) join hist_v using (tile, label, part, ch) join hist_gd using (tile, label, part, ch))
  select tile, label, unnest(range(74))::int as feature_idx, round(1e-9::double + unnest([{", ".join(f"({c})::double" for c in _VECTOR)}]), 4) as value
  from shape join (from st where part = 'n' and ch = 'g') n using (tile, label) {" ".join(f"left join (from st where part = 'c' and ch = '{c}') c{c} using (tile, label)" for c in vectors.CHANNELS)}"""
