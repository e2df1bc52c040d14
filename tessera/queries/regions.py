"""Queries of regions and morphology over the 8 x 8 tiles of the pixel queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import basins, flooding, morphology, regions
from .pixels import _PX, _gray

# A pixel is on at LEVEL or more, and a seed at SEED or more.
LEVEL, SEED = 128, 180


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gray(spark, sf_dir).select("tile", "y", "x", "gray", (F.col("gray") >= LEVEL).alias("on"))


def cc_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.label(_mask(spark, sf_dir), 8)


def cc_label4_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.relabel(regions.label(_mask(spark, sf_dir), 4))


def cc_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.boxes(regions.by_area(regions.label(_mask(spark, sf_dir), 8), 3, 30))


def cc_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = _mask(spark, sf_dir)
    return regions.select_seeded(regions.label(mask, 4), mask.filter(F.col("gray") >= SEED)).select("tile", "y", "x", "label")


def cc_fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.fill_holes(_mask(spark, sf_dir), 8)


def mor_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.opened(_gray(spark, sf_dir).select("tile", "y", "x", "gray"), "gray", morphology.disc(1))


def mor_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.dilate(_gray(spark, sf_dir).select("tile", "y", "x", "gray"), "gray", morphology.square(1))


def mor_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.squared_distance(_mask(spark, sf_dir))


def mor_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The h-dome marker: gray less 40, under gray."""
    px = _gray(spark, sf_dir).select("tile", "y", "x", "gray", F.greatest(F.col("gray") - 40, F.lit(0)).alias("marker"))
    return morphology.reconstruct(px, "gray", "marker", 8)


def mor_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basins.regional(_gray(spark, sf_dir), "gray", 8)


def mor_hmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basins.drop_shallow_minima(_gray(spark, sf_dir), "gray", 20, 8)


def mor_fill_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basins.fill_gray_holes(_gray(spark, sf_dir), "gray", 8)


def mor_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basins.basins(_gray(spark, sf_dir), "gray", 8)


def mor_watershed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minima of gray flood the colours; with dividing lines."""
    return flooding.watershed(_gray(spark, sf_dir), "gray", ["b", "g", "r"])


def cc_fill_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = _mask(spark, sf_dir)
    return regions.fill_from(mask, mask.filter("y = 3 and x = 3"), 4)


def _reach(on: str, conn: int) -> str:
    near = "abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1" if conn == 8 else "abs(a.y - b.y) + abs(a.x - b.x) <= 1"
    sql = _PX.replace("with e as", "with recursive e as", 1)
    return sql + f""", o as materialized (select tile, y, x, gray, y::bigint * {regions.STRIDE} + x as node from q where {on}),
     n as materialized (select a.tile, a.node as p, b.node as r from o a join o b on a.tile = b.tile and {near}),
     reach as (select tile, node as p, node as r from o union select n.tile, reach.p, n.r from reach join n on n.tile = reach.tile and n.p = reach.r),
     l as (select o.tile, o.y, o.x, o.gray, min(reach.r) as label from o join reach on reach.tile = o.tile and reach.p = o.node group by all) """


def _widest(mask: str, marker: str) -> str:
    """The widest way from every pixel: all widths that reach it, then the greatest."""
    sql = _PX.replace("with e as", "with recursive e as", 1)
    return sql + f""", n as materialized (select tile, y, x, y * 8 + x as node, ({mask})::int as m, least({mask}, {marker})::int as k from q),
     near as materialized (select a.tile, a.node as p, b.node as r, b.m from n a join n b on a.tile = b.tile and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and a.node != b.node),
     go as (select tile, node, k as v from n union select near.tile, near.r, least(go.v, near.m) from go join near on near.tile = go.tile and near.p = go.node),
     w as (select tile, node, max(v) as v from go group by all) """


_ON, _OFF = f"gray >= {LEVEL}", f"gray < {LEVEL}"
QUERIES = {f.__name__: f for f in (cc_label, cc_label4_numbered, cc_boxes, cc_select, cc_fill_holes, mor_open, mor_dilate, mor_distance, mor_reconstruct, mor_maxima, mor_hmin, mor_basins, mor_fill_gray, mor_watershed, cc_fill_seeds)}
_FLAT = """, n8 as materialized (select a.tile, a.node as p, a.gray as v, b.node as r, b.gray as u from o a join o b on a.tile = b.tile and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and a.node != b.node),
  reach as (select tile, node as p, node as r from o union select n.tile, reach.p, n.r from reach join n8 n on n.tile = reach.tile and n.p = reach.r and n.u = n.v),
  f as materialized (select tile, p, min(r) as label from reach group by all) """
_ALL = _PX.replace("with e as", "with recursive e as", 1) + f", o as materialized (select tile, y, x, gray, y::bigint * {regions.STRIDE} + x as node from q)" + _FLAT
ORACLE_SQL = {
    "mor_maxima": _ALL + """, bad as (select distinct f.tile, f.label from f join n8 on n8.tile = f.tile and n8.p = f.p and n8.u > n8.v)
      select o.tile, o.y, o.x, f.label from o join f on o.tile = f.tile and o.node = f.p where (f.tile, f.label) not in (select (tile, label) from bad)""",
    "cc_fill_seeds": _reach(_OFF, 4) + f"select tile, y, x from q where {_ON} union all select tile, y, x from l where (tile, label) in (select (tile, label) from l where y = 3 and x = 3)",
    "mor_basins": _ALL + """, dn as materialized (select a.tile, a.label, arg_min(b.label, (n8.u, b.label)) as nxt from n8 join f a on a.tile = n8.tile and a.p = n8.p join f b on b.tile = n8.tile and b.p = n8.r where n8.u < n8.v group by all),
      way as (select distinct tile, label, label as at from f union select way.tile, way.label, dn.nxt from way join dn on dn.tile = way.tile and dn.label = way.at),
      root as (select way.tile, way.label, way.at from way anti join dn on dn.tile = way.tile and dn.label = way.at)
      select o.tile, o.y, o.x, root.at as basin from o join f on o.tile = f.tile and o.node = f.p join root on root.tile = f.tile and root.label = f.label""",
    # links in the order of their weights, folded over a tile's list of parts: two parts join unless both have a root (positive)
    "mor_watershed": _ALL + """, bad as (select distinct f.tile, f.label from f join n8 on n8.tile = f.tile and n8.p = f.p and n8.u < n8.v),
      m as materialized (select o.tile, o.y, o.x, o.node, o.gray, p.b, p.g, p.r, case when (f.tile, f.label) not in (select (tile, label) from bad) then f.label + 1 else -1 - (o.y * 8 + o.x) end as part
        from o join f on o.tile = f.tile and o.node = f.p join p on p.tile = o.tile and p.y = o.y and p.x = o.x),
      k as (select a.tile, list([a.y * 8 + a.x + 1, c.y * 8 + c.x + 1]::bigint[] order by greatest(abs(a.b - c.b), abs(a.g - c.g), abs(a.r - c.r)), greatest(a.gray, c.gray), a.node, c.node) as links
        from m a join m c on a.tile = c.tile and ((c.y = a.y + 1 and c.x = a.x) or (c.y = a.y and c.x = a.x + 1)) group by a.tile),
      c as (select tile, list(part::bigint order by node) as parts from m group by tile),
      fold as (select tile, list_reduce(list_prepend(parts, links), lambda c, l: case when c[l[1]] > 0 and c[l[2]] > 0 then c
        else list_transform(c, lambda v: case when v = c[l[1]] or v = c[l[2]] then case when c[l[1]] > 0 then c[l[1]] when c[l[2]] > 0 then c[l[2]] else least(c[l[1]], c[l[2]]) end else v end) end) as parts from c join k using (tile)),
      b as materialized (select m.tile, m.y, m.x, fold.parts[m.y * 8 + m.x + 1] - 1 as basin from m join fold using (tile)),
      i as materialized (select a.tile, a.y, a.x, a.basin, coalesce(min(c.basin) < a.basin, false) as line from b a join b c on a.tile = c.tile and abs(a.y - c.y) + abs(a.x - c.x) <= 1 group by a.tile, a.y, a.x, a.basin)
      select i.tile, i.y, i.x, i.basin, i.line or coalesce(u.line and not i.line and (coalesce(not ul.line and l.line, false) or coalesce(not ur.line and r.line, false)), false) as line
      from i left join i u on u.tile = i.tile and u.y = i.y - 1 and u.x = i.x left join i l on l.tile = i.tile and l.y = i.y and l.x = i.x - 1 left join i r on r.tile = i.tile and r.y = i.y and r.x = i.x + 1
      left join i ul on ul.tile = i.tile and ul.y = i.y - 1 and ul.x = i.x - 1 left join i ur on ur.tile = i.tile and ur.y = i.y - 1 and ur.x = i.x + 1""",
    "cc_label": _reach(_ON, 8) + "select tile, y, x, label from l",
    "cc_label4_numbered": _reach(_ON, 4) + "select tile, y, x, label, dense_rank() over (partition by tile order by label)::int as number from l",
    "cc_boxes": _reach(_ON, 8) + "select tile, label, count(*) as area, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y from l group by tile, label having count(*) >= 3 and count(*) < 30",
    "cc_select": _reach(_ON, 4) + f"select tile, y, x, label from l where (tile, label) in (select (tile, label) from l where gray >= {SEED})",
    "cc_fill_holes": _reach(_OFF, 4) + f"select tile, y, x from q where {_ON} union all select tile, y, x from l where (tile, label) not in (select (tile, label) from l where x in (0, 7) or y in (0, 7))",
    "mor_reconstruct": _widest("gray", "greatest(gray - 40, 0)") + "select tile, y, x, v as value from w join n using (tile, node)",
    "mor_hmin": _widest("-gray", "-gray - 20") + "select tile, y, x, -v as value from w join n using (tile, node)",
    "mor_fill_gray": _widest("-gray", "case when x in (0, 7) or y in (0, 7) then -gray else -255 end") + "select tile, y, x, -v as value from w join n using (tile, node)",
    "mor_dilate": _PX + "select a.tile, a.y, a.x, max(b.gray) as gray from q a join q b on a.tile = b.tile and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all",
    "mor_open": _PX + """, w as (select a.tile, a.y, a.x, min(b.gray) as gray from q a join q b on a.tile = b.tile and abs(a.y - b.y) + abs(a.x - b.x) <= 1 group by all)
      select a.tile, a.y, a.x, max(b.gray) as gray from w a join w b on a.tile = b.tile and abs(a.y - b.y) + abs(a.x - b.x) <= 1 group by all""",
    "mor_distance": _PX + f"""select a.tile, a.y, a.x, case when a.{_ON} then min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) else 0 end::bigint as d2
      from q a left join q b on a.tile = b.tile and b.{_OFF} group by a.tile, a.y, a.x, a.gray""",
}
