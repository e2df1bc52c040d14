"""Queries of outlines, hulls and edges of objects over the 8 x 8 tiles of the pixel queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges, outlines, regions
from ..plans import fourier, hulls
from .pixels import _PX, _gray
from .regions import _ON, _mask, _reach

# Limits of the edges.
LOW, HIGH, APERTURE = 70, 90, 5
# Places around an outline, and borders between the bands of its spectrum.
PLACES, BANDS = 32, (2, 4, 8)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.label(_mask(spark, sf_dir), 8)


def cc_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of all outlines, in order."""
    return outlines.rings(_labels(spark, sf_dir))


def cc_contour_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas by outlines: they equal the pixel counts."""
    return outlines.areas(_labels(spark, sf_dir))


def fea_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines as text, at the tile's place in a row of tiles 8 pixels wide."""
    p = outlines.polygons(_labels(spark, sf_dir), dx=100, dy=50)
    return p.select("tile", "label", "ring", "hole", "polygon")


def fea_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = hulls.measures(_labels(spark, sf_dir))
    return m.select(*(F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes))


def fea_canny(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edges.canny(_gray(spark, sf_dir), "gray", LOW, HIGH, APERTURE)
    m = edges.edge_features(_labels(spark, sf_dir), found)
    return m.select("tile", "label", "canny_area", F.round("mean_canny", 5).alias("mean_canny"))


def prj_sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.sobel(_gray(spark, sf_dir), "gray", 3)


def fea_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape descriptors of every outline."""
    d = fourier.descriptors(outlines.rings(_labels(spark, sf_dir)), ["tile", "label", "ring"], PLACES, BANDS)
    return d.select("tile", "label", "ring", *(F.round(F.col("descriptors")[i], 5).alias(f"f{i}") for i in range(len(BANDS) + 1)))


QUERIES = {f.__name__: f for f in (cc_contours, cc_contour_areas, fea_polygons, fea_hull, fea_canny, prj_sobel, fea_fourier)}

_L8 = _reach(_ON, 8)
_STRIDE = regions.STRIDE
_DIRS = ", ".join(f"({d}, {', '.join(str(v) for o in (outlines.BEYOND[d], outlines.AHEAD[d], outlines.ACROSS[d], outlines.CORNER[(d + 1) % 4]) for v in o)})" for d in range(4))
#: All sides with the next one, then every side's whole ring walked from it; the ring's name is the least side.
_RINGS = _L8 + f""", d(d, by_, bx, ay, ax, cy, cx, ey, ex) as (values {_DIRS}),
  s as materialized (select l.tile, l.label, (l.y::bigint * {_STRIDE} + l.x) * 4 + d.d as id, d.d, l.y + d.ey as y, l.x + d.ex as x,
      case when c.tile is not null then (c.y::bigint * {_STRIDE} + c.x) * 4 + (d.d + 3) % 4 when a.tile is not null then (a.y::bigint * {_STRIDE} + a.x) * 4 + d.d else (l.y::bigint * {_STRIDE} + l.x) * 4 + (d.d + 1) % 4 end as nxt,
      c.tile is not null or a.tile is null as turns
    from l cross join d anti join l b on b.tile = l.tile and b.label = l.label and b.y = l.y + d.by_ and b.x = l.x + d.bx
    left join l a on a.tile = l.tile and a.label = l.label and a.y = l.y + d.ay and a.x = l.x + d.ax
    left join l c on c.tile = l.tile and c.label = l.label and c.y = l.y + d.cy and c.x = l.x + d.cx),
  walk as (select tile, id as start, id as here, 0::bigint as k from s union all select w.tile, w.start, s.nxt, w.k + 1 from walk w join s on s.tile = w.tile and s.id = w.here where s.nxt != w.start),
  leader as (select tile, start from walk group by tile, start having min(here) = start),
  ring as materialized (select s.tile, s.label, w.start as ring, w.k as ord, s.y, s.x, s.turns from walk w join leader using (tile, start) join s on s.tile = w.tile and s.id = w.here),
  c as materialized (select *, lag(y) over (partition by tile, ring order by ord) as py, lag(x) over (partition by tile, ring order by ord) as px from ring),
  sz as materialized (select tile, label, ring, sum(coalesce(px, lx) * y - x * coalesce(py, ly)) / 2 as area from (select c.*, last_value(x) over w as lx, last_value(y) over w as ly from c window w as (partition by tile, ring order by ord rows between unbounded preceding and unbounded following)) group by all) """

_SHIFT = lambda c, d, axis: f"coalesce({', '.join([f'max(case when o.{axis} = q.{axis} + ({k}) then o.{c} end)' for k in (range(d, 0) if d < 0 else range(d, 0, -1))])}, max(q.{c}))" if d else f"max(q.{c})"


def _sum(c: str, axis: str, weights: tuple[int, ...]) -> str:
    r = len(weights) // 2
    return " + ".join(f"{k} * {_SHIFT(c, d - r, axis)}" for d, k in enumerate(weights) if k)


def _derivatives(aperture: int) -> str:
    difference, smoothing = edges.KERNELS[aperture]
    r = aperture // 2
    return f""", dv as materialized (select q.tile, q.y, q.x, {_sum('gray', 'x', difference)} as d, {_sum('gray', 'x', smoothing)} as s from q join q o on o.tile = q.tile and o.y = q.y and abs(o.x - q.x) <= {r} group by q.tile, q.y, q.x),
  g as materialized (select q.tile, q.y, q.x, ({_sum('d', 'y', smoothing)})::bigint as dx, ({_sum('s', 'y', difference)})::bigint as dy from dv q join dv o on o.tile = q.tile and o.x = q.x and abs(o.y - q.y) <= {r} group by q.tile, q.y, q.x)"""


_AT = lambda dy, dx: f"coalesce((select o.m from mg o where o.tile = mg.tile and o.y = mg.y + {dy} and o.x = mg.x + {dx}), 0)"
_CANNY = _L8 + _derivatives(APERTURE) + f""", mg as materialized (select *, abs(dx) + abs(dy) as m from g),
  th as materialized (select tile, y, x, y * 8 + x as node, m from mg where m > {LOW} and case
    when abs(dy) * 32768 < abs(dx) * {edges.TANGENT} then m > {_AT(0, -1)} and m >= {_AT(0, 1)}
    when abs(dy) * 32768 > abs(dx) * {edges.TANGENT} + abs(dx) * 65536 then m > {_AT(-1, 0)} and m >= {_AT(1, 0)}
    when (dx < 0) != (dy < 0) then m > {_AT(-1, 1)} and m > {_AT(1, -1)} else m > {_AT(-1, -1)} and m > {_AT(1, 1)} end),
  kept as (select tile, y, x from th where m > {HIGH} union select th.tile, th.y, th.x from kept k join th on th.tile = k.tile and abs(th.y - k.y) <= 1 and abs(th.x - k.x) <= 1) """
_POINTS = _L8 + """, v as materialized (select distinct l.tile, l.label, l.y + dy as y, l.x + dx as x from l, (values (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx)),
  pr as (select p.tile, p.label, p.y as py, p.x as px, q.y as qy, q.x as qx from v p join v q on p.tile = q.tile and p.label = q.label and (p.y, p.x) != (q.y, q.x)),
  hull as (select tile, label, abs(sum(px * qy - qx * py)) / 2.0::double as convex_area from pr
    anti join v r on r.tile = pr.tile and r.label = pr.label and ((pr.qx - pr.px) * (r.y - pr.py) - (pr.qy - pr.py) * (r.x - pr.px) < 0
      or ((pr.qx - pr.px) * (r.y - pr.py) = (pr.qy - pr.py) * (r.x - pr.px) and (r.x - pr.px) * (r.x - pr.qx) + (r.y - pr.py) * (r.y - pr.qy) > 0)) group by tile, label),
  hole as materialized (select o.tile, o.label, z.y, z.x from (select distinct tile, label from l) o, (select y, x from generate_series(-1, 8) a(y), generate_series(-1, 8) b(x)) z anti join l on l.tile = o.tile and l.label = o.label and l.y = z.y and l.x = z.x),
  outer_ as (select tile, label, y, x from hole where y = -1 and x = -1 union select h.tile, h.label, h.y, h.x from outer_ k join hole h on h.tile = k.tile and h.label = k.label and abs(h.y - k.y) + abs(h.x - k.x) = 1),
  inner_ as materialized (select tile, label, y, x, y * 10 + x as node from hole anti join outer_ using (tile, label, y, x)),
  rn as (select tile, label, node as p, node as r from inner_ union select rn.tile, rn.label, rn.p, b.node from rn join inner_ a on a.tile = rn.tile and a.label = rn.label and a.node = rn.r join inner_ b on b.tile = a.tile and b.label = a.label and abs(a.y - b.y) + abs(a.x - b.x) = 1),
  hn as (select tile, label, count(distinct low) as holes from (select tile, label, p, min(r) as low from rn group by all) group by all),
  mo as (select tile, label, count(*) as area, var_pop(x) + 1 / 12.0::double as mxx, var_pop(y) + 1 / 12.0::double as myy, covar_pop(x, y) as mxy from l group by all),
  ms as (select *, sqrt((mxx - myy) * (mxx - myy) + 4 * mxy * mxy) as dd from mo) """
ORACLE_SQL = {
    "cc_contours": _RINGS + "select tile, label, ring, ord, y, x from ring where turns",
    "cc_contour_areas": _RINGS + """select tile, label, cast(sum(area) as bigint) as area, cast(sum(case when area > 0 then area end) as bigint) as filled, count(*) filter (where area < 0) as holes from sz group by all""",
    "fea_polygons": _RINGS + """select tile, label, ring, area < 0 as hole, string_agg((x + 100) || ',' || (y + 50), ';' order by ord) as polygon from ring join sz using (tile, label, ring) where turns group by all""",
    "fea_fourier": _RINGS + f""", corner as materialized (select tile, label, ring, ord, x, y, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny from ring where turns window w as (partition by tile, ring order by ord)),
      g as materialized (select *, abs(nx - x) + abs(ny - y) as len, sum(abs(nx - x) + abs(ny - y)) over (partition by tile, ring order by ord) as upto, sum(abs(nx - x) + abs(ny - y)) over (partition by tile, ring) as total from corner),
      pt as materialized (select tile, label, ring, j, x + (nx - x) * (j * total / {PLACES}.0::double - (upto - len)) / len as px, y + (ny - y) * (j * total / {PLACES}.0::double - (upto - len)) / len as py
        from g, range(0, {PLACES} + 1) r(j) where (j * total >= (upto - len) * {PLACES} and j * total < upto * {PLACES}) or (j = {PLACES} and upto = total)),
      an as (select tile, label, ring, j, atan2(round(lead(py) over w - py, 9), round(lead(px) over w - px, 9)) as a from pt window w as (partition by tile, ring order by j)),
      cu as materialized (select *, a - first_value(a) over (partition by tile, ring order by j) as c from an where j < {PLACES}),
      en as (select tile, label, ring, f, pow(sum(c * cos(2 * pi() * f * j / {PLACES})), 2) + pow(sum(c * sin(2 * pi() * f * j / {PLACES})), 2) as e from cu, range(0, {PLACES}) q(f) group by all)
      select tile, label, ring, {", ".join(f"round(sum(e) filter (where f between {lo - 1} and {hi - 1}) / nullif(sum(e), 0), 5) as f{i}" for i, (lo, hi) in enumerate(zip((1, *BANDS), (*BANDS, PLACES), strict=True)))} from en group by all""",
    "fea_hull": _POINTS + """select tile, label, area, round(convex_area, 5) as convex_area, round(area / convex_area, 5) as solidity, round(convex_area - area, 5) as convex_deficiency, 1 - coalesce(holes, 0) as euler,
      round(2 * sqrt(area / pi()), 5) as diameter, round(case when dd < 1e-9 then 0 else degrees(atan2(2 * case when abs(mxy) > 1e-9 then -mxy else 0 end, mxx - myy) / 2) end, 5) as orientation,
      round(1 - sqrt(greatest(mxx + myy - dd, 0) / (mxx + myy + dd)), 5) as elongation from ms join hull using (tile, label) left join hn using (tile, label)""",
    "fea_canny": _CANNY + """select l.tile, l.label, count(kept.tile) as canny_area, round(255.0::double * count(kept.tile) / count(*), 5) as mean_canny
      from l left join kept on kept.tile = l.tile and kept.y = l.y and kept.x = l.x group by l.tile, l.label""",
    "prj_sobel": _PX + _derivatives(3) + "select tile, y, x, (least(abs(dx), 255) + least(abs(dy), 255)) / 2.0::double as m from g",
}
