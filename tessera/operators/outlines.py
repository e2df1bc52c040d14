"""Outlines of labelled regions, holes included: pixel sides linked into rings and ordered by list ranking.

A pixel's side is on the outline if the pixel beyond it isn't of the region. Sides are directed so that the region lies to
the right (x to the right, y downward), and each knows from four windows over the labels which side comes next. Rings are
then found by pointer doubling: a side knows the least side among the 2^k that follow it and how far off that is, so after
rounds in the logarithm of the longest ring it knows its ring (the least side) and its place in it. A round is one join
over all tiles' sides.

Outer rings have a positive area, holes a negative one, so a region's area is the sum over its rings: its pixels. Where two
pixels of a region meet at a corner alone, the ring passes from one to the other under conn 8 and turns back under conn 4,
as in the labels. A pixel has one row; an empty table gives no rings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .morphology import STRIDE
from .staging import cut, drop

#: By direction (east along the top, south along the right side, west along the bottom, north along the left side): offsets
#: (dy, dx) of the pixel beyond the side, of the one ahead and of the one ahead beyond the side; and the side's first corner.
BEYOND = ((-1, 0), (0, 1), (1, 0), (0, -1))
AHEAD = ((0, 1), (1, 0), (0, -1), (-1, 0))
ACROSS = ((-1, 1), (1, 1), (1, -1), (-1, -1))
CORNER = ((0, 0), (0, 1), (1, 1), (1, 0))


def _like(dy: int, dx: int):
    """Whether the pixel at an offset has the same label: a window along a row, a column or a diagonal."""
    if dy == 0:
        w, step = Window.partitionBy("tile", "y").orderBy("x"), dx
    elif dx == 0:
        w, step = Window.partitionBy("tile", "x").orderBy("y"), dy
    else:
        w, step = Window.partitionBy("tile", F.col("y") - F.col("x") * (dy * dx)).orderBy("y"), dy
    return F.coalesce(F.max("label").over(w.rangeBetween(step, step)) == F.col("label"), F.lit(False))


def sides(labels: DataFrame, conn: int = 8) -> DataFrame:
    """tile, label, id, dir, next, turns (whether the next side has another direction), y, x (its last corner), area2 (twice its
    share of the ring's area): the sides on outlines."""
    near = {(dy, dx): f"at{dy + 1}{dx + 1}" for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx}
    p = labels.select("tile", "y", "x", "label")
    for offset, name in sorted(near.items(), key=lambda o: (o[0][0] != 0, o[0][1] != 0, o[0][0] * o[0][1])):
        p = p.withColumn(name, _like(*offset))
    number = lambda y, x, d: (y.cast("long") * STRIDE + x) * 4 + d
    y, x = F.col("y"), F.col("x")
    each = []
    for d in range(4):
        ahead, across = F.col(near[AHEAD[d]]), F.col(near[ACROSS[d]])
        left = across & (ahead if conn == 4 else F.lit(True))
        step = lambda o: (y + o[0], x + o[1])
        after = F.when(left, number(*step(ACROSS[d]), (d + 3) % 4)).when(ahead, number(*step(AHEAD[d]), d)).otherwise(number(y, x, (d + 1) % 4))
        (ay, ax), (by, bx) = CORNER[d], CORNER[(d + 1) % 4]
        area2 = (x + ax).cast("long") * (y + by) - (x + bx).cast("long") * (y + ay)
        each.append(F.when(~F.col(near[BEYOND[d]]), F.struct(number(y, x, d).alias("id"), F.lit(d).alias("dir"), after.alias("next"), (left | ~ahead).alias("turns"), (y + by).alias("y"), (x + bx).alias("x"), area2.alias("area2"))))
    return p.select("tile", "label", F.explode(F.array_compact(F.array(*each))).alias("s")).select("tile", "label", "s.*")


def ranked(found: DataFrame) -> DataFrame:
    """The sides with their ring (its least side) and ord (their place in it, from 0)."""
    known = cut(found)
    state = cut(known.select("tile", "id", F.col("next").alias("to"), F.col("id").alias("ring"), F.lit(0).cast("long").alias("off"), F.lit(1).cast("long").alias("width")))
    while True:
        ahead = state.select("tile", F.col("id").alias("to"), F.col("to").alias("then"), F.col("ring").alias("r2"), F.col("off").alias("o2"))
        less = F.col("r2") < F.col("ring")
        new = cut(state.join(ahead, ["tile", "to"]).select("tile", "id", F.col("then").alias("to"), F.when(less, F.col("r2")).otherwise(F.col("ring")).alias("ring"), F.when(less, F.col("o2") + F.col("width")).otherwise(F.col("off")).alias("off"), (F.col("width") * 2).alias("width"), less.alias("changed")))
        drop(state)
        state = new
        # windows of one width that don't change by the next window tile their whole ring: all have its least side
        if new.filter("changed").isEmpty():
            break
    long = state.groupBy("tile", "ring").agg(F.max("off").alias("last"))
    placed = state.join(long, ["tile", "ring"]).select("tile", "id", "ring", F.when(F.col("off") == 0, 0).otherwise(F.col("last") + 1 - F.col("off")).alias("ord"))
    out = cut(known.join(placed, ["tile", "id"]))
    drop(known, state)
    return out


def rings(labels: DataFrame, conn: int = 8) -> DataFrame:
    """tile, label, ring, ord, y, x: the corners at which outlines turn, in order (ord grows, with gaps)."""
    return ranked(sides(labels, conn)).filter("turns").select("tile", "label", "ring", "ord", "y", "x")


def measures(labels: DataFrame, conn: int = 8) -> DataFrame:
    """Per ring: tile, label, ring, hole, area (of what the ring encloses), length and corners."""
    r = ranked(sides(labels, conn)).groupBy("tile", "label", "ring").agg(F.sum("area2").alias("a"), F.count("*").alias("length"), F.count(F.when(F.col("turns"), 1)).alias("corners"))
    return r.select("tile", "label", "ring", (F.col("a") < 0).alias("hole"), F.abs(F.floor(F.col("a") / 2)).cast("long").alias("area"), "length", "corners")


def areas(labels: DataFrame) -> DataFrame:
    """Per region: tile, label, area (holes left out), filled (with its holes), holes (their number)."""
    m = measures(labels).groupBy("tile", "label")
    return m.agg(F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))).alias("area"), F.sum(F.when(~F.col("hole"), F.col("area"))).alias("filled"), F.count(F.when(F.col("hole"), 1)).alias("holes"))


def by_filled_area(labels: DataFrame, least: int, below: int | None = None) -> DataFrame:
    """The regions whose outline encloses least <= area (< below), their holes counted in."""
    a = areas(labels).filter(F.col("filled") >= least)
    return labels.join((a.filter(F.col("filled") < below) if below is not None else a).select("tile", "label"), ["tile", "label"], "left_semi")


def polygons(labels: DataFrame, conn: int = 8, dy: int = 0, dx: int = 0) -> DataFrame:
    """tile, label, ring, hole and the ring's corners as text `x,y;x,y`, shifted. A ring's corners meet in one row."""
    p = ranked(sides(labels, conn)).groupBy("tile", "label", "ring")
    corner = F.struct("ord", F.concat_ws(",", (F.col("x") + dx).cast("string"), (F.col("y") + dy).cast("string")).alias("t"))
    got = p.agg((F.sum("area2") < 0).alias("hole"), F.sort_array(F.collect_list(F.when(F.col("turns"), corner))).alias("c"))
    return got.select("tile", "label", "ring", "hole", F.array_join("c.t", ";").alias("polygon"))


def covered(polygon_rows: DataFrame) -> DataFrame:
    """tile, label, y, x of the pixels inside polygons (of polygons(), every ring of a label): the way back to a mask. A row of
    pixels is inside between its first and second, third and fourth upright side, and so on; holes fall out by themselves."""
    points = F.transform(F.split("polygon", ";"), lambda t: F.struct(F.element_at(F.split(t, ","), 2).cast("int").alias("y"), F.element_at(F.split(t, ","), 1).cast("int").alias("x")))
    p = polygon_rows.select("tile", "label", points.alias("p"))
    ends = F.arrays_zip(F.col("p").alias("a"), F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1)).alias("b"))
    upright = p.select("tile", "label", F.explode(ends).alias("s")).filter("s.a.x = s.b.x").select("tile", "label", F.col("s.a.x").alias("x"), F.explode(F.sequence(F.least("s.a.y", "s.b.y"), F.greatest("s.a.y", "s.b.y") - 1)).alias("y"))
    row = Window.partitionBy("tile", "label", "y").orderBy("x")
    spans = upright.withColumn("to", F.lead("x").over(row)).withColumn("n", F.row_number().over(row)).filter("n % 2 = 1")
    return spans.select("tile", "label", "y", F.explode(F.sequence(F.col("x"), F.col("to") - 1)).alias("x"))
