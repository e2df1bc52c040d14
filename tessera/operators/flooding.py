"""Watershed by flooding from markers: a minimum spanning forest over pixel links, rooted at the markers.

Flooding in the order of the links' weights reaches every pixel along its way in the minimum spanning forest that has one
root a marker. The forest is made by Boruvka rounds: every part without a root takes its lightest link outward; parts that
took each other join, chains of takers are followed by pointer doubling, and a part whose chain ends at a root gets that
root. Links between what is left are kept once a pair of parts, the lightest. So the rounds grow with the logarithm of a
tile's pixels, and each is a few joins and groupings with partial sums over all tiles at once.

Of links as heavy, the one whose first pixel, then whose second, comes first in raster order is lighter: so the forest is
one, however the rows are dealt. Pixels that no marker reaches have no basin. A pixel has one row; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .basins import regional
from .morphology import STRIDE, disc, square
from .staging import cut, drop

#: The basin of what is known to be background; less than every label.
BACKGROUND = -1


def _followed(hooks: DataFrame) -> DataFrame:
    """tile, a, to, root: `to` followed to its end, two doublings a round."""
    while True:
        ahead = hooks.select("tile", F.col("a").alias("to"), F.col("to").alias("next"))
        once = hooks.join(ahead, ["tile", "to"]).select("tile", "a", "root", F.col("next").alias("to"), F.col("to").alias("old"))
        new = cut(once)
        drop(hooks)
        if new.filter("to != old").isEmpty():
            return new
        hooks = new


def forest(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """tile, a, root of nodes (tile, a: unmarked). links: tile, a, and either b (an unmarked node; with its reverse) or r (the
    root of a marked neighbour), weight w, and l and h, which order links as heavy."""
    rounds: list[DataFrame] = []
    links = cut(links.select("tile", "a", "b", "r", "w", "l", "h"))
    while True:
        best = links.groupBy("tile", "a").agg(F.min(F.struct("w", "l", "h", "b", "r")).alias("t"))
        hooks = cut(nodes.join(best, ["tile", "a"], "left").select("tile", "a", F.col("t.r").alias("root"), F.coalesce("t.b", "a").alias("to")))
        back = hooks.select("tile", F.col("a").alias("to"), F.col("to").alias("back"))
        end = F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("to")), F.col("a")).otherwise(F.col("to"))
        ended = _followed(cut(hooks.join(back, ["tile", "to"]).select("tile", "a", "root", end.alias("to"))))
        drop(hooks)
        ends = ended.filter("a = to").select("tile", "to", "root")
        done = cut(ended.select("tile", "a", "to").join(ends, ["tile", "to"]).select("tile", "a", "to", "root"))
        drop(ended)
        rounds.append(done)
        mine = done.filter("root is null").select("tile", "a", F.col("to").alias("from"))
        other = done.select("tile", F.col("a").alias("b"), F.when(F.col("root").isNull(), F.col("to")).alias("into"), "root")
        moved = links.join(mine, ["tile", "a"]).join(other, ["tile", "b"], "left")
        moved = moved.select("tile", F.col("from").alias("a"), F.col("into").alias("b"), F.coalesce("r", "root").alias("r"), "w", "l", "h").filter("r is not null or a != b")
        fewer = cut(moved.groupBy("tile", "a", "b", "r").agg(F.min(F.struct("w", "l", "h")).alias("k")).select("tile", "a", "b", "r", "k.*"))
        drop(links)
        links = fewer
        nodes = links.select("tile", "a").distinct()
        if links.isEmpty():
            break
    roots = rounds[-1].select("tile", "a", "root")
    for done in rounds[-2::-1]:
        far = roots.select("tile", F.col("a").alias("to"), F.col("root").alias("far"))
        roots = cut(done.join(far, ["tile", "to"], "left").select("tile", "a", F.coalesce("root", "far").alias("root")))
    out = cut(roots)
    drop(links, *rounds)
    return out


def apart(colours: list[str]) -> Column:
    """Weight of a link between pixels p and q: the greatest difference of a channel."""
    each = [F.abs(F.col(f"p.{c}") - F.col(f"q.{c}")) for c in colours]
    return each[0] if len(each) == 1 else F.greatest(*each)


def higher(value: str) -> Column:
    """Weight of a link between pixels p and q: the height at which water passes."""
    return F.greatest(F.col(f"p.{value}"), F.col(f"q.{value}"))


def ordered(*weights: Column) -> Column:
    """The first weight; of links as heavy, the next one."""
    return F.struct(*(w.alias(f"w{i}") for i, w in enumerate(weights)))


def flood(pixels: DataFrame, weight: Column, conn: int = 4) -> DataFrame:
    """tile, y, x, basin of pixels (tile, y, x, marker: null where there is none, and what the weight of a link between p and
    q needs)."""
    at = F.col("y").cast("long") * STRIDE + F.col("x")
    p = cut(pixels.select("tile", at.alias("a"), "marker", F.struct(*pixels.columns).alias("v")))
    offsets = [dy * STRIDE + dx for dy, dx in (square(1) if conn == 8 else disc(1)) if (dy, dx) != (0, 0)]
    asks = p.filter("marker is null").select("tile", "a", F.col("v").alias("p"), F.explode(F.array(*(F.col("a") + d for d in offsets))).alias("near"))
    there = p.select("tile", F.col("a").alias("near"), "marker", F.col("v").alias("q"))
    free = F.when(F.col("marker").isNull(), F.col("near"))
    links = asks.join(there, ["tile", "near"]).select("tile", "a", free.alias("b"), F.col("marker").alias("r"), weight.alias("w"), F.least("a", "near").alias("l"), F.greatest("a", "near").alias("h"))
    found = forest(p.filter("marker is null").select("tile", "a"), links)
    out = cut(p.join(found, ["tile", "a"], "left").select("tile", "v.y", "v.x", F.coalesce("marker", "root").alias("basin")))
    drop(p, found)
    return out


def lines(basins: DataFrame, conn: int = 4) -> DataFrame:
    """tile, y, x, basin, line: whether the pixel touches a basin with a lesser name. Two basins that touch are apart (for this
    conn) without these pixels. Windows along rows and columns, without a join."""
    row, column = Window.partitionBy("tile", "y").orderBy("x"), Window.partitionBy("tile", "x").orderBy("y")
    beside = lambda w: F.min("basin").over(w.rangeBetween(-1, 1))
    b = basins.withColumn("along", beside(row))
    least = F.min("along" if conn == 8 else "basin").over(column.rangeBetween(-1, 1))
    return b.withColumn("least", F.least("along", least)).select("tile", "y", "x", "basin", F.coalesce(F.col("least") < F.col("basin"), F.lit(False)).alias("line"))


def closed_lines(lined: DataFrame) -> DataFrame:
    """The lines of lines(), closed where they only touch across a corner: a pixel becomes line if the one above it is line,
    it isn't, and on some side the upper neighbour is not line while the pixel's own neighbour is. Neighbours outside the tile
    don't count."""
    row, column = Window.partitionBy("tile", "y").orderBy("x"), Window.partitionBy("tile", "x").orderBy("y")
    at = lambda c, w, d: F.max(c).over(w.rangeBetween(d, d))
    sides = lined.withColumn("left", at("line", row, -1)).withColumn("right", at("line", row, 1))
    up = sides.withColumn("up", at("line", column, -1)).withColumn("up_left", at("left", column, -1)).withColumn("up_right", at("right", column, -1))
    gap = (~F.col("up_left") & F.col("left")) | (~F.col("up_right") & F.col("right"))
    closing = F.col("up") & ~F.col("line") & gap
    return up.select("tile", "y", "x", "basin", (F.col("line") | F.coalesce(closing, F.lit(False))).alias("line"))


def watershed(pixels: DataFrame, height: str, colours: list[str], conn: int = 8) -> DataFrame:
    """tile, y, x, basin, line: the regional minima of the height (regions of conn) flood the colours along pixel sides, by the
    greatest difference of a channel and, where that is equal, through the lower pass; lines as lines() and closed_lines() tell them. A basin's name is its minimum's first
    pixel in raster order."""
    low = regional(pixels, height, conn, maxima=False).select("tile", "y", "x", F.col("label").alias("marker"))
    marked = pixels.select("tile", "y", "x", height, *(c for c in colours if c != height)).join(low, ["tile", "y", "x"], "left")
    return closed_lines(lines(flood(marked, ordered(apart(colours), higher(height)))))
