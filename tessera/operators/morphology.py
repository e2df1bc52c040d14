"""Morphology on pixel tables (tile, y, x and a value): erosion, dilation, reconstruction, distance transform."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import cut, drop

#: Larger than the width of every tile.
STRIDE = 1 << 20


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) within the radius."""
    r = range(-radius, radius + 1)
    return [(dy, dx) for dy in r for dx in r if dy * dy + dx * dx <= radius * radius]


def square(radius: int) -> list[tuple[int, int]]:
    r = range(-radius, radius + 1)
    return [(dy, dx) for dy in r for dx in r]


def octagon(radius: int, reach: int) -> list[tuple[int, int]]:
    """Offsets of the square whose coordinates add up to at most `reach`: octagon(9, 14) is the 19 x 19 disc of the segmentation."""
    return [(dy, dx) for dy, dx in square(radius) if abs(dy) + abs(dx) <= reach]


def _spans(numbers: Iterable[int]) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of neighbouring numbers."""
    out: list[tuple[int, int]] = []
    for n in sorted(numbers):
        if out and out[-1][1] == n - 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def _around(pixels: DataFrame, value: str, offsets: Iterable[tuple[int, int]], how, best) -> DataFrame:
    """Every pixel hands its value to the offsets around it; values that land outside the tile go. The offsets are parted into
    spans along a row, with the rows that have each; a window over rows and one over columns take the spans, so that two
    shuffles do, and no pixel is copied, however large the kernel."""
    rows: dict[int, list[int]] = {}
    for dy, dx in offsets:
        rows.setdefault(dy, []).append(dx)
    having: dict[tuple[int, int], list[int]] = {}
    for dy, dxs in rows.items():
        for span in _spans(dxs):
            having.setdefault(span, []).append(dy)
    along, across = Window.partitionBy("tile", "y").orderBy("x"), Window.partitionBy("tile", "x").orderBy("y")
    p = pixels.select("tile", "y", "x", F.col(value).alias("v"))
    p = p.select("tile", "y", "x", *(how("v").over(along.rangeBetween(-hi, -lo)).alias(f"v{k}") for k, (lo, hi) in enumerate(having)))
    got = [how(f"v{k}").over(across.rangeBetween(-hi, -lo)) for k, dys in enumerate(having.values()) for lo, hi in _spans(dys)]
    return p.select("tile", "y", "x", (got[0] if len(got) == 1 else best(*got)).alias(value))


def dilate(pixels: DataFrame, value: str, offsets: Iterable[tuple[int, int]]) -> DataFrame:
    return _around(pixels, value, offsets, F.max, F.greatest)


def erode(pixels: DataFrame, value: str, offsets: Iterable[tuple[int, int]]) -> DataFrame:
    return _around(pixels, value, [(-dy, -dx) for dy, dx in offsets], F.min, F.least)


def opened(pixels: DataFrame, value: str, offsets: list[tuple[int, int]]) -> DataFrame:
    return dilate(erode(pixels, value, offsets), value, offsets)


def closed(pixels: DataFrame, value: str, offsets: list[tuple[int, int]]) -> DataFrame:
    return erode(dilate(pixels, value, offsets), value, offsets)


def _roots(hooks: DataFrame) -> DataFrame:
    """tile, a, m, e, to: `to` followed to its end. Pointers are doubled, so the rounds grow with the logarithm of the longest way."""
    while True:
        ahead = hooks.select("tile", F.col("a").alias("to"), F.col("to").alias("next"))
        new = cut(hooks.join(ahead, ["tile", "to"]).select("tile", "a", "m", "e", "to", "next"))
        drop(hooks)
        if new.filter("to != next").isEmpty():
            return new
        hooks = new.select("tile", "a", "m", "e", F.col("next").alias("to"))
        hooks._tessera_path = new._tessera_path


def reconstruct(pixels: DataFrame, mask: str, marker: str, conn: int = 8) -> DataFrame:
    """tile, y, x, value: the marker dilated again and again under the mask, until nothing changes.

    The value of a pixel is the widest way out: the greatest, over all ways to a pixel, of the least mask on the way and the
    marker at its end. So widest-first merging finds it, in rounds that grow with the logarithm of a tile's pixels, not with
    the longest way. Every node (at first a pixel) takes the widest of its links, or its marker if that is as wide; a node
    that takes its marker is settled. Along links taken one after another the width doesn't fall, hence a node's value is the
    least of the link that it took and the value at the end. Ends that are settled settle all nodes behind them, whose links
    to others become markers there; the other nodes join their ends, and the next round goes on with these."""
    half = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if conn == 8 else [])
    at = F.col("y").cast("long") * STRIDE + F.col("x")
    start = cut(pixels.select("tile", at.alias("a"), "y", "x", F.col(mask).alias("w"), F.least(mask, marker).alias("m")))
    steps = F.array(*(F.lit(dy * STRIDE + dx) for dy, dx in half))
    ask = start.select("tile", F.col("a").alias("p"), F.col("w").alias("v"), F.explode(steps).alias("d")).select("tile", "p", "v", (F.col("p") + F.col("d")).alias("a"))
    once = ask.join(start, ["tile", "a"]).select("tile", "a", F.col("p").alias("b"), F.least("v", "w").alias("w"))
    nodes = start.select("tile", "a", "m")
    links = cut(once.unionByName(once.select("tile", F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    rounds: list[DataFrame] = []
    while True:
        # of links as wide, the one whose two ends come first: the same order at both ends, so hooks make no ring but pairs
        order = F.struct("w", F.negative(F.least("a", "b")).alias("l"), F.negative(F.greatest("a", "b")).alias("h"), "b")
        best = links.groupBy("tile", "a").agg(F.max(order).alias("t"))
        takes = F.col("t").isNotNull() & (F.col("t.w") > F.col("m"))
        hooks = cut(nodes.join(best, ["tile", "a"], "left").select("tile", "a", "m", F.when(takes, F.col("t.w")).alias("e"), F.when(takes, F.col("t.b")).otherwise(F.col("a")).alias("to")))
        back = hooks.select("tile", F.col("a").alias("to"), F.col("to").alias("back"))
        end = F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("to")), F.col("a")).otherwise(F.col("to"))
        paired = cut(hooks.join(back, ["tile", "to"]).select("tile", "a", "m", "e", end.alias("to")))
        drop(hooks)
        ended = _roots(paired)
        # an end that took no link is settled with its marker; an end of a pair goes on
        ends = ended.filter("a = to and e is null").select("tile", "to", F.col("m").alias("out"))
        done = cut(ended.join(ends, ["tile", "to"], "left").select("tile", "a", "m", "to", F.when(F.col("a") == F.col("to"), None).otherwise(F.col("e")).alias("e"), "out").withColumn("value", F.when(F.col("out").isNotNull(), F.least("e", "out"))))
        drop(ended)
        rounds.append(done)
        open_ = done.filter("out is null")
        if open_.isEmpty():
            break
        ends_of = done.select("tile", "a", "to", "value")
        side = links.join(open_.select("tile", "a", F.col("to").alias("r")), ["tile", "a"]).join(ends_of.select("tile", F.col("a").alias("b"), F.col("to").alias("s"), "value"), ["tile", "b"])
        side = cut(side.select("tile", "r", "s", "w", "value").filter("value is not null or r != s"))
        drop(links)
        links = cut(side.filter("value is null").groupBy("tile", F.col("r").alias("a"), F.col("s").alias("b")).agg(F.max("w").alias("w")))
        given = side.filter("value is not null").select("tile", F.col("r").alias("a"), F.least("w", "value").alias("m"))
        nodes = cut(open_.select("tile", F.col("to").alias("a"), "m").unionByName(given).groupBy("tile", "a").agg(F.max("m").alias("m")))
        drop(side)
    values = rounds[-1].select("tile", "a", "value")
    for done in rounds[-2::-1]:
        far = values.select("tile", F.col("a").alias("to"), F.col("value").alias("far"))
        values = cut(done.join(far, ["tile", "to"], "left").select("tile", "a", F.coalesce("value", F.least("e", "far")).alias("value")))
    out = cut(start.join(values, ["tile", "a"]).select("tile", "y", "x", "value"))
    drop(start, links, nodes, *rounds)
    return out


#: Instead of a squared distance where a column has no off pixel.
_NONE = 1 << 40


def _least_parabola(x: np.ndarray, g2: np.ndarray) -> np.ndarray:
    """For each place of a row, the least of (x - x')^2 + g2(x'): the lower envelope of the row's parabolas. The place that
    gives the least moves right with x, so the middle place is solved first and halves what is left for either side; all
    places of a level are solved together."""
    n = len(x)
    best = np.zeros(n, np.int64)  # the place whose parabola is least
    out = np.empty(n, np.int64)
    step = 1 << max(n - 1, 0).bit_length()
    while step:
        todo = np.arange(step - 1, n, 2 * step)
        low = np.where(todo - step >= 0, best[np.maximum(todo - step, 0)], 0)
        high = np.where(todo + step < n, best[np.minimum(todo + step, n - 1)], n - 1)
        # where a level above has not reached the end of the row, what lies right of it is open
        sizes = high - low + 1
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(todo) else todo
        if len(todo):
            ask = np.repeat(low - starts, sizes) + np.arange(sizes.sum())
            cost = (np.repeat(x[todo], sizes) - x[ask]) ** 2 + g2[ask]
            least = np.minimum.reduceat(cost * n + ask, starts)
            best[todo], out[todo] = least % n, least // n
        step //= 2
    return out


def _rows_of_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pixels of whole rows in order, with d2 in place of g. A row may go on in the next batch."""
    kept: pa.Table | None = None

    def solved(table: pa.Table) -> pa.RecordBatch:
        tile, y, x = (table.column(c).to_numpy() for c in ("tile", "y", "x"))
        g2 = table.column("g2").fill_null(_NONE).to_numpy()
        borders = [0, *(np.flatnonzero((tile[1:] != tile[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), len(x)]
        d2 = np.concatenate([_least_parabola(x[a:b].astype(np.int64), g2[a:b]) for a, b in zip(borders, borders[1:], strict=False)])
        return pa.RecordBatch.from_arrays([table.column(c).combine_chunks() for c in ("tile", "y", "x")] + [pa.array(d2, pa.int64(), mask=d2 >= _NONE)], names=["tile", "y", "x", "d2"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]) if kept is not None else table
        if not table.num_rows:
            continue
        last = [table.column(c)[-1].as_py() for c in ("tile", "y")]
        begins = pa.compute.index(pa.compute.and_(pa.compute.equal(table.column("tile"), last[0]), pa.compute.equal(table.column("y"), last[1])), True).as_py()
        if begins:
            yield solved(table.slice(0, begins).combine_chunks())
        kept = table.slice(begins).combine_chunks()
    if kept is not None and kept.num_rows:
        yield solved(kept)


def squared_distance(mask: DataFrame) -> DataFrame:
    """tile, y, x, d2: squared Euclidean distance to the nearest off pixel of the tile; null in tiles that are all on.

    A window over columns tells each pixel the distance g to the nearest off pixel above or below. In a row the answer is the
    lower envelope of the parabolas (x - x')^2 + g(x')^2, solved row by row as sorted rows stream through a task: as many rows
    out as in, whatever the objects' width, and one row of a tile in memory."""
    w = Window.partitionBy("tile", "x").orderBy("y")
    at = F.when(~F.col("on"), F.col("y"))
    back = F.col("y") - F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col("y")
    g = mask.select("tile", "y", "x", F.least(back, ahead).cast("long").alias("g")).select("tile", "y", "x", (F.col("g") * F.col("g")).alias("g2"))
    kinds = dict(g.dtypes)
    out = ", ".join([*(f"{c} {kinds[c]}" for c in ("tile", "y", "x")), "d2 long"])
    return g.repartition("tile", "y").sortWithinPartitions("tile", "y", "x").mapInArrow(_rows_of_distances, out)
