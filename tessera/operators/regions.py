"""Connected regions of masks. A mask is a table of pixels: tile, y, x and a boolean column `on`; an absent pixel is off.

Runs of neighbouring pixels in a row are the nodes, and runs that touch across two rows are linked, so the iteration works
on one row a run instead of one a pixel, and only on regions that reach beyond the rows that a task holds. A region's label is its first pixel in raster order, y * STRIDE + x.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .morphology import STRIDE
from .staging import cut, drop, shuffled


# Links of this many rows of pixels go to one task; so many links of one tile are looked at together.
BAND, MOST = 32, 1 << 17


def _numbered(tiles: pa.ChunkedArray) -> np.ndarray:
    """Numbers from 0 of a sorted column's values."""
    parts = pa.table([tiles], ["tile"])
    while any(pa.types.is_struct(t) for t in parts.schema.types):
        parts = parts.flatten()
    new = np.zeros(len(tiles), bool)
    for c in parts.columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy()
    return np.cumsum(new)


def _star(links: pa.Table, tile: np.ndarray) -> pa.RecordBatch:
    """tile, node, root: the least node of the same tile that is reachable through these links."""
    n = len(tile)
    names, at = np.unique(np.concatenate([links.column(c).to_numpy() for c in "ab"]), return_inverse=True)
    places, first, at = np.unique(np.tile(tile, 2) * len(names) + at, return_index=True, return_inverse=True)
    root = np.arange(len(places))
    while (root[at[:n]] != root[at[n:]]).any():
        a, b = root[at[:n]], root[at[n:]]
        np.minimum.at(root, a, b)
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root = root[root]
    node = names[places % len(names)]
    return pa.RecordBatch.from_arrays([links.column("tile").combine_chunks().take(pa.array(first % n)), pa.array(node), pa.array(node[root])], ["tile", "node", "root"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_star() of links (tile, a, b) sorted by tile: whole tiles at a time, or MOST links of a tile that has more."""
    held = None
    for batch in batches:
        links = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if not links.num_rows:
            continue
        tile = _numbered(links.column("tile"))
        end = len(tile) if tile[-1] == 0 and len(tile) >= MOST else int(np.searchsorted(tile, tile[-1]))
        if end:
            yield _star(links.slice(0, end), tile[:end])
        held = links.slice(end) if end < len(tile) else None
    if held is not None:
        yield _star(held, np.zeros(held.num_rows, np.int64))


def lowest_reachable(links: DataFrame) -> DataFrame:
    """tile, node, label: the least node reachable through the links (tile, a, b), for every node that has one. First the tasks
    lead the nodes of neighbouring rows to the least one, links of small tiles all together. Roots of which two tasks, or two
    parts of a large tile, hold a common node are linked in turn; only these go through rounds of joins."""
    near = links.select("tile", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    near = near.repartition("tile", F.floor(F.col("a") / (STRIDE * BAND))).sortWithinPartitions("tile", "a")
    stars = cut(near.mapInArrow(_stars, StructType([near.schema["tile"], StructField("node", LongType()), StructField("root", LongType())])))
    least = stars.groupBy("tile", "node").agg(F.min("root").alias("root"), F.max("root").alias("other"))
    met = least.filter("root < other").select("tile", "node", F.col("root").alias("a"))
    across = cut(stars.join(met, ["tile", "node"]).filter("a < root").select("tile", "a", F.col("root").alias("b")).distinct())
    found = least.select("tile", "node", "root")
    if across.isEmpty():
        found = found.withColumnRenamed("root", "label")
    else:
        ends = across.select("tile", F.col("a").alias("node")).union(across.select("tile", "b")).distinct()
        found = found.join(_by_rounds(ends, across).withColumnRenamed("node", "root"), ["tile", "root"], "left").select("tile", "node", F.coalesce("label", "root").alias("label"))
    drop(across)
    return shuffled(found)


def _by_rounds(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """tile, node, label by joins alone. Each round takes the least label among the neighbours and then the label of the label,
    until no row changes."""
    both = cut(links.unionByName(links.select("tile", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = nodes.select("tile", "node", F.col("node").alias("label"))
    while True:
        near = both.join(state.select("tile", F.col("node").alias("b"), "label"), ["tile", "b"]).groupBy("tile", F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = state.join(near, ["tile", "node"], "left").select("tile", "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = cut(hooked)
        drop(state)
        up = hooked.select("tile", F.col("node").alias("label"), F.col("label").alias("up"))
        moved = cut(hooked.join(up, ["tile", "label"]).select("tile", "node", "old", F.col("up").alias("label")))
        drop(hooked)
        state = moved.drop("old")
        state._tessera_path = moved._tessera_path
        if moved.filter("old != label").isEmpty():
            drop(both)
            return state


def label(mask: DataFrame, conn: int = 8) -> DataFrame:
    """tile, y, x, label of the pixels that are on; conn is 4 or 8."""
    w = Window.partitionBy("tile", "y").orderBy("x")
    start = F.when(F.lag("x").over(w) == F.col("x") - 1, None).otherwise(F.col("x"))
    on = mask.filter("on").select("tile", "y", "x").withColumn("s", start)
    run = F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = cut(on.select("tile", "y", "x", (F.col("y").cast("long") * STRIDE + run).alias("node")))
    reach = F.array(*(F.lit(d) for d in ((-1, 0, 1) if conn == 8 else (0,))))
    below = runs.select("tile", (F.col("y") - 1).alias("y"), F.col("node").alias("b"), "x", F.explode(reach).alias("d")).select("tile", "y", (F.col("x") + F.col("d")).alias("x"), "b")
    links = runs.join(below, ["tile", "y", "x"]).select("tile", F.col("node").alias("a"), "b").distinct()
    return shuffled(runs.join(lowest_reachable(links), ["tile", "node"], "left").select("tile", "y", "x", F.coalesce("label", "node").alias("label")))


def relabel(labels: DataFrame) -> DataFrame:
    """Labels numbered from 1 in raster order within each tile."""
    own = labels.select("tile", "label").distinct()
    return labels.join(own.withColumn("number", F.row_number().over(Window.partitionBy("tile").orderBy("label"))), ["tile", "label"])


def select_seeded(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """The regions that some seed pixel (tile, y, x) touches."""
    hit = labels.join(seeds.select("tile", "y", "x"), ["tile", "y", "x"], "left_semi").select("tile", "label").distinct()
    return shuffled(labels.join(hit, ["tile", "label"], "left_semi"))


def boxes(labels: DataFrame) -> DataFrame:
    """Area and bounding box per region."""
    return labels.groupBy("tile", "label").agg(F.count("*").alias("area"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def by_area(labels: DataFrame, least: int, below: int | None = None) -> DataFrame:
    """The regions with least <= area, and area < below if that is given."""
    area = labels.groupBy("tile", "label").agg(F.count("*").alias("area")).filter(F.col("area") >= least)
    if below is not None:
        area = area.filter(F.col("area") < below)
    return shuffled(labels.join(area.select("tile", "label"), ["tile", "label"], "left_semi"))


def fill_holes(mask: DataFrame, conn: int = 8) -> DataFrame:
    """tile, y, x of the mask with its holes: regions of off pixels that don't reach the tile's border. The mask has a row
    for every pixel of a tile. Off pixels touch as 4-neighbours under conn 8 and as 8-neighbours under conn 4."""
    off = label(mask.select("tile", "y", "x", (~F.col("on")).alias("on")), 4 if conn == 8 else 8)
    edge = mask.groupBy("tile").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    outer = off.join(edge, "tile").filter("x in (x0, x1) or y in (y0, y1)").select("tile", "label").distinct()
    holes = off.join(outer, ["tile", "label"], "left_anti")
    return mask.filter("on").select("tile", "y", "x").unionByName(holes.select("tile", "y", "x"))


def plateaus(pixels: DataFrame, value: str, conn: int = 8) -> DataFrame:
    """tile, y, x, value, label: regions of neighbours with equal values; each pixel of the tile is in one."""
    w = Window.partitionBy("tile", "y").orderBy("x")
    p = pixels.select("tile", "y", "x", F.col(value).alias("value"))
    same = (F.lag("x").over(w) == F.col("x") - 1) & F.lag("value").over(w).eqNullSafe(F.col("value"))
    runs = p.withColumn("s", F.when(~F.coalesce(same, F.lit(False)), F.col("x")))
    run = F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = cut(runs.select("tile", "y", "x", "value", (F.col("y").cast("long") * STRIDE + run).alias("node")))
    reach = F.array(*(F.lit(d) for d in ((-1, 0, 1) if conn == 8 else (0,))))
    below = runs.select("tile", (F.col("y") - 1).alias("y"), "value", F.col("node").alias("b"), "x", F.explode(reach).alias("d")).select("tile", "y", (F.col("x") + F.col("d")).alias("x"), "value", "b")
    links = runs.join(below, ["tile", "y", "x", "value"]).select("tile", F.col("node").alias("a"), "b").distinct()
    return shuffled(runs.join(lowest_reachable(links), ["tile", "node"], "left").select("tile", "y", "x", "value", F.coalesce("label", "node").alias("label")))


def fill_from(mask: DataFrame, seeds: DataFrame, conn: int = 8) -> DataFrame:
    """tile, y, x of the mask with the off regions that a seed touches."""
    off = label(mask.select("tile", "y", "x", (~F.col("on")).alias("on")), conn)
    return mask.filter("on").select("tile", "y", "x").unionByName(select_seeded(off, seeds).select("tile", "y", "x"))
