"""Tiles: reading images into pixel tables, pairing masks with images, grids over slides, and cutting anew."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Image endings, those first in the list preferred.
ENDINGS = ("tif", "tiff", "png")
PIXELS = "path string, y int, x int, b int, g int, r int"


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def ending(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def replace_ending(path: Column, new: str) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "." + new)


def position(name: Column) -> tuple[Column, Column]:
    """x and y of a tile from its name, <image>-<x>-<y>.<ending>; None for other names."""
    at = lambda k: F.regexp_extract(name, r"-(\d+)-(\d+)\.[^/]*$", k).try_cast("bigint")
    return at(1), at(2)


def list_files(spark: SparkSession, folder: str, suffix: str, recursive: bool = True) -> DataFrame:
    """path, length and modificationTime of the files with the suffix, but for empty ones; contents aren't read."""
    return spark.read.format("binaryFile").load(folder, pathGlobFilter="*" + suffix, recursiveFileLookup=recursive).select("path", "length", "modificationTime")


def pair(masks: DataFrame, images: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """mask, image, stem: each mask (column `path`, <stem>.mask.<ending>) with the image of its stem, of the first ending
    that there is. Masks without an image go, and so do those whose stem is in `done`."""
    m = masks.select(F.col("path").alias("mask"), F.regexp_replace(file_name(F.col("path")), r"\.mask\.[^.]*$", "").alias("stem"))
    rank = F.array_position(F.array(*(F.lit(e) for e in ENDINGS)), ending(F.col("path")))
    i = images.select("path", F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", "").alias("stem"), rank.alias("rank")).filter("rank > 0")
    best = i.groupBy("stem").agg(F.min(F.struct("rank", "path")).alias("m")).select("stem", F.col("m.path").alias("image"))
    if done is not None:
        m = m.join(done.select("stem"), "stem", "left_anti")
    return m.join(best, "stem").select("mask", "image", "stem")


def read_pixels(spark: SparkSession, folder: str, rows_at_once: int = 256) -> DataFrame:
    """Pixels of the binary graymaps and pixmaps (8 bits a sample) under a folder. A task holds one file at a time and
    hands out its pixels a few rows at a time. Files of other kinds give no rows."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                head = _header(data)
                if head is None:
                    continue
                channels, width, height, start = head
                samples = np.frombuffer(data, np.uint8, width * height * channels, start).reshape(height, width, channels)
                for top in range(0, height, rows_at_once):
                    part = samples[top : top + rows_at_once]
                    y, x = np.divmod(np.arange(part.shape[0] * width), width)
                    flat = part.reshape(-1, channels)
                    yield pd.DataFrame({"path": path, "y": y + top, "x": x, "b": flat[:, -1], "g": flat[:, channels // 2], "r": flat[:, 0]})

    files = spark.read.format("binaryFile").load(folder, pathGlobFilter="*.p[gp]m", recursiveFileLookup=True)
    return files.select("path", "content").mapInPandas(unpack, PIXELS)


def _header(data: bytes) -> tuple[int, int, int, int] | None:
    """Channels, width, height and the offset of the samples."""
    words, at = [], 0
    while len(words) < 4 and at < len(data):
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
        elif data[at : at + 1].isspace():
            at += 1
        else:
            end = at
            while end < len(data) and not data[end : end + 1].isspace():
                end += 1
            words.append(data[at:end])
            at = end
    channels = {b"P5": 1, b"P6": 3}.get(words[0] if words else b"")
    if channels is None or len(words) < 4 or not all(w.isdigit() for w in words[1:]) or words[3] != b"255":
        return None
    width, height = int(words[1]), int(words[2])
    return (channels, width, height, at + 1) if len(data) >= at + 1 + width * height * channels else None


def grid(levels: DataFrame, magnification: float, size: int) -> DataFrame:
    """slide, level, x, y, w, h: tiles of the level whose magnification is nearest to the wanted one (ties: the lesser
    level). levels: slide, level, magnification, width, height. Tiles at the far edges may be smaller."""
    best = levels.groupBy("slide").agg(F.min_by(F.struct("level", "width", "height"), F.struct(F.abs(F.col("magnification") - magnification), "level")).alias("b")).select("slide", "b.*").filter("width > 0 and height > 0")
    step = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1, F.lit(size)))
    tiles = best.withColumn("x", step("width")).withColumn("y", step("height"))
    return tiles.select("slide", "level", "x", "y", F.least(F.lit(size), F.col("width") - F.col("x")).alias("w"), F.least(F.lit(size), F.col("height") - F.col("y")).alias("h"))


def retile(pixels: DataFrame, size: int) -> DataFrame:
    """Pixels in image coordinates (gx, gy) with the tile that they are in (tile_x, tile_y: its first pixel) and x, y
    within it; no shuffle."""
    at = lambda c: F.floor(F.col(c) / size) * size
    return pixels.withColumns({"tile_x": at("gx"), "tile_y": at("gy")}).withColumns({"x": F.col("gx") - F.col("tile_x"), "y": F.col("gy") - F.col("tile_y")})


def sample(rows: DataFrame, numerator: int, denominator: int, partition: list[str], order: str, width: int = 10_000) -> DataFrame:
    """Every time the running share numerator / denominator of a group passes a whole number, its row is taken. `order` is a
    whole number that no two rows of a group share. Rows are numbered in slices of `width` of it, from the counts of all
    earlier slices, so a group with a third of all rows is many tasks."""
    sliced = rows.withColumn("_slice", F.floor(F.col(order) / width))
    keys = [*partition, "_slice"]
    per = sliced.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = per.select(*keys, (F.sum("_n").over(Window.partitionBy(*partition).orderBy("_slice")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    numbered = sliced.withColumn("_inside", inside).join(before, keys).withColumn("_rn", F.col("_inside") + F.col("_before"))
    taken = F.floor(F.col("_rn") * numerator / denominator) > F.floor((F.col("_rn") - 1) * numerator / denominator)
    return numbered.filter(taken).select(*rows.columns)


def shuffled(files: DataFrame, column: str, limit: int = -1, seed: str = "0") -> DataFrame:
    """The files in an order drawn by a seeded hash of their names, the same on every run; the first `limit`, or all (-1). Equal
    names stay together, in no certain order."""
    drawn = files.orderBy(F.md5(F.concat_ws(":", F.lit(seed), column)), column)
    return drawn if limit < 0 else drawn.limit(limit)
