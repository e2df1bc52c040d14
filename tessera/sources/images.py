"""Tiles as PNG or TIFF files: a data source with a partition a tile, read and written in the tasks.

    spark.dataSource.register(TileFiles)
    spark.read.format("tiles").option("box", "0,0,4096,4096").load("file:///shared/tiles")

A file is named IMAGE_X_Y.png (or .tif): the image, and where the tile lies in it. The reader gives a row per pixel: image,
tile_x, tile_y, y, x, b, g, r; gray files give equal b, g, r. `box` (x0, y0, x1, y1 in the image, ends left out) and `image`
skip files by their names, before they are opened. Paths are URIs that pyarrow's file systems know.

8-bit samples. PNG: gray, colour, and these with alpha (which is left out), not interlaced. TIFF: strips, as they are or
deflated. Files of other kinds raise an error; an empty folder gives no rows; a tile has all its pixels or writing raises.
"""

from __future__ import annotations

import itertools
import posixpath
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

COLUMNS = ["image", "tile_x", "tile_y", "y", "x", "b", "g", "r"]
SCHEMA = "image string, tile_x int, tile_y int, y int, x int, b int, g int, r int"
_ARROW = pa.schema([("image", pa.string()), *((c, pa.int32()) for c in COLUMNS[1:])])
_NAME = re.compile(r"(.+)_(\d+)_(\d+)\.(png|tif|tiff)\Z")
#: Rows of pixels in a batch.
STRIP = 64
PNG_HEAD = b"\x89PNG\r\n\x1a\n"


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A PNG row without its filter; step: bytes of a pixel."""
    if kind == 0:
        return line
    if kind == 1:  # the pixel before
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:  # the pixel above
        return line + above
    if kind not in (3, 4):
        raise ValueError(f"unknown PNG filter {kind}")
    out, up = [0] * step + line.tolist(), [0] * step + above.tolist()
    for i in range(step, len(out)):
        left, top, corner = out[i - step], up[i], up[i - step]
        if kind == 3:
            near = (left + top) // 2
        else:  # of left, above and corner, the one nearest to left + above - corner
            a, b, c = abs(top - corner), abs(left - corner), abs(left + top - 2 * corner)
            near = left if a <= b and a <= c else top if b <= c else corner
        out[i] = (out[i] + near) & 255
    return np.array(out[step:], np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """Height x width x channels."""
    if data[:8] != PNG_HEAD:
        raise ValueError("no PNG file")
    at, body, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("broken PNG chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("PNG of another kind")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.uint8)
    for y in range(height):
        above = out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, channels)
    pixels = out.reshape(height, width, channels)
    return pixels[:, :, : channels - 1] if channels in (2, 4) else pixels


def write_png(pixels: np.ndarray) -> bytes:
    """Each row less the one above, deflated."""
    height, width, channels = pixels.shape
    flat = pixels.reshape(height, width * channels)
    rows = np.full((height, 1 + width * channels), 2, np.uint8)
    rows[:, 1:] = np.diff(flat, axis=0, prepend=np.zeros((1, width * channels), np.uint8))
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return PNG_HEAD + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


# Tags of TIFF directories, and sizes and codes of their number types.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _OFFSETS, _SAMPLES, _ROWS, _SIZES, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
_NUMBERS = {1: "B", 3: "H", 4: "I"}


def read_tiff(data: bytes) -> np.ndarray:
    """Height x width x channels of the first image of a file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, tuple[int, ...]] = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind in _NUMBERS:
            size = n * struct.calcsize(_NUMBERS[kind])
            place = at + 10 + 12 * i if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
            tags[tag] = struct.unpack(f"{order}{n}{_NUMBERS[kind]}", data[place : place + size])
    width, height, channels = tags[_WIDTH][0], tags[_HEIGHT][0], tags.get(_SAMPLES, (1,))[0]
    if _OFFSETS not in tags or set(tags.get(_BITS, (1,))) != {8} or tags.get(_PLANAR, (1,))[0] != 1 or tags.get(_COMPRESSION, (1,))[0] not in (1, 8, 32946):
        raise ValueError("TIFF of another kind")
    strips = [data[o : o + n] for o, n in zip(tags[_OFFSETS], tags[_SIZES], strict=True)]
    if tags.get(_COMPRESSION, (1,))[0] != 1:
        strips = [zlib.decompress(s) for s in strips]
    pixels = np.frombuffer(b"".join(strips), np.uint8).reshape(height, width, channels)
    if tags.get(_PREDICTOR, (1,))[0] == 2:
        pixels = np.cumsum(pixels, axis=1, dtype=np.uint8)
    if tags.get(_PHOTOMETRIC, (1,))[0] == 0:
        pixels = 255 - pixels
    return pixels[:, :, :3] if channels > 3 else pixels[:, :, :1] if channels == 2 else pixels


def write_tiff(pixels: np.ndarray, rows: int = STRIP) -> bytes:
    """Deflated strips of so many rows."""
    height, width, channels = pixels.shape
    strips = [zlib.compress(np.ascontiguousarray(pixels[y : y + rows]).tobytes(), 6) for y in range(0, height, rows)]
    offsets = list(itertools.accumulate(map(len, strips), initial=8))
    tags = [(_WIDTH, [width]), (_HEIGHT, [height]), (_BITS, [8] * channels), (_COMPRESSION, [8]), (_PHOTOMETRIC, [2 if channels == 3 else 1]), (_OFFSETS, offsets[:-1]), (_SAMPLES, [channels]), (_ROWS, [rows]), (_SIZES, [len(s) for s in strips]), (_PLANAR, [1])]
    at = offsets[-1] + offsets[-1] % 2
    lists_at, directory, lists = at + 2 + 12 * len(tags) + 4, struct.pack("<H", len(tags)), b""
    for tag, values in tags:
        packed = struct.pack(f"<{len(values)}I", *values)
        directory += struct.pack("<HHI", tag, 4, len(values)) + (packed if len(values) == 1 else struct.pack("<I", lists_at + len(lists)))
        lists += packed if len(values) > 1 else b""
    body = b"".join(strips) + b"\0" * (offsets[-1] % 2)
    return b"II*\0" + struct.pack("<I", at) + body + directory + b"\0\0\0\0" + lists


READ = {"png": read_png, "tif": read_tiff, "tiff": read_tiff}
WRITE = {"png": write_png, "tif": write_tiff}


@dataclass
class Tile(InputPartition):
    """A file and what its name says."""

    path: str
    image: str
    x: int
    y: int
    kind: str


def parse_name(path: str) -> Tile | None:
    m = _NAME.match(posixpath.basename(path))
    return Tile(path, m[1], int(m[2]), int(m[3]), m[4]) if m else None


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri, self.image = options["path"], options.get("image")
        self.box = [int(v) for v in options["box"].split(",")] if options.get("box") else None

    def partitions(self) -> Sequence[InputPartition]:
        fs, path = pa.fs.FileSystem.from_uri(self.uri)
        found = [parse_name(f.path) for f in fs.get_file_info(pa.fs.FileSelector(path, recursive=True)) if f.is_file]
        tiles = [t for t in found if t is not None and (self.image is None or t.image == self.image)]
        # a tile that begins beyond the box holds none of it; where one begins before, its size decides when it is read
        return [t for t in tiles if self.box is None or (t.x < self.box[2] and t.y < self.box[3])] or [Tile("", "", 0, 0, "")]

    def read(self, tile: Tile) -> Iterator[pa.RecordBatch]:
        if not tile.path:
            return
        fs, _ = pa.fs.FileSystem.from_uri(self.uri)
        with fs.open_input_stream(tile.path) as f:
            pixels = READ[tile.kind](f.read())
        height, width, channels = pixels.shape
        x0, y0, x1, y1 = self.box or (0, 0, tile.x + width, tile.y + height)
        x0, y0, x1, y1 = max(x0 - tile.x, 0), max(y0 - tile.y, 0), min(x1 - tile.x, width), min(y1 - tile.y, height)
        for y in range(y0, y1, STRIP):
            part = pixels[y : min(y + STRIP, y1), x0:x1]
            h, w, _ = part.shape
            if h and w:
                places = [np.repeat(np.arange(y, y + h), w), np.tile(np.arange(x0, x1), h)]
                # files hold red first
                colours = [part[:, :, c].ravel() for c in ((2, 1, 0) if channels == 3 else (0, 0, 0))]
                numbers = [np.full(h * w, tile.x), np.full(h * w, tile.y), *places, *colours]
                yield pa.RecordBatch.from_arrays([pa.array([tile.image] * (h * w)), *(pa.array(v.astype(np.int32)) for v in numbers)], schema=_ARROW)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Tiles are written under a hidden name and renamed once all tasks are done."""

    def __init__(self, options: dict) -> None:
        self.uri, self.kind, self.gray = options["path"], options.get("kind", "png"), options.get("gray", "false") == "true"

    def _save(self, fs: pa.fs.FileSystem, folder: str, tile: tuple, parts: list[pa.Table]) -> tuple[str, str]:
        rows = pa.concat_tables(parts)
        y, x = rows.column("y").to_numpy(), rows.column("x").to_numpy()
        height, width = int(y.max()) + 1, int(x.max()) + 1
        if len(y) != height * width:
            raise ValueError(f"tile {tile} has {len(y)} pixels of {height} x {width}")
        out = np.zeros((height, width, 1 if self.gray else 3), np.uint8)
        for c, name in enumerate("g" if self.gray else "rgb"):
            out[y, x, c] = rows.column(name).to_numpy()
        name = f"{tile[0]}_{tile[1]}_{tile[2]}.{self.kind}"
        hidden = f"{folder}/.{name}.{np.random.default_rng().integers(1 << 62):x}"
        with fs.open_output_stream(hidden) as f:
            f.write(WRITE[self.kind](out))
        return hidden, f"{folder}/{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = pa.fs.FileSystem.from_uri(self.uri)
        fs.create_dir(folder, recursive=True)
        files, now, parts = [], None, []
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            keys = list(zip(*(table.column(c).to_pylist() for c in ("image", "tile_x", "tile_y")), strict=True))
            for tile, run in itertools.groupby(range(len(keys)), key=keys.__getitem__):
                places = list(run)
                if tile != now and parts:
                    files.append(self._save(fs, folder, now, parts))
                    parts = []
                now = tile
                parts.append(table.slice(places[0], len(places)))
        if parts:
            files.append(self._save(fs, folder, now, parts))
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = pa.fs.FileSystem.from_uri(self.uri)
        for m in messages:
            for hidden, name in m.files if m else ():
                fs.move(hidden, name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = pa.fs.FileSystem.from_uri(self.uri)
        for m in messages:
            for hidden, _ in m.files if m else ():
                fs.delete_file(hidden)


class TileFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def read(spark: SparkSession, path: str, box: tuple[int, int, int, int] | None = None, image: str | None = None) -> DataFrame:
    """The pixels of a folder's tiles, of one image or within a box of it."""
    spark.dataSource.register(TileFiles)
    source = spark.read.format("tiles")
    source = source.option("box", ",".join(map(str, box))) if box else source
    return (source.option("image", image) if image else source).load(path)


def write(pixels: DataFrame, path: str, kind: str = "png", gray: bool = False) -> None:
    """Write a file per image, tile_x, tile_y. Pixels of a tile meet in one task; a task holds one tile at a time."""
    pixels.sparkSession.dataSource.register(TileFiles)
    whole = pixels.select("image", *(F.col(c).cast("int").alias(c) for c in COLUMNS[1:]))
    dealt = whole.repartition("image", "tile_x", "tile_y").sortWithinPartitions("image", "tile_x", "tile_y")
    dealt.write.format("tiles").option("kind", kind).option("gray", str(gray).lower()).mode("append").save(path)


def write_masks(labels: DataFrame, grid: DataFrame, status: DataFrame, path: str, success: int = 0) -> None:
    """Masks (255 on objects) of the tiles (image, tile_x, tile_y) whose status is success, as gray PNG; of others, nothing.
    grid has a row for every pixel."""
    keys = ["image", "tile_x", "tile_y"]
    good = grid.select(*keys, "y", "x").join(status.filter(F.col("status") == success).select(*keys), keys, "left_semi")
    on = good.join(labels.select(*keys, "y", "x", F.lit(255).alias("g")), [*keys, "y", "x"], "left").withColumn("g", F.coalesce("g", F.lit(0)))
    write(on.select(*keys, "y", "x", F.col("g").alias("b"), "g", F.col("g").alias("r")), path, gray=True)


def mosaic(pixels: DataFrame, size: int, ground: int = 255) -> DataFrame:
    """The tiles of each image put together and cut anew into pieces of `size`, so a piece is one task's work whatever the
    image. Where no tile lies within the image's canvas the colour is `ground`; where tiles overlap, the later one (by
    tile_y, then tile_x) counts."""
    at = pixels.select("image", (F.col("tile_x") + F.col("x")).alias("gx"), (F.col("tile_y") + F.col("y")).alias("gy"), F.struct("tile_y", "tile_x", "b", "g", "r").alias("p"))
    piece = lambda c: (F.floor(F.col(c) / size) * size).cast("int")
    placed = at.groupBy("image", "gx", "gy").agg(F.max("p").alias("p"))
    canvas = at.groupBy("image").agg(F.max("gx").alias("w"), F.max("gy").alias("h"))
    steps = lambda c: F.explode(F.sequence(F.lit(0), F.floor(F.col(c) / size).cast("int")))
    pieces = canvas.withColumn("px", steps("w")).withColumn("py", steps("h"))
    ends = lambda p, c: F.sequence(F.col(p) * size, F.least(F.col(p) * size + size - 1, F.col(c)))
    grid = pieces.withColumn("gy", F.explode(ends("py", "h"))).select("image", "gy", F.explode(ends("px", "w")).alias("gx"))
    full = grid.join(placed, ["image", "gx", "gy"], "left").select("image", piece("gx").alias("tile_x"), piece("gy").alias("tile_y"), "gx", "gy", *(F.coalesce(F.col(f"p.{c}"), F.lit(ground)).alias(c) for c in "bgr"))
    return full.select("image", "tile_x", "tile_y", (F.col("gy") - F.col("tile_y")).alias("y"), (F.col("gx") - F.col("tile_x")).alias("x"), "b", "g", "r")
