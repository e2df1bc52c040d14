"""Tile files: codecs, the data source, masks and mosaics."""

import struct
import zlib

import numpy as np
import pytest

from tessera.sources import images


def shades(seed, h, w, c):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)


@pytest.mark.parametrize("shape", [(1, 1, 1), (9, 5, 3), (70, 3, 1), (130, 2, 3)])
def test_round_trips(shape):
    p = shades(1, *shape)
    assert (images.read_png(images.write_png(p)) == p).all()
    assert (images.read_tiff(images.write_tiff(p)) == p).all()


def png(pixels, kinds):
    """A PNG whose rows have the given filters, applied as the format says."""
    h, w, c = pixels.shape
    raw, flat = b"", np.vstack([np.zeros((1, w * c), int), pixels.reshape(h, -1)]).astype(int)
    for y in range(1, h + 1):
        left = np.concatenate([np.zeros(c, int), flat[y, :-c]])
        corner = np.concatenate([np.zeros(c, int), flat[y - 1, :-c]])
        up, kind = flat[y - 1], kinds[(y - 1) % len(kinds)]
        guess = left + up - corner
        a, b, d = abs(guess - left), abs(guess - up), abs(guess - corner)
        near = {0: 0 * up, 1: left, 2: up, 3: (left + up) // 2, 4: np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))}[kind]
        raw += bytes([kind]) + ((flat[y] - near) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, part: struct.pack(">I", len(part)) + k + part + struct.pack(">I", zlib.crc32(k + part))
    body = zlib.compress(raw)
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    return images.PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_all_row_filters(channels):
    p = shades(channels, 11, 6, channels)
    got = images.read_png(png(p, [0, 1, 2, 3, 4]))
    assert (got == (p if channels in (1, 3) else p[:, :, : channels - 1])).all()


def test_tiff_of_other_writers():
    """Big-endian, plain strips in any order, horizontal differences, white as zero."""
    p = shades(7, 4, 5, 1)
    strips = [p[2:].tobytes(), p[:2].tobytes()]
    tags = [(256, 3, [5]), (257, 3, [4]), (258, 3, [8]), (259, 3, [1]), (262, 3, [0]), (273, 4, [18, 8]), (277, 3, [1]), (278, 3, [2]), (279, 4, [10, 10])]
    at = 28
    lists_at, directory, lists = at + 2 + 12 * len(tags) + 4, struct.pack(">H", len(tags)), b""
    for tag, kind, values in tags:
        packed = struct.pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values)
        directory += struct.pack(">HHI", tag, kind, len(values)) + (packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack(">I", lists_at + len(lists)))
        lists += packed if len(packed) > 4 else b""
    data = b"MM\0*" + struct.pack(">I", at) + b"".join(strips) + directory + b"\0\0\0\0" + lists
    assert (images.read_tiff(data) == 255 - p).all()


@pytest.mark.parametrize("data", [b"", b"no image", images.PNG_HEAD + b"\0\0\0\0IEND\0\0\0\0"])
def test_broken_files(data):
    for read in (images.read_png, images.read_tiff):
        with pytest.raises((ValueError, struct.error)):
            read(data)


def grid(spark, at):
    rows = [(name, tx, ty, y, x, (x * 7 + ty) % 256, y, tx % 256) for name, tx, ty, w, h in at for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, images.SCHEMA)


def test_source(spark, tmp_path):
    df = grid(spark, [("a_1", 0, 0, 6, 5), ("a_1", 6, 0, 3, 5), ("b", 0, 5, 4, 4)])
    uri = f"file://{tmp_path}/t"
    images.write(df, uri)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["a_1_0_0.png", "a_1_6_0.png", "b_0_5.png"]
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(images.read(spark, uri)) == key(df)
    box = images.read(spark, uri, box=(5, 1, 8, 3))
    assert key(box) == key(df.filter("tile_x + x between 5 and 7 and tile_y + y between 1 and 2"))
    assert images.read(spark, uri, image="b").count() == 16
    # a file beyond the box is never opened
    (tmp_path / "t" / "b_90_90.png").write_bytes(b"broken")
    assert images.read(spark, uri, box=(0, 0, 80, 80)).count() == df.count()
    with pytest.raises(Exception, match="no PNG"):
        images.read(spark, uri).count()
    (tmp_path / "none").mkdir()
    assert images.read(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="pixels of"):
        images.write(df.filter("not (image = 'b' and x = 1 and y = 1)"), f"file://{tmp_path}/bad")


def test_masks_of_successful_tiles(spark, tmp_path):
    df = grid(spark, [("m", 0, 0, 3, 2), ("m", 3, 0, 3, 2)])
    labels = df.filter("x = 1").selectExpr("image", "tile_x", "tile_y", "y", "x", "7L as label")
    status = spark.createDataFrame([("m", 0, 0, 0), ("m", 3, 0, 2)], "image string, tile_x int, tile_y int, status int")
    images.write_masks(labels, df, status, f"file://{tmp_path}/m")
    got = images.read(spark, f"file://{tmp_path}/m").collect()
    assert {(r.tile_x, r.x, r.g) for r in got} == {(0, 0, 0), (0, 1, 255), (0, 2, 0)} and len(got) == 6


def test_mosaic(spark):
    df = grid(spark, [("m", 0, 0, 3, 3), ("m", 5, 2, 3, 3), ("m", 2, 2, 2, 2)])
    got = {(r.tile_x + r.x, r.tile_y + r.y): (r.tile_x, r.tile_y, r.b, r.g, r.r) for r in images.mosaic(df, 4).collect()}
    assert set(got) == {(x, y) for x in range(8) for y in range(5)}
    assert got[4, 0] == (4, 0, 255, 255, 255) and got[2, 2] == (0, 0, 2, 0, 2) and got[7, 4] == (4, 4, 16, 2, 5)
