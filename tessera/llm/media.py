"""Media columns by content-defined chunking.

A text becomes a payload: its UTF-8 bytes (null: none) and bytes 255 up to the next positive multiple of UNIT. A rolling
gear hash cuts the payload into chunks; equal chunks have equal digests wherever they stand. The stored form of a payload
is its ordered chunk list (digest and length of each chunk) and the chunks' 8-bit samples.

All of it is written to the shared folder and read again; every column comes from what was read.

1. A first pass writes the digests of every document's chunks. A count by digest tells which of them several documents
   have; these go into a bitmap of fixed size (BITMAP_BITS, so 4 MB whatever the input).
2. The second pass writes one row per document: its ordered chunk list, and the samples of those of its chunks that no other
   document has. The samples of the others are written once a digest, by grouping. A false hit in the bitmap only groups a
   chunk that stands alone; with a bitmap full of hits all chunks are grouped, with the same results.
3. Rows are read again. Lists that name grouped chunks fetch them by a join on the digest. Payloads are put together from
   their lists and samples; every chunk is checked against its digest and every payload against its own, and a mismatch
   raises.

Defined results: a null or empty text gives one unit of bytes 255; repeated rows and equal texts give equal values; rows
with a null doc_id are kept; texts are taken whole, whatever their length; an empty table gives no rows; extra columns, of any
name, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FLUSH_SIZE, bit_words, cut, drop_cut, has_bit, slices, table

UNIT, FILL = 576, 255
#: Chunk lengths in bytes: the least, the mean beyond it (as bits), the most.
LEAST, MASK_BITS, MOST = 512, 11, 16_384
#: Bits of the bitmap of shared digests.
BITMAP_BITS = 1 << 25

FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _gear(seed: int = 20240229) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, 256, dtype=np.uint32)


GEAR = _gear()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the padded payload."""
    data = (text or "").encode()
    return len(data), data + bytes([FILL]) * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The gear hash of a place covers the 32 bytes up to it: h = sum of GEAR[byte] << distance,
    made here for all places at once by doubling the covered width."""
    n = len(data)
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    out, at, i = [], 0, 0
    marks = marks.tolist()
    while n - at > LEAST:
        while i < len(marks) and marks[i] < at + LEAST:
            i += 1
        end = marks[i] if i < len(marks) and marks[i] <= at + MOST else min(at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def chunks_of(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk, in order."""
    out, at = [], 0
    for end in cuts(data):
        out.append((digest(data[at:end]), data[at:end]))
        at = end
    return out


def features_of(chunks: list[tuple[bytes, bytes]], key: bytes) -> tuple:
    """Features of a payload from the chunks that were read back; checks every chunk and the payload."""
    for name, data in chunks:
        if digest(data) != name:
            raise ValueError("a stored chunk doesn't match its digest")
    data = b"".join(x for _, x in chunks)
    if digest(data) != key:
        raise ValueError("the chunks don't make up their payload")
    manifest = b"".join(name + len(x).to_bytes(4, "big") for name, x in chunks)
    media = hashlib.sha256(manifest)
    media.update(data)
    samples = np.frombuffer(data, np.uint8)
    feature = f"chunks={len(chunks)};longest={max(len(x) for _, x in chunks)};mean={samples.mean():.6f};var={samples.var():.6f};high={np.count_nonzero(samples >= 128)}"
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(manifest) + len(data), media.hexdigest(), feature


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f"c{i}" for i in range(len(kinds))])


def _digest_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct chunk digests of each document."""
    for batch in slices(batches):
        rows = [(list({name: None for name, _ in chunks_of(payload_of(text)[1])}),) for text in batch.column("text").to_pylist()]
        if rows:
            yield _batch(rows, [pa.list_(pa.binary())])


def shared_bitmap(docs: DataFrame) -> np.ndarray:
    """Bitmap of the digests that more than one document has. At most BITMAP_BITS / 64 words come to the driver."""
    digests = cut(docs.select("text").mapInArrow(_digest_pass, "digests array<binary>"))
    shared = digests.select(F.explode("digests").alias("digest")).groupBy("digest").count().filter("count > 1")
    bit = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long") % BITMAP_BITS
    out = bit_words(shared, [bit], BITMAP_BITS)
    drop_cut(digests)
    return out


def _flagged(names: list[bytes], bitmap: np.ndarray) -> list[bool]:
    return has_bit(bitmap, np.array([int.from_bytes(x[:6], "big") % BITMAP_BITS for x in names], np.uint64)).tolist()


class _Rows:
    """Each document's payload digest, ordered chunk list, and the samples of its chunks that aren't flagged."""

    def __init__(self, bitmap: np.ndarray) -> None:
        self.bitmap = bitmap

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32())])), pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())])), pa.bool_()]
        for batch in slices(batches):
            rows: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, data = payload_of(text)
                chunks = chunks_of(data)
                every = dict(chunks)
                flags = _flagged(list(every), self.bitmap)
                own = [{"digest": name, "bytes": x} for (name, x), flag in zip(every.items(), flags, strict=True) if not flag]
                rows.append((doc_id, n, digest(data), [{"digest": name, "length": len(x)} for name, x in chunks], own, not any(flags)))
                size += len(data)
                if size > FLUSH_SIZE:
                    yield _batch(rows, kinds)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, kinds)


class _Shared:
    """The flagged chunks, once a batch."""

    def __init__(self, bitmap: np.ndarray) -> None:
        self.bitmap = bitmap

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            every = dict(x for text in batch.column("text").to_pylist() for x in chunks_of(payload_of(text)[1]))
            rows = [x for x, flag in zip(every.items(), _flagged(list(every), self.bitmap), strict=True) if flag]
            if rows:
                yield _batch(rows, [pa.binary(), pa.binary()])


def chunk_store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written store: a row per document (doc_id, n_bytes, payload, chunks, own, whole: no chunk is grouped), and a row
    per grouped chunk (digest, bytes)."""
    bitmap = shared_bitmap(docs)
    fields = "doc_id long, n_bytes long, payload binary, chunks array<struct<digest:binary,length:int>>, own array<struct<digest:binary,bytes:binary>>, whole boolean"
    rows = cut(docs.mapInArrow(_Rows(bitmap), fields), "zstd")
    sent = docs.select("text").mapInArrow(_Shared(bitmap), "digest binary, bytes binary")
    return rows, cut(sent.groupBy("digest").agg(F.first("bytes").alias("bytes")), "zstd")


class _Rebuild:
    """FEATURES of payloads from their chunk lists and stored samples, behind the columns that name them."""

    def __init__(self, names: list[tuple[str, pa.DataType]]) -> None:
        self.names = names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [k for _, k in self.names] + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in slices(batches, 64):
            rows = []
            for key, chunks, stored, *named in zip(*(batch.column(c).to_pylist() for c in ("payload", "chunks", "stored", *(n for n, _ in self.names))), strict=True):
                found = {x["digest"]: x["bytes"] for x in stored}
                rows.append((*named, *features_of([(c["digest"], found[c["digest"]]) for c in chunks], key)))
            if rows:
                yield _batch(rows, kinds)


def read_back(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """FEATURES of every document, from the written store alone."""
    named = [("doc_id", pa.int64()), ("n_bytes", pa.int64())]
    alone = rows.filter("whole").withColumnRenamed("own", "stored").mapInArrow(_Rebuild(named), f"doc_id long, n_bytes long, {FEATURES}")
    # equal payloads are put together once
    joint = rows.filter("not whole")
    payloads = joint.groupBy("payload").agg(F.first("chunks").alias("chunks"), F.first("own").alias("own"))
    # own samples of its payload, if any, stay with it; a list whose chunks are missing fails instead of vanishing
    wanted = payloads.select("payload", F.explode(F.array_distinct("chunks.digest")).alias("digest"))
    fetched = wanted.join(shared.hint("merge"), "digest").groupBy("payload").agg(F.collect_list(F.struct("digest", "bytes")).alias("fetched"))
    whole = payloads.join(fetched.hint("merge"), "payload", "left").select("payload", "chunks", F.concat("own", F.coalesce("fetched", F.array())).alias("stored"))
    by_key = whole.mapInArrow(_Rebuild([("payload", pa.binary())]), f"payload binary, {FEATURES}")
    return alone.unionByName(joint.select("doc_id", "n_bytes", "payload").join(by_key.hint("merge"), "payload").drop("payload"))


def media_features(docs: DataFrame) -> DataFrame:
    """Chunk, store, read back and verify every document; one row each: doc_id, n_bytes and FEATURES."""
    return read_back(*chunk_store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))


def op10_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
