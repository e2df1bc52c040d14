"""MinHash near-dedup by min-max hashing.

A document's set holds its distinct shingles of K words. Under each of PERMUTATIONS hash functions both the least and the
largest value over the set are kept, so one evaluation gives two signature values. Bands of ROWS least (or largest) values
make bucket keys. Two sets of similarity 0.8 miss all 32 buckets with probability 5e-8. One byte of each signature value
(128 in all) estimates the similarity of two sets: at 0.8, fewer than LEAST_MATCHES bytes agree with probability 3e-8.

1. Documents with equal sets are one class (a node); one row of each goes on.
2. In every bucket all nodes are paired with one pivot: as many pairs as members. Pairs whose sizes or signature bytes
   can't go with the similarity go no further.
3. Pairs are confirmed on full sets: 100 * shared >= PERCENT * union. Both sets of a pair come to a task by the pair's
   first node; a node with many pairs is dealt to several tasks, each of which reads its set once. Confirmed links give
   components.
4. A bucket whose members are still in several components may hide links between members other than the pivot. There,
   all members but the pivot are compared on full sets, if they are in different components: sets are dealt into blocks of
   about BLOCK_SHINGLES shingles, a task holds two blocks at a time, and only links that join what isn't joined yet leave
   it. No pair is given up. The work of this step grows with the square of a bucket's members that aren't linked with its
   pivot, and its rows with their number times their blocks.

Defined results: words are split at ASCII white space, A-Z count as a-z; a text with fewer than K words has its whole
sequence as one shingle; null, empty and blank texts have empty sets and link with nothing; repeated rows are copies of
each other; rows with one doc_id and different texts are nodes of their own (a row is named by doc_id and a hash of its
text); rows with a null doc_id are not linked (component null, kept true); texts are taken whole, whatever their length; an
empty table gives no rows; extra columns, of any name, are ignored by classes() and kept by keep_one().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, batch_of, bit_words, cut, drop_cut, fresh_name, has_bit, mixed, slices, table
from .graph import components

PERMUTATIONS, ROWS, PERCENT = 64, 4, 80
#: Signature bytes of 2 * PERMUTATIONS that agree in a pair which is confirmed.
LEAST_MATCHES = 72
#: Shingles of a block of step 4, and pairs of one node that a task confirms.
BLOCK_SHINGLES, DEALT_PAIRS = 1 << 19, 512
#: Bits of the filter that tells which texts' sets are needed: so many a node, up to a bound; beyond it, more sets pass.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27

_RNG = np.random.Generator(np.random.PCG64(41))
_FACTORS = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BANDS = 2 * PERMUTATIONS // ROWS


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a sequence of word hashes."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mixed((words * _PLACES[:n]).sum(keepdims=True) + np.uint64(n))
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out += words[i : n - k + 1 + i] * _PLACES[i]
    return np.unique(mixed(out))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bucket keys of a set (bands of least values, then bands of largest values), and a byte of each value."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for lo in range(0, len(shingles), 8192):
        values = shingles[lo : lo + 8192, None] * _FACTORS
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    values = np.concatenate([low, high])
    keys = (values.reshape(BANDS, ROWS) * _PLACES[:ROWS]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)
    return mixed(keys).view(np.int64), mixed(values).astype(np.uint8).tobytes()


def _set_of(hashes: WordHashes, text: str | None, k: int) -> np.ndarray:
    return shingle_set(hashes.of((text or "").encode().lower().split()), k)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketches(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            rows = []
            for doc_id, t, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "t", "text")), strict=True):
                own = _set_of(hashes, text, k)
                rows.append((doc_id, t, len(own), _digest(own), *signature(own)) if len(own) else (doc_id, t, 0, None, None, None))
            yield batch_of(rows, schema)

    return sketch


class _Sets:
    """The sets of the texts whose bit is in the filter, named by their digests."""

    def __init__(self, k: int, bits: np.ndarray) -> None:
        self.k, self.bits = k, bits

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.binary()), ("shingles", pa.list_(pa.int64()))])
        hashes = WordHashes()
        for batch in slices(batches):
            batch = batch.filter(pa.array(has_bit(self.bits, batch.column("bit").to_numpy().view(np.uint64))))
            sets = [_set_of(hashes, text, self.k) for text in batch.column("text").to_pylist()]
            yield batch_of([(_digest(own), own.view(np.int64)) for own in sets if len(own)], schema)


def _may_link(n: np.ndarray, m: np.ndarray, matches: np.ndarray) -> np.ndarray:
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (matches >= LEAST_MATCHES)


def _bytes_of(column: pa.Array) -> np.ndarray:
    """Rows of signature bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * PERMUTATIONS)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and signature bytes allow a link."""
    for batch in slices(batches, 4096):
        matches = (_bytes_of(batch.column("x")) == _bytes_of(batch.column("y"))).sum(axis=1)
        yield batch.filter(pa.array(_may_link(batch.column("n").to_numpy(), batch.column("m").to_numpy(), matches))).select(["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among pairs that come in order: the set of a first node, then the sets of its others."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    first = None
    for batch in slices(batches):
        rows = []
        sets = batch.column("shingles")
        for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
            own = sets[i].values.to_numpy()
            if b is None:
                first = own.copy()
                continue
            shared = len(np.intersect1d(first, own, assume_unique=True))
            if 100 * shared >= PERCENT * (len(first) + len(own) - shared):
                rows.append((a, b))
        yield batch_of(rows, schema)


def confirm(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of nodes whose full sets are similar enough."""
    pairs = cut(pairs)
    many = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / DEALT_PAIRS).alias("parts"))
    dealt = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    named = nodes.select("node", "digest")
    wanted = dealt.select("a", "part", F.col("b"), F.col("b").alias("node")).unionByName(dealt.select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("node")).distinct())
    rows = wanted.join(named, "node").join(sets, "digest").select("a", "part", "b", "shingles")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "b").select("a", "b", "shingles").mapInArrow(_confirmed, "a long, b long")


def unit_links(nodes: np.ndarray, comps: np.ndarray, sides: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the components of some sets: those between side 0 and side 1, or all if there is one side. comps
    changes with the links found."""
    sizes = np.array([len(x) for x in sets])
    one = not sides.any()
    right = np.arange(len(nodes)) if one else np.flatnonzero(sides)
    flat, owner = np.concatenate([sets[i] for i in right]), np.repeat(right, sizes[right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    for i in np.flatnonzero(sides == 0).tolist():
        fits = (comps != comps[i]) & (100 * np.minimum(sizes, sizes[i]) >= PERCENT * np.maximum(sizes, sizes[i]))
        if one:
            fits[:i] = False
        else:
            fits &= sides == 1
        if not fits.any():
            continue
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(nodes))
        for j in np.flatnonzero(fits & (100 * shared >= PERCENT * (sizes + sizes[i] - shared))).tolist():
            if comps[j] != comps[i]:
                out.append((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
                comps[comps == comps[j]] = comps[i]
    return out


def _across_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within units of work, whose rows (key, lo, hi, side, node, component, shingles) come one after another."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    unit, held = None, []

    def close() -> list[tuple[int, int]]:
        if len({c for _, c, _, _ in held}) < 2:
            return []
        return unit_links(*(np.array([h[i] for h in held]) for i in range(3)), [h[3] for h in held])

    for batch in slices(batches):
        rows = []
        sets = batch.column("shingles")
        for i, (*mine, node, comp, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi", "node", "component", "side")), strict=True)):
            if mine != unit:
                rows += close()
                unit, held = mine, []
            held.append((node, comp, side, sets[i].values.to_numpy().copy()))
        yield batch_of(rows, schema)
    yield batch_of(close(), schema)


def _across(members: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members (key, node, component) of one bucket in different components."""
    sized = members.join(nodes.select("node", "n", "digest"), "node")
    blocks = sized.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    dealt = sized.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "component", "digest")
    rows = units.join(sets, "digest").select("key", "lo", "hi", "side", "node", "component", "shingles")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_across_units, "a long, b long")


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """Every row's doc_id, t (a hash of its text), n_shingles, and lead: doc_id and t of its component's first row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    sketch = cut(rows.mapInArrow(_sketches(k), "doc_id long, t long, n_shingles long, digest binary, bands array<long>, sig binary"))
    filled = sketch.filter("doc_id is not null and n_shingles > 0")
    # numbers of their own, as several nodes may have one least doc_id; they are written, so they hold from here on
    same = filled.groupBy("digest").agg(F.min(F.struct("doc_id", "t")).alias("lead"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    equal = cut(same.withColumn("node", F.monotonically_increasing_id()))
    members = equal.select("node", F.explode("bands").alias("key"))
    pivots = members.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    buckets = cut(members.join(pivots, "key"))
    nodes = cut(equal.select("node", "n", "digest", "sig", "lead").join(buckets.select("node").distinct(), "node"))

    x, y = nodes.select(F.col("node").alias("a"), "n", F.col("sig").alias("x")), nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sig").alias("y"))
    pairs = buckets.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    alike = pairs.join(x, "a").join(y, "b").mapInArrow(_alike, "a long, b long")
    n_bits = 1 << min(MOST_FILTER_BITS.bit_length() - 1, max(10, (FILTER_BITS * nodes.count()).bit_length()))
    bit = lambda doc_id, t: F.pmod(F.xxhash64(doc_id, t), F.lit(n_bits))
    wanted = rows.filter("doc_id is not null").select("text", bit("doc_id", "t").alias("bit"))
    bits = bit_words(nodes, [bit("lead.doc_id", "lead.t")], n_bits)
    made = cut(wanted.mapInArrow(_Sets(k, bits), "digest binary, shingles array<long>"))
    # equal texts under one filter bit come more than once
    sets = made if made.count() == made.select("digest").distinct().count() else made.dropDuplicates(["digest"])
    links = cut(confirm(alike, nodes, sets))

    found = components(links)
    now = buckets.filter("size > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    now = cut(now)
    at_pivot = now.filter("node = pivot").select("key", F.col("component").alias("pivot_component"))
    others = now.filter("node != pivot")
    rest = cut(others.join(at_pivot, "key").filter("component != pivot_component").select("key").distinct())
    if not rest.isEmpty():
        more = cut(_across(others.join(rest, "key").select("key", "node", "component"), nodes, sets))
        if not more.isEmpty():
            drop_cut(found)
            found = components(links.unionByName(more))
        drop_cut(more)
    for done in (buckets, made, links, now, rest):
        drop_cut(done)
    linked = nodes.select("node", "digest", "lead").join(found, "node")
    leads = linked.groupBy("component").agg(F.min("lead").alias("first"))
    named = linked.join(leads, "component").select("digest", "first")
    out = sketch.select("doc_id", "t", "n_shingles", "digest").join(equal.select("digest", "lead"), "digest", "left").join(named, "digest", "left")
    out = cut(out.select("doc_id", "t", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "lead", F.struct("doc_id", "t"))).alias("lead")))
    for done in (sketch, equal, nodes, found):
        drop_cut(done)
    return out


def classes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    out = _classes(docs, k).select("doc_id", "n_shingles", F.col("lead.doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = 5) -> DataFrame:
    """The documents without the later ones of each near-duplicate group, all columns as they are. Of repeated rows (doc_id
    and text) one stays, as long as the doc_id isn't null."""
    found = _classes(docs, k).filter("doc_id is not null")
    d, t = fresh_name(docs, "d"), fresh_name(docs, "t")
    out = cut(found.filter("lead.doc_id != doc_id or lead.t != t").select(F.col("doc_id").alias(d), F.col("t").alias(t)).distinct())
    keyed = docs.withColumns({d: F.col("doc_id").cast("long"), t: F.xxhash64("text")})
    stay = keyed.join(out, [d, t], "left_anti")
    repeated = not found.groupBy("doc_id", "t").count().filter("count > 1").isEmpty()
    drop_cut(found)
    if repeated:
        stay = stay.filter(F.col(d).isNotNull()).dropDuplicates([d, t]).unionByName(stay.filter(F.col(d).isNull()))
    return stay.select(*docs.columns)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), 2)


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, case when len(ws) < 2 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as own from w),
e as (select doc_id, len(own) as n, unnest(own) as x from s),
links as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id != b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) as (select doc_id, doc_id from s union select r.a, l.b from reach r join links l on l.a = r.b)
select doc_id, cast(len(own) as bigint) as n_shingles, min(b) as component_id, doc_id = min(b) as kept
from s join reach on a = doc_id group by doc_id, len(own)
"""
