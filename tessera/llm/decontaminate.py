"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over SPAN neighbouring words ignore some positions, so a seed still hits when words at these positions were
replaced. Seeds of all benchmark items make a table (hash, item, place). Seeds of the documents are hashed everywhere, but
only those that pass a Bloom filter of the benchmark's seeds (BITS_PER_SEED bits a seed, up to MOST_BLOOM_BITS; with more
seeds, more places pass and the findings are the same) leave the task, together with the words around them. A Spark join on the hash finds the items; then every hit diagonal is verified word by
word: the stretch with the best score (+1 for an equal word, -MISS for another) must cover enough of the item with enough
equal words. Items shorter than SPAN words are sought as whole phrases.

Defined results: words are runs of letters and digits, lower case; null and empty texts and items have none; items with
fewer than LEAST_ITEM words are not sought; repeated rows, and rows with one doc_id and other texts, give one finding (the
best) per doc_id; rows with a null doc_id are found under a null doc_id; of equal stretches the first counts; texts are taken
whole, whatever their length; empty tables give no rows; extra columns, of any name, are ignored by findings() and kept by
drop_contaminated(), which judges every row by its own text (named by a 64-bit hash), not by its doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, batch_of, bit_words, cut, fresh_name, has_bit, mixed, slices, table

# The masks; 1 is a position that counts.
MASKS = ("110101011", "101110011", "111001101")
SPAN = 9
BITS_PER_SEED, LEAST_BLOOM_BITS, MOST_BLOOM_BITS = 256, 1 << 20, 1 << 28
#: Words around a hit that come along, and the gap that ends a group of hits.
FLANK, GAP = 40, 24
MISS = 1.5
#: A finding has so many equal words, this share of equal words in its stretch, and covers this share of the item or this
#: many words.
LEAST_EQUAL, LEAST_SHARE, LEAST_COVER, LEAST_WORDS = 6, 0.7, 0.5, 13
LEAST_ITEM = 4

_WORD = re.compile(r"[^\W_]+")
_PLACES = np.random.Generator(np.random.PCG64(73)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return [w.encode() for w in _WORD.findall((text or "").lower())]


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every place where it fits."""
    n = len(words) - len(mask) + 1
    out = np.full(max(n, 0), len(mask) * 1_000_003 + int(mask, 2), np.uint64)
    for i, c in enumerate(mask):
        if c == "1" and n > 0:
            out += words[i : i + n] * _PLACES[i]
    return mixed(out)


def _bits(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64(n_bits - 1), (hashes >> np.uint64(32)) & np.uint64(n_bits - 1)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("hash", pa.int64()), ("item_id", pa.int64()), ("place", pa.int32()), ("span", pa.int32())])
    hashes = WordHashes()
    for batch in slices(batches):
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = hashes.of(words_of(text))
            if len(words) < LEAST_ITEM:
                continue
            for mask in MASKS if len(words) >= SPAN else ("1" * len(words),):
                got = seeds(words, mask)
                rows += [(h, item, i, len(mask)) for i, h in enumerate(got.view(np.int64).tolist())]
        yield batch_of(rows, schema)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("item_id", pa.int64()), ("item", pa.list_(pa.int64()))])
    hashes = WordHashes()
    for batch in slices(batches):
        yield batch_of([(i, hashes.of(words_of(t)).view(np.int64)) for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True)], schema)


def _islands(bloom: np.ndarray, spans: list[int]):
    """Per document, groups of places whose seeds pass the filter: where the words begin, the words (hashes) from FLANK
    before the first to FLANK behind the last, and the seeds with their places."""
    masks = [*MASKS, *("1" * s for s in spans if s < SPAN)]
    schema = pa.schema([("doc_id", pa.int64()), ("began", pa.int32()), ("words", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))])

    def islands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            rows = []
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            every = hashes.of([w for t in texts for w in t])
            places, found = [], []
            for mask in masks:  # over the whole slice at once; places that reach into the next document go below
                got = seeds(every, mask)
                low, high = _bits(got, 64 * len(bloom))
                at = np.flatnonzero(has_bit(bloom, low))
                at = at[has_bit(bloom, high[at])]
                at = at[np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + len(mask) - 1, "right")]
                places.append(at)
                found.append(got[at].view(np.int64))
            at, got = np.concatenate(places), np.concatenate(found)
            order = np.argsort(at, kind="stable")
            at, got = at[order], got[order]
            which = np.searchsorted(ends, at, "right")
            new = np.flatnonzero(np.r_[True, (np.diff(which) != 0) | (np.diff(at) > GAP)]) if len(at) else []
            for lo, hi in zip(new, [*new[1:], len(at)], strict=True) if len(at) else ():
                d = int(which[lo])
                first, last = int(ends[d]) - len(texts[d]), int(ends[d])
                a, b = max(first, int(at[lo]) - FLANK), min(last, int(at[hi - 1]) + SPAN + FLANK)
                rows.append((batch.column("doc_id")[d].as_py(), a - first, every[a:b].view(np.int64), (at[lo:hi] - a).astype(np.int32), got[lo:hi]))
            yield batch_of(rows, schema)

    return islands


def best_stretch(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """On one diagonal (doc place less item place): start and end of the best stretch in the item, and its equal words."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi <= lo:
        return 0, 0, 0
    same = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -MISS))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return lo + start, lo + end, int(same[start:end].sum())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("n_equal", pa.int32()), ("item_words", pa.int32())])
    for batch in slices(batches):
        rows = []
        words, items = batch.column("words"), batch.column("item")
        for i, (doc_id, item_id, began, diagonal) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "began", "diagonal")), strict=True)):
            item = items[i].values.to_numpy()
            start, end, equal = best_stretch(words[i].values.to_numpy(), item, diagonal)
            n = end - start
            if equal >= min(LEAST_EQUAL, len(item)) and equal >= LEAST_SHARE * n and (n >= LEAST_COVER * len(item) or n >= LEAST_WORDS):
                rows.append((doc_id, item_id, began + diagonal + start, n, equal, len(item)))
        yield batch_of(rows, schema)


def findings(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, the best stretch's first word in the document
    (from 0) and words, how many equal the item's, and the item's words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    test = cut(items.mapInArrow(_item_seeds, "hash long, item_id long, place int, span int"))
    n_bits = max(LEAST_BLOOM_BITS, min(MOST_BLOOM_BITS, 1 << (BITS_PER_SEED * test.count()).bit_length()))
    bloom = bit_words(test, [F.col("hash").bitwiseAND(F.lit(n_bits - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(n_bits - 1))], n_bits)
    spans = sorted(r.span for r in test.filter(F.col("span") < SPAN).select("span").distinct().collect())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = cut(rows.mapInArrow(_islands(bloom, spans), "doc_id long, began int, words array<long>, places array<int>, hashes array<long>"))
    # a text that many documents share gives equal islands: each distinct one is joined and verified once
    key = F.xxhash64("words")
    named = made.select("doc_id", "began", key.alias("island"))
    distinct = made.groupBy(key.alias("island"), F.xxhash64(F.reverse("words")).alias("check")).agg(F.first("words").alias("words"), F.first("places").alias("places"), F.first("hashes").alias("hashes"))
    distinct = cut(distinct.drop("check"))
    hits = distinct.select("island", F.explode(F.arrays_zip("places", "hashes")).alias("s")).select("island", F.col("s.hashes").alias("hash"), F.col("s.places").alias("at"))
    diagonals = hits.join(test.select("hash", "item_id", "place"), "hash").select("island", "item_id", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    words = items.mapInArrow(_item_words, "item_id long, item array<long>")
    pairs = diagonals.join(distinct.select("island", "words"), "island").join(words, "item_id")
    found = pairs.select(F.col("island").alias("doc_id"), "item_id", F.lit(0).alias("began"), "diagonal", "words", "item").mapInArrow(_verified, "doc_id long, item_id long, first_word int, n_words int, n_equal int, item_words int")
    best = found.groupBy(F.col("doc_id").alias("island"), "item_id").agg(F.max(F.struct("n_equal", F.negative("n_words").alias("w"), F.negative("first_word").alias("f"), "item_words")).alias("b"))
    out = named.join(best, "island").groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("b.n_equal").alias("n_equal"), F.col("b.w").alias("w"), (F.col("b.f") - F.col("began")).alias("f"), F.col("b.item_words").alias("item_words"))).alias("b"))
    return out.select("doc_id", "item_id", F.negative("b.f").alias("first_word"), F.negative("b.w").alias("n_words"), "b.n_equal", "b.item_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in whose text no item is found, all columns as they are."""
    h = fresh_name(docs, "h")
    keyed = docs.withColumn(h, F.xxhash64("text"))
    bad = findings(keyed.select(F.col(h).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(h)).distinct()
    return keyed.join(bad, h, "left_anti").select(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
