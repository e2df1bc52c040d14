"""Toxicity by a weighted lexicon.

Texts are folded: lower case, characters that look like Latin letters become those, digits and signs that stand for
letters become letters where a letter follows, invisible characters go, and words are joined by one space. An
Aho-Corasick automaton then finds all lexicon entries in one walk over the whole text. Entries are word beginnings
(`` idio``) or whole words (`` idiot ``); in each word the heaviest entry counts. Entries inside an exception phrase don't
count. The weights are summed over distinct hits and over all hits, the latter per length, and a logistic function of both
gives the score.

The entries, their weights and the logistic function (not the exceptions, a fixed list) come from labelled documents: at most
SAMPLE_ROWS of them, the first in the order of a hash of doc_id (documents' crc32 decides which labels may be used). Copies
count once: a document's family are those with equal folded words in equal order. An entry's weight is its log odds between toxic
and other families. The lexicon has at most LEXICON_ROWS entries.

Defined results: null and empty texts have no hits and get the score of a text without hits; repeated rows give equal rows;
null doc_ids are kept (held_out null counts as false); with no usable labels the lexicon is empty and all scores are 0;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, slices, table

#: Bounds of what is learned from: labelled documents, and lexicon entries.
SAMPLE_ROWS, LEXICON_ROWS = 12_000, 4_000
#: An entry needs so many toxic families, and this log odds at least.
LEAST_FAMILIES, LEAST_ODDS = 4, 2.5
#: Lengths of word beginnings.
STEMS = range(3, 9)
FLAGGED = 0.3

# Characters drawn like Latin letters, and digits and signs written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i",
    "ǀ": "l", "ꜱ": "s", "ʀ": "r", "ʏ": "y",
}
WRITTEN_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "taking out the trash", "clown fish", "circus clown",
    "clown car", "pond scum", "soap scum", "scum line", "idiot proof", "idiot light", "sore loser", "loser bracket",
    "garden path", "dumb bell", "stupid simple", "not stupid", "not an idiot", "not worthless", "not pathetic",
)

_INVISIBLE = "­​‌‍⁠﻿"
_TABLE = str.maketrans(LOOKALIKES | {c: None for c in _INVISIBLE})
_SIGNS = re.compile("[" + "".join(re.escape(c) for c in WRITTEN_FOR) + r"]+(?=[^\W\d_])")
_SIGN_TABLE = str.maketrans(WRITTEN_FOR)
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = text.lower().translate(_TABLE)
    else:
        text = text.lower()
    return _WORD.findall(_SIGNS.sub(lambda m: m[0].translate(_SIGN_TABLE), text))


def entries_of(words: set[str]) -> set[str]:
    """What the words of a text could be found by."""
    out = {f" {w} " for w in words}
    for w in words:
        out.update(f" {w[:k]}" for k in STEMS if k < len(w))
    return out


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("family", pa.string()), ("toxic", pa.int32()), ("text", pa.string())])
    for batch in slices(batches):
        rows = []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = fold(text or "")
            if words:
                rows.append((xxhash.xxh3_128_hexdigest(" ".join(words)), toxic, text))
        yield batch_of(rows, schema)


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries counted over a batch's documents, toxic and other."""
    schema = pa.schema([("entry", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])
    for batch in slices(batches, 256):
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for e in entries_of(set(fold(text))):
                counts.setdefault(e, [0, 0])[1 - toxic] += 1
        yield batch_of([(e, *c) for e, c in counts.items()], schema)


class Lexicon:
    """Finds entries in texts and scores them."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], model: list[float] | None = None) -> None:
        self.weights, self.exceptions, self.model, self.automaton = weights, exceptions, model, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def _built(self):
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
            for entry, weight in self.weights.items():
                self.automaton.add_word(entry, (len(entry), weight))
            if len(self.automaton):
                self.automaton.make_automaton()
        return self.automaton

    def measure(self, text: str | None) -> tuple[float, float, int, int]:
        """Weight of distinct hits, weight of all hits, number of hits, number of words."""
        words = fold(text or "")
        found: dict[int, tuple[float, int]] = {}
        held: list[tuple[int, int]] = []
        if words and len(self._built()):
            folded = f" {' '.join(words)} "
            for end, (n, weight) in self._built().iter(folded):
                start = end - n + 1
                if weight is None:
                    held.append((start, end))
                elif start not in found or found[start][0] < weight:
                    found[start] = (weight, n)
            if held:
                found = {s: x for s, x in found.items() if not any(a <= s and s + x[1] - 1 <= b for a, b in held)}
            kinds = {folded[s : s + n]: weight for s, (weight, n) in found.items()}
            return sum(kinds.values()), sum(w for w, _ in found.values()), len(found), len(words)
        return 0.0, 0.0, 0, len(words)

    @staticmethod
    def inputs(distinct: float, total: float, n_words: int) -> list[float]:
        return [1.0, math.log1p(distinct), math.log1p(100.0 * total / max(20, n_words)), distinct / 10.0]

    def score(self, measured: tuple[float, float, int, int]) -> float:
        if self.model is None:
            return 0.0
        z = sum(a * b for a, b in zip(self.model, self.inputs(measured[0], measured[1], measured[3]), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def fit(self, rows: list[tuple[list[float], int]]) -> None:
        """The logistic function, by Newton steps with a small penalty."""
        x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + 0.5 * w
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), grad)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        self.model = w.tolist()

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_hits", pa.int64()), ("n_words", pa.int64())])
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                m = self.measure(text)
                rows.append((doc_id, self.score(m), m[2], m[3]))
            yield batch_of(rows, schema)

    def measures(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32())])
        for batch in slices(batches):
            rows = [(self.inputs(m[0], m[1], m[3]), y) for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True) for m in [self.measure(t)]]
            yield batch_of(rows, schema)

    def keep(self, limit: float):
        """A function for mapInArrow that passes the rows whose text scores under the limit, all columns as they are."""

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield batch.filter(pa.array([self.score(self.measure(t)) < limit for t in batch.column("text").to_pylist()], pa.bool_()))

        return passed


def held_out(doc_id: str = "doc_id"):
    """Whether a document's label must not be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from the labels that may be used. What comes to the driver: LEXICON_ROWS entries, and three numbers for
    each of at most SAMPLE_ROWS documents."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id")
    from .common import cut, drop_cut

    families = cut(texts.select("text", "toxic").mapInArrow(_families, "family string, toxic int, text string").groupBy("family", "toxic").agg(F.min("text").alias("text")))
    n = dict(families.groupBy("toxic").count().collect())
    if not n.get(0) or not n.get(1):
        drop_cut(families)
        return Lexicon({}, list(EXCEPTIONS))
    counts = families.select("text", "toxic").repartition("text").mapInArrow(_entry_rows, "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("other") + 0.5) / (n[0] + 1.0))
    heavy = counts.filter(F.col("toxic") >= LEAST_FAMILIES).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    weights = {r.entry: r.odds for r in heavy.orderBy(F.desc("odds"), F.desc("toxic"), "entry").limit(LEXICON_ROWS).select("entry", "odds").collect()}
    out = Lexicon(weights, list(EXCEPTIONS))
    out.fit([(list(r.x), r.y) for r in families.select("text", "toxic").repartition("text").mapInArrow(out.measures, "x array<double>, y int").collect()])
    drop_cut(families)
    return out


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, n_hits and n_words of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lexicon.scores, "doc_id long, score double, n_hits long, n_words long")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, limit: float) -> DataFrame:
    """The documents whose score is under the limit, with all their columns."""
    return docs.mapInArrow(lexicon.keep(limit), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= FLAGGED).cast("int").alias("predicted"), "n_hits", "n_words")
