"""SentencePiece encoding with seeded merge-dropout, and decoding.

The pieces and scores come from a public merge-type (BPE) model, whose path is a parameter. Symbols start as characters; an
agenda holds each neighbouring pair whose join is a piece, the best score first (leftmost on ties). A candidate taken from
the agenda is skipped for good when a keyed hash of (seed, document, number of the chunk in the text, both symbols, place in
the chunk) falls under the dropout; else the two symbols join. So each occurrence of a word has a segmentation of its own,
which any process repeats exactly. Dropout 0 gives the library's own segmentation.

A task keeps what it has seen of a chunk's agenda as a tree: a node is a candidate, with one branch for joining and one for
skipping, and a leaf holds the piece ids. All chunks of a batch walk their trees together; a chunk whose tree doesn't reach
on is segmented for itself, and a branch missed often is added. The tree only saves work: what it gives equals segment().

Chunks are runs of spaces with the word after them, and line breaks. No piece of such a model crosses their borders
(this is checked when it is loaded; else the whole text is one chunk). Characters without a piece become byte pieces, and
so does a literal U+2581, which stands for a space in pieces; so decoding gives back every text.

Defined results: a null or empty text has no tokens and decodes to an empty text; repeated rows give equal rows; rows with
a null doc_id are kept and use 0 as key; texts are taken whole, whatever their length, and each of their chunks without
spaces is segmented as a whole; an empty table gives no rows; extra columns, of any name, are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FLUSH_SIZE, batch_of, mixed, slices, table

MODEL = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")
SEED, DROPOUT = 17, 0.1
#: Nodes of the trees that a task keeps, names of chunks it has seen, and sightings or misses after which a tree or a branch is
#: worth its making.
NODES, NAMES, OFTEN = 1 << 20, 400_000, 20
SPACE = "▁"
#: Chunks up to so many characters are segmented together.
WIDEST = 40
NONE = 1 << 40
#: Instead of a node: a branch that isn't known; a new chunk, one less for each sighting; leaf i is FIRST_LEAF - i.
UNKNOWN, NEW, FIRST_LEAF = -1, -2, -1000

_CHUNK = re.compile(r" *[^ \n]+|\n| +")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("token_ids", pa.list_(pa.int32())), ("decoded_crc32", pa.int64())])


def _candidate(left, right, place):
    """A number of a candidate merge: integers, or arrays of uint64."""
    x = left * 0x9E3779B97F4A7C15 + right * 0xC2B2AE3D27D4EB4F + place * 0x165667B19E3779F9
    return x & 0xFFFFFFFFFFFFFFFF if isinstance(x, int) else x


def chunk_keys(seed: int, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys of the chunks of documents (uint64), by their numbers in the texts."""
    return mixed(mixed(docs * np.uint64(0x27D4EB2F165667C5) + np.uint64(seed)) + places.astype(np.uint64) * np.uint64(0x85EBCA77C2B2AE63))


class Pieces:
    """A model's pieces, and the segmentation of texts."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], seed: int, dropout: float) -> None:
        self.pieces, self.byte_ids, self.seed, self.dropout = pieces, byte_ids, seed, dropout
        self.cutoff = min(int(dropout * (1 << 64)), (1 << 64) - 1)
        self.raw = {i: p.replace(SPACE, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        crossing = any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces)
        self.chunks = (lambda text: [text]) if crossing else _CHUNK.findall
        self._forget()
        by_score = sorted(pieces.items(), key=lambda x: (-x[1][1], x[1][0]))
        self.id_of_rank = np.array([i for _, (i, _) in by_score], np.int64)
        self.rank = {i: r for r, (_, (i, _)) in enumerate(by_score)}
        self.stride = 1 + max(self.rank)
        pairs = sorted((pieces[p[:k]][0] * self.stride + pieces[p[k:]][0], self.rank[i]) for p, (i, _) in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces)
        self.pair_keys = np.array([-1, *(k for k, _ in pairs)], np.int64)
        self.pair_ranks = np.array([NONE, *(r for _, r in pairs)], np.int64)
        # a slot tells the pair whose key falls there; pairs that share a slot are sought among all
        self.slot_shift = np.uint64(64 - max(4, (8 * len(self.pair_keys)).bit_length()))
        slot = self._slot(self.pair_keys)
        n_slots = 1 << (64 - int(self.slot_shift))
        self.slot_keys, self.slot_ranks = np.full(n_slots, -1, np.int64), np.full(n_slots, NONE, np.int64)
        self.slot_keys[slot], self.slot_ranks[slot] = self.pair_keys, self.pair_ranks
        self.slot_shared = np.bincount(slot, minlength=n_slots) > 1
        self.of_char = np.full(65536, -1, np.int64)
        for p, (i, _) in pieces.items():
            if len(p) == 1 and ord(p) < 65536 and p != SPACE:
                self.of_char[ord(p)] = i
        if SPACE in pieces:
            self.of_char[ord(" ")] = pieces[SPACE][0]

    @classmethod
    def load(cls, path: str = MODEL, seed: int = SEED, dropout: float = DROPOUT) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = {model.id_to_piece(i): (i, model.get_score(i)) for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        return cls(plain, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], seed, dropout)

    def _forget(self) -> None:
        """Drop all trees."""
        self.roots: dict[str, int] = {}
        self.words: dict[int, str] = {}  # of the root nodes
        self.n_nodes, self.n_ids = 0, 0
        self.candidate, self.join, self.skip, self.parent, self.missed = (np.full(1024, UNKNOWN, np.int64) for _ in range(5))
        self.leaf_at, self.leaf_n, self.n_leaves = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.ids = np.zeros(8192, np.int32)

    def skipped(self, key: int, left: int, right: int, place: int) -> bool:
        """Whether a candidate merge is skipped: a keyed hash of what it joins, and where, against the dropout."""
        return bool(self.cutoff) and int(mixed(np.array([key ^ _candidate(left, right, place)], np.uint64))[0]) < self.cutoff

    def segment(self, chunk: str, key: int) -> list[int]:
        """Piece ids of one chunk (spaces as they are)."""
        return self._run(chunk, lambda left, right, place: self.skipped(key, left, right, place))

    def _run(self, chunk: str, skip: Callable[[int, int, int], bool]) -> list[int]:
        symbols = [SPACE if c == " " else None if c == SPACE else c for c in chunk]  # None: a literal U+2581
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, str, str]] = []

        def propose(i: int) -> None:
            j = after[i]
            if j < 0 or symbols[i] is None or symbols[j] is None:
                return
            got = self.pieces.get(symbols[i] + symbols[j])
            if got is not None:
                heapq.heappush(agenda, (self.rank[got[0]], i, symbols[i], symbols[j]))

        for i in range(n - 1):
            propose(i)
        gone = [False] * n
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if gone[i] or j < 0 or symbols[i] != left or symbols[j] != right or skip(self.pieces[left][0], self.pieces[right][0], i):
                continue
            symbols[i] = left + right
            gone[j] = True
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            if before[i] >= 0:
                propose(before[i])
            propose(i)
        out: list[int] = []
        i = 0
        while i >= 0:
            got = self.pieces.get(symbols[i]) if symbols[i] is not None else None
            if got is not None:
                out.append(got[0])
            else:
                out += [self.byte_ids[b] for b in (symbols[i] or SPACE).encode()]
            i = after[i]
        return out

    def segment_many(self, chunks: list[str], keys: np.ndarray) -> list[list[int]]:
        """segment() for many chunks at once: one row of symbols a chunk, and each round takes the best candidate of every row
        off its agenda. Rows with characters that have no piece, and long ones, go through segment()."""
        return [np.frombuffer(b, np.int32).tolist() for b in self._packed_many(chunks, keys)]

    def _packed_many(self, chunks: list[str], keys: np.ndarray) -> list[bytes]:
        """segment_many() as bytes of 32-bit ids, which cost the interpreter's garbage collector nothing."""
        out: list[bytes | None] = [None] * len(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] <= WIDEST]
        for lo in range(0, len(order), 8192):
            self._segment_rows(chunks, order[lo : lo + 8192], lengths, keys, out)
        return [np.array(self.segment(c, int(k)), np.int32).tobytes() if o is None else o for c, k, o in zip(chunks, keys, out, strict=True)]

    def _segment_rows(self, chunks: list[str], rows: np.ndarray, lengths: np.ndarray, keys: np.ndarray, out: list) -> None:
        """Symbols are linked lists inside flat arrays: a join writes its first symbol and unlinks its second, so no row is
        moved. Each row ends with a symbol -1, which joins with nothing."""
        width = int(lengths[rows[-1]])
        text = "".join([chunks[i].ljust(width, "\0") for i in rows.tolist()])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(rows), width)
        ids = np.where(points < 65536, self.of_char[np.minimum(points, 65535)], -1)
        known = ((ids >= 0) | (np.arange(width) >= lengths[rows][:, None])).all(axis=1)
        rows, ids = rows[known], ids[known]
        if not len(rows):
            return
        rank = np.full((len(rows), width + 1), NONE, np.int64)
        rank[:, :-2] = self._rank_of(ids[:, :-1], ids[:, 1:])
        ids = np.concatenate([ids, np.full((len(rows), 1), -1)], axis=1).ravel()
        after, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        before[:: width + 1] = -1
        base, key = np.arange(len(rows)) * (width + 1), keys[rows]  # of the rows that still have candidates
        own = base
        while True:
            j = rank.argmin(axis=1)
            flat = rank.ravel()
            best = flat[own + j]
            going = np.flatnonzero(best != NONE)
            if not len(going):
                break
            if len(going) < 0.7 * len(rank):
                rank, base, key, j, best = rank[going], base[going], key[going], j[going], best[going]
                flat, own = rank.ravel(), np.arange(len(rank)) * (width + 1)
                at, shift = own + j, base - own
            else:
                j, best, at, shift = j[going], best[going], (own + j)[going], (base - own)[going]
            first = at + shift
            second = after[first]
            if self.cutoff:
                with np.errstate(over="ignore"):
                    names = _candidate(ids[first].astype(np.uint64), ids[second].astype(np.uint64), j.astype(np.uint64))
                skip = mixed((key if len(key) == len(j) else key[going]) ^ names) < np.uint64(self.cutoff)
                flat[at[skip]] = NONE
                best, at, shift, first, second = (x[~skip] for x in (best, at, shift, first, second))
            joined = self.id_of_rank[best]
            ids[first], ids[second] = joined, -1
            flat[second - shift] = NONE
            third = after[second]
            after[first], before[third] = third, first
            flat[at] = self._rank_of(joined, ids[third])
            some = before[first] >= 0
            left = before[first][some]
            flat[left - shift[some]] = self._rank_of(ids[left], joined[some])
        ids = ids.reshape(len(rows), width + 1)
        ends = (4 * np.cumsum((ids >= 0).sum(axis=1))).tolist()
        every, lo = ids[ids >= 0].astype(np.int32).tobytes(), 0
        for i, hi in zip(rows.tolist(), ends, strict=True):
            out[i] = every[lo:hi]
            lo = hi

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that two neighbours make; NONE if they make none."""
        want = left * self.stride + right
        slot = self._slot(want)
        out = np.where((self.slot_keys[slot] == want) & (left >= 0) & (right >= 0), self.slot_ranks[slot], NONE)
        shared = np.nonzero(self.slot_shared[slot])
        if len(shared[0]):
            left, right, want = left[shared], right[shared], want[shared]
            at = np.minimum(np.searchsorted(self.pair_keys, want), len(self.pair_keys) - 1)
            out[shared] = np.where((self.pair_keys[at] == want) & (left >= 0) & (right >= 0), self.pair_ranks[at], NONE)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.slot_shift).view(np.int64)

    def _grown(self, x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.full(max(n, 2 * len(x)) - len(x), UNKNOWN, x.dtype)])

    def _add(self, word: str, decided: list[bool], parent: int) -> int:
        """Add what follows behind some decisions (skip or not) on a word's candidates, if no other one is skipped; the first
        node or leaf of it."""
        met: list[int] = []

        def skip(left: int, right: int, place: int) -> bool:
            met.append(_candidate(left, right, place))
            return len(met) <= len(decided) and decided[len(met) - 1]

        found = self._run(word, skip)
        new = met[len(decided) :]
        n, i = len(found), self.n_leaves
        self.ids, self.leaf_at, self.leaf_n = self._grown(self.ids, self.n_ids + n), self._grown(self.leaf_at, i + 1), self._grown(self.leaf_n, i + 1)
        self.ids[self.n_ids : self.n_ids + n], self.leaf_at[i], self.leaf_n[i] = found, self.n_ids, n
        self.n_ids, self.n_leaves = self.n_ids + n, i + 1
        first, last = self.n_nodes, self.n_nodes + len(new)
        for name in ("candidate", "join", "skip", "parent", "missed"):
            setattr(self, name, self._grown(getattr(self, name), last))
        self.candidate[first:last] = np.array(new, np.uint64).view(np.int64)
        self.join[first:last] = [*range(first + 1, last), FIRST_LEAF - i][: len(new)]
        self.skip[first:last], self.missed[first:last] = UNKNOWN, 0
        self.parent[first:last] = [parent, *range(first, last - 1)][: len(new)]
        self.n_nodes = last
        return first if new else FIRST_LEAF - i

    def _add_skip(self, node: int) -> None:
        """Add the branch of a node on which its candidate is skipped."""
        decided, at = [True], node
        while self.parent[at] != UNKNOWN:
            above = int(self.parent[at])
            decided.append(self.join[above] != at)
            at = above
        self.skip[node] = self._add(self.words[at], decided[::-1], node)

    def _walk(self, chunks: list[str], keys: np.ndarray) -> np.ndarray:
        """The leaf of every chunk that its tree leads to; UNKNOWN for others."""
        got = np.fromiter(map(self.roots.get, chunks, repeat(NEW)), np.int64, len(chunks))
        for i in np.flatnonzero((got <= NEW) & (got > FIRST_LEAF)).tolist():
            c = chunks[i]
            if len(c) > WIDEST:
                continue
            state = self.roots.get(c, NEW)
            if NEW - OFTEN < state <= NEW:
                self.roots[c] = state - 1
            elif FIRST_LEAF < state <= NEW:
                self.roots[c] = root = self._add(c, [], UNKNOWN)
                if root >= 0:
                    self.words[root] = c
        leaf = np.where(got <= FIRST_LEAF, FIRST_LEAF - got, UNKNOWN)
        at = np.flatnonzero(got >= 0)
        node, key = got[at], keys[at]
        while len(at):
            skip = mixed(key ^ self.candidate[node].view(np.uint64)) < np.uint64(self.cutoff)
            after = np.where(skip, self.skip[node], self.join[node])
            done = after <= FIRST_LEAF
            leaf[at[done]] = FIRST_LEAF - after[done]
            lost = node[after == UNKNOWN]
            if len(lost):
                np.add.at(self.missed, lost, 1)
                for n in set(lost[self.missed[lost] >= OFTEN].tolist()):
                    self._add_skip(n)
            going = after >= 0
            at, node, key = at[going], after[going], key[going]
        return leaf

    def encode_many(self, texts: list[str], docs: list[int]) -> list[np.ndarray]:
        """Ids (int32) of each text, whose document's number is part of the hash."""
        if self.n_nodes > NODES or len(self.roots) > NAMES:
            self._forget()
        lists = [self.chunks(" " + text) if text else [] for text in texts]
        sizes = np.array([len(x) for x in lists])
        chunks = [c for x in lists for c in x]
        ends = np.cumsum(sizes)
        numbers = np.array([d & 0xFFFFFFFFFFFFFFFF for d in docs], np.uint64)
        keys = chunk_keys(self.seed, np.repeat(numbers, sizes), np.arange(len(chunks)) - np.repeat(ends - sizes, sizes))
        leaf = self._walk(chunks, keys)
        rest = np.flatnonzero(leaf == UNKNOWN)
        packed = self._packed_many([chunks[i] for i in rest.tolist()], keys[rest])
        n = np.where(leaf == UNKNOWN, 0, self.leaf_n[leaf])
        n[rest] = [len(b) // 4 for b in packed]
        begin = np.cumsum(n) - n
        every = np.empty(int(n.sum()), np.int32)
        known = np.flatnonzero(leaf != UNKNOWN)
        for which, source, start in ((known, self.ids, self.leaf_at[leaf[known]]), (rest, np.frombuffer(b"".join(packed), np.int32), np.cumsum(n[rest]) - n[rest])):
            m = n[which]
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            every[np.repeat(begin[which], m) + step] = source[np.repeat(start, m) + step]
        stops = np.concatenate([begin, [len(every)]])[ends]
        return np.split(every, stops[:-1]) if len(texts) else []

    def encode(self, text: str, key: int) -> list[int]:
        return self.encode_many([text], [key])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode()[1:]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in slices(batches, 320):
            docs = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, text, ids in zip(docs, texts, self.encode_many(texts, [d or 0 for d in docs]), strict=True):
                back = self.decode(ids.tolist())
                if back != text:
                    raise ValueError(f"document {doc_id} doesn't decode to its text")
                rows.append((doc_id, len(ids), ids, zlib.crc32(back.encode())))
                size += 4 * len(ids)
            if size > FLUSH_SIZE:
                yield batch_of(rows, _SCHEMA)
                rows, size = [], 0
        if rows:
            yield batch_of(rows, _SCHEMA)


def encode(docs: DataFrame, path: str = MODEL, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """One row per document: doc_id, n_tokens, token_ids, and the crc32 of the text decoded from them. The model (a fixed
    vocabulary) goes to the tasks with the function, so executors need not have the file."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(Pieces.load(path, seed, dropout), "doc_id long, n_tokens int, token_ids array<int>, decoded_crc32 long")


class _Decode:
    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        for batch in slices(batches, 128):
            yield batch_of([(d, self.pieces.decode(ids) if ids else "") for d, ids in zip(batch.column("doc_id").to_pylist(), batch.column("token_ids").to_pylist(), strict=True)], schema)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and token_ids; no or null ids give an empty text."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(_Decode(Pieces.load(path)), "doc_id long, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
