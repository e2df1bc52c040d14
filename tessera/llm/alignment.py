"""Cross-tokenizer alignment: where the tokens of two tokenizers meet, and which of them go together over all texts.

A task takes texts block by block. Texts fall into passages before a single space between two characters that aren't white
space; neither tokenizer has a token across such a place (the pre-tokenizer of the first begins anew there, and the model of
the second is looked through for pieces across it), so the tokens of a text are those of its passages, and a passage seen
before in a block isn't encoded again. DuckDB holds a block's tokens as interval tables of byte offsets: ASOF joins give for
each token the token of the other side that holds its first byte, which together are all overlaps; a window sum over the
common ends numbers the groups.

Spark sums the blocks' counts of linked id pairs, finds the highest count of each id of the second tokenizer, and brings
the sums of a block's own pairs back to the block, whose texts then add them up. A block has BLOCK_CHARS characters at most
(or one text), so what meets in one task is bounded, and a pair crosses the network once a block, not once a text.

Defined results: a null or empty text, or one whose joined tokens of either side aren't the bytes of space+text, has no
tokens: zeros and an empty groups_sha256; strings of special tokens inside texts are plain text; repeated rows count as often
as they stand there; null doc_ids are kept; texts are taken whole, whatever their length; ids of the second tokenizer without links
have no highest count; ties of the highest all count; an empty table gives no rows; extra columns, of any name, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table

FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_MODEL, PIECE_MODEL = os.path.join(FOLDER, "byte_bpe_50k.json"), os.path.join(FOLDER, "piece_bpe_32k.model")
#: Characters of a block, and passages that are encoded and aligned at a time.
BLOCK_CHARS, PASSAGES = 8_000_000, 32_768
#: Passages that a task keeps for its next block.
MOST_PASSAGES = 400_000
#: An id pair as one number: the first tokenizer's id times this, plus the second's.
PAIR = 1 << 32
#: Pairs, or passages' links, in one row.
ROW_ITEMS = 100_000

#: A block's rows, by kind: texts; pairs (of the block, with their number of links); passages' links (numbers of pairs).
_SCHEMA = pa.schema([
    ("block", pa.int64()), ("kind", pa.string()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
    ("first", pa.int64()), ("items", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])
_DDL = "block long, kind string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, first long, items array<int>, pairs array<long>, counts array<long>"
_RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])
_RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

_PASSAGE, _ODD_SPACE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"^ |\s |\s\Z| \s")


def _byte_of() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_model: str, piece_model: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_model)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        of = _byte_of()
        entries = self.first.get_vocab()
        by_id = {i: e for e, i in entries.items()}
        self.first_bytes = [bytes(of[c] for c in e) if all(c in of for c in e) else e.encode() for e in (by_id.get(i, "") for i in range(max(by_id) + 1))]
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.first_lengths, self.second_lengths = (np.array([len(of[i]) for i in range(len(of))], np.int64) for of in (self.first_bytes, self.second_bytes))
        #: An id with the separator after it, at 4 * id + 0 (of passages), 1 (of groups), 2 (of sides), 3 (of ids).
        self.words = [f"{i}{sign}" for i in range(max(len(self.first_bytes), len(self.second_bytes))) for sign in ("\n", ";", "|", ",")]
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)

    def passages(self, text: str) -> list[str]:
        """The passages of a text, without the space before each."""
        if not self.splits:
            return [text]
        return _PASSAGE.split(text) if _ODD_SPACE.search(text) else text.split(" ")

    def encode(self, passages: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Token ids of both tokenizers for passages, each after a space."""
        first = self.first.encode_batch_fast([f" {p}" for p in passages], add_special_tokens=False)
        return [e.ids for e in first], self.second.encode(passages, num_threads=1)


@functools.cache
def tokenizers(byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> Tokenizers:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizers(byte_model, piece_model)


def intervals(ids: list[list[int]], lengths: np.ndarray) -> pa.Table:
    """Token table: passage (its number), id, and its bytes' first and end, counted on through all passages."""
    passage = np.repeat(np.arange(len(ids)), np.fromiter(map(len, ids), np.int64, len(ids)))
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, len(passage))
    ends = np.cumsum(lengths[flat])
    return pa.table({"passage": passage, "id": flat, "s": ends - lengths[flat], "e": ends})


#: All overlaps: the second side's token that holds the first byte of each first side's one, and the other way round.
LINKS = """
select a.passage, a.id as a, b.id as b from a asof join b on a.s >= b.s
union all
select b.passage, a.id as a, b.id as b from b asof join a on b.s >= a.s where b.s > a.s
"""
#: Tokens of both sides with their group: the common ends before.
GROUPS = """
with ends as (select a.e from a semi join b on a.e = b.e),
a_in as (select passage, 0 as side, id, s, cast(coalesce(sum(cast(ends.e is not null as int)) over (order by s rows between unbounded preceding and 1 preceding), 0) as bigint) as g from a left join ends on a.e = ends.e),
b_in as (select passage, 1 as side, id, s, cast(coalesce(sum(cast(ends.e is not null as int)) over (order by s rows between unbounded preceding and 1 preceding), 0) as bigint) as g from b left join ends on b.e = ends.e)
select passage, side, id, g from (select * from a_in union all select * from b_in) order by g, side, s
"""


def database() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "350MB", "temp_directory": os.environ.get("TMPDIR", "/tmp")})


def group_texts(groups: pa.Table, n: int, words: list[str]) -> tuple[list[str], np.ndarray]:
    """Per passage (0 to n - 1), its groups as text `a1,a2|b1;a3|b2,b3`, and their number. groups: of GROUPS; words: of
    Tokenizers."""
    passage, side, ids, g = (groups.column(c).to_numpy() for c in ("passage", "side", "id", "g"))
    out = [""] * n
    if not len(ids):
        return out, np.zeros(n, np.int64)
    other, new = passage[1:] != passage[:-1], g[1:] != g[:-1]
    sign = np.where(other, 0, np.where(new, 1, np.where(side[1:] != side[:-1], 2, 3)))
    texts = "".join(map(words.__getitem__, (4 * ids + np.append(sign, 0)).tolist())).split("\n")
    for p, text in zip(passage[np.append(True, other)].tolist(), texts, strict=False):
        out[p] = text
    return out, np.bincount(passage[np.append(True, new | other)], minlength=n)


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: str) -> int:
        out = self[key] = len(self)
        return out


class Passages:
    """Different passages that a task has seen, and what DuckDB tells of each: n_a, n_b, n_groups, n_links, group text, links."""

    def __init__(self, both: Tokenizers) -> None:
        self.both, self.done = both, 0
        self.place = _Numbers()
        self.good = np.zeros(0, bool)
        #: Rows: n_a, n_b, n_groups, n_links.
        self.sums = np.zeros((4, 0), np.int64)
        self.groups: list[str] = []
        self.links, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's passages, in order."""
        return np.array(list(map(self.place.__getitem__, self.both.passages(text))), np.int32)

    def align(self) -> None:
        """See to the passages that came since the last call. One whose bytes don't come back is not `good`."""
        if self.done == len(self.place):
            return
        new = list(itertools.islice(self.place, self.done, None))
        con = database()
        made = [self._aligned(con, new[lo : lo + PASSAGES]) for lo in range(0, len(new), PASSAGES)]
        con.close()
        good, sums, groups, links = zip(*made, strict=True)
        self.good = np.concatenate([self.good, *good])
        self.sums = np.concatenate([self.sums, *sums], axis=1)
        self.groups += itertools.chain.from_iterable(groups)
        self.links = np.concatenate([self.links, *links])
        self.ends = np.concatenate([[0], np.cumsum(self.sums[3])])
        self.done = len(self.place)

    def _aligned(self, con: duckdb.DuckDBPyConnection, some: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        first, second = self.both.encode(some)
        raws = [f" {p}".encode() for p in some]
        good = np.ones(len(some), bool)
        for ids, of in ((first, self.both.first_bytes), (second, self.both.second_bytes)):
            if b"".join(map(of.__getitem__, itertools.chain.from_iterable(ids))) != b"".join(raws):
                good &= [b"".join([of[i] for i in x]) == raw for x, raw in zip(ids, raws, strict=True)]
        if not good.all():  # the others' tokens go
            first, second = ([x if ok else [] for x, ok in zip(ids, good, strict=True)] for ids in (first, second))
        a, b = intervals(first, self.both.first_lengths), intervals(second, self.both.second_lengths)
        con.register("a", a)
        con.register("b", b)
        texts, n_groups = group_texts(con.sql(GROUPS).to_arrow_table(), len(some), self.both.words)
        links = con.sql(f"select passage, a * {PAIR} + b as pair from ({LINKS}) order by passage").to_arrow_table()
        con.unregister("a")
        con.unregister("b")
        n = [np.bincount(t.column("passage").to_numpy(), minlength=len(some)) for t in (a, b, links)]
        return good, np.stack([n[0], n[1], n_groups, n[2]]), texts, links.column("pair").to_numpy()


class Block:
    """Texts of one block, by the numbers of their passages."""

    def __init__(self, passages: Passages, number: int) -> None:
        self.passages, self.number, self.chars = passages, number, 0
        self.docs: list[tuple[int | None, np.ndarray | None]] = []

    def add(self, doc_id: int | None, text: str | None) -> None:
        self.docs.append((doc_id, self.passages.numbers(text) if text else None))
        self.chars += len(text or "")

    def rows(self) -> Iterator[dict]:
        """The block's rows of _SCHEMA."""
        known = self.passages
        known.align()
        whole = [parts is not None and bool(known.good[parts].all()) for _, parts in self.docs]
        used = np.concatenate([np.zeros(0, np.int32), *(parts for (_, parts), ok in zip(self.docs, whole, strict=True) if ok)])
        # the block's own numbers of passages, and of their pairs
        freq = np.bincount(used, minlength=len(known.place))
        mine = np.flatnonzero(freq)
        number = np.zeros(len(freq), np.int32)
        number[mine] = np.arange(len(mine), dtype=np.int32)
        for (doc_id, parts), ok in zip(self.docs, whole, strict=True):
            if not ok:
                yield {"kind": "text", "doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""}
                continue
            text = ";".join(map(known.groups.__getitem__, parts.tolist()))
            sums = dict(zip(("n_a", "n_b", "n_groups", "n_links"), known.sums[:, parts].sum(axis=1).tolist(), strict=True))
            yield {"kind": "text", "doc_id": doc_id, **sums, "groups_sha256": hashlib.sha256(text.encode()).hexdigest(), "items": number[parts]}
        sizes = known.sums[3][mine]
        ends = np.cumsum(sizes)
        links = known.links[np.repeat(known.ends[mine] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        pairs, links = np.unique(links, return_inverse=True)
        counts = np.bincount(links, weights=np.repeat(freq[mine], sizes), minlength=len(pairs)).astype(np.int64)
        for lo in range(0, len(pairs), ROW_ITEMS):
            yield {"kind": "pairs", "first": lo, "pairs": pairs[lo : lo + ROW_ITEMS], "counts": counts[lo : lo + ROW_ITEMS]}
        # links of passages lo to hi as numbers of pairs, with the links of each
        for lo in range(0, len(mine), ROW_ITEMS):
            part = sizes[lo : lo + ROW_ITEMS]
            yield {"kind": "links", "first": lo, "items": links[ends[lo] - sizes[lo] :][: part.sum()], "counts": part}


def _batch(rows: list[dict], number: int) -> pa.RecordBatch:
    columns = [pa.array([number] * len(rows), pa.int64())] + [pa.array([r.get(f.name) for r in rows], f.type) for f in list(_SCHEMA)[1:]]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _blocks(byte_model: str, piece_model: str, batches: Iterator[pa.RecordBatch], most: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    both, made = tokenizers(byte_model, piece_model), 0
    base = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0

    def out(block: Block) -> Iterator[pa.RecordBatch]:
        rows, items = [], 0
        for row in block.rows():
            rows.append(row)
            items += 1 + len(row.get("items", ()))
            if items > 1_000_000 or len(rows) > 4096:
                yield _batch(rows, block.number)
                rows, items = [], 0
        yield _batch(rows, block.number)

    passages = Passages(both)
    block = Block(passages, base)
    for batch in slices(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            if block.docs and block.chars + len(text or "") > most:
                yield from out(block)
                made += 1
                passages = passages if len(passages.place) <= MOST_PASSAGES else Passages(both)
                block = Block(passages, base + made)
            block.add(doc_id, text)
    yield from out(block)


def blocks(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, most: int = BLOCK_CHARS) -> DataFrame:
    """Texts, id pairs and passages' links of all blocks."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _blocks(byte_model, piece_model, batches, most), _DDL)


def pair_counts(made: DataFrame) -> DataFrame:
    """pair, a, b, count (of links over all texts) and best (whether it is the highest of its b). A b has at most as many pairs
    as the first tokenizer has ids."""
    partial = made.filter("kind = 'pairs'").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    total = partial.groupBy("pair").agg(F.sum("n").alias("count"))
    total = total.select("pair", F.floor(F.col("pair") / PAIR).cast("long").alias("a"), (F.col("pair") % PAIR).alias("b"), "count")
    top = total.groupBy("b").agg(F.max("count").alias("top"))
    return total.join(top, "b").select("pair", "a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def _add_up(made: pa.Table, scored: pa.Table) -> pa.Table:
    """Texts of one block with the sums over their links."""
    kinds = {k: made.filter(pa.compute.equal(made.column("kind"), k)) for k in ("text", "links")}
    order = np.argsort(scored.column("at").to_numpy())
    count, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(order):
        at = scored.column("at").to_numpy()[order]
        count, best = (np.zeros(at[-1] + 1, np.int64) for _ in range(2))
        count[at] = scored.column("count").to_numpy()[order]
        best[at] = scored.column("best").to_numpy(zero_copy_only=False)[order]
    parts = sorted(zip(kinds["links"].column("first").to_pylist(), range(kinds["links"].num_rows), strict=True))
    per_best, per_count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, k in parts:
        items, sizes = (kinds["links"].column(c)[k].values.to_numpy() for c in ("items", "counts"))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for values, to in ((best, per_best), (count, per_count)):
            run = np.concatenate([[0], np.cumsum(values[items])])
            to.append(run[ends[1:]] - run[ends[:-1]])
    per_best, per_count = np.concatenate(per_best), np.concatenate(per_count)
    texts = kinds["text"]
    sums = [(int(per_best[x].sum()), int(per_count[x].sum())) if len(x) else (0, 0) for x in (np.zeros(0, np.int64) if not i.is_valid else i.values.to_numpy() for i in texts.column("items"))]
    columns = [texts.column(c).combine_chunks() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)] + [texts.column("groups_sha256").combine_chunks()]
    return pa.Table.from_arrays(columns, schema=_RESULT)


def align(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, most: int = BLOCK_CHARS) -> DataFrame:
    """Per text its tokens, groups and links, how many links are their b's most frequent, and the sum of their counts."""
    made = cut(blocks(docs, byte_model, piece_model, most), "zstd")
    own = made.filter("kind = 'pairs'").select("block", "first", F.posexplode("pairs").alias("i", "pair"))
    own = own.select(F.col("block").alias("in_block"), (F.col("first") + F.col("i")).alias("at"), "pair")
    scored = own.join(pair_counts(made), "pair").select("in_block", "at", "count", "best")
    return made.filter("kind != 'pairs'").drop("pairs").groupBy("block").cogroup(scored.groupBy("in_block")).applyInArrow(_add_up, _RESULT_DDL)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
