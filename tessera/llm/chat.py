"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only that reply is under
the loss mask. A conversation that doesn't end with an assistant turn gets one more example without a target, so that no
turn is lost. Turns of one conversation stream through one task in order; the task holds the formatted prefix of one
conversation and hands examples on in small batches, so its memory follows the longest conversation alone.

The template is ``<turn ROLE>\\nTEXT</turn>\\n``. Inside a role or text a backslash comes before each ``\\`` and ``<``
(and ``>`` in a role), so control strings inside a text can't be read as control strings and parse() is exact.

Defined results: a null text or role counts as empty; turns with equal numbers are ordered by role, then text (null turn
numbers first); repeated rows are repeated turns; rows with a null conv_id form one conversation; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FLUSH_SIZE, slices, table

EXAMPLES = "conv_id long, example int, n_turns int, formatted string, loss_start int, loss_end int"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_TEXT = re.compile(r"[\\<]")
_ROLE = re.compile(r"[\\<>]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ([^\\<>]*(?:\\.[^\\<>]*)*)>\n([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)


def escape(text: str, what: re.Pattern = _TEXT) -> str:
    return what.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted string; raises if anything is not part of a turn."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int32()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])
    rows: list[tuple] = []
    size = 0
    began, conv, prefix, turns, made, open_tail = False, None, "", 0, 0, False

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in slices(batches):
        for cid, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if not began or cid != conv:
                if open_tail:
                    rows.append((conv, made, turns, prefix, None, None))
                    size += len(prefix)
                began, conv, prefix, turns, made, open_tail = True, cid, "", 0, 0, False
            role = role or ""
            head = f"{prefix}<turn {escape(role, _ROLE)}>\n"
            body = escape(text or "")
            prefix = f"{head}{body}</turn>\n"
            turns += 1
            open_tail = role != "assistant"
            if not open_tail:
                rows.append((conv, made, turns, prefix, len(head), len(head) + len(body)))
                made += 1
                size += len(prefix)
            if size > FLUSH_SIZE:
                yield flush()
                rows, size = [], 0
    if began and open_tail:
        rows.append((conv, made, turns, prefix, None, None))
    if rows:
        yield flush()


def expand(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, its number, its turns, the formatted string, and the loss mask as a span of code
    points (null: nothing is trained). Rows of a conversation stay together and in order within a partition."""
    turns = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return turns.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_examples, EXAMPLES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    began, conv, last, loss, n_loss, chars = False, None, "", hashlib.sha256(), 0, 0

    def close() -> None:
        turns = parse(last)
        digest = hashlib.sha256()
        for role, text in turns:
            digest.update(f"{role}\n{text}\n".encode())
        out.append((conv, len(turns), digest.hexdigest(), n_loss, loss.hexdigest(), chars))

    def flush() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for batch in slices(batches, 64):
        for cid, formatted, start, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
            if not began or cid != conv:
                if began:
                    close()
                began, conv, loss, n_loss, chars = True, cid, hashlib.sha256(), 0, 0
            last = formatted
            chars += len(formatted)
            if start is not None:
                reply = unescape(formatted[start:end])
                loss.update(reply.encode())
                n_loss += len(reply)
        if len(out) >= 5000:
            yield flush()
            out.clear()
    if began:
        close()
        yield flush()


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what the formatted examples of expand() hold: all turns (from its last example) and all text
    under the loss masks."""
    return examples.mapInArrow(_digests, DIGESTS)


#: A conversation whose texts look like a template's control strings.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def op9_chat_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    return read_back(expand(turns.unionByName(probe)))


SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' union all select {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'),
r as (
  select *, row_number() over w as k, count(*) over (partition by conv_id) as n,
    -- <turn ROLE>, a line break, TEXT</turn> and a line break: 16 characters, and one before each sign that is escaped
    sum(16 + length(role) + length(text) + length(regexp_replace(role, '[^\\<>]', '', 'g')) + length(regexp_replace(text, '[^\\<]', '', 'g'))) over w as chars
  from t window w as (partition by conv_id order by turn, role, text rows unbounded preceding))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) filter (where role = 'assistant' or k = n) as bigint) as formatted_chars
from r group by conv_id
"""
