"""Conversation structure repair by a dynamic program that shared prefixes of a trie compute once.

A conversation becomes a signature, one character a row: the role's initial and the row's fault. What a repair costs, and
its edits, depend on the signature alone. Conversations are dealt by ranges of signatures, and a task walks its sorted
signatures as a depth-first pass over their prefix trie: the program's layer after a prefix (least cost for each state of
the wanted role pattern) is made once and kept while signatures with that prefix go by; the end of a signature is a
terminal node, whose edits are read off the layers of its path. Ranges are of (signature, hash of conv_id), so a signature
that a third of all conversations share goes to many tasks, each of which solves it once.

Texts are streamed in order, once to find the faults and once to hash the repaired rows; a task holds one digest a row of
one conversation, never its texts.

Faults, the first that holds: blank (no character but white space), duplicate (role and text stood earlier in the
conversation), truncated (the last such character isn't one of ``.!?``). Edits: keep (0), give role user or assistant (2),
delete (3, and the only edit of a blank or duplicate row), insert a user or assistant row without text (2); a truncated row
that stays costs 1 more. The roles' initials must become ``(s?(ua)+)?``. Of the cheapest edits, those whose initials
(K, R, D, I) are least in ASCII are taken.

Defined results: rows with equal turns are taken by role, then text (null turns first); null roles and texts are one
space, and so are nulls in the key of the damage; rows with a null conv_id are one conversation; a role's initial is its
first character, an empty role has none and is like any other role than s, u, a; a conversation whose rows are all dropped
has zeros, no edits and the hash of nothing; repeated rows are repeated rows (so duplicates); an empty table gives no rows;
texts are taken whole, whatever their length; extra columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, cut, drop_cut, slices, table

# The edits' costs.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the wanted pattern: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a row with this initial leads to.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The user or assistant row that each state wants next.
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ACCEPTED = (START, ASSISTANT)
FAR = 1 << 40

STATS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
_SOLVED = [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())]
_FILLED, _ENDED = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with the damage that crc32 of conv_id:turn (mod 20) says: 0 dropped, 1 text emptied, 2 without ``.!?``,
    3 twice, 4 role user. Dropped rows stay, marked by `there`, so that their conversations stay known."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), F.explode(times).alias("time")).drop("time")


class _Faults:
    """What is told of one conversation from its rows in order."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.seen, self.signature, self.last = conv, set(), [], None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.greatest = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:  # turns come in order
            self.turns += turn != self.greatest
            self.least = turn if self.least is None else self.least
            self.greatest = turn
        key = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode())
        initial = role[:1]
        if not _FILLED.search(text):
            self.blank += 1
            sign = "x"
        elif key in self.seen:
            self.duplicate += 1
            sign = "x"
        else:
            ended = bool(_ENDED.search(text))
            self.truncated += not ended
            sign = initial if initial in ("s", "u", "a") else "o"
            sign = sign if ended else sign.upper()
        self.seen.add(key)
        self.signature.append(sign)
        if self.last is not None:
            self.illegal += f"{self.last}{initial}" not in ("su", "ua", "au")
        self.last = initial

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.greatest - self.least + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, "".join(self.signature)


def _find_faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), ("signature", pa.string())])
    out, now = [], None
    for batch in slices(batches):
        for conv, turn, role, text, there in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "there")), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.row())
                now = _Faults(conv)
            if there:
                now.add(turn, role, text)
        if len(out) > 5000:
            yield batch_of(out, schema)
            out = []
    yield batch_of([*out, *([now.row()] if now else [])], schema)


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    order = ["conv_id", *first, "turn", "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order))


def faults(damaged: DataFrame) -> DataFrame:
    """Per conversation its counts of faults and its signature: s, u, a or o for a row's role (capital: truncated), x for a
    row that must go."""
    return _in_order(damaged).mapInArrow(_find_faults, STATS)


def inserted(layer: list[int]) -> list[int]:
    """A layer with the states that inserted rows reach."""
    start, system, user, assistant = layer
    user = min(user, start + INSERT, system + INSERT, assistant + INSERT)
    return [start, system, user, min(assistant, user + INSERT)]


def step(layer: list[int], sign: str) -> list[int]:
    """The layer after one more row."""
    out = [c + DELETE for c in layer]
    if sign != "x":
        initial, extra = sign.lower(), TRUNCATED * sign.isupper()
        for state, cost in enumerate(layer):
            wanted, after = NEXT[state]
            if wanted != initial:
                out[after] = min(out[after], cost + REROLE + extra)
            if (after := AFTER.get((state, initial))) is not None:
                out[after] = min(out[after], cost + extra)
    return inserted(out)


def first_layer() -> list[int]:
    return inserted([0, FAR, FAR, FAR])


def terminal(signature: str, layers: list[list[int]]) -> tuple[int, str]:
    """Cost and edits of the signature whose prefixes have these layers. Backwards, the least cost to the end from each
    node tells which edges are on a cheapest way; then forwards the least initial of such an edge, which names the next
    node."""
    best = min(layers[-1][s] for s in ACCEPTED)
    n = len(signature)
    rest = np.full((n + 1, 4), FAR, np.int64).tolist()

    def close(to_end: list[int]) -> list[int]:
        """With rows inserted from each state."""
        start, system, user, assistant = to_end
        user = min(user, assistant + INSERT)
        more = user + INSERT
        return [min(start, more), min(system, more), user, min(assistant, more)]

    rest[n] = close([0 if s in ACCEPTED else FAR for s in range(4)])
    for i in range(n - 1, -1, -1):
        rest[i] = close([min(cost + rest[i + 1][after] for _, cost, after in moves(signature[i], s)) for s in range(4)])
    edits, i, state, spent = [], 0, START, 0
    while i < n or state not in ACCEPTED:
        # D, I, K, R: in the order of ASCII
        options = [(e, c, i + 1, a) for e, c, a in (moves(signature[i], state) if i < n else ())]
        options.append(("I", INSERT, i, NEXT[state][1]))
        edit, cost, i, state = min(o for o in options if spent + o[1] + rest[o[2]][o[3]] == best)
        edits.append(edit)
        spent += cost
    return best, "".join(edits)


def moves(sign: str, state: int) -> list[tuple[str, int, int]]:
    """The edits of a row in a state: initial, cost, state after it."""
    out = [("D", DELETE, state)]
    if sign != "x":
        initial, extra = sign.lower(), TRUNCATED * sign.isupper()
        if (after := AFTER.get((state, initial))) is not None:
            out.append(("K", extra, after))
        wanted, after = NEXT[state]
        if wanted != initial:
            out.append(("R", REROLE + extra, after))
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_SOLVED)
    path, layers, answer = None, [first_layer()], None
    for batch in slices(batches, 4096):
        out = []
        for *stats, signature in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if signature != path:
                shared = len(os.path.commonprefix((path or "", signature)))
                del layers[shared + 1 :]
                for sign in signature[shared:]:
                    layers.append(step(layers[-1], sign))
                path, answer = signature, terminal(signature, layers)
            out.append((*stats, *answer))
        yield batch_of(out, schema)


def solve(found: DataFrame) -> DataFrame:
    """Cost and audit (the edits' initials) in place of the signatures of faults()."""
    dealt = found.repartitionByRange("signature", F.xxhash64("conv_id")).sortWithinPartitions("signature")
    return dealt.mapInArrow(_solve, ", ".join([STATS.rpartition(",")[0], "cost long", "audit string"]))


class _Repaired:
    """The hash of one conversation's repaired rows, as they stream by."""

    def __init__(self, row: dict) -> None:
        self.row, self.hash, self.at, self.state, self.began = row, hashlib.sha256(), 0, START, False

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.began}{role}:{text}".encode())
        self.began = True

    def inserts(self) -> None:
        audit = self.row["audit"]
        while self.at < len(audit) and audit[self.at] == "I":
            self.new("")

    def new(self, text: str) -> None:
        wanted, self.state = NEXT[self.state]
        self.put("user" if wanted == "u" else "assistant", text)
        self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.row["audit"][self.at]
        if edit == "R":
            self.new(text)
            return
        if edit == "K":
            self.state = AFTER[self.state, role[:1]]
            self.put(role, text)
        self.at += 1

    def done(self) -> tuple:
        self.inserts()
        return (*self.row.values(), self.hash.hexdigest())


def _hash_repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [n for n, _ in _SOLVED]
    schema = pa.schema([*_SOLVED, ("repaired_sha256", pa.string())])
    out, now = [], None
    for batch in slices(batches):
        for row in batch.select([*names, "role", "text"]).to_pylist():
            role, text = row.pop("role"), row.pop("text")
            if row["audit"] is not None:  # a conversation begins
                if now is not None:
                    out.append(now.done())
                now = _Repaired(row)
            else:
                now.add(role, text)
        if len(out) > 5000:
            yield batch_of(out, schema)
            out = []
    yield batch_of([*out, *([now.done()] if now else [])], schema)


def repaired(damaged: DataFrame, solved: DataFrame) -> DataFrame:
    """The solved conversations with the hash of their repaired rows. A conversation's edits come before its rows."""
    null = lambda d, names: [F.lit(None).cast(t).alias(n) for n, t in d.dtypes if n in names]
    names = [n for n, _ in _SOLVED]
    heads = solved.select(F.lit(0).alias("kind"), *names, *null(damaged, ("turn", "role", "text")))
    rows = damaged.filter("there").select(F.lit(1).alias("kind"), "conv_id", *null(solved, names[1:]), "turn", "role", "text")
    schema = ", ".join([STATS.rpartition(",")[0], "cost long", "audit string", "repaired_sha256 string"])
    return _in_order(heads.unionByName(rows), "kind").mapInArrow(_hash_repaired, schema)


def repair(damaged: DataFrame) -> DataFrame:
    """Counts of faults, cost, audit and the hash of the repaired rows, per conversation of rows like those of damage()."""
    found = cut(faults(damaged))
    solved = cut(solve(found))
    drop_cut(found)
    return repaired(damaged, solved)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


#: SQL for what a truncated row x adds.
_EXTRA = f"{TRUNCATED} * cast(x[1] between 'A' and 'Z' as int)"


def _plus(path: str, cost: int | str, edit: str) -> str:
    """SQL for a way (six digits of cost, then its edits) with one more edit."""
    return f"printf('%06d', cast({path}[1:6] as int) + {cost}) || {path}[7:] || '{edit}'"


def _reach(start: str, system: str, user: str, assistant: str) -> str:
    """SQL for a layer (a list of ways, the cheapest and then least for each state) with inserted rows."""
    user = f"least({user}, {_plus(f'({start})', INSERT, 'I')}, {_plus(f'({system})', INSERT, 'I')}, {_plus(f'({assistant})', INSERT, 'I')})"
    return f"[{start}, {system}, {user}, least({assistant}, {_plus(f'({user})', INSERT, 'I')})]"


def _kept(state: int, initial: str, rerole: bool = True) -> str:
    """SQL for the way from a state by a row that becomes one of this initial: kept, or else given the role."""
    keep, give = _plus(f"w[{state + 1}]", _EXTRA, "K"), _plus(f"w[{state + 1}]", f"{REROLE} + {_EXTRA}", "R")
    return f"case when lower(x[1]) = '{initial}' then {keep} when {str(rerole).lower()} and x[1] <> 'x' then {give} end"


_ROW = [f"{_plus(f'w[{s + 1}]', DELETE, 'D')}" for s in range(4)]
_STEP = f"[{_ROW[0]}, least({_ROW[1]}, {_kept(START, 's', False)}), least({_ROW[2]}, {_kept(START, 'u')}, {_kept(SYSTEM, 'u')}, {_kept(ASSISTANT, 'u')}), least({_ROW[3]}, {_kept(USER, 'a')})]"

#: DuckDB has no crc32: a table of its steps, and a fold over the bytes. The program is a fold over the signature.
SQL = rf"""
with steps as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as step),
c as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))), '..'), lambda x: cast('0x' || x as bigint))),
      lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1])), 4294967295) % 20 as kind from conversations, steps),
d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case kind when 3 then 2 else 1 end)) from c where kind <> 0),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, row_number() over (partition by conv_id, role, text) as nth from d),
f as (
  select *, substr(role, 1, 1) as initial,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when nth > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault,
    lag(substr(role, 1, 1)) over (partition by conv_id order by i) as earlier from (select * exclude nth, row_number() over (partition by conv_id, role, text order by i) as nth from n)),
g as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where earlier || initial not in ('su', 'ua', 'au')) as illegal,
    list(case when fault in ('blank', 'duplicate') then 'x' when fault = 'truncated' then upper(case when initial in ('s', 'u', 'a') then initial else 'o' end) when initial in ('s', 'u', 'a') then initial else 'o' end order by i) as signs
  from f group by conv_id),
w as (
  select *, list_reduce(list_prepend({_reach("'000000'", "cast(null as varchar)", "cast(null as varchar)", "cast(null as varchar)")}, list_transform(signs, lambda s: [s])),
    lambda w, x: list_transform([{_STEP}], lambda y: {_reach("y[1]", "y[2]", "y[3]", "y[4]")})[1]) as ways from g),
a as (select *, cast(least(ways[1], ways[4])[1:6] as bigint) as cost, least(ways[1], ways[4])[7:] as audit from w),
e as (select conv_id, p, audit[p] as edit, length(regexp_replace(audit[1:p], 'I', '', 'g')) as i, length(regexp_replace(audit[1:p], 'D', '', 'g')) as j from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as p from a)),
o as (
  select e.*, f.role, f.text, max(cast(e.edit = 'K' and e.j = 1 and f.initial = 's' as int)) over (partition by e.conv_id) as led
  from e left join f on e.conv_id is not distinct from f.conv_id and e.i = f.i),
h as (
  select conv_id, string_agg(case when edit = 'K' then role when (j - led) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by p) as repaired
  from o where edit <> 'D' group by conv_id)
select q.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) q left join a on q.conv_id is not distinct from a.conv_id left join h on q.conv_id is not distinct from h.conv_id
"""
