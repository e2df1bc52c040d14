"""Line dedup with a suffix array over line ids, with DataFrame functions only.

Every document is a sequence of line ids (blank lines left out). Suffixes of all sequences are ranked by distributed prefix
doubling: ranks by the first line, then by the first 2, 3, 6, 12, ... lines, where the rank by 2n lines orders the pairs
(rank by n lines here, rank by n lines n places on); the one step that reaches min_lines overlaps. It goes on until no prefix
occurs twice. The ranks of a step are given to the distinct pairs alone, which are range-partitioned and sorted, so a line or
run that a third of all rows hold is one row there. Suffixes whose prefix occurs once are discarded as soon as that shows.

Equal ranks by n lines are exactly the intervals of the suffix array whose longest common prefix is n lines or more. In each,
the first suffix in the order of doc_id and place is the copy that stays, and every later one is a span of n lines to delete,
if n is min_lines or more, or its lines hold min_words words. Spans that touch make a stretch. Where all of a stretch lies along
one first copy, it is one run. Elsewhere the longest prefix that each suffix shares with an earlier one is found by descent
over the kept ranks, from the longest to those of one line: the suffixes of an interval part by the rank of what follows, and
those with an earlier one beside them go on to the longer interval. So these lengths are exact, and a run is a span that no
span from a lesser place holds: one for every maximal repeat, whole in its first copy. Two runs overlap only where no earlier
place holds them together.

So a line goes just when it lies in MIN_LINES or more neighbouring lines, or in one or two of MIN_WORDS words together, that
also stand earlier (in a document of lower doc_id, or higher up in the same document).

Defined results: lines end at \\n; lines of white space alone are no part of runs, and go only between two deleted lines; a
null text has no lines and stays null; of rows with equal doc_id and text, one is given, the one whose columns have the least
hash; null doc_ids come first in the order; documents with equal doc_id and other texts are ordered by a hash of the text; an
empty table gives no rows; dedup_lines keeps extra columns as they are, and puts underscores after the names of its own
columns where the table has such names. A very long text is one row a line, but its spans are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, fresh_name, table

MIN_LINES = 3
#: Words from which a run of fewer lines counts too.
MIN_WORDS = 40
_KEY = ["d", "t"]
_WORD = r"[^\x20\x09-\x0D]+"
_FIGURES = ["n_lines", "n_deleted", "n_runs", "longest_run"]


def _keyed(docs: DataFrame, d: str, t: str) -> DataFrame:
    """The documents with an order key in columns d and t; rows with equal keys once. Whether there are any is asked of the
    ids first."""
    out = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), t: F.xxhash64("text")})
    ids = docs.select(F.col("doc_id").cast("long").alias("d"))
    if ids.groupBy("d").count().filter("count > 1 or d is null").isEmpty():
        return out
    names = out.columns
    one = out.groupBy(d, t).agg(F.min_by(F.struct(*names), F.xxhash64(F.to_json(F.struct(*docs.columns)))).alias("r"))
    return one.select(*(F.col("r")[c].alias(c) for c in names))


def _named(found: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of several suffixes with the first of these, and a rank that follows the order of the keys."""
    many = found.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "place")).alias("first")).filter("n > 1").drop("n")
    return many.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id())


def repeated_prefixes(docs: DataFrame, min_lines: int = MIN_LINES) -> list[tuple[int, DataFrame]]:
    """For each length in lines, the suffixes whose prefix of it occurs more than once: d, t, place, line (its number in the
    text), last (that of the prefix's last line), words (while the length is below min_lines), rank, and the first of the
    suffixes of that rank. The tables are cut; the caller drops them."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("x"))), lambda s: s["x"].rlike(_WORD))
    rows = docs.filter("text is not null").select("d", "t", F.posexplode(lines).alias("place", "s"))
    rows = rows.select("d", "t", "place", F.col("s.line").alias("line"), F.xxhash64("s.x").alias("h1"), F.xxhash64(F.lit("second"), "s.x").alias("h2"), F.regexp_count("s.x", F.lit(_WORD)).alias("words"))
    keys = ["h1", "h2"]
    ranks = cut(rows.join(_named(rows, keys), keys).select("d", "t", "place", "line", F.col("line").alias("last"), "words", "rank", "first"))
    length, out = 1, []
    while not ranks.isEmpty():
        out.append((length, ranks))
        step = length if length >= min_lines else min(length, min_lines - length)
        here = ranks.select("d", "t", "place", "line", "words", F.col("rank").alias("a"))
        ahead = ranks.select("d", "t", (F.col("place") - step).alias("place"), "last", F.col("words").alias("more"), F.col("rank").alias("b"))
        pairs = here.join(ahead, ["d", "t", "place"]).withColumn("words", F.col("words") + F.col("more")).drop("more")
        ranks = cut(pairs.join(_named(pairs, ["a", "b"]), ["a", "b"]).drop("a", "b"))
        length += step
    drop_cut(ranks)
    return out


def _me() -> Column:
    return F.struct("d", "t", "place")


def _told(levels: list[tuple[int, DataFrame]], min_lines: int, min_words: int) -> DataFrame:
    """For each suffix with an earlier copy, its longest span of the ranked lengths, the stretch of touching spans that it is
    in, and whether the stretch forks: is along more than one first copy. A cut table."""
    spans = None
    for length, ranks in levels:
        enough = F.lit(True) if length >= min_lines else F.col("words") >= min_words
        later = ranks.filter(enough & (_me() != F.col("first"))).select("d", "t", "place", F.struct(F.lit(length).alias("n"), "line", "last", "first").alias("span"))
        spans = later if spans is None else spans.unionByName(later)
    longest = spans.groupBy("d", "t", "place").agg(F.max("span").alias("span")).select("d", "t", "place", "span.*")
    order = Window.partitionBy("d", "t").orderBy("place")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("place") + F.col("n")
    along = F.when(end > F.col("before"), F.struct(F.col("first.d"), F.col("first.t"), F.col("first.place") - F.col("place")))
    marked = longest.withColumn("before", F.coalesce(F.max(end).over(earlier), F.lit(-1)))
    marked = marked.withColumn("stretch", F.sum((F.col("place") > F.col("before")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("along", along)
    turns = F.col("along").isNotNull() & (F.col("place") <= F.col("before")) & (F.col("along") != F.last("along", ignorenulls=True).over(earlier))
    return cut(marked.withColumn("turns", turns).withColumn("fork", F.max("turns").over(Window.partitionBy("d", "t", "stretch"))).drop("before", "along", "turns"))


def _shared_lengths(levels: list[tuple[int, DataFrame]], told: DataFrame) -> DataFrame | None:
    """d, t, place, n and first of the suffixes in forked stretches: the length of the longest prefix that an earlier suffix
    has too, and the first such suffix. None if no stretch forks. A cut table.

    A suffix whose longest ranked span is of n lines has a length between n and the next ranked one. The rows are the members
    of its interval but for those with a longer ranked span, which are first in no interval that matters here. In each step a
    row takes on the rank of the lines after its own; of equal rows, the later go on to the longer length, the first does so as
    their source and stays as well, and rows alone stay. An interval is named by its first suffix."""
    forks = told.filter("fork")
    asked = cut(forks.select(F.col("n").alias("base"), "first").distinct())
    longest = asked.agg(F.max("base")).first()[0]
    if longest is None:
        drop_cut(asked)
        return None
    members = None
    for length, ranks in levels:
        if length <= longest:
            of = ranks.select("d", "t", "place", F.lit(length).alias("base"), "first")
            members = of if members is None else members.unionByName(of)
    own = told.select("d", "t", "place", F.col("n").alias("own"))
    rows = members.join(asked, ["base", "first"], "left_semi").join(own, ["d", "t", "place"], "left").filter("own is null or own <= base")
    state = cut(rows.select("d", "t", "place", "base", F.col("base").alias("n"), "first"))
    drop_cut(asked)
    for step, ranks in reversed(levels):
        if step >= longest:
            continue
        ahead = ranks.select("d", "t", F.col("place").alias("at"), F.col("rank").alias("ahead"))
        tried = state.withColumn("at", F.when(F.col("base") > step, F.col("place") + F.col("n"))).join(ahead, ["d", "t", "at"], "left").drop("at")
        keys = ["base", "n", "first", "ahead"]
        several = tried.filter("ahead is not null").groupBy(*keys).agg(F.count("*").alias("size"), F.min(_me()).alias("source")).filter("size > 1").drop("size")
        stays = F.struct("n", "first")
        goes = F.struct((F.col("n") + step).alias("n"), F.col("source").alias("first"))
        forms = F.when(F.col("source").isNull(), F.array(stays)).when(_me() == F.col("source"), F.array(stays, goes)).otherwise(F.array(goes))
        new = cut(tried.join(several, keys, "left").select("d", "t", "place", "base", F.explode(forms).alias("s")).select("d", "t", "place", "base", "s.*"))
        drop_cut(state)
        state = new
    out = cut(state.filter(_me() != F.col("first")).drop("base").join(forks.select("d", "t", "place"), ["d", "t", "place"], "left_semi"))
    drop_cut(state)
    return out


def later_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The runs of lines that are later copies, of documents with keys d and t: place and line of their first line, last (the
    number of their last line), n (lines that aren't blank), first (d, t and place of the first copy), and fresh (lines that
    are in no run with a lesser place). A cut table."""
    levels = repeated_prefixes(docs, min_lines)
    if not levels:
        return docs.sparkSession.createDataFrame([], "d long, t long, place int, line int, last int, n int, first struct<d: long, t: long, place: int>, fresh long")
    told = _told(levels, min_lines, min_words)
    order = Window.partitionBy("d", "t").orderBy("place")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("place") + F.col("n")
    before = F.coalesce(F.max(end).over(earlier), F.lit(-1))
    least = F.min(F.struct("place", "line", "first"))
    straight = told.filter("not fork").groupBy("d", "t", "stretch").agg(least.alias("s"), F.max("last").alias("last"), (F.max(end) - F.min("place")).alias("n"))
    runs = straight.select("d", "t", "s.place", "s.line", "last", "n", "s.first")
    exact = _shared_lengths(levels, told)
    if exact is not None:
        # spans inside an earlier one fall away: the ends of the rest rise with their places
        forked = told.filter("fork").select("d", "t", "place", "line").join(exact, ["d", "t", "place"])
        forked = forked.withColumn("before", before).filter(end > F.col("before"))
        lasts = levels[0][1].select("d", "t", (F.col("place") + 1).alias("stop"), F.col("line").alias("last"))
        runs = runs.unionByName(forked.withColumn("stop", end).join(lasts, ["d", "t", "stop"]).drop("before", "stop"))
    out = cut(runs.withColumn("fresh", (end - F.greatest(F.col("place"), before)).cast("long")))
    for made in [told, exact, *(ranks for _, ranks in levels)]:
        drop_cut(made)
    return out


def _own_names(docs: DataFrame) -> dict[str, str]:
    return {c: fresh_name(docs, c) for c in _FIGURES}


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, all columns, with later copies of runs deleted from their texts, and n_lines, n_deleted (lines that
    aren't blank), n_runs and longest_run."""
    own = _own_names(docs)
    d, t, spans = (fresh_name(docs, c) for c in ("_d", "_t", "_spans"))
    deleted, count, longest = (fresh_name(docs, c) for c in ("_deleted", "_count", "_longest"))
    keyed = _keyed(docs, d, t)
    runs = later_runs(keyed.select(F.col(d).alias("d"), F.col(t).alias("t"), "text"), min_lines, min_words)
    by_doc = runs.groupBy(F.col("d").alias(d), F.col("t").alias(t)).agg(
        F.collect_list(F.struct(F.col("line").alias("a"), F.col("last").alias("b"))).alias(spans), F.sum("fresh").alias(deleted), F.count("*").alias(count), F.max("n").alias(longest)
    )
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.exists(spans, lambda r: i.between(r["a"], r["b"])))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: x.rlike(_WORD))))
    # runs grow with the documents, so both sides are dealt by key at every size
    out = keyed.join(by_doc.hint("merge"), [d, t], "left").withColumns({
        own["n_lines"]: n_lines.cast("long"), own["n_deleted"]: F.coalesce(F.col(deleted), F.lit(0)).cast("long"), own["n_runs"]: F.coalesce(F.col(count), F.lit(0)).cast("long"),
        own["longest_run"]: F.coalesce(F.col(longest), F.lit(0)).cast("long"), "text": F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")),
    })
    return out.select(*docs.columns, *own.values())


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their columns alone; one of whose lines (that aren't blank) none is left goes."""
    own = _own_names(docs)
    out = dedup_lines(docs, min_lines, min_words)
    return out.filter((F.col(own["n_deleted"]) == 0) | (F.col(own["n_deleted"]) < F.col(own["n_lines"]))).select(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", "n_runs", "longest_run", "text")


SQL = f"""
with recursive l as (
  select doc_id, line - 1 as line, x, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) as words
  from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)
  where regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
seq as (select doc_id, row_number() over (partition by doc_id order by line) as place, line, md5(x) as x, words from l),
g as (
  select doc_id, place, 1 as n, line, line as last, words, x as key from seq qualify count(*) over (partition by x) > 1
  union all
  select g.doc_id, g.place, g.n + 1, g.line, s.line, g.words + s.words, md5(g.key || s.x) as longer
  from g join seq s on s.doc_id = g.doc_id and s.place = g.place + g.n qualify count(*) over (partition by longer) > 1),
r as (select *, row_number() over (partition by n, key order by doc_id, place) as copy from g),
longest as (
  select *, place + n as stop from r where copy > 1 and (n >= {MIN_LINES} or words >= {MIN_WORDS})
  qualify row_number() over (partition by doc_id, place order by n desc) = 1),
runs as (
  select doc_id, line as a, last as b, n, stop - greatest(place, before) as fresh
  from (select *, coalesce(max(stop) over (partition by doc_id order by place rows between unbounded preceding and 1 preceding), -1) as before from longest) where stop > before),
every as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents),
kept as (
  select doc_id, coalesce(string_agg(x, chr(10) order by line), '') as text
  from every e where not exists (select 1 from runs u where u.doc_id = e.doc_id and e.line between u.a and u.b) group by doc_id),
n as (select doc_id, count(*) as n_lines from l group by doc_id),
s as (select doc_id, sum(fresh)::bigint as n_deleted, count(*) as n_runs, max(n)::bigint as longest_run from runs group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted, coalesce(n_runs, 0) as n_runs, coalesce(longest_run, 0) as longest_run,
  case when d.text is not null then coalesce(kept.text, '') end as text
from documents d left join n using (doc_id) left join s using (doc_id) left join kept using (doc_id)
"""
