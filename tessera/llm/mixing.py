"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every row has a key: the MD5 digest of the seed, its doc_id and its text. A source's words are summed by the key's first
digits (a histogram); the bucket in which the running sum crosses the source's budget is the only one that is summed again
by the next digits, and so on, until the rows left have one key. That key is the source's threshold: rows under it are
taken once more, rows over it aren't. Rows are never sorted and no source is gathered in one task; what windows run over
has at most 4096 rows a source. Thresholds nest: with the same seed, a greater budget of a source takes all that a smaller
one takes.

Targets: a source's weight is 5, 2, 1, repeating over the sources by code point (null last), and all sources share
`share` times all words by weight. A target stops at `most` times its source's words; what is over goes to the others by
weight, until none is over. Every row of a source is taken floor(target / words) times, and those under the threshold once
more. The row at the threshold is taken if the source then comes nearer to its target, so a source differs from it by half
a row at most.

Defined results: a null or empty text has no words and takes none; a null source is a source of its own; null doc_ids are
kept; of fully equal rows (one key), as many as fit are taken once more, and which of them makes no difference; a source
without words has target 0; texts are taken whole, whatever their length; an empty table gives no rows; extra columns, of
any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, table

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1, 3, "tessera-11"
#: Hexadecimal digits of the key that one histogram resolves: 4096 buckets.
DIGITS = 3
#: Sources up to which their table is broadcast (some 100 bytes each); beyond, rows are salted and joined.
BROADCAST_SOURCES, SALTS = 100_000, 64


def _words(text: Column) -> Column:
    """Number of maximal runs of characters other than white space."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")).cast("long")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source (null: a null), size in words, and the key of every row."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("text"), F.lit(""))))
    return docs.select("doc_id", "source", _words(F.col("text")).alias("size"), key.alias("key"))


def numbered(sources: DataFrame) -> DataFrame:
    """The sources with their place (from 0) by code point, null last: by ranges of sources and the counts of earlier ranges,
    so that a million sources aren't one task's sort."""
    dealt = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    out = cut(dealt.withColumn("place", F.row_number().over(inside) - 1).join(offsets, "part").withColumn("place", F.col("place") + F.col("before")).drop("part", "before"))
    drop_cut(dealt)
    return out


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target of sources (source, source_size). A round finds the sources that are over their limit
    and reshares; rounds end when no further one is over. Only sums come to the driver."""
    placed = numbered(sources)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    per = placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("limit"))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    r = per.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("w"), F.count("*").alias("n")).first()
    budget = int(share * (r.words or 0))
    left, weight_left, known = budget, r.w or 1, 0
    over = F.lit(False)
    while weight_left:
        over = F.lit(left).cast("decimal(38,0)") * exact("weight") >= exact("limit") * F.lit(weight_left).cast("decimal(38,0)")
        r = per.agg(F.coalesce(F.sum(F.when(over, F.col("limit"))), F.lit(0)).alias("limits"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
        if r.n == known:
            break
        left, weight_left, known = budget - r.limits, r.w, r.n
    target = F.when(over, F.col("limit").cast("double")).otherwise(F.lit(left).cast("double") * F.col("weight") / F.lit(max(weight_left, 1)))
    return per.select("source", "source_size", target.alias("target"))


def _with_sources(rows: DataFrame, per_source: DataFrame, n_sources: int) -> DataFrame:
    """Each row with its source's columns: broadcast up to BROADCAST_SOURCES sources, else dealt with a salt from the row's
    key, so that a source with a third of all rows is many tasks."""
    ours = per_source.withColumnRenamed("source", "its_source")
    same = F.col("source").eqNullSafe(F.col("its_source"))
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(ours), same).drop("its_source")
    salted = rows.withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS)))
    each = ours.withColumn("its_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, same & (F.col("salt") == F.col("its_salt"))).drop("its_source", "salt", "its_salt")


def thresholds(rows: DataFrame, per_source: DataFrame, n_sources: int) -> DataFrame:
    """source, threshold (a key; null: none is crossed), and before, the words of its rows under it. rows: of sized();
    per_source: source and twice, the doubled budget."""
    found, todo, at = None, cut(per_source.select("source", "twice", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))), 0
    pool = rows.filter("size > 0")
    while True:
        at += DIGITS
        ranked = _with_sources(pool, todo, n_sources).filter(F.col("key").startswith(F.col("prefix")))
        bucket = F.substring("key", 1, at)
        sums = ranked.groupBy("source", bucket.alias("bucket")).agg(F.first("twice").alias("twice"), F.first("before").alias("base"), F.sum("size").alias("words"), F.min("key").alias("least"), F.max("key").alias("greatest"))
        earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        running = sums.withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        # a bucket is crossed if its last word lies beyond the budget; of these, the first
        crossed = running.filter(F.col("before") + F.col("words") > F.col("twice") / 2).groupBy("source").agg(F.min_by(F.struct("bucket", "before", "twice", "least", "greatest"), "bucket").alias("b")).select("source", "b.*")
        crossed = cut(crossed)
        ends = crossed.filter("least = greatest").select("source", F.col("least").alias("threshold"), "before")
        found = ends if found is None else found.unionByName(ends)
        drop_cut(todo)
        todo = cut(crossed.filter("least < greatest").select("source", "twice", F.col("bucket").alias("prefix"), "before"))
        if todo.isEmpty():
            drop_cut(todo)
            return found
        if at == DIGITS:  # from now on only the crossed buckets' rows
            pool = cut(_with_sources(pool, todo.drop("twice", "before"), n_sources).filter(F.col("key").startswith(F.col("prefix"))).drop("prefix"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (how often the mix takes the row) of every document."""
    rows = cut(sized(docs, seed))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = targets(sums, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = cut(per.withColumn("whole", whole).withColumn("twice", 2 * (F.col("target") - F.col("whole") * F.col("source_size"))))
    n_sources = per.count()
    at = cut(thresholds(rows, per.select("source", "twice"), n_sources))
    laws = per.alias("p").join(at.alias("t"), F.expr("p.source <=> t.source"), "left").select("p.*", "threshold", "before")
    laws = cut(laws)
    placed = _with_sources(rows, laws, n_sources)
    # of the rows with the threshold's key (equal rows), those whose middle word lies under the budget
    equal = cut(placed.filter(F.col("key") == F.col("threshold")).withColumn("id", F.monotonically_increasing_id()))
    equal = equal.withColumn("part", F.shiftright("id", 33))
    here = equal.groupBy("source", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = here.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = equal.withColumn("inside", F.row_number().over(Window.partitionBy("source", "part").orderBy("id")))
    ties = inside.alias("e").join(offsets.alias("o"), F.expr("e.source <=> o.source and e.part = o.part")).select("e.*", (F.col("inside") - 1 + F.col("offset")).alias("nth"))
    ties = ties.withColumn("more", (2 * F.col("before") + (2 * F.col("nth") + 1) * F.col("size") < F.col("twice")).cast("int"))
    # a source of no threshold takes every row or none: its budget is at least its words, or it has none
    under = F.when(F.col("threshold").isNull(), F.col("twice") > 0).otherwise(F.col("key") < F.col("threshold"))
    others = placed.filter(F.col("threshold").isNull() | (F.col("key") != F.col("threshold"))).withColumn("more", under.cast("int"))
    columns = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("more")).alias("copies")]
    return others.select(*columns).unionByName(ties.select(*columns))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


SQL = rf"""
with d as (
  select doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) as size,
    md5('{SEED}:' || coalesce(cast(doc_id as varchar), '-') || ':' || coalesce(text, '')) as key from documents),
s as (
  select source, cast(sum(size) as hugeint) as words, [{", ".join(map(str, WEIGHTS))}][cast((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1 as int)] as weight
  from d group by source),
r as (
  select *, {MOST} * words as lim, {SHARE} * sum(words) over () - coalesce(sum({MOST} * words) over (order by {MOST} * words / weight, source rows between unbounded preceding and 1 preceding), 0) as left_words,
    sum(weight) over (order by {MOST} * words / weight, source rows between current row and unbounded following) as left_weight from s),
o as (select *, left_words * weight >= lim * left_weight as over from r),
l as (select {SHARE} * sum(words) - coalesce(sum(lim) filter (where over), 0) as left_words, coalesce(sum(weight) filter (where not over), 0) as left_weight from o),
t as (
  select source, words, case when over then cast(lim as double) else cast(l.left_words as double) * weight / greatest(l.left_weight, 1) end as target from o, l),
w as (select *, case when words > 0 then cast(floor(target / words) as bigint) else 0 end as whole from t),
p as (
  select d.*, w.words, w.target, w.whole, 2 * (w.target - w.whole * w.words) as twice,
    sum(size) over (partition by d.source order by key, size rows unbounded preceding) as upto from d join w on d.source is not distinct from w.source)
select doc_id, cast(size as bigint) as size, cast(words as bigint) as source_size, target,
  cast(size * (whole + case when 2 * upto - size < twice then 1 else 0 end) as bigint) as taken, source from p
"""
