"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked; a row's fraction is its rank in its source over the source's
size. Sorted by fraction, every stretch of rows has the sources in the corpus' proportions, so cutting the order into equal
counts makes every shard match the mixture. The fraction of rank r (from 1) of n is (r - s) / n, where s in (0, 1) is fixed
by the source, so that sources of few rows spread over the shards.

No step ranks a source, or the corpus, in one task. Ranks are taken inside buckets of the hash (or the fraction), whose
sizes are counted first and added up before; the number of buckets follows the number of rows, so a bucket stays at about
BUCKET_ROWS rows even if one source has all rows. Only sums
go through windows: over SPAN buckets, and over one row for each SPAN buckets.

Law: `rows`. Counts of shards are at most one apart; slots run from 0 without gaps.

Defined results: a null text has size 1 and crc32 0; a null source is a source of its own; rows with equal hashes are
ordered by doc_id, then the text's crc32 and size, and fully equal rows take neighbouring slots; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARDS, SEED = 16, "tessera-7"
#: Rows that a bucket has on average.
BUCKET_ROWS = 5_000
#: Buckets that are summed together before all are: a window holds so many of them, or one row for each such group.
SPAN = 4_096


def _unit(x: Column) -> Column:
    """A number from 0 up to 1 out of a hexadecimal digest."""
    return F.conv(F.substring(x, 1, 12), 16, 10).cast("double") / float(1 << 48)


def _ranked(rows: DataFrame, keys: list[str], bucket: str, order: list[Column | str], rank: str, counts: DataFrame) -> DataFrame:
    """Ranks from 1 by bucket and then order, within keys; counts has the rows of every bucket (keys, bucket, n)."""
    span = F.floor(F.col(bucket) / SPAN)
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.groupBy(*keys, span.alias("span")).agg(F.sum("n").alias("n"))
    spans = spans.withColumn("spans_before", F.coalesce(F.sum("n").over(earlier(*keys, "span")), F.lit(0))).drop("n")
    within = counts.withColumn("span", span).withColumn("before", F.coalesce(F.sum("n").over(earlier(*keys, "span", bucket)), F.lit(0)))
    offsets = within.join(spans, [*keys, "span"]).withColumn("before", F.col("before") + F.col("spans_before")).drop("n", "span", "spans_before")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    ranked = rows.withColumn(rank, F.row_number().over(inside).cast("long"))
    return ranked.join(offsets, [*keys, bucket]).withColumn(rank, F.col(rank) + F.col("before")).drop("before")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, source, shard and slot of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    keyed = docs.select("doc_id", source.alias("stratum"), mixed.alias("mix"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("text_crc32"))
    n = docs.count()
    buckets = max(1, n // BUCKET_ROWS)
    small = keyed.withColumn("bucket", F.floor(_unit(F.col("mix")) * buckets))
    per_bucket = small.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    ranked = _ranked(small, ["stratum"], "bucket", ["mix", "doc_id", "text_crc32", "bytes"], "rank", per_bucket)
    totals = per_bucket.groupBy("stratum").agg(F.sum("n").alias("total"))
    shift = _unit(F.md5(F.concat_ws(":", F.lit(seed), F.col("stratum"))))
    placed = ranked.join(totals, "stratum").withColumn("fraction", (F.col("rank") - shift) / F.col("total"))
    placed = placed.withColumn("part", F.floor(F.col("fraction") * buckets)).select("doc_id", "stratum", "mix", "bytes", "text_crc32", "rank", "fraction", "part")
    per_part = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("all", F.lit(1))
    ordered = _ranked(placed.withColumn("all", F.lit(1)), ["all"], "part", ["fraction", "stratum", "rank"], "position", per_part)
    at = F.col("position") - 1
    out = ordered.select("doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", F.when(F.col("stratum") != "-", F.substring("stratum", 2, 1 << 30)).alias("source"), at.alias("at"), F.expr(f"cast((cast(position - 1 as decimal(38,0)) * {shards}) div {max(1, n)} as int)").alias("shard"))
    first = F.expr(f"cast((cast(shard as decimal(38,0)) * {n} + {shards - 1}) div {shards} as long)")
    return out.withColumn("slot", F.col("at") - first).drop("at")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


#: DuckDB has no crc32: a table of its steps, and a fold over the bytes.
SQL = f"""
with steps as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as step),
d as (
  select doc_id, coalesce('s' || source, '-') as stratum, md5('{SEED}:' || coalesce(cast(doc_id as varchar), '-')) as mix,
         cast(strlen(coalesce(text, '')) + 1 as bigint) as size, source,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x as bigint))),
             lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1])), 4294967295) as text_crc32 from documents, steps),
r as (
  select *, row_number() over (partition by stratum order by mix, doc_id, text_crc32, size) as rank, count(*) over (partition by stratum) as total,
         cast(cast('0x' || substr(md5('{SEED}:' || stratum), 1, 12) as bigint) as double) / 281474976710656.0 as shift from d),
p as (
  select *, row_number() over (order by (rank - shift) / total, stratum, rank) - 1 as pos, count(*) over () as n from r)
select doc_id, size, text_crc32, 'rows' as law, cast(pos * {SHARDS} // n as int) as shard,
       cast(pos - (pos * {SHARDS} // n * n + {SHARDS - 1}) // {SHARDS} as bigint) as slot, cast(null as int) as grown_shard, source from p
"""
