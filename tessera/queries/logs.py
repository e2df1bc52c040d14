"""Queries of the event-log analytics; the driver's events play the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import logs

# Event types of the log.
TYPES = {"click": 0, "view": 31, "purchase": 32, "signup": 21, "error": -1}
INTERVAL = 200_000


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.coalesce(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))[F.col("event_type")], F.lit(11))
    start = us - F.lit(1_704_067_200_000_000) + 1
    rows = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("pid"), F.col("event_type").alias("eventName"), kind.alias("eventType"), start.alias("startT"), "value")
    return rows.withColumn("endT", F.col("startT") + F.floor(F.col("value") * 1000)).withColumn("attribute", F.floor(F.col("value") * 1024)).drop("value")


_CASE = " ".join(f"when '{k}' then {v}" for k, v in TYPES.items())
_LOG = f"""with log as (select event_id as seq, user_id as pid, event_type as eventName, cast(case event_type {_CASE} else 11 end as int) as eventType,
  epoch_us(ts) - 1704067200000000 + 1 as startT, epoch_us(ts) - 1704067200000000 + 1 + cast(floor(value * 1000) as bigint) as endT, cast(floor(value * 1024) as bigint) as attribute from events) """


def _round(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def agg_process_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(logs.summarize_by_process(log_events(spark, sf_dir)), "min_ms", "max_ms", "total_ms", "sq_ms")


def agg_type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(logs.merge_processes(logs.summarize_by_process(log_events(spark, sf_dir)), ["eventType"]), "min_ms", "max_ms", "total_ms", "mean_ms", "std_ms").drop("sq_ms")


def win_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(logs.resample(log_events(spark, sf_dir), INTERVAL), "value")


def win_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = 3_600_000_000  # the driver's events span years, so buckets of an hour and windows of five hours
    return _round(logs.throughput(logs.resample(log_events(spark, sf_dir), wide), wide, span=5 * wide), "peak", "mean", "std", digits=9)


def prj_stage_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.collapse_runs(log_events(spark, sf_dir), F.col("eventName") == "click")


def flt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.filter_events(log_events(spark, sf_dir), {"eventName": ["click", "view"], "~eventType": [31]}, "OR").select("seq", "pid", "eventName")


def agg_wall_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = log_events(spark, sf_dir).groupBy("pid").agg(F.min("startT").alias("a"), F.max("endT").alias("b"))
    return per.agg((F.max("b") - (F.min("a") - 1)).alias("app_wall"), F.sum(F.col("b") - F.col("a") + 1).alias("process_wall"))


def agg_running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.col("endT") - F.col("startT") + 1).cast("double")
    s = log_events(spark, sf_dir).groupBy("eventName").agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"))
    return _round(s.withColumn("std", F.when(F.col("n") == 1, -1.0).otherwise(F.col("std"))), "mean", "std", digits=3)


def agg_rollup_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_events(spark, sf_dir).withColumn("node", F.element_at(F.array(F.lit("assign"), F.lit("io"), F.lit("seg")), (F.col("pid") % 3 + 1).cast("int")))
    log.createOrReplaceTempView("_tessera_log")
    return spark.sql("select node, eventType, count(*) as n, sum(attribute) as data from _tessera_log group by grouping sets ((eventType), (node, eventType))")


_SUM = _LOG + """, part as (select pid, eventType, count(*) as n, min((endT - startT) / 1000.0::double) as min_ms, max((endT - startT) / 1000.0::double) as max_ms, sum((endT - startT) / 1000.0::double) as total_ms,
  sum(((endT - startT) / 1000.0::double) * ((endT - startT) / 1000.0::double)) as sq_ms, sum(attribute)::bigint as data from log group by all),
  s as (select p.pid, t.eventType, coalesce(n, 0) as n, coalesce(min_ms, 0) as min_ms, coalesce(max_ms, 0) as max_ms, coalesce(total_ms, 0) as total_ms, coalesce(sq_ms, 0) as sq_ms, coalesce(data, 0) as data
  from (select distinct pid from log) p cross join (select distinct eventType from log) t left join part using (pid, eventType)) """

QUERIES = {f.__name__: f for f in (agg_process_summary, agg_type_summary, win_resample, win_throughput, prj_stage_collapse, flt_events, agg_wall_time, agg_running_stats, agg_rollup_types)}
ORACLE_SQL = {
    "agg_process_summary": _SUM + "select pid, eventType, n, round(min_ms, 4) as min_ms, round(max_ms, 4) as max_ms, round(total_ms, 4) as total_ms, round(sq_ms, 4) as sq_ms, data from s",
    "agg_type_summary": _SUM + """select eventType, sum(n)::bigint as n, round(min(min_ms), 4) as min_ms, round(max(max_ms), 4) as max_ms, round(sum(total_ms), 4) as total_ms,
      round(case when sum(n) > 0 then sum(total_ms) / sum(n) else 0 end, 4) as mean_ms,
      round(coalesce(case when sum(n) > 1 then sqrt(greatest((sum(sq_ms) - sum(n) * (sum(total_ms) / sum(n)) * (sum(total_ms) / sum(n))) / (sum(n) - 1), 0)) end, 0), 4) as std_ms from s group by eventType""",
    "win_resample": _LOG + f""", b as (select *, unnest(generate_series(cast(ceil(startT / {INTERVAL}.0) as bigint), cast(ceil(endT / {INTERVAL}.0) as bigint))) as bucket from log)
      select eventType, bucket, round(sum(attribute * (least(endT, bucket * {INTERVAL}) - greatest(startT, (bucket - 1) * {INTERVAL} + 1) + 1) / (endT - startT + 1)::double), 4) as value from b group by all""",
    "win_throughput": _LOG + """, b as (select *, unnest(generate_series(cast(ceil(startT / 3600000000.0) as bigint), cast(ceil(endT / 3600000000.0) as bigint))) as bucket from log),
      r as (select eventType, bucket, sum(attribute * (least(endT, bucket * 3600000000) - greatest(startT, (bucket - 1) * 3600000000 + 1) + 1) / (endT - startT + 1)::double) as value from b group by all),
      g as (select t.eventType, u.bucket from (select distinct eventType from r) t cross join (select unnest(generate_series(1, (select max(bucket) from r))) as bucket) u),
      s as (select eventType, sum(coalesce(value, 0)) over (partition by eventType order by bucket rows between 2 preceding and 2 following) / 1073741824.0::double as rate from g left join r using (eventType, bucket))
      select eventType, round(max(rate), 9) as peak, round(avg(rate), 9) as mean, round(stddev_samp(rate), 9) as std from s group by eventType""",
    "prj_stage_collapse": _LOG + """, i as (select *, sum(case when eventName = 'click' then 1 else 0 end) over (partition by pid order by startT, seq rows unbounded preceding)::bigint as island from log)
      select pid, island, min(startT) as startT, max(endT) as endT, arg_max(eventName, (startT, seq)) as last_event, count(*) as n_events from i group by pid, island""",
    "flt_events": _LOG + "select seq, pid, eventName from log where eventName in ('click', 'view') or eventType not in (31)",
    "agg_wall_time": _LOG + "select max(b) - (min(a) - 1) as app_wall, sum(b - a + 1)::bigint as process_wall from (select pid, min(startT) as a, max(endT) as b from log group by pid)",
    "agg_running_stats": _LOG + "select eventName, count(*) as n, round(avg((endT - startT + 1)::double), 3) as mean, round(case when count(*) = 1 then -1.0 else stddev_pop((endT - startT + 1)::double) end, 3) as std from log group by eventName",
    "agg_rollup_types": _LOG + "select case pid % 3 when 0 then 'assign' when 1 then 'io' else 'seg' end as node, eventType, count(*) as n, sum(attribute)::bigint as data from log group by grouping sets ((eventType), (case pid % 3 when 0 then 'assign' when 1 then 'io' else 'seg' end, eventType))",
}
