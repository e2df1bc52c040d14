"""Queries over processes, hosts and sessions of the event log, and over its text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import logs
from ..sources import eventlog
from .logs import _LOG, _SUM, _round, log_events

# Sessions and the labels of the processes that have them, first match first.
NODES = [("assign", "master"), ("io", "writer"), ("seg", "worker")]
HOUR = 3_600_000_000


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_events(spark, sf_dir)
    session = F.element_at(F.array(*(F.lit(s) for s, _ in NODES)), ((F.col("pid") + F.col("seq")) % 2 + F.col("pid") % 2 + 1).cast("int"))
    return log.withColumns({"hostName": F.concat(F.lit("n"), (F.col("pid") % 4).cast("string")), "grp": (F.col("pid") % 3).cast("int"), "sessionName": session})


_S = _LOG + """, s as (select *, 'n' || (pid % 4) as hostName, cast(pid % 3 as int) as grp, (['assign', 'io', 'seg'])[(pid + seq) % 2 + pid % 2 + 1] as sessionName from log) """


def src_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as text lines and parsed again."""
    lines = eventlog.format_lines(sessions(spark, sf_dir))
    return eventlog.parse_lines(lines, "v2.1").drop("seq")


def agg_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = logs.aggregate_rows(sessions(spark, sf_dir), ["pid"], ["hostName", "sessionName"])
    return per.select("pid", F.array_join("hostName", ",").alias("hosts"), F.array_join("sessionName", ",").alias("sessions"), logs.node_type(F.col("sessionName"), NODES).alias("node"), "n_events", "first", "last", "data")


def agg_across_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.across_processes(logs.summarize_by_process(log_events(spark, sf_dir)), ["n", "total_ms", "data"])
    return _round(out, *(c for c in out.columns if c != "eventType"), digits=3)


def agg_outcome_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(logs.outcome_mix(log_events(spark, sf_dir), ["click", "view", "error"]), "share", "mean", "std", digits=3)


def agg_time_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.equal_bins(log_events(spark, sf_dir), F.col("startT"), 1000)


def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = sessions(spark, sf_dir)
    return named.groupBy("hostName").pivot("sessionName", [s for s, _ in NODES]).agg(F.count(F.lit(1)).alias("n"), F.sum("attribute").alias("data")).fillna(0)


def win_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(logs.occupancy(log_events(spark, sf_dir), 200_000), "value", digits=9)


def win_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("eventName").isin("click", "view"), "compute").when(F.col("eventName") == "purchase", "io")
    return _round(logs.concurrency(sessions(spark, sf_dir), kind, HOUR), "load", digits=9)


def prj_log_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_events(spark, sf_dir).withColumn("attribute", F.expr("nullif(attribute % 5, 0)"))
    return logs.repair(log, 21, 23, 32, 67_108_864).select("seq", "eventType", F.coalesce("attribute", F.lit(-1)).alias("attribute"))


def join_replace_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"))
    return logs.replace_times(o, li, "o_orderkey", "o_totalprice").select("o_orderkey", F.round("o_totalprice", 1).alias("o_totalprice"))


QUERIES = {f.__name__: f for f in (src_event_log, agg_identifiers, agg_across_processes, agg_outcome_mix, agg_time_bins, agg_pivot, win_occupancy, win_concurrency, prj_log_repair, join_replace_times)}
_ACROSS = ", ".join(f"round(min({c}), 3) as min_{c}, round(max({c}), 3) as max_{c}, round(avg({c}), 3) as mean_{c}, round(stddev_samp({c}), 3) as std_{c}" for c in ("n", "total_ms", "data"))
_PIVOT = ", ".join(f"count(*) filter (sessionName = '{s}') as {s}_n, coalesce(sum(attribute) filter (sessionName = '{s}'), 0)::bigint as {s}_data" for s, _ in NODES)
ORACLE_SQL = {
    "src_event_log": _S + "select cast(pid as int) as pid, hostName, grp, sessionName, eventName, eventType, startT, endT, attribute from s",
    "agg_identifiers": _S + """, a as (select pid, string_agg(distinct hostName, ',' order by hostName) as hosts, string_agg(distinct sessionName, ',' order by sessionName) as sessions, count(*) as n_events,
      min(startT) as first, max(endT) as last, sum(attribute)::bigint as data from s group by pid)
      select pid, hosts, sessions, case when contains(sessions, 'assign') then 'master' when contains(sessions, 'io') then 'writer' else 'worker' end as node, n_events, first, last, data from a""",
    "agg_across_processes": _SUM + f"select eventType, {_ACROSS} from s group by eventType",
    "agg_outcome_mix": _LOG + """, o as (select eventName, (endT - startT + 1)::double as d from log where eventName in ('click', 'view', 'error'))
      select eventName, round(count(*) / (select count(*) from o)::double, 3) as share, round(avg(d), 3) as mean, round(coalesce(stddev_samp(d), 0), 3) as std from o group by eventName""",
    "agg_time_bins": _LOG + """, m as (select min(startT)::double as lo, max(startT)::double as hi from log)
      select eventType, cast(least(floor((startT::double - lo) / (hi - lo) * 1000), 999) as int) as bin, count(*) as n from log, m group by all""",
    "agg_pivot": _S + f"select hostName, {_PIVOT} from s group by hostName",
    "win_occupancy": _LOG + """, b as (select *, unnest(generate_series(cast(ceil(startT / 200000.0) as bigint), cast(ceil(endT / 200000.0) as bigint))) as bucket from log)
      select eventType, bucket, round(sum(least(endT, bucket * 200000) - greatest(startT, (bucket - 1) * 200000 + 1) + 1)::double / 200000, 9) as value from b group by all""",
    "win_concurrency": _S + """, e as (select case when eventName = 'purchase' then 'io' else 'compute' end as cls, hostName as host, startT, endT from s where eventName in ('click', 'view', 'purchase')),
      d as (select cls, host, t, sum(d) as d from (select cls, host, startT as t, 1 as d from e union all select cls, host, endT, -1 from e) group by all),
      l as (select cls, host, sum(d) over (partition by cls, host order by t) as level from d),
      p as (select cls, host, max(level)::bigint as peak from l group by all)
      select cls, host, peak, busy, round(busy / span::double, 9) as load from p join (select cls, host, sum(endT - startT)::bigint as busy, max(endT) - min(startT) as span from e group by all) using (cls, host)""",
    "prj_log_repair": _LOG + """, r as (select seq, eventType, nullif(attribute % 5, 0) as attribute from log)
      select seq, case when eventType = 21 then 23 else eventType end as eventType, coalesce(attribute, case when eventType = 32 then 67108864 else -1 end) as attribute from r""",
    "join_replace_times": """select o_orderkey, round(coalesce(t, o_totalprice), 1) as o_totalprice from orders
      left join (select l_orderkey as o_orderkey, round(sum(l_extendedprice), 2) as t from lineitem where l_returnflag = 'R' group by 1) using (o_orderkey)""",
}
