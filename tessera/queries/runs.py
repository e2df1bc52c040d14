"""Queries over runs; the driver's orders play runs, its customers console logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import logs
from ..sources import runs
from .logs import _LOG, log_events

_LAYOUT, _SYSTEM, _TRANSPORT = ["separate", "coloc", "baseline"], ["keeneland", "kfs", "jaguar"], ["MPI_AMR", "POSIX", "NULL"]
_SAID = ["done\n", "all fine\n", "x\nMPICH2 ERROR\ny\n", "_pmii: exit signal Aborted\n", "walltime exceeded\n", "a\nfailed to open\nb\n"]


def _pick(values: list[str], by: str):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.expr(by) % len(values) + 1).cast("int"))


def src_run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of an order's numbers, and read; -1 stands for all."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c"))
    folder = F.concat(F.lit("/data/"), _pick(_SYSTEM, "c"), F.when(F.expr("k % 7 = 0"), "-compressed/").otherwise("-runs/"))
    front = F.concat(F.lit("set."), _pick(_LAYOUT, "k"), F.when(F.expr("k % 5 = 0"), ".push").otherwise(""), F.when(F.expr("k % 2 = 0"), ".n").otherwise(".p"), F.expr("cast(c + 100 as string)"), F.expr("'.f' || (k * 3)"))
    tuned = F.concat(F.lit("."), _pick(_TRANSPORT, "c"), F.expr("'.b' || (c % 4 + 1)"), F.expr("case when k % 3 = 0 then '.io' || (if(c % 6 = 0, -1, c % 60 + 1)) || '-1' else '' end"), F.expr("'.is' || (if(c % 11 = 0, -1, c % 30 + 1))"))
    back = F.expr("case when k % 3 = 2 then '' when c % 2 = 0 then '.data2048.nb' else '' end || if(k % 4 = 0, '.ost', '')")
    name = F.concat(folder, front, F.when(F.expr("k % 3 = 2"), "").otherwise(tuned), back)
    return runs.name_parameters(o.select("k", name.alias("name")), "name").drop("name").fillna(-1, ["n_io", "io_group_size"])


def src_run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders written as runs of one console log, and scraped."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("long").alias("log"), F.col("o_orderkey").cast("long").alias("k"))
    at = F.timestamp_seconds(F.lit(1_357_000_000) + F.col("k") * 61)
    stamp = F.concat(F.date_format(at, "EEE MMM "), F.lpad(F.date_format(at, "d"), 2, " "), F.date_format(at, " HH:mm:ss"), F.when(F.col("k") % 2 == 0, " EST ").otherwise(" EDT "), F.date_format(at, "yyyy"))
    said = F.concat(stamp, F.when(F.col("k") % 3 == 0, "\naprun").otherwise("\nmpirun"), F.expr("' -n ' || (k % 90) || ' ./seg-' || (k % 4) || '.exe in out ' || k || '\\nRecognized Options:\\n  size : ' || (k % 9) || '\\n  mode: m:' || (k % 5) || '\\ndir to create: d\\n'"), _pick(_SAID, "k"))
    text = F.concat(F.lit("loading modules\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", said.alias("said")))), lambda x: x["said"]), ""))
    made = runs.scrape(o.groupBy("log").agg(text.alias("text"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("ended")).withColumn("ended", F.col("ended").cast("timestamp")))
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return made.select("log", "run", when("start"), "launcher", "program", "arguments", F.col("options")["size"].alias("size"), F.col("options")["mode"].alias("mode"), "status", when("finish"))


def prj_stage_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from one click up to the next, told by their last kind and their number."""
    made = logs.collapse_runs(log_events(spark, sf_dir), F.col("eventName") == "click")
    told = logs.stage_outcome(made, {"seen": ("view", 2), "bought": ("purchase", 3), "left": ("click", 1)})
    return told.select("pid", "island", "startT", "endT", F.coalesce("outcome", F.lit("none")).alias("outcome"))


QUERIES = {f.__name__: f for f in (src_run_names, src_run_logs, prj_stage_outcome)}
_OUT = "k % 3 <> 2"
ORACLE_SQL = {
    "prj_stage_outcome": _LOG + """, i as (select *, sum((eventName = 'click')::int) over (partition by pid order by startT, seq rows unbounded preceding)::bigint as island from log),
      g as (select pid, island, min(startT) as startT, max(endT) as endT, arg_max(eventName, (startT, seq)) as last, count(*) as n from i group by pid, island)
      select pid, island, startT, endT, case when last = 'view' and n = 2 then 'seen' when last = 'purchase' and n = 3 then 'bought' when last = 'click' and n = 1 then 'left' else 'none' end as outcome from g""",
    "src_run_names": f"""with o as (select o_orderkey::bigint as k, o_custkey::bigint as c from orders),
      n as (select *, case when k % 2 = 0 then 12 else 1 end * (c + 100) as procs, case when k % 5 = 0 then 0 else 1 end::bigint as masters, case when k % 3 = 0 and c % 6 <> 0 then c % 60 + 1 end as writers,
        case when {_OUT} and c % 11 <> 0 then c % 30 + 1 end as g, case when k % 3 = 0 then case when c % 6 = 0 then -1 else c % 60 + 1 end else c % 4 + 1 end as than from o)
      select k, 'TCGA' as type, ({_LAYOUT})[k % 3 + 1] as layout, ({_SYSTEM})[c % 3 + 1] as sys, procs as n_procs, masters as n_master, procs - masters - coalesce(writers, 0) as n_compute, coalesce(writers, -1) as n_io, k * 3 as n_files,
        case when {_OUT} then ({_TRANSPORT})[c % 3 + 1] else 'opencv' end as transport, case when {_OUT} then c % 4 + 1 else 1 end as buffer_size, case when g <> than then g else -1 end as io_group_size,
        case when {_OUT} and c % 2 = 0 then 2048 else 4096 end::bigint as data_size, case when {_OUT} and c % 2 = 0 then 'nb' else 'b' end as blocking, k % 7 = 0 as compressed, k % 4 = 0 as striped from n""",
    "src_run_logs": """with o as (select o_custkey::bigint as log, o_orderkey::bigint as k, strftime(timestamp '1970-01-01' + to_seconds(1357000000 + o_orderkey::bigint * 61), '%Y-%m-%d %H:%M:%S') as start,
        ([null, null, 'MPI ERROR', 'Aborted', '> limit', 'OTHER FAILURE'])[o_orderkey % 6 + 1] as status from orders)
      select log, (row_number() over w - 1)::int as run, start, case when k % 3 = 0 then 'aprun' else 'mpirun' end as launcher, './seg-' || (k % 4) || '.exe' as program, 'in out ' || k as arguments,
        (k % 9)::varchar as size, 'm:' || (k % 5) as mode, status, case when status is null then coalesce(lead(start) over w, '2020-01-01 00:00:00') end as finish from o window w as (partition by log order by k)""",
}
