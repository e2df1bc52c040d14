"""Event-log analytics: events of processes with start and end (µs, inclusive) and an attribute (bytes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summarize_by_process(log: DataFrame) -> DataFrame:
    """Per process and event type, over the dense grid of both (absent pairs are zero): count, min, max and total ms, sum
    of squares, data. Duration is (end - start) / 1000."""
    ms = (F.col("endT") - F.col("startT")) / 1000.0
    some = log.groupBy("pid", "eventType").agg(
        F.count("*").alias("n"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.sum(ms).alias("total_ms"), F.sum(ms * ms).alias("sq_ms"), F.sum("attribute").alias("data"),
    )
    types = log.groupBy().agg(F.sort_array(F.collect_set("eventType")).alias("types"))  # a small fixed domain
    grid = log.select("pid").distinct().join(F.broadcast(types)).select("pid", F.explode("types").alias("eventType"))
    return grid.join(some, ["pid", "eventType"], "left").fillna(0)


def merge_processes(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Partial summaries of processes merged: mean and sample deviation from sums; deviation 0 for counts under 2."""
    s = summary.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"), F.sum("total_ms").alias("total_ms"), F.sum("sq_ms").alias("sq_ms"))
    mean = F.when(F.col("n") > 0, F.col("total_ms") / F.col("n")).otherwise(0.0)
    var = (F.col("sq_ms") - F.col("n") * mean * mean) / F.when(F.col("n") > 1, F.col("n") - 1)
    return s.withColumn("mean_ms", mean).withColumn("std_ms", F.coalesce(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0)))


def resample(log: DataFrame, interval: int, key: str = "eventType") -> DataFrame:
    """Attribute of each event spread over the fixed buckets that it overlaps, in proportion: key, bucket (from 1), value.
    Times count from 1; each event becomes one row a bucket, so no range join is needed."""
    first, last = F.ceil(F.col("startT") / interval), F.ceil(F.col("endT") / interval)
    rows = log.select(key, "startT", "endT", "attribute", F.explode(F.sequence(first, last)).alias("bucket"))
    overlap = F.least(F.col("endT"), F.col("bucket") * interval) - F.greatest(F.col("startT"), (F.col("bucket") - 1) * interval + 1) + 1
    return rows.groupBy(key, "bucket").agg(F.sum(F.col("attribute") * overlap / (F.col("endT") - F.col("startT") + 1)).alias("value"))


def collapse_runs(log: DataFrame, is_start: Column, width: int = 1 << 36) -> DataFrame:
    """Consecutive events of a process from one start event up to the next become one event. A process' time is cut into
    slices of `width`; starts are counted up within a slice, from the count of all earlier ones, so a process with very many
    events is as many tasks as slices, and only one row a slice goes through the window over a process."""
    sliced = log.withColumns({"slice": F.floor(F.col("startT") / width), "begins": is_start.cast("int")})
    per = sliced.groupBy("pid", "slice").agg(F.sum("begins").alias("n"))
    before = per.select("pid", "slice", (F.sum("n").over(Window.partitionBy("pid").orderBy("slice")) - F.col("n")).alias("before"))
    inside = F.sum("begins").over(Window.partitionBy("pid", "slice").orderBy("startT", "seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = sliced.withColumn("inside", inside).join(before, ["pid", "slice"]).withColumn("island", F.col("inside") + F.col("before"))
    return rows.groupBy("pid", "island").agg(F.min("startT").alias("startT"), F.max("endT").alias("endT"), F.max_by("eventName", F.struct("startT", "seq")).alias("last_event"), F.count("*").alias("n_events"))


# What the stages of one tile come to, by the last of them and their number from the first on.
OUTCOMES = {"computeNoFG": ("background", 2), "computeNoNU": ("removeRBC", 6), "computeFull": ("finalCleanup", 8)}


def stage_outcome(collapsed: DataFrame, outcomes: dict[str, tuple[str, int]] = OUTCOMES) -> DataFrame:
    """Runs of collapse_runs() with `outcome`: null for one that stops at another stage or lacks some."""
    found = [F.when((F.col("last_event") == last) & (F.col("n_events") == n), name) for name, (last, n) in outcomes.items()]
    return collapsed.withColumn("outcome", F.coalesce(*found) if found else F.lit(None).cast("string"))


def filter_events(log: DataFrame, fields: dict[str, list], how: str = "AND") -> DataFrame:
    """Value lists are ORed, `~field` negates, fields are joined by AND or OR; unknown fields are ignored; a field given
    both plain and negated is an error."""
    names = {f.lstrip("~") for f in fields}
    if len(names) < len(fields):
        raise ValueError("a field is given both plain and negated")
    terms = [~F.col(f[1:]).isin(v) if f[0] == "~" else F.col(f).isin(v) for f, v in fields.items() if f.lstrip("~") in log.columns]
    if not terms:
        return log
    out = terms[0]
    for t in terms[1:]:
        out = out & t if how == "AND" else out | t
    return log.filter(out)


def throughput(resampled: DataFrame, interval: int, key: str = "eventType", span: int = 1_000_000, slice_buckets: int = 4096) -> DataFrame:
    """Sliding throughput of resampled data (key, bucket, value): the sum over a centred window of `span`, in 2^30 units;
    peak, mean and sample deviation per key over all buckets from 1 to the last one, empty ones included.

    Time is cut into slices of `slice_buckets`. A bucket near a slice's end also goes to the next slice, where it counts in
    sums but gives no rate of its own, so few keys over a long time are still many tasks; the slices' counts, sums and sums
    of squares are merged at the end. A slice makes its own grid of buckets."""
    k = round(span / interval)
    back, ahead = k - 1 - k // 2, k // 2
    last = resampled.groupBy().agg(F.max("bucket").cast("long").alias("last"))
    keys = resampled.select(key).distinct().join(F.broadcast(last))  # one row
    slices = keys.select(key, "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / slice_buckets))).alias("slice"))
    low, high = F.col("slice") * slice_buckets, (F.col("slice") + 1) * slice_buckets - 1
    grid = slices.select(key, "slice", F.explode(F.sequence(F.greatest(low - back, F.lit(1)), F.least(high + ahead, F.col("last")))).alias("bucket"))
    at = F.col("bucket").cast("long")
    reached = F.sequence(F.floor((at - ahead) / slice_buckets), F.floor((at + back) / slice_buckets))
    held = resampled.select(key, at.alias("bucket"), "value", F.explode(reached).alias("slice"))
    w = Window.partitionBy(key, "slice").orderBy("bucket").rowsBetween(-back, ahead)
    dense = grid.join(held, [key, "slice", "bucket"], "left").fillna(0.0, ["value"])
    rate = dense.withColumn("rate", F.sum("value").over(w) / float(1 << 30)).filter((F.col("bucket") >= low) & (F.col("bucket") <= high))
    return rate.groupBy(key).agg(F.max("rate").alias("peak"), F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("std"))


def aggregate_rows(log: DataFrame, keys: list[str], others: list[str]) -> DataFrame:
    """Per key: the sorted distinct values of the other identifiers (small domains such as hosts and sessions), and the
    count, span and data of the events. No keys make one group."""
    sets = [F.sort_array(F.collect_set(c)).alias(c) for c in others]
    return log.groupBy(*keys).agg(*sets, F.count("*").alias("n_events"), F.min("startT").alias("first"), F.max("endT").alias("last"), F.sum("attribute").alias("data"))


def node_type(sessions: Column, layouts: list[tuple[str, str]]) -> Column:
    """The label of the first layout whose session is among the sessions; None if there is none."""
    out = F.lit(None).cast("string")
    for session, label in reversed(layouts):
        out = F.when(F.array_contains(sessions, session), label).otherwise(out)
    return out


def across_processes(summary: DataFrame, columns: list[str]) -> DataFrame:
    """min, max, mean and sample deviation of columns over the processes, per event type; the absent count as zero."""
    return summary.groupBy("eventType").agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))))


def outcome_mix(log: DataFrame, outcomes: list[str]) -> DataFrame:
    """Share, mean and sample deviation of the duration (inclusive) per outcome among the events of those names."""
    d = (F.col("endT") - F.col("startT") + 1).cast("double")
    per = log.filter(F.col("eventName").isin(outcomes)).groupBy("eventName").agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std"))
    total = per.groupBy().agg(F.sum("n").alias("total"))  # one row
    return per.join(F.broadcast(total)).select("eventName", (F.col("n") / F.col("total")).alias("share"), "mean", "std")


def occupancy(log: DataFrame, interval: int, key: str = "eventType") -> DataFrame:
    """Busy time of each bucket as a fraction of its length, summed over the events: key, bucket, value."""
    busy = log.withColumn("attribute", (F.col("endT") - F.col("startT") + 1).cast("double"))
    return resample(busy, interval, key).withColumn("value", F.col("value") / interval)


def concurrency(log: DataFrame, classes: Column, slice_width: int) -> DataFrame:
    """Sweep over starts (+1) and ends (-1): cls, host, peak, busy (sum of active time) and load (busy over the span of
    host and class). `classes` maps events to classes; null ones are left out.

    Time is cut into slices, so that no window holds a whole host: the running sum within a slice starts from the sum of
    all earlier slices, which comes from a window over one row per slice."""
    keys = ["cls", "host"]
    e = log.select(classes.alias("cls"), F.col("hostName").alias("host"), "startT", "endT").filter("cls is not null")
    step = e.select(*keys, F.explode(F.array(F.struct(F.col("startT").alias("t"), F.lit(1).alias("d")), F.struct(F.col("endT").alias("t"), F.lit(-1).alias("d")))).alias("s"))
    delta = step.groupBy(*keys, F.col("s.t").alias("t")).agg(F.sum("s.d").alias("d")).withColumn("slice", F.floor(F.col("t") / slice_width))
    per = delta.groupBy(*keys, "slice").agg(F.sum("d").alias("d"))
    before = per.select(*keys, "slice", (F.sum("d").over(Window.partitionBy(*keys).orderBy("slice")) - F.col("d")).alias("before"))
    inside = F.sum("d").over(Window.partitionBy(*keys, "slice").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    level = delta.withColumn("inside", inside).join(before, [*keys, "slice"]).withColumn("level", F.col("inside") + F.col("before"))
    peak = level.groupBy(*keys).agg(F.max("level").alias("peak"))
    busy = e.groupBy(*keys).agg(F.sum(F.col("endT") - F.col("startT")).alias("busy"), (F.max("endT") - F.min("startT")).alias("span"))
    return peak.join(busy, keys).select(*keys, "peak", "busy", (F.col("busy") / F.when(F.col("span") > 0, F.col("span"))).alias("load"))


def equal_bins(log: DataFrame, value: Column, bins: int, key: str = "eventType") -> DataFrame:
    """Counts in equally wide bins between the least and the greatest value of all rows: key, bin (from 0), n."""
    rows = log.select(key, value.cast("double").alias("v"))
    ends = rows.groupBy().agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return rows.join(F.broadcast(ends)).groupBy(key, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def repair(log: DataFrame, wrong: int, right: int, sized: int, size: int) -> DataFrame:
    """Events of the wrong type relabelled; events of type `sized` without an attribute get the size."""
    kind = F.when(F.col("eventType") == wrong, right).otherwise(F.col("eventType"))
    return log.withColumns({"eventType": kind, "attribute": F.when(kind == sized, F.coalesce("attribute", F.lit(size))).otherwise(F.col("attribute"))})


def replace_times(runs: DataFrame, measured: DataFrame, key: str, column: str) -> DataFrame:
    """The column of runs replaced by the measured one where there is a measurement."""
    got = measured.select(key, F.col(column).alias("_measured"))
    return runs.join(got, key, "left").withColumn(column, F.coalesce("_measured", column)).drop("_measured")


def run_status(text: Column, limit: str) -> Column:
    """How a run ended, by its console text: the first rule that applies; None for a run without an error."""
    # Patterns and their states, in order. The last one takes a whole line, of more lines, that says "fail" or
    # "error" anywhere, so a line with "error" alone is a failure too.
    signal = r"exit signal (Aborted|Terminated|Segmentation fault)"
    return (
        F.when(text.rlike(r"(?i)MPI(CH2)? ERROR"), "MPI ERROR")
        .when(text.rlike(signal), F.regexp_extract(text, signal, 1))
        .when(text.rlike("Invalid argument"), "INVALID ARG")
        .when(text.rlike(r"Other I/O error"), "IO ERROR")
        .when(text.rlike("(?i)exceeded"), F.lit("> " + limit))
        .when(text.rlike(r"(?i)\n.*(fail|error).*\n"), "OTHER FAILURE")
    )
