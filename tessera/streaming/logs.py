"""Event logs as streams: throughput per time bucket, sliding throughput and running totals per session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pieces(log: DataFrame, interval: int) -> DataFrame:
    """Each event cut at the bucket borders: one row per bucket with its share of the attribute and `ts`, the bucket's
    start (µs from the log's start) as a timestamp. Times count from 1."""
    first, last = F.ceil(F.col("startT") / interval), F.ceil(F.col("endT") / interval)
    rows = log.withColumn("bucket", F.explode(F.sequence(first, last)))
    overlap = F.least(F.col("endT"), F.col("bucket") * interval) - F.greatest(F.col("startT"), (F.col("bucket") - 1) * interval + 1) + 1
    share = F.col("attribute") * overlap / (F.col("endT") - F.col("startT") + 1)
    return rows.withColumn("share", share).withColumn("ts", F.timestamp_micros((F.col("bucket") - 1) * interval))


def resample(log: DataFrame, interval: int, late: str = "1 minute", key: str = "eventType") -> DataFrame:
    """Data per tumbling bucket and key: key, start, value. Pieces more than `late` behind are dropped."""
    return _windows(pieces(log, interval), key, late, f"{interval} microseconds", None)


def throughput(log: DataFrame, interval: int, span: str = "1 second", late: str = "1 minute", key: str = "eventType") -> DataFrame:
    """Data per sliding window of `span`, moved on by one bucket at a time."""
    return _windows(pieces(log, interval), key, late, span, f"{interval} microseconds")


def _windows(rows: DataFrame, key: str, late: str, span: str, slide: str | None) -> DataFrame:
    out = rows.withWatermark("ts", late).groupBy(key, F.window("ts", span, slide).alias("w")).agg(F.sum("share").alias("value"))
    return out.select(key, F.col("w.start").alias("start"), "value")


def running_totals(log: DataFrame) -> DataFrame:
    """Events, time and data per session and event name so far, for output mode update or complete. The state is one row
    per session and name."""
    ms = (F.col("endT") - F.col("startT") + 1) / 1000.0
    return log.groupBy("sessionName", "eventName").agg(F.count("*").alias("n"), F.sum(ms).alias("total_ms"), F.sum("attribute").alias("data"))
