"""Event logs as text: one line per process and session, with its events appended.

The first line of a file names the version. Version 1 has events of four fields (name, type, start, end), version 2 adds an
attribute and version 2.1 also a group. A missing attribute is 0. Blank lines, `#` comments and lines of anything else are
passed over; a process without events gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields before the first event, and fields an event, by version.
LAYOUT = {"v1": (6, 4), "v2": (6, 5), "v2.1": (8, 5)}
UNSUPPORTED = ("v2.2", "v3.0")
EVENT = "array<struct<eventName:string,eventType:int,startT:bigint,endT:bigint,attribute:bigint>>"


def version(header: Column) -> Column:
    """The version that a first line names; None for those that aren't supported."""
    named = F.when(header.startswith("v2.1"), "v2.1").when(header.startswith("v2"), "v2").otherwise("v1")
    return F.when(~(header.startswith(UNSUPPORTED[0]) | header.startswith(UNSUPPORTED[1])), named)


def _number(x: Column, kind: str) -> Column:
    return F.coalesce(x.try_cast(kind), F.lit(0).cast(kind))


def _parse(lines: DataFrame, head: Column, width: Column, grouped: Column) -> DataFrame:
    """Events of lines whose version gives the fields before the first event, the fields an event and whether there is a
    group. A line is split once, then taken apart inside one array function; each event is a slice of it."""
    others = [c for c in lines.columns if c != "value"]

    def line(part: Column) -> Column:
        at = lambda i: F.try_element_at(part, F.lit(i))
        n = F.floor((F.size(part) - head) / width).cast("int")
        # a last attribute may lack its closing comma, or be left out together with it
        n = F.when((width == 5) & ((F.size(part) - head) % width == width - 1), n + 1).otherwise(n)
        events = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(part, head + 1 + i * width, width)))
        grp, session = F.when(grouped, at(6).try_cast("int")), F.when(grouped, at(8)).otherwise(at(6))
        return F.struct(at(2).try_cast("int").alias("pid"), at(4).alias("hostName"), grp.alias("grp"), session.alias("sessionName"), events.alias("events"))

    rows = lines.filter(F.trim("value").startswith("pid,")).select(*others, F.explode(F.transform(F.array(F.split("value", ",")), line)).alias("l"))
    flat = rows.select(*others, "l.pid", "l.hostName", "l.grp", "l.sessionName", F.posexplode("l.events").alias("seq", "e"))
    field = lambda k: F.try_element_at("e", F.lit(k))
    return flat.filter(field(1) != "").select(
        *others, "pid", "hostName", "grp", "sessionName", "seq", field(1).alias("eventName"), field(2).try_cast("int").alias("eventType"),
        field(3).try_cast("bigint").alias("startT"), field(4).try_cast("bigint").alias("endT"), _number(field(5), "bigint").alias("attribute"),
    )


def parse_lines(lines: DataFrame, known: str) -> DataFrame:
    """Events of the lines (column `value`; other columns are kept) of one version: pid, hostName, grp, sessionName, seq
    (from 0 within the line), eventName, eventType, startT, endT, attribute. Works on batches and streams."""
    head, width = LAYOUT[known]
    return _parse(lines, F.lit(head), F.lit(width), F.lit(known == "v2.1"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All events of the files under a path, with their file as `experiment`. Files of unsupported versions give none."""
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("experiment"))
    lines = lines.filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    heads = lines.filter(F.col("value").rlike(r"^v\d")).groupBy("experiment").agg(F.min("value").alias("head"))
    known = lines.join(heads, "experiment", "left").withColumn("version", version(F.coalesce("head", F.lit("")))).drop("head")
    by_version = lambda of: F.coalesce(*(F.when(F.col("version") == v, of(v)) for v in LAYOUT))
    supported = known.filter(F.col("version").isNotNull())
    return _parse(supported, by_version(lambda v: LAYOUT[v][0]), by_version(lambda v: LAYOUT[v][1]), F.col("version") == "v2.1").drop("version")


def read_stream(spark: SparkSession, path: str, known: str = "v2.1", files_per_trigger: int = 64) -> DataFrame:
    """Events of files as they arrive, all of one version."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select("value", F.col("_metadata.file_path").alias("experiment"))
    return parse_lines(lines, known)


def format_lines(log: DataFrame) -> DataFrame:
    """One version 2.1 line per event (column `value`), so that no process is gathered into one row. Parsing gives the
    same events; each is number 0 of its line."""
    return log.select(F.concat_ws(",", F.lit("pid"), "pid", F.lit("hostName"), "hostName", F.lit("group"), "grp", F.lit("sessionName"), "sessionName", "eventName", "eventType", "startT", "endT", "attribute", F.lit("")).alias("value"))
