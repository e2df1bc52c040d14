"""Runs told by their files: parameters written in file names, and console logs of several runs each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.logs import run_status

# Processes of a node, and what holds where a name says nothing.
CORES = 12
DEFAULT = {"type": "TCGA", "layout": "separate", "sys": "keeneland", "transport": "opencv", "buffer": 1, "size": 4096, "blocking": "b"}
SYSTEMS = ("kfs", "jaguar")
# Spellings of the layouts.
LAYOUTS = {"separate": "separate", "sep": "separate", "coloc": "coloc", "baseline": "baseline"}

_STAMP = r"[^\n]* E[DS]T \d{4}"
_RUN = rf"(?m)(?=^{_STAMP}\n(?:mpirun|aprun) )"


def name_parameters(rows: DataFrame, name: str) -> DataFrame:
    """The rows with what a run's file name in the column says, a column a parameter. A name is words between points (and one
    layout behind a point, a minus or a slash): n or p with nodes or processes, f files, a transport, b buffered images, io
    writers, is the size of a group of writers, data the edge of an image, nb for calls that don't block, ost for striped
    storage. Folders and the rest name the system, a push without a master, synthetic images and compression.

    -1 writers or none named: all (null); a group of -1, or of as many as there are writers (in a name without writers, as
    there are buffers): all (null). Processes that are neither master nor writer compute. A name without processes has no
    parameters: all are null."""
    whole = F.trim(name)
    part = lambda pattern: F.nullif(F.regexp_extract(whole, pattern, 1), F.lit(""))
    number = lambda tag: part(rf"\.{tag}(-?\d+)(?=[.\-]|$)").cast("long")
    has = lambda pattern: whole.rlike(pattern)
    read = {tag: number(tag) for tag in ("p", "n", "f", "b", "io", "is", "data")}
    read["layout"] = part(rf"[/.\-]({'|'.join(LAYOUTS)})\.")
    read["transport"] = part(r"\.f-?\d+\.([A-Z][^.]*)\.b\d+")
    read["sys"] = part(rf"({'|'.join(SYSTEMS)})")
    # read once, in a projection of its own
    told = rows.withColumn("_told", F.struct(*(c.alias(tag) for tag, c in read.items())))
    t = F.col("_told")
    spelled = F.create_map(*(F.lit(x) for kv in LAYOUTS.items() for x in kv))
    procs = F.coalesce(t["p"], t["n"] * CORES)
    masters = F.when(has("push"), 0).otherwise(1).cast("long")
    all_of = lambda n: F.when(n != -1, n)
    or_default = lambda c, key: F.coalesce(c, F.lit(DEFAULT[key]))
    fields = {
        "type": F.when(has("syntest"), "synth").otherwise(DEFAULT["type"]), "layout": or_default(spelled[t["layout"]], "layout"), "sys": or_default(t["sys"], "sys"), "n_procs": procs, "n_master": masters,
        "n_compute": procs - masters - F.coalesce(all_of(t["io"]), F.lit(0)), "n_io": all_of(t["io"]), "n_files": t["f"], "transport": or_default(t["transport"], "transport"),
        "buffer_size": or_default(t["b"], "buffer").cast("long"), "io_group_size": F.when(t["is"] != F.coalesce(t["io"], t["b"], F.lit(-1)), all_of(t["is"])), "data_size": or_default(t["data"], "size").cast("long"),
        "blocking": F.when(has(r"\.nb(?=[.\-]|$)"), "nb").otherwise(DEFAULT["blocking"]), "compressed": has("compress"), "striped": has(r"\.osts?(?=[.\-]|$)"),
    }
    return told.select(*rows.columns, *(F.when(procs.isNotNull(), c).alias(k) for k, c in fields.items()))


def stamp(text: Column) -> Column:
    """The local time of a stamp like "Mon Mar  4 05:06:07 EST 2013", with or without its zone; null for another text."""
    found = lambda i: F.regexp_extract(text, r"^\w{3} (\w{3}) {1,2}(\d{1,2}) (\d\d:\d\d:\d\d) (?:E[DS]T )?(\d{4})$", i)
    return F.try_to_timestamp(F.concat_ws(" ", found(1), found(2), found(4), found(3)), F.lit("MMM d yyyy HH:mm:ss"))


def scrape(consoles: DataFrame) -> DataFrame:
    """One row a run of console logs (log, text, ended): log, run (from 0), start, launcher, program, arguments, options (a
    map of the lines "name: value" under "Recognized Options:"), status (null without an error) and finish: the start of the
    next run of the log, or the log's own end; null where the run failed. A log is one row; its runs are split apart at their
    stamps. Text before the first run belongs to none."""
    runs = consoles.select("log", "ended", F.posexplode(F.filter(F.split("text", _RUN), lambda x: x.rlike(rf"\A{_STAMP}\n(mpirun|aprun) "))).alias("run", "said"))
    head = lambda i: F.regexp_extract("said", rf"\A({_STAMP})\n(mpirun|aprun) (?:[^\n]*? )??(\S+\.exe) ?([^\n]*)\n", i)
    told = F.regexp_extract("said", r"(?s)Recognized Options:\n(.*?)(?:dir to create:|\z)", 1)
    pairs = F.transform(F.regexp_extract_all(told, F.lit(r"(?m)^\s*([\w\-]+\s*:[^\n]*)$"), 1), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    # a name said twice counts as said last
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    rows = runs.select("log", "run", stamp(head(1)).alias("start"), head(2).alias("launcher"), head(3).alias("program"), head(4).alias("arguments"), F.map_from_entries(last).alias("options"), run_status(F.col("said"), "limit").alias("status"), "ended")
    after = F.coalesce(F.lead("start").over(Window.partitionBy("log").orderBy("run")), F.col("ended"))
    return rows.withColumn("finish", F.when(F.col("status").isNull(), after)).drop("ended")


def read_consoles(spark: SparkSession, path: str, glob: str = "*.o[12]*") -> DataFrame:
    """Console logs under a path, one row a file that isn't empty: log, text, ended (the file's last change)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("log"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("ended")).filter(F.length("text") > 0)
