"""Cutting lineage between the rounds of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a new local one, if the driver is the only machine; else an
    error, as executors couldn't see it."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="tessera-rounds-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def fresh(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted at the end of the driver."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows written in the shared folder and read again, so that a lost executor costs no earlier round. drop() or the
    end of the driver deletes them.

    Joins with the table, or with what is projected, filtered or grouped from it, shuffle: of pixels and labels a file is a
    small part of the rows that it holds, so by its size Spark would send them whole through the driver to all executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = shuffled(spark.read.schema(df.schema).parquet(path))
    out._tessera_path = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """The rows, such that the next join with them shuffles, whatever size Spark guesses."""
    return df.hint("merge")


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() that no later plan reads; other tables are left alone."""
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        spark = _written.pop(path, None)
        if spark is not None:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone by now
            pass
