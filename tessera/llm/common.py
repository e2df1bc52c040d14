"""Small helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that a task turns into Python objects at a time.
SLICE_ROWS = 512
#: Characters or bytes of output after which a task hands a batch on.
FLUSH_SIZE = 4_000_000

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset, a new local one, if the driver
    is the only machine; else an error, as executors couldn't see it."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write a table in the shared folder and read it again: later stages no longer depend on the executors that made
    it. The table is dropped by drop_cut() or at the end of the driver."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Drop a table of cut() that no later plan reads."""
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


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut smaller, so that few rows are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hashes of words, kept for up to `most` words at a time; the same in every process."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (finalizer of a multiply-xorshift hash)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bit_words(df: DataFrame, bits: list[Column], n_bits: int) -> np.ndarray:
    """A bitmap of n_bits with the given bits (long columns) of every row set, as 64-bit words. Spark makes it; at most
    n_bits / 64 words come to the driver, whatever the rows."""
    one = df.select(F.explode(F.array(*bits)).alias("bit"))
    words = one.groupBy((F.col("bit") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    out = np.zeros(n_bits // 64, np.int64)
    got = words.toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def has_bit(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the bits (uint64) are set."""
    return (words.view(np.uint64)[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63)) & np.uint64(1)).astype(bool)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
