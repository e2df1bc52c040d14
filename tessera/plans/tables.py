"""Small relational operations on any table: matching by key, masks as sets, projection, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_indices(a: DataFrame, b: DataFrame, key: str, index: str) -> DataFrame:
    """For every row of a, the sorted indices of the rows of b with its key (none: an empty list). b is grouped first, so a key
    that many rows of a have is joined once each, not with every duplicate."""
    lists = b.groupBy(key).agg(F.sort_array(F.collect_list(index)).alias("matches"))
    return a.join(lists, key, "left").withColumn("matches", F.coalesce("matches", F.array().cast(lists.schema["matches"].dataType)))


def combine_masks(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The pixels that are set in a or b (tables of set pixels), with the columns both, either, one (alone) and first (alone)."""
    every = a.select(*keys, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(*keys, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    got = every.groupBy(*keys).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    p, q = F.col("in_a") == 1, F.col("in_b") == 1
    return got.select(*keys, (p & q).alias("both"), (p | q).alias("either"), (p != q).alias("one"), (p & ~q).alias("first"))


def project(df: DataFrame, wanted: list[str] | str) -> DataFrame:
    """The wanted columns that the table has, in the order wanted; none or "*" mean all."""
    if not wanted or wanted == "*" or "*" in wanted:
        return df
    return df.select(*(c for c in wanted if c in df.columns))


def without(df: DataFrame, dropped: list[str]) -> DataFrame:
    """The table without some columns."""
    return df.select(*(c for c in df.columns if c not in dropped))


def largest_groups(df: DataFrame, key: str, most: int) -> DataFrame:
    """The groups of most rows, in order of rows (most first), then key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)


def distinct_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Number of distinct values per column."""
    return df.groupBy(*keys).agg(*(F.countDistinct(c).alias(f"n_{c}") for c in columns))


def label_to_mask(label: Column, x: Column, y: Column, width: int, height: int, border: bool = True) -> Column:
    """255 for any label, else 0; without border, pixels at the edge of the tile are 0."""
    inside = F.lit(True) if border else (x > 0) & (y > 0) & (x < width - 1) & (y < height - 1)
    return F.when((label != 0) & inside, 255).otherwise(0)
