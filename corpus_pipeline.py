"""A corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before has kept. All but the last give
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, lines, neardup, pieces, toxicity
from tessera.llm.common import cut, drop_cut, table

#: Score from which a document is rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), TOXIC)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("minhash", dedup_near), ("decontamination", decontaminate_benchmark), ("sentencepiece", encode)]

#: SQL can't express the stages; each operator is tested against brute force, and the run for what must and mustn't be left.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            made = cut(made)
            drop_cut(docs)
        docs = made
    return docs
