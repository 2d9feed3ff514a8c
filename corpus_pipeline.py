"""Corpus preparation: the operators of ``flowspark.llm`` in a row over ``documents``.

Each stage takes all that the one before it kept.  The first four return the columns of
``documents``; the last returns one row for each training sequence with the documents in it.
"""

from __future__ import annotations

from flowspark.llm import mixing, queries, shingle_sets, simhash, string_tiling, toxicity, training_order
from flowspark.llm.common import clear, made, scratch, table
from pyspark.sql import DataFrame, SparkSession


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts within four bits, and then of those with five-word Jaccard similarity 0.8, one each."""
    prints, _, roots = simhash.grouped(docs)
    return simhash.keep_one(docs, prints, shingle_sets.near_copies(docs, simhash.firsts(prints, roots)))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return string_tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, mixing.drawn(docs))


def order_for_training(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks, pattern, eos = queries.byte_vocabulary()
    return training_order.ordered_digest(docs, ranks, pattern, eos)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix_sources),
    ("training_order", order_for_training),
]

#: SQL can express neither the trees nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    home = scratch(spark, "pipeline")
    for name, stage in STAGES:
        mark = made()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{home}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{home}/{name}")
        clear(spark, mark)  # what the stage stored on the way
    return docs
