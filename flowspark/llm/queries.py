"""The training-data queries, one for each operator, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, html_blocks, line_dedup, mixing, personal_data, quality_rules, secret_scan, simhash, string_tiling, token_count, toxicity, training_order, turn_repair
from .common import table

#: Folder of the tokenizers' vocabulary files, and the files that the queries take.
TOKENIZERS = os.environ.get("FLOWSPARK_TOKENIZERS", "/opt/tokenizers")
UNIGRAM_FILE, BYTE_FILE, BYTE_EOS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken", 50256
#: Fixed value: how the vocabulary of BYTE_FILE cuts a text before it merges bytes.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_vocabulary(folder: str = TOKENIZERS) -> tuple[dict[bytes, int], str, int]:
    return training_order.load_ranks(os.path.join(folder, BYTE_FILE)), BYTE_PATTERN, BYTE_EOS


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_main_text(table(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_count.load_vocabulary(os.path.join(TOKENIZERS, UNIGRAM_FILE))
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find(table(spark, sf_dir, "documents")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern, eos = byte_vocabulary()
    return training_order.ordered_digest(table(spark, sf_dir, "documents"), ranks, pattern, eos)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, shifted)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_shared_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.digest(turn_repair.repair(turn_repair.damage(conversations)), conversations)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_mix_sources": op2_mix_sources,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_personal_data": op5_personal_data,
    "op6_decontaminate": op6_decontaminate,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_training_order": op9_training_order,
    "op10_simhash": op10_simhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_line_dedup": op12_line_dedup,
    "op13_turn_repair": op13_turn_repair,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {"op2_mix_sources": mixing.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op12_line_dedup": line_dedup.ORACLE_SQL}
