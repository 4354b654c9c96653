"""The operators applied to their whole tables with production parameters, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, backoff, language, line_runs, media, mixing, passages, pieces, ranking, repair, simhash, token_counts, toxicity
from .common import table

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.fuzzy_passages(table(spark, sf_dir, "documents"))


def op7_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.backoff_scores(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.line_report(table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_nearest, op4_token_counts, op5_mixture, op6_passages, op7_backoff_scores, op8_media_columns, op9_line_dedup, op10_pieces, op11_language, op12_conversation_repair, op13_ranked_search, pipeline)}
ORACLE_SQL = {"op3_nearest": ann.ORACLE, "op5_mixture": mixing.ORACLE, "op7_backoff_scores": backoff.ORACLE, "op9_line_dedup": line_runs.ORACLE, "op13_ranked_search": ranking.ORACLE}
