"""Registered queries ``opN_<name>`` over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseek.llm import ann, chat, decontaminate, fim, licenses, lines, packing, pieces, quality, secrets, simhash, substring, whitening


#: The model of operator 13, by its name among the public tokenizers.
PIECE_MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recurring line templates leave of every document."""
    return lines.line_dedup(_table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of every piece of every document; near-duplicates, as operator 7 finds them, are one cluster."""
    return packing.pack_rows(packing.near_clusters(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts of every document."""
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, found or inherited."""
    files = _table(spark, sf_dir, "documents").select("doc_id", licenses.document_path().alias("path"), "text")
    return licenses.scan_licenses(files)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat an earlier passage."""
    return substring.substring_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(chat.PROBE_TEXT).alias("text"),
    )
    return chat.chat_digests(turns.union(probe))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in its middle, as digests."""
    return fim.fim_digests(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened components of every vector."""
    return whitening.whitening_report(_table(spark, sf_dir, "embeddings"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    return pieces.piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_line_dedup,
        op3_nearest_neighbours,
        op4_best_fit_packing,
        op5_secret_scan,
        op6_decontamination,
        op7_simhash_near_dedup,
        op8_license_scan,
        op9_substring_dedup,
        op10_chat_format,
        op11_fill_in_middle,
        op12_embedding_whitening,
        op13_sentencepiece,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": lines.ORACLE_SQL,
    "op5_secret_scan": secrets.oracle_sql(),
    "op8_license_scan": licenses.oracle_sql(),
    "op10_chat_format": chat.ORACLE_SQL,
    "op11_fill_in_middle": fim.ORACLE_SQL,
}
