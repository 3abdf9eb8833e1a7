"""One query for each operator, with production parameters, over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import op1_pii, op2_secrets, op3_simhash, op4_chat, op5_langid, op6_sentencepiece, op7_packing, op8_ann, op9_embedding_dedup, op10_suffix, op11_resample, op12_bpe, op13_repair

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file: in the folder AUDITLOOM_TOKENIZERS if that is set, else where the vocabularies are installed."""
    if folder := os.environ.get("AUDITLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii.pii_digests(table(spark, sf_dir, "documents"))


def op2_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_secrets.scan_digests(table(spark, sf_dir, "documents"))


def op3_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_chat.format_chats(op4_chat.with_probe(table(spark, sf_dir, "conversations")), tokenizer_file(BYTE_BPE))


def op5_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = op5_langid.fit(table(spark, sf_dir, "documents"))
    return op5_langid.identify_pages(table(spark, sf_dir, "pages"), model)


def op6_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_sentencepiece.encode(table(spark, sf_dir, "documents"), tokenizer_file(PIECES))


def op7_packing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE))


def op8_ann_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_ann.nearest(table(spark, sf_dir, "embeddings"), every=20)


def op9_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_suffix.repeat_digests(table(spark, sf_dir, "documents"))


def op11_importance_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_bpe.codec_digests(table(spark, sf_dir, "documents"), tokenizer_file(RANKS))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_repair.repair(op13_repair.damage(table(spark, sf_dir, "conversations")), present="present")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_disclosure": op1_pii_disclosure,
        "op2_secret_entropy": op2_secret_entropy,
        "op3_simhash_gray": op3_simhash_gray,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_language_evidence": op5_language_evidence,
        "op6_sentencepiece_codec": op6_sentencepiece_codec,
        "op7_packing_windows": op7_packing_windows,
        "op8_ann_cross_polytope": op8_ann_cross_polytope,
        "op9_embedding_forest": op9_embedding_forest,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_importance_tries": op11_importance_tries,
        "op12_bpe_chunks": op12_bpe_chunks,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_entropy": op2_secrets.ORACLE_SQL}
