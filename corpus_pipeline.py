"""A corpus pipeline of five stages: language ID, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import op1_pii, op3_similar, op5_langid, op7_packing, op10_suffix
from auditloom.llm._store import drop, keep, save, temporary
from auditloom.llm.queries import BYTE_BPE, table, tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language of the corpus explains; the others go. Their labels fit the text model, so they are no evidence as well."""
    return op5_langid.filter_documents(docs, op5_langid.fit(docs), declared_col=None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles or more."""
    return op3_similar.drop_similar(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that also start elsewhere; all documents stay."""
    return op10_suffix.remove_repeats(docs, length_col="n_chars")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; all documents stay."""
    return op1_pii.sanitise(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens."""
    return op7_packing.pack_documents(docs, tokenizer_file(BYTE_BPE))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packing),
]

#: No SQL expresses SimHash components over XXH64 or the packing programme; tests/llm compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, one after the other, each reread from the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary():
            kept = keep(save(stage(spark, docs, sf_dir), name))
        drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
