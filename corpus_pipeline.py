"""A training-corpus pipeline over `documents`: each stage works on all that its predecessor kept.

Quality first, then one document per near-duplicate group, then documents with benchmark passages go, secrets are
replaced, and what is left is encoded. All but the last stage return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathmix.llm import bpe, common, decontamination, minhash, quality, secrets


def importance_resampling(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Gumbel top-k over importance weights keeps."""
    return quality.filtered(docs, common.table(spark, sf_dir, "labels"))


def chosen_path_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash.representatives(docs, percent=80, width=5)


def suffix_array_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontamination.remove(docs, common.table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark, n_chars set anew."""
    return secrets.redact(docs)


def backtracking_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the token ids of each document."""
    return bpe.encode_decode(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("importance_resampling", importance_resampling),
    ("chosen_path_dedup", chosen_path_dedup),
    ("suffix_array_decontamination", suffix_array_decontamination),
    ("secret_redaction", secret_redaction),
    ("backtracking_bpe", backtracking_bpe),
]

#: SQL can express neither the models and draws of the first stage nor the encoder; a test compares with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each one's rows are written to the shared folder and read again as the next one's."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.settle(docs)
    return docs
