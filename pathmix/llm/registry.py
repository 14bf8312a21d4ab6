"""The thin queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import attribution, bpe, common, decontamination, htmltext, minhash, pii, quality, secrets, sharding, vectors


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(common.table(spark, sf_dir, "documents"))


def op2_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.table(spark, sf_dir, "documents"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.keep(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op4_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(common.table(spark, sf_dir, "pages"))


def op5_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op6_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(common.table(spark, sf_dir, "documents"))


def op7_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(common.table(spark, sf_dir, "documents"))


def op8_subspace_pigeonhole_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op9_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(common.table(spark, sf_dir, "documents"))


def op10_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


_OPERATORS = (
    op1_token_attribution, op2_bounded_ring_shards, op3_importance_resampling, op4_site_style_tree, op5_suffix_array_decontamination,
    op6_randomness_battery, op7_backtracking_bpe, op8_subspace_pigeonhole_join, op9_boosted_candidates, op10_chosen_path_join, pipeline,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
#: None of these is expressible in SQL with all its parts; tests/llm compares each with a brute-force version.
ORACLES: dict[str, str] = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
