"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import license_scan, mixing, near_dedup, nearest, packing, quality_classifier, quality_rules, sharding, substring_dedup, token_counts
from plumbline.llm.common import read_table
from plumbline.llm.oracles import ORACLES

VOCABULARY = "byte_bpe_50k.json"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(read_table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), window=1024)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"), shards=40)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read_table(spark, sf_dir, "documents")).verdicts()


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality_classifier.resample(docs, labels).verdicts()


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality_rules.judge(docs, labels).drop("class_distance", "word_distance")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path(VOCABULARY), limit=512)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_mixing": op2_mixing,
    "op3_nearest": op3_nearest,
    "op4_packing": op4_packing,
    "op5_sharding": op5_sharding,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
}

__all__ = ["ORACLES", "QUERIES"]
