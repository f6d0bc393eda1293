"""The registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftline.llm.common import table
from siftline.llm.oracle import ORACLE as ORACLE

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.pii import digests, find_personal_data, fit_detector

    docs = table(spark, sf_dir, "documents")
    return digests(find_personal_data(docs, fit_detector(docs)))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.bpe import bpe_encode_decode, digests

    return digests(bpe_encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.language_id import identify_languages, learn_profiles

    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, learn_profiles(docs))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.secrets import digests, scan_secrets

    return digests(scan_secrets(table(spark, sf_dir, "documents")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.quality_classifier import fit, score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.spelling import group_variants

    return group_variants(table(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_language": op2_language,
    "op3_sharding": op3_sharding,
    "op4_pii": op4_pii,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_bpe": op6_bpe,
    "op7_secrets": op7_secrets,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance": op11_importance,
    "op12_spelling": op12_spelling,
    "op13_neighbours": op13_neighbours,
}
