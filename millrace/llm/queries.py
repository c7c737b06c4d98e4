"""Queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, collocations, decontam, jaccard, kdmeans, langid, license, pieces, quality, suffixdedup, superkmer, tokencount, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(k: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder `fold` by k."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k == fold


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), id_fold(4, 2))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.removed_spans(table(spark, sf_dir, "documents")).drop("kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_fold(3, 1))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.digested(table(spark, sf_dir, "documents"))


def op11_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdmeans.clustered(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_license_scan, op3_token_counts, op4_ngram_jaccard, op5_byte_bpe, op6_quality_rules, op7_decontamination, op8_suffix_array_dedup, op9_toxicity, op10_substring_dedup, op11_phrase_collocation, op12_sentencepiece, op13_centroid_clustering)}
