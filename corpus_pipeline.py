"""The corpus pipeline: five operators, one after the other, over the documents of a folder.

`STAGES` lists (name, function); each function takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bytebpe, decontam, jaccard, superkmer, toxicity
from millrace.llm._common import discard, settled
from millrace.llm.queries import id_fold, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score stays under the threshold."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"), id_fold(3, 1))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id."""
    return jaccard.kept(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; words in passages that stand elsewhere too are taken out of their texts."""
    return superkmer.applied(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes that they decode to."""
    return bytebpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can't express the first stage (a fitted model); the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again by the next; what a stage
    leaves besides, and its input, is deleted once it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(functools.partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
