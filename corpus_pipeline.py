"""Cleaning pipeline over ``documents``: each stage reads what its predecessor kept and writes Parquet.

Stages, in order: the quality classifier drops what it rejects; of equal texts the smallest
id stays; of near-duplicate groups one document stays; repeated passages are cut from all but
the first document that has them; the rest is packed into token sequences. All but the last
return the columns of ``documents``.

Defined results: rows are kept or dropped one by one, never by id alone; null texts count as empty
and are scored and compared like others; null ids come last where the smallest id stays, and their
texts are not cut; of rows repeated with id and text one stays; further columns, whatever their
names, are passed on. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import exact_dedup, near_dedup, packing, quality, registry, scratch, substring_dedup


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, registry.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: Classifier, near duplicates and tokens have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``; each stage's result is written and read again."""
    docs = registry.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.written(docs, f"stage-{name}")
    return docs
