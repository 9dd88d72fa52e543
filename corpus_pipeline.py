"""From raw documents to packed training sequences, stage by stage.

Each stage works on all rows its predecessor kept.  All but the last return the columns of
``documents``; ``run`` writes what a stage returns as Parquet and rereads it for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spillway.llm import mixing, packing, quality_model, repetition, simhash
from spillway.llm.queries import LEVELS, WEIGHTS
from spillway.llm.storage import stored, workers_find_package

#: No document twice, and nine tenths of the tokens that are left.
MIX = mixing.Mix(LEVELS, WEIGHTS, share=0.9, epochs=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; null, empty and short texts go."""
    return repetition.passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least one half.  It learns from the labelled ones
    among them, outside the held-out fold; without any it keeps all."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.accepted(docs, quality_model.fit_quality(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints differ in at most 2 bits."""
    return simhash.one_per_group(docs, size=3, most_bits=2)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's token budget from one seeded epoch."""
    return mixing.mixed(docs, MIX, "_epoch").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``: sequences of at most 1024 ids."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: SQL has no boosted trees, no XXH64 and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the ``documents`` of ``sf_dir``."""
    workers_find_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
