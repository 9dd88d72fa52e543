"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    attribution,
    hard_negatives,
    huffman,
    itq,
    lattice_lm,
    licenses,
    mixing,
    packing,
    quality_model,
    repetition,
    simhash,
    suffix_dedup,
    whitening,
)
from .statements import STATEMENTS
from .storage import workers_find_package
from .texts import documents

#: Domains are groups of sources; large ones weigh more, and no document is taken more than twice.
DOMAINS = """CASE pmod(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 4)
    WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forums' WHEN 3 THEN 'news' ELSE 'other' END"""
LEVELS = (("domain", DOMAINS), ("lang", "lang"), ("source", "source"))
WEIGHTS = {
    "domain": {"web": 4, "books": 3, "forums": 1, "news": 2},
    "lang": {"en": 6, "de": 2, "fr": 2},
}
MIX = mixing.Mix(LEVELS, WEIGHTS, share=1.0, epochs=2)


def op1_lattice_lm(spark: SparkSession, folder: str) -> DataFrame:
    pieces = lattice_lm.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    return lattice_lm.lattice_scores(documents(spark, folder), pieces)


def op2_huffman_ids(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    read = huffman.ids_written_and_read(documents(spark, folder), path, False, 1)
    return read.selectExpr(
        "doc_id", "start", "length(ids) DIV 4 AS n_tokens", "crc32(ids) AS ids_crc32"
    )


def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.mixed(documents(spark, folder), MIX)
    return taken.selectExpr(
        "doc_id",
        f"{DOMAINS} AS domain",
        "coalesce(lang, '(none)') AS lang",
        "coalesce(source, '(none)') AS source",
        f"CAST({MIX.tokens} AS BIGINT) AS n_tokens",
        "epoch",
    )


def op4_token_attribution(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return attribution.attributed_tokens(documents(spark, folder), path)


def op5_quality_gbt(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    return quality_model.quality_scores(docs, quality_model.fit_quality(docs, labels))


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    keep = ("doc_id", "piece", "start", "length", "crc32(ids) AS ids_crc32")
    return packing.packed_documents(documents(spark, folder), path, 2, keep=keep)


def op7_repetition_rules(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetition_rules(documents(spark, folder))


def op8_itq_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return itq.near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(documents(spark, folder)).drop("spans")


def op10_simhash_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_near_duplicates(documents(spark, folder)).selectExpr(
        "doc_id", "lower(lpad(hex(fingerprint), 16, '0')) AS fingerprint", "component_id"
    )


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """A row per vector and component; ``deviation`` is null where it is beyond a long."""
    rows = whitening.whitened(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return rows.select("*", F.posexplode("whitened").alias("place", "value")).selectExpr(
        "vec_id",
        "place + 1 AS component",
        "n",
        "try_cast(deviation AS BIGINT) AS deviation",
        "value AS whitened",
        "explained[place] AS explained",
        "identity_error",
    )


def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, folder)).selectExpr(
        "doc_id",
        "n_bytes",
        "n_bytes - length(kept) AS n_removed",
        "CAST(size(spans) AS BIGINT) AS n_spans",
        "sha2(kept, 256) AS kept_sha256",
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    moved = "CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
    return hard_negatives.hard_negatives(vectors, label_rule=moved)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def _registered(*found):
    def ready(query):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            workers_find_package(spark)
            return query(spark, folder)

        return run

    return {query.__name__: ready(query) for query in found}


QUERIES = _registered(
    op1_lattice_lm,
    op2_huffman_ids,
    op3_source_mix,
    op4_token_attribution,
    op5_quality_gbt,
    op6_best_fit_packing,
    op7_repetition_rules,
    op8_itq_near_dups,
    op9_license_scan,
    op10_simhash_near_dups,
    op11_embedding_whitening,
    op12_suffix_dedup,
    op13_hard_negatives,
    pipeline,
)

__all__ = ["QUERIES", "STATEMENTS"]
