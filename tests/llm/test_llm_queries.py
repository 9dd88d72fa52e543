"""Every registered query of this subpackage, and the pipeline, on given tables."""

import compare
import pytest

import __spark_entry__ as registry
import corpus_pipeline
from spillway.llm import QUERIES, STATEMENTS
from spillway.llm.packing import packed

SMALL = "/root/testdata/sf0.001"

CONTRACT = {
    "op1_lattice_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_huffman_ids": "doc_id start n_tokens ids_crc32",
    "op3_source_mix": "doc_id domain lang source n_tokens epoch",
    "op4_token_attribution": "doc_id section first_char end_char n_tokens n_crossing",
    "op5_quality_gbt": "doc_id held_out score predicted",
    "op6_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op7_repetition_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_itq_near_dups": "vec_id n_links component_id kept",
    "op9_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op10_simhash_near_dups": "doc_id fingerprint component_id",
    "op11_embedding_whitening": "vec_id component n deviation whitened explained identity_error",
    "op12_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op13_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "pipeline": "doc_id piece start length ids sequence_id offset",
}


def test_all_are_registered():
    assert set(QUERIES) == set(CONTRACT) <= set(registry.queries())
    assert set(STATEMENTS) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_and_rows(spark, name):
    frame = QUERIES[name](spark, SMALL)
    assert set(CONTRACT[name].split()) <= set(frame.columns)
    assert frame.count() > 0


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_rows_equal(spark, name):
    spark_names, spark_rows = compare.spark_rows(QUERIES[name](spark, SMALL))
    duck_names, duck_rows = compare.duck_rows(compare.connect(SMALL), STATEMENTS[name])
    assert spark_names == duck_names
    assert spark_rows == duck_rows


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids and docs.count() == len(now)
        left[name], ids = len(now), now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r[0] for r in pieces.select("doc_id").collect()} == ids
    assert pieces.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 1024


def test_stages_take_awkward_rows(spark, docs, empty):
    for frame in (docs, empty):
        frame = frame.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SMALL)
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SMALL).count() >= 0


def test_items_keep_their_columns(spark):
    frame = spark.createDataFrame([(1, 5, "a")], "id long, length long, offset_note string")
    assert packed(frame).columns == ["id", "length", "offset_note", "sequence_id", "offset"]
