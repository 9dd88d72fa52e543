"""The pipeline's rows against plain Python, stage by stage."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from test_components import brute as components_of
from test_mixing import chosen
from test_repetition import brute_kept
from test_simhash import brute as print_of

import corpus_pipeline
from spillway.llm.quality_model import fit_quality, scores
from spillway.llm.tokens import WordEncoder

SMALL = "/root/testdata/sf0.001"


def expected_pieces(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r for r in table.collect() if brute_kept(r["text"])]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = fit_quality(spark.createDataFrame(rows, table.schema), labels)
    good = scores(model, [r["text"].encode() for r in rows]) >= 0.5
    rows = [r for r, keep in zip(rows, good) if keep]
    prints = [print_of(r["text"]) for r in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a, len(rows)) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = components_of(near)
    first = {}
    for n, r in enumerate(rows):
        first[root[n]] = min(first.get(root[n], r["doc_id"]), r["doc_id"])
    rows = [r for n, r in enumerate(rows) if first[root[n]] == r["doc_id"]]
    domains = ("web", "books", "forums", "news")

    def leaf(r):
        return domains[int(r["source"].removeprefix("src")) % 4], r["lang"], r["source"]

    taken = chosen([(r["doc_id"], len(r["text"].split()), leaf(r)) for r in rows], leaf, corpus_pipeline.MIX)
    assert set(taken.values()) == {1} and {e for _, e in taken} == {0}
    library = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), True).library
    pieces = []
    for r in rows:
        if (r["doc_id"], 0) in taken:
            ids = [*library.encode(r["text"], add_special_tokens=False).ids, 2]
            cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                pieces.append((r["doc_id"], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return pieces


def test_rows(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in rows]
    assert Counter(got) == Counter(expected_pieces(spark))
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
        assert sum(n for _, n in own) <= 1024
    assert len(places) <= -(-sum(r["length"] for r in rows) // 1024) + 8
