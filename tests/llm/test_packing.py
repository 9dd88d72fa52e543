"""Pieces against the library, and packing against document-by-document best fit."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import TEXTS, rows_of
from tokenizers import Tokenizer

from spillway.llm.packing import best_fit, packed, token_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces(docs, empty):
    rows = rows_of(token_pieces(docs, PATH, 2, 64))
    library = Tokenizer.from_file(PATH)
    whole = sorted((str(i), [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in TEXTS)
    texts, open_ = [], {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= 64
        if r["piece"] == 0:
            open_[r["doc_id"]] = own = []
            texts.append((str(r["doc_id"]), own))
        else:
            assert r["length"] == 64
        assert r["start"] == len(open_[r["doc_id"]])
        open_[r["doc_id"]].extend(ids)
    assert sorted(texts) == whole
    assert token_pieces(empty, PATH, 2).count() == 0


def one_by_one(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_as_many_sequences_as_best_fit_decreasing(seed):
    pick = random.Random(seed)
    lengths = [pick.choice([pick.randint(1, 100), pick.randint(1, 20), 33, 50]) for _ in range(400)]
    runs, sequences = best_fit(Counter(lengths), 100)
    assert sequences == one_by_one(lengths, 100)
    used = Counter()
    for length, _, number, first, each, offset in runs.tolist():
        for n in range(number):
            place = offset + n % each * length
            used.update({(first + n // each, place + k): 1 for k in range(length)})
    assert max(used.values()) == 1 and max(p for _, p in used) < 100
    assert runs[:, 2].sum() == len(lengths)


def test_packed_items(spark, empty):
    pick = random.Random(3)
    items = [(n, pick.choice([pick.randint(1, 50), 17, 17]), "kept") for n in range(500)]
    items += [(1000, None, "none"), (1001, 0, "none"), (1002, 80, "too long"), (0, items[0][1], "repeated")]
    frame = spark.createDataFrame(items, "id long, length long, note string")
    rows = rows_of(packed(frame.repartition(5), capacity=50))
    assert sorted((r["id"], r["length"] or 0, r["note"]) for r in rows) == sorted((i, n or 0, t) for i, n, t in items)
    inside = {}
    for r in rows:
        if not r["length"]:
            assert r["sequence_id"] is None and r["offset"] is None
        else:
            inside.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["note"]))
    for own in inside.values():
        own.sort()
        if own[0][2] == "too long":
            assert len(own) == 1
            continue
        ends = 0
        for offset, length, _ in own:
            assert offset == ends
            ends += length
        assert ends <= 50
    assert len(inside) == one_by_one([min(n, 50) for _, n, _ in items if n], 50)
    assert packed(frame.limit(0), capacity=50).count() == 0
