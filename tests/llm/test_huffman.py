"""Length-limited codes, blocks, and the written and reread table."""

import heapq
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import TEXTS, rows_of
from tokenizers import Tokenizer

from spillway.llm.huffman import _TOGETHER, Code, code_lengths, ids_written_and_read

PATH = public_tokenizers.path("word_bpe_49k.json")


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


@pytest.mark.parametrize("seed", range(5))
def test_unlimited_code_is_a_huffman_code(seed):
    counts = np.random.default_rng(seed).integers(0, 1000, 60)
    lengths = code_lengths(counts, 24)
    assert (lengths * counts).sum() == huffman_cost(counts)


def best_limited(counts, limit):
    """Least cost of a prefix code of at most ``limit`` bits, by trying all sorted lengths."""
    from itertools import combinations_with_replacement

    falling = sorted(counts, reverse=True)
    return min(
        sum(a * b for a, b in zip(falling, lengths))
        for lengths in combinations_with_replacement(range(1, limit + 1), len(falling))
        if sum(2.0**-x for x in lengths) <= 1
    )


@pytest.mark.parametrize("counts, limit", [([1, 1, 2, 4, 8, 16], 3), ([100, 1, 1, 1, 1], 3), ([5, 5, 5, 5], 2), ([1, 2, 3, 5, 8, 13, 21], 4)])
def test_limited_code_is_the_best_of_its_kind(counts, limit):
    lengths = code_lengths(np.array(counts), limit)
    assert lengths.max() <= limit and (2.0**-lengths).sum() <= 1
    assert (lengths * counts).sum() == best_limited(counts, limit)


def test_few_symbols():
    assert code_lengths(np.array([0, 0]), 5).tolist() == [0, 0]
    assert code_lengths(np.array([0, 9, 0]), 5).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        code_lengths(np.ones(9, int), 3)


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("symbols", [1, 2, 3000])
def test_round_trip(size, symbols):
    ids = np.minimum(np.random.default_rng(size).geometric(0.01, size), symbols) - 1
    code = Code(code_lengths(np.bincount(ids, minlength=symbols) + (symbols == 1), 16))
    bits, checkpoints = code.encode(ids)
    assert len(checkpoints) == -(-size // 256)
    assert code.decode(bits, checkpoints, size).tolist() == ids.tolist()
    if size > 300:
        assert code.decode_part(bits, checkpoints, 290, 7).tolist() == ids[290:297].tolist()


def test_written_and_read(docs, empty, monkeypatch):
    monkeypatch.setattr("spillway.llm.huffman.BLOCK_IDS", 500)
    rows = rows_of(ids_written_and_read(docs, PATH, False, 1).orderBy("start"))
    library = Tokenizer.from_file(PATH)
    expected = sorted(
        (i if i is not None else -1, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()))
        for i, t in TEXTS
    )
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, zlib.crc32(r["ids"])) for r in rows]
    assert sorted(got) == expected
    assert [i for i, _ in got] == [i for i, _ in expected]
    before = 0
    for r in rows:
        assert r["start"] == before
        before += len(r["ids"]) // 4
    assert ids_written_and_read(empty, PATH, False, 1).count() == 0


def test_long_blocks_are_put_in_place_in_parts():
    """The bits are the codes one behind the other, whatever part a code is placed with."""
    code = Code(code_lengths(np.random.default_rng(1).integers(1, 1 << 16, 300), 18))
    ids = np.random.default_rng(2).integers(0, 300, 3 * _TOGETHER + 77).astype("<u2")
    bits, checkpoints = code.encode(ids)
    plain = "".join(format(int(code.codes[i]), f"0{code.lengths[i]}b") for i in ids)
    assert "".join(format(b, "08b") for b in bits)[: len(plain)] == plain and len(bits) == -(-len(plain) // 8)
    assert (code.decode(bits, checkpoints, len(ids)) == ids).all()
