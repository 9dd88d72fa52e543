"""Lattice probabilities against the sum over all segmentations, and the scores of texts."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import TEXTS, rows_of

from spillway.llm import lattice_lm
from spillway.llm.lattice_lm import END, Lattice, Pieces, lattice_scores, learned, pieces_of, word_counts
from spillway.llm.texts import held_out

SURFACES = (b" ", b" a", b"a", b"b", b"ab", b"ba", b"aba", b" ab", b" abab")


def toy():
    weights = np.arange(1.0, len(SURFACES) + 2)
    return Pieces(SURFACES, np.log(weights[:-1] / weights.sum()), math.log(weights[-1] / weights.sum()))


def segmentations(text, pieces):
    if not text:
        yield ()
    for n, s in enumerate(pieces.surfaces):
        if text.startswith(s):
            for rest in segmentations(text[len(s) :], pieces):
                yield (n, *rest)


@pytest.mark.parametrize("word", [b"a", b"b", b"ab", b"abab", b"bbabaab", b"aaaaaaaa"])
def test_marginal_and_expected_counts(word):
    pieces = toy()
    ways = [(w, math.exp(sum(pieces.logs[n] for n in w))) for w in segmentations(b" " + word, pieces)]
    total = sum(p for _, p in ways)
    lattice = Lattice(pieces)
    assert np.isclose(lattice.marginals([b"a", word, b"ab", word])[1], math.log(total))
    expected = np.zeros(len(SURFACES))
    for way, p in ways:
        for n in way:
            expected[n] += 3 * p / total
    assert np.allclose(lattice.expected([word], np.array([3])), expected)


def test_probabilities_of_texts_add_up_to_at_most_one():
    pieces, lattice = toy(), Lattice(toy())
    words = [bytes(w) for n in range(1, 9) for w in np.stack(np.meshgrid(*[[97, 98]] * n)).reshape(n, -1).T.astype(np.uint8)]
    single = np.exp(lattice.marginals(words)).sum()
    assert 0 < math.exp(pieces.end) * (1 + single) < 1


def test_public_vocabulary_covers_every_text():
    pieces = pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    assert np.isclose(np.exp(pieces.logs).sum() + math.exp(pieces.end), 1)
    odd = ["日本".encode(), bytes([0xF0, 0x9F, 0x98, 0x80]), b"\x00\x7f", b"q" * 900, "é́".encode()]
    assert np.isfinite(Lattice(pieces).marginals(odd)).all()


@pytest.mark.parametrize("stretch", [7, 1 << 14])
def test_long_words_are_swept_to_the_same_values(monkeypatch, stretch):
    pieces = pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    lattice, pick = Lattice(pieces), random.Random(5)
    found = [bytes(pick.randrange(33, 256) for _ in range(n)) for n in (1, 24, 25, 26, 60, 300, 300, 900)]
    found += ["日本語テスト".encode() * 40, b"the" * 200]
    counts = np.arange(1, len(found) + 1)
    together = lattice.marginals(found), lattice.expected(found, counts)
    for longest in (0, 1 << 40):
        monkeypatch.setattr("spillway.llm.lattice_lm.LONG", longest)
        monkeypatch.setattr("spillway.llm.lattice_lm.STRETCH", stretch)
        assert np.allclose(lattice.marginals(found), together[0], rtol=1e-12)
        assert np.allclose(lattice.expected(found, counts), together[1], rtol=1e-9, atol=1e-9)


def test_a_megabyte_of_unbroken_text(spark, monkeypatch):
    monkeypatch.setattr("spillway.llm.lattice_lm.HELD", 1 << 16)
    pieces, pick = pieces_of(public_tokenizers.path("piece_bpe_32k.model")), random.Random(6)
    word = "".join(pick.choices("etaoinshrdlu", k=1 << 20))
    rows = spark.createDataFrame([(2, word), (3, word[: 1 << 17]), (8, "a b")], "doc_id long, text string")
    started = time.monotonic()
    one, two, three = sorted(rows_of(lattice_scores(rows, pieces, rounds=1)), key=lambda r: r["doc_id"])
    assert time.monotonic() - started < 120
    assert one["score"] < two["score"] < three["score"] < 0
    assert (one["n_tokens"], three["n_tokens"]) == (2, 3)
    counted = {bytes(r["word"]): r["c"] for r in word_counts(rows).collect()}
    assert counted == {word.encode(): 1, word[: 1 << 17].encode(): 1, b"a": 1, b"b": 1, b"": 3}


def test_learning_raises_the_likelihood(spark, docs):
    counts = word_counts(docs)
    seen = {bytes(r["word"]): r["c"] for r in counts.collect()}
    texts = seen.pop(b"")
    assert texts == len(TEXTS)
    likelihoods = []
    for rounds in range(3):
        pieces = learned(pieces_of(public_tokenizers.path("piece_bpe_32k.model")), counts, texts, rounds, 1e-9)
        logs = Lattice(pieces).marginals(list(seen))
        likelihoods.append(np.dot(logs, list(seen.values())) + texts * pieces.end)
    assert likelihoods[0] < likelihoods[1] < likelihoods[2]


def brute(first, folds=5, rounds=4):
    """Every text's figures, word by word."""
    words = [[*(t or "").encode().lower().split(), b""] for _, t in TEXTS]
    held = [i is not None and zlib.crc32(str(i).encode()) % folds == 1 for i, _ in TEXTS]
    counts = Counter(w for own, h in zip(words, held) if not h for w in own)
    total, divisor = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    pieces, size = first, len(first.surfaces)
    for _ in range(rounds):
        plain = [w for w in counts if w]
        expected = Lattice(pieces).expected(plain, np.array([counts[w] for w in plain])) + 0.1
        end = counts[b""] + 0.1
        pieces = Pieces(first.surfaces, np.log(expected / (expected.sum() + end)), math.log(end / (expected.sum() + end)))
    assert size == len(pieces.surfaces)
    lattice = Lattice(pieces)
    for (i, _), own, h in zip(TEXTS, words, held):
        score = pieces.end + (lattice.marginals(own[:-1]).sum() if own[1:] else 0.0)
        base = sum(math.log10((counts[w] + 0.5) / divisor) for w in own)
        yield str(i), h, len(own), sum(counts[w] > 0 for w in own), total, base, score / math.log(10)


@pytest.mark.parametrize("head", [1 << 17, 3])
def test_scores(docs, empty, monkeypatch, head):
    monkeypatch.setattr("spillway.llm.lattice_lm.HEAD", head)
    first = pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    rows = rows_of(lattice_scores(docs, first))
    got = sorted((str(r["doc_id"]), *list(r.values())[1:]) for r in rows)
    expected = sorted(brute(first))
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert np.allclose([g[5:] for g in got], [e[5:] for e in expected], rtol=1e-9)
    assert lattice_scores(empty, first).count() == 0


def test_held_out_fold(docs):
    for row in docs.select("doc_id", held_out("doc_id", 5).alias("h")).collect():
        assert row["h"] == (row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 1)


def test_words_met_again_keep_their_marginals(monkeypatch):
    """Once a worker holds many words, only those of other texts are dropped."""
    monkeypatch.setattr(lattice_lm, "KEPT", 2)
    scorer, asked = lattice_lm.Scorer(toy(), {b"ab": 5, END: 3}, 9.0), []
    marginals = scorer.lattice.marginals
    monkeypatch.setattr(Lattice, "marginals", lambda self, words: asked.append(set(words)) or marginals(words))
    scorer.learn([b"a ab", b"ba a"])
    first = scorer.score(b"ab ba ab")
    scorer.learn([b"ab ba ab bb"])
    assert asked == [{b"a", b"ab", b"ba"}, {b"bb"}]
    assert scorer.score(b"ab ba ab") == first
    total, known, base, score, tail = first
    assert (total, known, tail) == (4, 3, [(b"ba", 1)])
    assert base == pytest.approx(2 * math.log10(5.5 / 9) + math.log10(3.5 / 9))
    by_hand = toy().end + 2 * marginals([b"ab"])[0] + marginals([b"ba"])[0]
    assert score == pytest.approx(by_hand / math.log(10))
