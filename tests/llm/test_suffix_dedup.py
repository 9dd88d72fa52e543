"""Removed bytes against a count of every string of the given length."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from llm_helpers import TEXTS, rows_of, table, words

from spillway.llm import suffix_dedup
from spillway.llm.queries import QUERIES
from spillway.llm.suffix_dedup import without_repeats
from spillway.llm.suffixes import IndexFamily, sampled, suffixes


def brute(texts, least):
    """Spans and kept bytes of each text, from all its strings of ``least`` bytes."""
    texts = [(t or "").encode() if not isinstance(t, bytes) else t for t in texts]
    counts = Counter(t[a : a + least] for t in texts for a in range(len(t) - least + 1))
    out = []
    for text in texts:
        gone = np.zeros(len(text) + 1, bool)
        for a in range(len(text) - least + 1):
            if counts[text[a : a + least]] > 1:
                gone[a : a + least] = True
        edges = np.flatnonzero(np.diff(gone, prepend=False)).tolist()
        spans = list(zip(edges[::2], edges[1::2]))
        kept = bytes(np.frombuffer(text, np.uint8)[~gone[:-1]]) if text else b""
        out.append((len(text), spans, kept))
    return out


def check(frame, rows, least, **more):
    expected = Counter((i, n, tuple(s), k) for (i, _), (n, s, k) in zip(rows, brute([t for _, t in rows], least)))
    got = rows_of(without_repeats(frame, least=least, **more))
    found = Counter((r["doc_id"], r["n_bytes"], tuple((s["first"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in got)
    assert found == expected
    return [r for r in got if r["spans"]]


def passages(seed, count=60, small=3):
    """Texts of few letters that share stretches of many lengths, at edges, twice in one, changed."""
    pick = random.Random(seed)
    letters = lambda n: "".join(pick.choice("abcdefgh"[:small]) for _ in range(n))
    shared = [letters(n) for n in (39, 40, 41, 45, 60, 90, 150, 300)]
    out = []
    for _ in range(count):
        parts = []
        for _ in range(pick.randrange(5)):
            parts.append(letters(pick.choice([0, 1, 3, 20, 120])))
            own = pick.choice(shared)
            a, b = sorted((pick.randrange(len(own) + 1), pick.randrange(len(own) + 1)))
            parts.append(pick.choice([own, own[a:], own[:b], own[:a] + "z" + own[a:]]))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed,least,depth,batches", [(1, 40, 16, 4), (2, 40, 8, 3), (3, 41, 32, 1), (4, 64, 24, 7)])
def test_shared_stretches(spark, seed, least, depth, batches):
    rows = list(enumerate(passages(seed, small=3 if depth > 8 else 8)))
    assert len(check(table(spark, rows), rows, least, depth=depth, batches=batches)) > 10


def test_suffixes_with_very_many_classes(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CLASSES", 3)
    rows = list(enumerate(passages(5)))
    check(table(spark, rows), rows, 40, depth=16)


def test_small_portions(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PORTION", 5)
    rows = list(enumerate(passages(6)))
    check(table(spark, rows), rows, 40, depth=16)


def test_awkward_texts_at_full_length(spark, docs):
    rows = [*TEXTS, (20, "é" * 900), (21, words(12, 400) + words(7, 200)), (22, words(7, 200)), (23, "y" * 399), (24, "y" * 399)]
    found = check(table(spark, rows), rows, 400)
    assert {1, 6, 5, 20, 22} <= {r["doc_id"] for r in found}
    assert without_repeats(docs).count() == len(TEXTS)


def test_equal_rows_and_one_text_with_a_third(spark):
    rows = [(n, words(n, 90)) for n in range(40)] + [(100 + n % 3, words(200, 90)) for n in range(20)]
    rows += [(300 + n, words(500 + n, 30) + " " + words(200, 85) + " " + words(700 + n, 30)) for n in range(20)]
    assert len(check(table(spark, rows), rows, 400)) >= 40


def test_empty(spark, empty):
    assert without_repeats(empty).count() == 0


@pytest.mark.parametrize("least,depth", [(40, 16), (400, 128)])
def test_every_string_holds_a_sampled_suffix(monkeypatch, least, depth):
    from spillway.llm import suffixes as module

    for text in (words(3, 900).encode(), b"ab" * 700, b"x" * 900, random.Random(1).randbytes(3000)):
        whole = np.concatenate(list(sampled(text, least, depth)))
        gaps = np.diff(whole, prepend=-1, append=len(text) - depth + 1)
        assert gaps.max() <= least - depth + 1 and (np.diff(whole) > 0).all()
        with monkeypatch.context() as m:
            m.setattr(module, "_STARTS", 100)
            assert np.concatenate(list(sampled(text, least, depth))).tolist() == whole.tolist()
        # The same places wherever the string stands.
        moved = np.concatenate(list(sampled(b"0123456789" * 50 + text + b"end" * 200, least, depth))) - 500
        inside = (whole >= least) & (whole < len(text) - least)
        assert set(whole[inside]) <= set(moved)


def test_levels_merge_geometrically(spark):
    family = IndexFamily(spark)
    texts = list(enumerate(passages(9, 40)))
    sizes = []
    for n in range(6):
        family.add(suffixes(table(spark, texts[6 * n : 6 * n + 6]), 40, 16, "doc_id", "text"))
        sizes.append(sorted(family.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2], [1, 2]]
    family.remove()
    assert not family.levels


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in rows_of(QUERIES["op12_suffix_dedup"](spark, folder))}
    expected = {
        i: (n, n - len(k), len(s), hashlib.sha256(k).hexdigest())
        for (i, _), (n, s, k) in zip(rows, brute([t for _, t in rows], 400))
    }
    assert got == expected
    assert sum(x[1] > 0 for x in expected.values()) > 5


def test_planted_passages_of_400_bytes_go_and_nothing_else(spark):
    """A passage put into two documents goes where it has 400 bytes, in both; shorter ones stay."""
    pick = random.Random(7)
    word = lambda: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, least = [], {}
    for n in range(30):
        passage = text(51 if n % 3 == 0 else 49 if n % 3 == 1 else 0)  # 407, 391 or no bytes
        for doc in (2 * n, 2 * n + 1):
            rows.append((doc, f"{text(30)} {passage} {text(40)}"))
            least[doc] = 407 if n % 3 == 0 else 0
    got = rows_of(without_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    removed = {r["doc_id"]: r["n_bytes"] - len(r["kept"]) for r in got}
    assert {r["doc_id"]: r["n_bytes"] for r in got} == {doc: len(t) for doc, t in rows}
    assert all(removed[d] == 0 if not n else n <= removed[d] <= n + 2 for d, n in least.items())


FILES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_only_what_is_still_read_stays_on_disk(spark, monkeypatch, tmp_path):
    """Steps and shuffle files go as soon as nothing reads them; the session's settings stay."""
    from spillway.llm import storage, suffixes as module
    from spillway.sources import shared_folder

    def own(session, purpose):
        return shared_folder(session, purpose, str(tmp_path))

    for place in (storage, module):
        monkeypatch.setattr(place, "shared_folder", own)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {files.apply(n).getName() for n in range(files.size()) if files.apply(n).getName().endswith(".data")}

    before, setting = shuffled(), spark.conf.get(FILES_END, None)
    rows = list(enumerate(passages(11, 20)))
    found = without_repeats(table(spark, rows), least=40, depth=16)
    assert [p.name.split("-")[1] for p in tmp_path.iterdir()] == ["repeated"]
    assert spark.conf.get(FILES_END, None) == setting
    for _ in range(50):  # the files are removed behind the run's back
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert found.count() == 20


def test_values_of_many_contexts_take_little_beside_themselves():
    """The running sums of 15,000 contexts (the most a portion can have, about) are not all held."""
    import tracemalloc

    pick = np.random.default_rng(3)
    backs = pick.integers(0, 273, 15_000)
    contexts = [pick.bytes(int(b) + 400) for b in backs]
    tracemalloc.start()
    values, there = suffix_dedup._windows(backs, contexts, 400, 128)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * (values.nbytes + there.nbytes)
    some, there_too = suffix_dedup._windows(backs[700:720], contexts[700:720], 400, 128)
    assert (np.where(there_too, some, 0) == np.where(there[700:720], values[700:720], 0)).all()
