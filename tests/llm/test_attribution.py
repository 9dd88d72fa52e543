"""Tokens dealt out to sections, against a loop over tokens and sections."""

from collections import Counter

import public_tokenizers
from llm_helpers import TEXTS, rows_of
from tokenizers import Tokenizer

from spillway.llm.attribution import attributed_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def brute(text, sections):
    """{section: (tokens, crossing tokens)}"""
    out = {s: [0, 0] for s, _, _ in sections}
    for a, b in LIBRARY.encode(text, add_special_tokens=False).offsets:
        held = [(min(b, end) - max(a, begin), -n) for n, (_, begin, end) in enumerate(sections)]
        most = max(held, default=(0, 0))
        if most[0] > 0:
            section, begin, end = sections[-most[1]]
            out[section][0] += 1
            out[section][1] += a < begin or b > end
    return {s: tuple(n) for s, n in out.items()}


def lines(text):
    out, at = [], 0
    for n, line in enumerate(text.split("\n")):
        end = min(len(text), at + len(line) + 1)
        out.append((n, at, end))
        at = end
    return out


def test_lines(docs, empty):
    rows = rows_of(attributed_tokens(docs, PATH))
    expected = Counter()
    for i, t in TEXTS:
        found = brute(t or "", lines(t or ""))
        expected.update((i, s, begin, end, *found[s]) for s, begin, end in lines(t or ""))
    got = Counter((r["doc_id"], r["section"], r["first_char"], r["end_char"], r["n_tokens"], r["n_crossing"]) for r in rows)
    assert got == expected
    assert attributed_tokens(empty, PATH).count() == 0


def test_given_sections(spark, docs):
    given = {1: [(7, 3, 20), (2, 20, 21), (5, 30, 41)], 7: [(0, 0, 9), (1, 9, 33)], 13: [(0, 1, 3), (1, 3, 30)], 404: [(0, 0, 5)]}
    rows = [(i, s, a, b) for i, own in given.items() for s, a, b in own]
    sections = spark.createDataFrame(rows, "doc_id long, section int, first_char long, end_char long")
    got = {(r["doc_id"], r["section"]): (r["n_tokens"], r["n_crossing"]) for r in attributed_tokens(docs, PATH, sections).collect()}
    texts = dict(TEXTS)
    assert any(crossing for _, crossing in got.values())
    assert got == {
        (i, s): n for i, own in given.items() if i in texts for s, n in brute(texts[i], own).items()
    }
