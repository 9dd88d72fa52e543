"""Repetition rules against plain counting."""

import re
from collections import Counter

import pytest
from llm_helpers import TEXTS, rows_of, words

from spillway.llm.repetition import RepetitionRules, measures, passing, repetition_rules


def brute(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = {"n_words": len(found), "word_chars": sum(map(len, found))}
    out["n_symbols"] = sum(c in "#*$%&|<>" for c in text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for n, x in enumerate(lines) if x in lines[:n]] if len(lines) < 2000 else []
    out["n_dup_lines"] = len(again)
    out["dup_line_chars"] = sum(len(re.sub(r"[\x20\x09-\x0D]+", "", x)) for x in again)

    def inside(n, first):
        windows = [tuple(found[i : i + n]) for i in range(len(found) - n + 1)]
        times, seen, places = Counter(windows), set(), set()
        for i, w in enumerate(windows):
            if times[w] > 1 and (first or w in seen):
                places.update(range(i, i + n))
            seen.add(w)
        return places

    out["n_repeat_words"] = len(inside(3, True))
    for n in range(5, 11):
        out[f"dup_{n}gram_chars"] = sum(len(found[i]) for i in inside(n, False))
    out["base_failed"] = len(found) < 50 or 100 * out["n_repeat_words"] > 50 * len(found)
    return out


def brute_kept(text):
    """The verdict, with the limits of the published rules and a heading left out word by word."""
    found = brute(text)
    lines = [x.split() for x in (text or "").split("\n")]
    raw = (text or "").split("\n")
    again = [i for i, x in enumerate(raw) if x.strip() and x in raw[:i]]
    split, heading = [w for x in lines for w in x], range(0)
    if len(again) == 1 and len(lines[again[0]]) <= 20:
        before = sum(map(len, lines[: again[0]]))
        heading = range(before, before + len(lines[again[0]]))
    limits = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
    for n, most in limits.items():
        windows = [tuple(split[i : i + n]) for i in range(len(split) - n + 1)]
        inside = {i + k for i, w in enumerate(windows) if w in windows[:i] for k in range(n)}
        left = inside.difference(heading) if len(heading) >= n else inside
        if sum(len(split[i]) for i in left) > most * found["word_chars"]:
            return False
    if found["dup_line_chars"] > 0.2 * found["word_chars"]:
        return False
    return not found["base_failed"]


def test_against_counting(docs):
    rows = rows_of(repetition_rules(docs))
    assert len(rows) == len(TEXTS)
    expected = sorted((str(i), sorted(brute(t).items())) for i, t in TEXTS)
    got = [(str(r.pop("doc_id")), r.pop("kept"), r) for r in rows]
    verdicts = sorted((str(i), brute_kept(t)) for i, t in TEXTS if len(t or "") < 50_000)
    assert sorted((i, kept) for i, kept, r in got if r["n_words"] < 10_000) == verdicts
    assert sorted((i, sorted(r.items())) for i, _, r in got) == expected
    assert not any(kept and r["base_failed"] for _, kept, r in got)


def test_one_repeated_heading_is_kept_and_many_are_not():
    clean = "A heading of six words here\n" + words(7, 90) + "\nA heading of six words here"
    assert measures(clean.encode(), RepetitionRules())["kept"]
    lines = [words(n, 12) for n in range(20)]
    many = "\n".join(lines + lines[:8])
    found = measures(many.encode(), RepetitionRules())
    assert not found["kept"]


HEADING = "A heading of nine words that stands here again"
LONG = HEADING.replace(" ", "xxxxx ")


@pytest.mark.parametrize(
    "text, kept",
    [
        (f"{HEADING}\n{words(7, 65)}\n{HEADING}", True),  # beyond the limits of 5 to 9 words alone
        (f"{HEADING}\n{words(7, 65)}\n{HEADING}\nAgain\nAgain", False),  # two lines
        (f"{HEADING}\n{words(7, 55)}\n{HEADING}\n{HEADING}", False),  # it comes three times
        (f"{HEADING} {words(7, 65)} {HEADING}", False),  # no line of its own
        (f"{HEADING}\n{words(7, 40)}\n{HEADING} ", False),  # no equal line, for the blank at its end
        (f"{LONG}\n{words(7, 36)}\n{LONG}", False),  # over a fifth of the text
        (f"{HEADING}\n{words(7, 65)}\n{HEADING}\n{' '.join(words(7, 65).split()[:12])}", False),  # and more
        (f"{words(9, 21).strip()}\n{words(7, 160)}\n{words(9, 21).strip()}", False),  # too long for a heading
    ],
)
def test_headings(text, kept):
    assert measures(text.encode(), RepetitionRules())["kept"] == kept == brute_kept(text)


@pytest.mark.parametrize("n", [5, 10])
def test_share_is_compared_with_its_own_limit(n):
    rules = RepetitionRules(ngrams=((n, 0.10),), lines=1.0)
    text = words(8, 200) + " " + " ".join(words(8, 200).split()[:30])
    assert not measures(text.encode(), rules)["kept"]
    assert measures(text.encode(), RepetitionRules(ngrams=((n, 0.99),), lines=1.0))["kept"]


def test_filter_keeps_columns_and_empty_table(docs, empty):
    kept = passing(docs)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {
        r["doc_id"] for r in repetition_rules(docs).where("kept").collect()
    }
    assert passing(empty).count() == 0 and repetition_rules(empty).count() == 0
