"""Quality rules on repetition: how much of a text lies in repeated n-grams and lines.

Words and lines become numbers, an n-gram a rolling hash over the numbers of its words, and sorting
the hashes of one length finds the repeated ones.  All in numpy, one text at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import id_type, rows_kept, rows_per_text, schema_of

#: The shares of characters beyond which a text is rejected, by n-gram length, as in
#: the published rules for large web corpora.
DUPLICATE_NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
DUPLICATE_LINE_CHARACTERS = 0.20

SYMBOLS = b"#*$%&|<>"
#: An odd multiplier, so that the rolling hash modulo 2**64 loses nothing.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class RepetitionRules:
    """Least words, the most words (in percent) inside repeated 3-word windows, and the most
    characters inside n-grams and lines seen before.  A heading is no repetition of its own: where
    one line alone was seen before, only once, and has at most ``heading_words`` words, the rules of
    n-grams that fit into it leave its characters out; the rule of lines still counts them."""

    least_words: int = 50
    most_repeated_percent: int = 50
    heading_words: int = 20
    ngrams: tuple[tuple[int, float], ...] = tuple(DUPLICATE_NGRAM_SHARES.items())
    lines: float = DUPLICATE_LINE_CHARACTERS


def numbered(items: list[bytes]) -> np.ndarray:
    """Each item's number in order of first appearance: equal numbers, equal items."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in items), np.int64, len(items))


def rolling_hashes(numbers: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n-word window."""
    size = len(numbers) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    mixed = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * _FACTOR + mixed[k : k + size]
    return out ^ (out >> np.uint64(29))


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether it occurs twice or more, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, again


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in an n-word window that begins at a marked start."""
    change = np.zeros(size + 1, np.int64)
    change[: len(starts)] += starts
    change[n : n + len(starts)] -= starts
    return np.cumsum(change[:-1]) > 0


def measures(text: bytes, rules: RepetitionRules) -> dict[str, float]:
    """All figures of one text.  Duplicated n-grams and lines count from their second place on;
    repeated 3-word windows count from the first."""
    words = text.split()
    ascii_only = text.isascii()
    lengths = np.fromiter(
        map(len, words) if ascii_only else (len(w.decode()) for w in words), np.int64, len(words)
    )
    characters = int(lengths.sum())
    numbers = numbered(words)
    twice, _ = repeats(rolling_hashes(numbers, 3))
    repeated = int(covered(twice, 3, len(words)).sum())
    lines = [line for line in text.split(b"\n") if line.split()]
    seen: set[bytes] = set()
    again = [line for line in lines if line in seen or seen.add(line)]
    out = {
        "n_words": len(words),
        "word_chars": characters,
        "n_symbols": sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))),
        "n_dup_lines": len(again),
        "n_repeat_words": repeated,
        "dup_line_chars": sum(sum(len(w.decode()) for w in line.split()) for line in again),
    }
    out["base_failed"] = (
        len(words) < rules.least_words or 100 * repeated > rules.most_repeated_percent * len(words)
    )
    rejected = out["dup_line_chars"] > rules.lines * characters
    heading = len(again[0].split()) if len(again) == 1 else 0
    if heading > rules.heading_words:
        heading = 0
    for n, most in rules.ngrams:
        _, before = repeats(rolling_hashes(numbers, n))
        inside = covered(before, n, len(words))
        out[f"dup_{n}gram_chars"] = share = int(lengths[inside].sum())
        # Every word of a heading of n words or more lies in an n-gram seen before.
        own = out["dup_line_chars"] if heading >= n else 0
        rejected |= share - own > most * characters
    out["kept"] = not (out["base_failed"] or bool(rejected))
    return out


def repetition_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rules: RepetitionRules = RepetitionRules(),
) -> DataFrame:
    """One row per row of ``docs``: the id, word and repetition figures, ``base_failed``, ``kept``.

    A null or empty text has no words and fails.  Repeated rows each get their own row; ties cannot
    arise, since each text is judged alone; an empty table gives an empty one; other columns are
    not read.  A text is held by one task, with a few numbers per word beside it.
    """
    figures = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long"}
    figures |= {"n_repeat_words": "long", "dup_line_chars": "long"}
    figures |= {f"dup_{n}gram_chars": "long" for n, _ in rules.ngrams}
    figures |= {"base_failed": "boolean", "kept": "boolean"}

    def measure(texts: list[bytes]) -> dict[str, list]:
        rows = [measures(t, rules) for t in texts]
        return {n: [r[n] for r in rows] for n in figures}

    passed: list[Column] = [F.col(doc_id)]
    return rows_per_text(
        docs, passed, text, measure, schema_of(**{doc_id: id_type(docs, doc_id)}, **figures)
    )


def passing(docs: DataFrame, text: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return rows_kept(docs, text, lambda texts: [measures(t, rules)["kept"] for t in texts])
