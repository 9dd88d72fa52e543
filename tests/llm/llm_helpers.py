"""Awkward documents shared by the operators' tests."""

from __future__ import annotations

import random

COLUMNS = """doc_id long, text string, lang string, source string, n_chars long,
    score double, label int, component_id long, n_words string"""


def words(seed: int, count: int, vocabulary: int = 400) -> str:
    """Reproducible text of some sentences."""
    pick = random.Random(seed)
    out = []
    for n in range(count):
        number = pick.randrange(vocabulary)
        word = "".join(chr(97 + (number * 7 + k * 5) % 26) for k in range(1 + number % 7))
        out.append(word + ("." if n % 11 == 10 else "") + ("\n" if n % 23 == 22 else " "))
    return "".join(out).strip()


TEXTS = [
    (1, words(1, 120)),
    (2, None),
    (3, ""),
    (4, " \n\t \r\n"),
    (5, "same words again and again " * 4000),
    (6, words(1, 120)),
    (6, words(1, 120)),
    (7, "Ünïcode ÄÖ Straße 日本語 テスト 😀x é naïve. Σας ΟΔΟΣ İstanbul"),
    (8, words(2, 60) + "\nReleased under the MIT License.\n" + words(3, 60)),
    (9, words(1, 119) + " changed"),
    (None, words(4, 80)),
    (None, None),
    (10, "x" * 5000 + " " + "y" * 300),
    (11, "short text"),
    (12, words(5, 3000)),
    (13, "tabs\tand  double  blanks\n\nempty lines \n at 12345 ends!! don't ###"),
]


def table(spark, texts=TEXTS):
    """Documents with further columns whose names operators use themselves."""
    rows = [
        (i, t, ["en", None, "de"][n % 3], f"src{n % 4}" if n % 5 else None, None, 0.5, 1, 77, "clash")
        for n, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, COLUMNS)


def rows_of(frame):
    return [r.asDict(recursive=True) for r in frame.collect()]
