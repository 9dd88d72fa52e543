"""Licence scan by diagonal voting.

Every k-word window of every text is hashed, and the hashes are joined with those of the templates.
A hit says that the template lies in the text at a certain offset, its diagonal; hits are counted
per text, template and diagonal.  Neighbouring diagonals, as insertions and omissions make them, are
merged, and the words of the text are compared with those of the template along them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import DECISIVE, MORE_PHRASES, NOTICES, PHRASES
from .storage import small, stored
from .texts import id_type, schema_of, texts_of

#: Bytes to themselves, capital letters to small ones, everything below 0x80 that is neither letter
#: nor digit to a blank.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


@dataclass(frozen=True)
class Template:
    """``exact``: counts only word for word.  ``base``: one of the phrases every scan reports.
    ``decisive``: places of words that have to stand in the text, whatever share of the others does."""

    label: str
    words: tuple[bytes, ...]
    exact: bool
    base: bool = False
    decisive: frozenset[int] = frozenset()


def places_of(phrase: tuple[bytes, ...], words: tuple[bytes, ...]) -> set[int]:
    """All places in ``words`` that lie in an occurrence of ``phrase``."""
    starts = [n for n in range(len(words)) if words[n : n + len(phrase)] == phrase]
    if not starts:
        raise ValueError(f"{phrase} is not in its notice")
    return {n + k for n in starts for k in range(len(phrase))}


def templates() -> tuple[Template, ...]:
    """The base phrases, more phrases, and notices."""

    def words(text: str) -> tuple[bytes, ...]:
        return tuple(words_of(text.encode()))

    return (
        *(Template(label, words(text), True, True) for text, label in PHRASES.items()),
        *(Template(label, words(text), True) for text, label in MORE_PHRASES.items()),
        *(
            Template(
                label,
                words(text),
                False,
                decisive=frozenset().union(*(places_of(words(p), words(text)) for p in DECISIVE.get(label, ()))),
            )
            for label, text in NOTICES.items()
        ),
    )


def window_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A hash of every k-word window."""
    hash64 = xxhash.xxh64_intdigest
    own = np.fromiter((hash64(w) for w in words), np.uint64, len(words))
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        out = out * _FACTOR + own[i : i + len(out)]
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def votes(docs: DataFrame, known: tuple[Template, ...], k: int, doc_id: str, text: str) -> DataFrame:
    """``id, text_key, template, diagonal, first, last, votes``: hits per diagonal; ``first`` and
    ``last`` are the template's windows that were hit there."""
    spark = docs.sparkSession
    windows = [
        (int(h), number, at)
        for number, template in enumerate(known)
        for at, h in enumerate(window_hashes(list(template.words), k))
    ]
    places = F.broadcast(spark.createDataFrame(windows, "window long, template int, at int"))
    schema = schema_of(id=id_type(docs, doc_id), text_key="long", windows="array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                hashes = [window_hashes(words_of(t), k) for t in texts_of(part.column(2))]
                ends = np.cumsum([0] + [len(h) for h in hashes])
                values = pa.array(np.concatenate(hashes) if hashes else np.empty(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], schema.fieldNames())

    hashed = docs.select(
        F.col(doc_id).alias("id"), _text_key(text).alias("text_key"), F.col(text).alias("_text")
    ).mapInArrow(run, schema)
    return (
        hashed.select("id", "text_key", F.posexplode("windows").alias("position", "window"))
        .join(places, "window")
        .selectExpr("id", "text_key", "template", "position - at AS diagonal", "at")
        .groupBy("id", "text_key", "template", "diagonal")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("votes"))
    )


def _text_key(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def spans(
    words: list[bytes], hits: list[dict], known: tuple[Template, ...], k: int, drift: int
) -> list[tuple[int, int, int, float, bool]]:
    """(template, first word, word after the last, share of the template's words found in place,
    whether all its decisive words are) after merging diagonals at most ``drift`` apart and comparing
    words."""
    out = []
    by_template: dict[int, list[dict]] = {}
    for hit in hits:
        by_template.setdefault(hit["template"], []).append(hit)
    for number, own in by_template.items():
        template = known[number]
        size = len(template.words)
        own.sort(key=lambda h: h["diagonal"])
        merged: list[list[dict]] = []
        for hit in own:
            near = merged and not template.exact and hit["diagonal"] - merged[-1][-1]["diagonal"] <= drift
            merged[-1].append(hit) if near else merged.append([hit])
        for group in merged:
            found: set[int] = set()
            begin, end = len(words), 0
            for hit in group:
                for at in range(hit["first"], hit["last"] + k):
                    place = hit["diagonal"] + at
                    if words[place] == template.words[at]:
                        found.add(at)
                        begin, end = min(begin, place), max(end, place + 1)
            if found:
                out.append((number, begin, end, len(found) / size, template.decisive <= found))
    return out


def best_of_overlapping(
    sound: list[tuple[int, int, int, float, bool]], known: tuple[Template, ...]
) -> list[tuple[int, int, int, float, bool]]:
    """``sound`` without the notices that lie by more than half in the place of a better one, or a
    better one in theirs: one with more words in place, of equal ones the one with the larger share,
    then the smaller label.  Phrases stay."""
    kept = [s for s in sound if known[s[0]].exact]
    notices = [s for s in sound if not known[s[0]].exact]
    best: list[tuple[int, int, int, float, bool]] = []
    for found in sorted(
        notices, key=lambda s: (-round(s[3] * len(known[s[0]].words)), -s[3], known[s[0]].label, s[1])
    ):
        _, begin, end, *_ = found
        if all(2 * (min(end, b) - max(begin, a)) <= min(end - begin, b - a) for _, a, b, *_ in best):
            best.append(found)
    return kept + best


#: Hits, of four numbers each, that may be broadcast with their texts' ids.
MOST_HITS = 500_000


def license_scan(
    docs: DataFrame,
    known: tuple[Template, ...] | None = None,
    k: int = 3,
    least: float = 0.8,
    drift: int = 8,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans``.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are the first and
    last of their starts (null without any).  ``labels`` are those of all phrases found and of
    notices of whose words at least ``least`` lie in place, all decisive ones (version, name, clause)
    among them, and whose place no better notice has; ``score`` is the largest such share of
    any template, 0 without a hit.  ``spans`` lists label, first word, word after the last, share.

    Null and empty texts have no words; ties between notices go to the larger share, then the smaller
    label.  A very long text is one task's, with its hits.  Repeated rows have equal results; a null id is an id like
    any other; an empty table gives an empty one; other columns are not read.  Templates have at
    least ``k`` words.  Only the hits per diagonal are shuffled; they return to the texts by a join
    on id and text hash, broadcast where the number of texts and that of all their hits
    (:data:`MOST_HITS`) allow it.
    """
    known = known or templates()
    if any(len(t.words) < k for t in known):
        raise ValueError(f"templates need {k} words")
    per_text = stored(
        votes(docs, known, k, doc_id, text)
        .groupBy("id", "text_key")
        .agg(F.collect_list(F.struct("template", "diagonal", "first", "last")).alias("hits")),
        "licence-votes",
    ).withColumnsRenamed({"id": "_id", "text_key": "_text_key"})
    number = per_text.agg(F.sum(F.size("hits"))).first()[0] or 0
    hits_side = small(per_text) if number <= MOST_HITS else per_text
    base = docs.select(F.col(doc_id).alias("id"), _text_key(text).alias("text_key"), F.col(text).alias("_text"))
    same = base["id"].eqNullSafe(per_text["_id"]) & (base["text_key"] == per_text["_text_key"])
    schema = schema_of(
        **{doc_id: id_type(docs, doc_id)}, n_words="long", n_base="long", first_word="long",
        last_word="long", base_labels="string", labels="string", score="double",
        spans="array<struct<label:string,first:long,end:long,share:double>>",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            found = [
                _verdict(words_of(t), hits, known, k, drift, least)
                for t, hits in zip(texts_of(batch.column(1)), batch.column(2).to_pylist())
            ]
            columns = [pa.array(x, f.type) for x, f in zip(zip(*found), list(kinds)[1:])]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.fieldNames())

    return base.join(hits_side, same, "left").select("id", "_text", "hits").mapInArrow(run, schema)


def _verdict(words, hits, known, k, drift, least) -> tuple:
    found = spans(words, hits, known, k, drift) if hits else []
    sound = [s for s in found if s[4] and s[3] >= (1.0 if known[s[0]].exact else least)]
    sound = best_of_overlapping(sound, known)
    starts = [s[1] for s in sound if known[s[0]].base]
    base = sorted({known[s[0]].label for s in sound if known[s[0]].base})
    every = sorted({known[s[0]].label for s in sound})
    rows = sorted((known[n].label, a, b, share) for n, a, b, share, _ in sound)
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(base),
        ",".join(every),
        max((s[3] for s in found), default=0.0),
        rows,
    )
