"""Token counts of parts of a text: encode the whole text once, then deal its tokens out by place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import id_type, schema_of, texts_of
from .tokens import decoded, encoder


def lines_of(text: str) -> np.ndarray:
    """First and last-plus-one character of each line, its line end included."""
    ends = np.cumsum([len(line) + 1 for line in text.split("\n")])
    ends[-1] -= 1
    return np.stack([np.append(0, ends[:-1]), ends], axis=1)


def allocated(spans: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the section it belongs to (-1: none), and whether it crosses a boundary.

    A token belongs to the section that holds most of its characters, on equal shares to the earlier
    one; without a character in any section, to none.  Sections are sorted and do not overlap.
    """
    starts, ends = sections[:, 0], sections[:, 1]
    begin, last = spans[:, 0], np.maximum(spans[:, 0], spans[:, 1] - 1)
    first = np.searchsorted(ends, begin, "right")  # the first section that ends behind the start
    final = np.searchsorted(starts, last, "right") - 1  # the last one that starts at or before it
    owner = np.where(first <= final, first, -1)
    inside = (owner >= 0) & (first == final)
    at = np.clip(first, 0, max(0, len(starts) - 1))
    whole = inside & (starts[at] <= begin) & (spans[:, 1] <= ends[at]) if len(starts) else inside
    crossing = (owner >= 0) & ~whole
    for token in np.flatnonzero(crossing & (first != final)):
        own = np.arange(first[token], final[token] + 1)
        held = np.minimum(ends[own], spans[token, 1]) - np.maximum(starts[own], spans[token, 0])
        owner[token] = own[np.argmax(held)]
    return owner, crossing


def attributed_tokens(
    docs: DataFrame,
    path: str,
    sections: DataFrame | None = None,
    blanks_count: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, section, first_char, end_char, n_tokens, n_crossing`` per section of each row.

    Without ``sections`` the sections of a text are its lines, each with its line end, numbered from
    0.  Otherwise ``sections (doc_id, section, first_char, end_char)`` names them, in characters;
    those of one document must not overlap, tokens outside of them count nowhere, and documents
    without any have no rows.  ``n_crossing`` counts the section's tokens that reach over one of its
    ends; see :func:`allocated` for the rule.

    A null or empty text has one empty line and no tokens.  A null id matches no given sections.
    Repeated rows each get their sections; an empty table gives an empty one; other columns are not
    read.
    """
    kind = id_type(docs, doc_id)
    schema = schema_of(
        **{doc_id: kind}, section="int", first_char="long", end_char="long", n_tokens="long", n_crossing="long"
    )
    given = sections is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path, blanks_count)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = decoded(texts_of(part.column(1)))
                named = part.column(2).to_pylist() if given else [None] * len(texts)
                rows, tables = [], []
                for row, (t, own, (_, spans)) in enumerate(zip(texts, named, library.ids_and_spans(texts))):
                    if given:
                        listed = sorted((x["first_char"], x["end_char"], x["section"]) for x in own)
                        table = np.array(listed, np.int64)
                    else:
                        lines = lines_of(t)
                        table = np.column_stack([lines, np.arange(len(lines))])
                    owner, crossing = allocated(spans, table[:, :2])
                    counts = np.bincount(owner[owner >= 0], minlength=len(table))
                    over = np.bincount(owner[crossing], minlength=len(table))
                    rows += [row] * len(table)
                    tables.append(np.column_stack([table[:, 2], table[:, :2], counts, over]))
                every = np.concatenate(tables) if tables else np.empty((0, 5), np.int64)
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(every[:, 0].astype(np.int32))]
                columns += [pa.array(every[:, k]) for k in range(1, 5)]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    base = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    if given:
        per_text = sections.groupBy(F.col("doc_id").alias("_id")).agg(
            F.collect_list(
                F.struct(
                    F.col("section").cast("int").alias("section"),
                    F.col("first_char").cast("long").alias("first_char"),
                    F.col("end_char").cast("long").alias("end_char"),
                )
            ).alias("_sections")
        )
        base = base.join(per_text, "_id").select("_id", "_text", "_sections")
    return base.mapInArrow(run, schema)
