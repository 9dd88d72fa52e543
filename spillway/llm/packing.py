"""Best-fit packing of token sequences, in bulk rounds over sorted runs of documents and gaps.

Lengths are whole numbers up to the capacity, so documents of one length differ only in their rank,
and gaps of one size only in their sequence number.  Sorted by length, the documents are at most
``capacity`` runs (length, number of ranks); sorted by size, the gaps are runs (size, first
sequence, number).  A round takes the longest run of documents left, sweeps the gaps upwards from
its successor, the smallest gap that fits, settles by rank which document gets which gap, updates
the gaps, and goes on with what is left; documents without a gap open sequences.  That is best-fit
decreasing, document by document, at the price of a histogram.

The ranking and the placing, which touch every document, are distributed; the rounds only see runs,
whose number depends on the capacity and not on the input.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import small, stored
from .texts import id_type, schema_of, texts_of
from .tokens import decoded, encoder

_PART, _RANK, _SIZE = "_pack_part", "_pack_rank", "_pack_size"
#: Texts encoded at once.
_TEXTS = 256


def token_pieces(
    docs: DataFrame,
    path: str,
    end_id: int,
    capacity: int = 1024,
    blanks_count: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids``: each text's ids (32-bit little-endian) and the end id,
    cut into pieces of ``capacity`` ids, of which the first may be shorter.

    A null or empty text is the end id alone; a very long one is many pieces; repeated rows are
    documents of their own; null ids stay null; an empty table has no pieces; other columns are not
    read.
    """
    texts = docs.select(F.col(doc_id), F.col(text).alias("_text"))
    return texts.mapInArrow(_cutting(path, end_id, capacity, blanks_count), _pieces(docs, doc_id))


def _pieces(docs: DataFrame, doc_id: str) -> T.StructType:
    return schema_of(doc_id=id_type(docs, doc_id), piece="int", start="long", length="long", ids="binary")


def _cutting(path: str, end_id: int, capacity: int, blanks_count: bool):
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path, blanks_count, end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                rows, pieces, starts, lengths, ids = [], [], [], [], []
                for row, raw in enumerate(library.ids(decoded(texts_of(part.column(1))))):
                    own = np.frombuffer(raw, library.kind).astype("<u4").tobytes()
                    total = len(own) // 4
                    cuts = [0, *range(total % capacity or capacity, total, capacity), total]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(a)
                        lengths.append(b - a)
                        ids.append(own[4 * a : 4 * b])
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32())]
                columns += [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs ``(length, first rank, documents, first sequence, documents per sequence, offset)`` and
    the number of sequences, for ``counts`` documents of each length."""
    runs: list[tuple] = []
    sizes: list[int] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def opened(size: int, first: int, number: int) -> None:
        if size and number:
            if size not in gaps:
                insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):  # no gap is large enough: open sequences for all that is left
                number = -(-left // (capacity // length))
                opened(capacity, sequences, number)
                sequences += number
                continue
            size = sizes[at]
            first, number = gaps[size].pop()
            if not gaps[size]:
                del gaps[size]
                sizes.pop(at)
            each = size // length
            full = min(number, left // each)
            taken = full * each
            if full < number and left > taken:
                rest = left - taken
                runs.append((length, rank + taken, rest, first + full, each, capacity - size))
                opened(size - rest * length, first + full, 1)
                opened(size, first + full + 1, number - full - 1)
                done = left
            else:
                opened(size, first + full, number - full)
                done = taken
            if full:
                runs.append((length, rank, taken, first, each, capacity - size))
                opened(size - each * length, first, full)
            rank, left = rank + done, left - done
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    return table, sequences


def _ranks(sizes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each row's number among the rows of its size, counted on from ``seen``, which is updated."""
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    firsts = np.flatnonzero(np.diff(ordered, prepend=-1))
    numbers = np.diff(np.append(firsts, len(ordered)))
    out = np.empty(len(sizes), np.int64)
    out[order] = np.arange(len(ordered)) - np.repeat(firsts, numbers) + seen[ordered]
    seen[ordered[firsts]] += numbers
    return out


def packed(items: DataFrame, length: str = "length", capacity: int = 1024) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: where each one lies, without gaps in front.

    Items of no or null length lie nowhere (both columns null); an item longer than the capacity
    fills a sequence alone.  Equal items are placed one after the other in an order that depends on
    how the table is split; an empty table gives an empty one.
    """
    ranked = _ranking(items.columns.index(length), capacity)
    return _placed(items.mapInArrow(ranked, _with_ranks(items.schema)), items.columns, capacity)


def packed_documents(
    docs: DataFrame,
    path: str,
    end_id: int,
    capacity: int = 1024,
    blanks_count: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id", "piece", "start", "length", "ids"),
) -> DataFrame:
    """The pieces of :func:`token_pieces`, :func:`packed`; encoding and ranking are one pass.

    ``keep`` is SQL over a piece's columns: what of it is stored and returned.
    """
    schema = _pieces(docs, doc_id)
    cut, ranked = _cutting(path, end_id, capacity, blanks_count), _ranking(3, capacity)
    texts = docs.select(F.col(doc_id), F.col(text).alias("_text"))
    rows = texts.mapInArrow(lambda batches: ranked(cut(batches)), _with_ranks(schema))
    rows = rows.selectExpr(*keep, _PART, _SIZE, _RANK)
    return _placed(rows, rows.columns[: len(keep)], capacity)


def _with_ranks(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + schema_of(**{_PART: "int", _SIZE: "long", _RANK: "long"}).fields)


def _ranking(place: int, capacity: int):
    """Adds the task, the length in column ``place`` and the rank among the task's rows of that
    length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            raw = batch.column(place).fill_null(0).to_numpy(zero_copy_only=False)
            sizes = np.clip(raw, 0, capacity).astype(np.int64)
            new = [np.full(len(sizes), part, np.int32), sizes, _ranks(sizes, seen)]
            names = [*batch.schema.names, _PART, _SIZE, _RANK]
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(x) for x in new], names)

    return run


def _placed(ranked: DataFrame, columns: list[str], capacity: int) -> DataFrame:
    """The rounds over the histogram of lengths, and every ranked row's place."""
    rows = stored(ranked, "ranked-pieces")
    counts = stored(rows.groupBy(_SIZE, _PART).agg(F.count("*").alias("n")), "piece-counts")
    per_size = counts.where(f"{_SIZE} > 0").groupBy(_SIZE).agg(F.sum("n").alias("n"))
    table, _ = best_fit({r[_SIZE]: r["n"] for r in per_size.collect()}, capacity)
    before = counts.selectExpr(
        _SIZE, _PART, f"sum(n) OVER (PARTITION BY {_SIZE} ORDER BY {_PART}) - n AS _pack_before"
    )
    plan = rows.sparkSession.sparkContext.broadcast(table)
    kept = [rows.schema[c] for c in columns]
    out = T.StructType(kept + schema_of(sequence_id="long", offset="long").fields)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        keys = runs[:, 0] << 40 | runs[:, 1]
        for batch in batches:
            size, rank = (batch.column(batch.num_columns - k).to_numpy() for k in (2, 1))
            absent = size == 0
            if len(runs):
                run = runs[np.searchsorted(keys, size << 40 | rank, "right") - 1]
                step = rank - run[:, 1]
                new = [run[:, 3] + step // run[:, 4], run[:, 5] + step % run[:, 4] * run[:, 0]]
            else:
                new = [size, size]
            columns = batch.columns[:-2] + [pa.array(x, pa.int64(), mask=absent) for x in new]
            yield pa.RecordBatch.from_arrays(columns, out.fieldNames())

    return (
        rows.join(small(stored(before, "piece-ranks")), [_SIZE, _PART])
        .select(*columns, _SIZE, (F.col(_RANK) + F.col("_pack_before")).alias(_RANK))
        .mapInArrow(placed, out)
    )
