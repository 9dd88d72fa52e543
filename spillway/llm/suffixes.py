"""Sampled suffix arrays, and a logarithmic family of them.

A suffix is indexed where it holds the least value of some window of a text: every string of
``least`` bytes then has an indexed suffix inside, at the same place in each of its copies and with
at least ``depth`` bytes of the string behind it, whatever surrounds it.  One byte in about
``(least - depth) / 2`` starts one.

A batch's suffix array is the table of its suffixes in the order of (first eight bytes, hash of the
first ``depth``), so suffixes that agree for ``depth`` bytes are neighbours.  A family keeps at most
one array of each size: a new batch is scanned against itself and merge-joined with every array
there is, and arrays of equal size are then merged into one of twice the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import remove_folder, shared_folder
from .storage import shuffles_end, stored
from .texts import texts_of

#: Bits for a place in a text; the bits above are the value's.
_PLACE = np.uint64(31)
#: Window starts handled at once.
_STARTS = 1 << 18

KEY = ["head", "hash"]

SUFFIXES = """text_key binary, who long, pos int, last int, n int, back int, ahead int, head long,
    hash long, context long"""


def _values(text: np.ndarray) -> np.ndarray:
    """A mixed value of the eight bytes at every place; ``text`` has seven more than there are."""
    out = np.empty(len(text) - 7, np.uint64)
    raw = text.tobytes()
    for k in range(min(8, len(out))):
        out[k::8] = np.frombuffer(raw, "<u8", (len(out) - k + 7) // 8, k)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def sampled(text: bytes, least: int, depth: int) -> Iterator[np.ndarray]:
    """The places of the indexed suffixes, rising, in portions: of each window of ``least`` bytes the
    first place of the least value."""
    width = least - depth + 1
    after = -1
    for at in range(0, len(text) - least + 1, _STARTS):
        starts = min(_STARTS, len(text) - least + 1 - at)
        places = starts + width - 1
        own = _values(np.frombuffer(text, np.uint8, places + 7, at))
        own = own >> _PLACE << _PLACE | np.arange(at, at + places, dtype=np.uint64)
        blocks = -(-places // width)
        padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
        padded[:places] = own
        padded = padded.reshape(blocks, width)
        behind = np.minimum.accumulate(padded, axis=1).reshape(-1)
        before = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        best = np.minimum(before[:starts], behind[width - 1 : width - 1 + starts])
        found = (best & np.uint64((1 << 31) - 1)).astype(np.int64)
        found = found[np.diff(found, prepend=after) > 0]
        if len(found):
            after = int(found[-1])
            yield found


def suffixes(docs: DataFrame, least: int, depth: int, doc_id: str, text: str) -> DataFrame:
    """The indexed suffixes of all texts, :data:`SUFFIXES`.

    ``back`` and ``ahead`` are how many bytes around ``pos`` a string of ``least`` bytes over the
    suffix's first ``depth`` can reach, and ``context`` is a hash of them.  Neighbours in a text with
    one context (as in one letter repeated) are a single row from ``pos`` to ``last``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            keys, whos = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, who, own in zip(keys, whos, texts_of(batch.column(2))):
                for places in sampled(own, least, depth):
                    _add(rows, key, who, own, places.tolist(), least, depth)
                    if len(rows) > 20_000:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    return docs.select(
        text_key(text).alias("text_key"), F.xxhash64(F.col(doc_id)).alias("who"), F.col(text).alias("_text")
    ).mapInArrow(run, SUFFIXES)


def text_key(text: str):
    """128 bits of the text, null as empty: equal texts have equal spans."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _add(rows: list, key: bytes, who: int, text: bytes, places: list[int], least: int, depth: int) -> None:
    reach, end = least - depth, len(text)
    of = xxhash.xxh3_64_intdigest
    run = None
    for place in places:
        back = place if place < reach else reach
        context = of(text[place - back : place + least], back) - (1 << 63)
        if run and run[9] == context:
            run[3], run[4] = place, run[4] + 1
            continue
        if run:
            rows.append(run)
        head = int.from_bytes(text[place : place + 8], "big") - (1 << 63)
        own = of(text[place : place + depth]) - (1 << 63)
        run = [key, who, place, place, 1, back, min(end - place, least), head, own, context]
    rows.append(run)


_KINDS = (pa.binary(), pa.int64(), *[pa.int32()] * 5, *[pa.int64()] * 3)
_NAMES = [f.split()[0] for f in SUFFIXES.split(",")]


def _batch(rows: list) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)


class IndexFamily:
    """Suffix arrays of 1, 2, 4 ... batches, at most one of each size, in the shared folder.

    The paths of what :meth:`add` returns are appended to ``matches``, whose owner removes them."""

    def __init__(self, spark: SparkSession, matches: list[str] | None = None):
        self.spark, self.matches = spark, matches
        self.levels: dict[int, str] = {}

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch's suffixes and return the keys that agree for ``depth`` bytes with another
        suffix, of the batch or of an array indexed before; only keys the batch has."""
        path = self._written(batch)
        new = self._read(path)
        same = new.groupBy(*KEY).agg(F.sum("n").alias("n")).where("n > 1").select(*KEY)
        for level in self.levels.values():
            same = same.union(self._scanned(new, self._read(level)))
        found = stored(same.distinct(), "suffix-matches", self.matches)
        self._carry(path)
        return found

    def _scanned(self, new: DataFrame, level: DataFrame) -> DataFrame:
        """Keys of both arrays: one merge over two sorted runs."""
        return new.select(*KEY).join(level.select(*KEY).hint("merge"), KEY, "left_semi")

    def _carry(self, path: str) -> None:
        """Put an array on the lowest level; where one is there, merge the two and go a level up."""
        level = 0
        while level in self.levels:
            other = self.levels.pop(level)
            merged = self._written(self._read(path).union(self._read(other)))
            remove_folder(self.spark, path)
            remove_folder(self.spark, other)
            path, level = merged, level + 1
        self.levels[level] = path

    def _written(self, rows: DataFrame) -> str:
        """The suffixes with equal contexts as one row each, sorted within their partitions."""
        path = shared_folder(self.spark, "suffix-array")
        array = rows.groupBy(*KEY, "context").agg(F.sum("n").cast("long").alias("n"))
        with shuffles_end(self.spark):
            array.sortWithinPartitions(*KEY).write.option("compression", "zstd").parquet(path)
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("head long, hash long, context long, n long").parquet(path)

    def remove(self) -> None:
        """Delete the arrays."""
        for path in self.levels.values():
            remove_folder(self.spark, path)
        self.levels.clear()
