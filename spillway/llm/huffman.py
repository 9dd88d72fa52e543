"""Token ids as canonical, length-limited Huffman codes in independent blocks.

File format: a folder of Parquet files whose rows are blocks of whole documents, and next to it the
code lengths.  Blocks are ordered by document id.  A block has

* ``shard, block, ids_before``: its place, and the ids of its shard in front of it,
* ``doc_ids, lengths``: its documents and how many ids each has,
* ``checkpoints``: the bit offset of every ``step``-th id,
* ``bits``: the codes, first bit highest, padded with zeros.

A block is read with nothing but the code lengths.  Its stretches between checkpoints are decoded
side by side, one table look-up per id and stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared_folder
from .storage import stored
from .texts import id_type, schema_of, texts_of
from .tokens import decoded, encoder

#: Ids from one checkpoint to the next, and the ids after which a block ends with its document.
STEP, BLOCK_IDS = 256, 1 << 18
#: Ids whose codes are put in place at once.
_TOGETHER = 1 << 13


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Bits per symbol (0: does not occur) of the best prefix code of at most ``limit`` bits.

    Package-merge: at every level the symbols are merged with pairs of the level before; a symbol's
    length is the number of levels that use it.
    """
    present = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(present)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    if n < 2:
        lengths[present] = 1
        return lengths
    rising = present[np.argsort(counts[present], kind="stable")]
    weights = counts[rising].astype(np.float64 if counts.sum() > 1 << 40 else np.int64)
    level, symbols = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        symbols.append(order < n)
    used = 2 * n - 2
    for is_symbol in reversed(symbols):
        own = int(is_symbol[:used].sum())
        lengths[rising[:own]] += 1
        used = 2 * (used - own)
    return lengths


@dataclass(frozen=True)
class Code:
    """The canonical code of some code lengths: shorter first, then by id."""

    lengths: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.lengths, kind="stable")
        order = order[self.lengths[order] > 0]
        own = self.lengths[order]
        longest = int(own.max(initial=1))
        if longest > 24:
            raise ValueError("codes of more than 24 bits do not fit the decoder's window")
        sizes = np.left_shift(np.int64(1), longest - own)
        starts = np.cumsum(sizes) - sizes
        codes = np.zeros(len(self.lengths), np.uint64)
        codes[order] = starts >> (longest - own)
        object.__setattr__(self, "codes", codes)
        object.__setattr__(self, "longest", longest)
        # For every way the next bits can begin: the id, and in the lowest five bits its length.
        table = np.zeros(1 << longest, np.int32)
        table[: int(sizes.sum())] = np.repeat((order << 5 | own).astype(np.int32), sizes)
        object.__setattr__(self, "table", table)

    def encode(self, ids: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of every ``step``-th id."""
        if not len(ids):
            return b"", np.empty(0, np.int64)
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1] + 63 >> 6) + 1, np.uint64)
        for at in range(0, len(ids), _TOGETHER):  # so few that they stay in the processor's cache
            own = sizes[at : at + _TOGETHER]
            starts = ends[at : at + _TOGETHER] - own
            word, free = starts >> 6, 64 - (starts & 63) - own
            codes = self.codes[ids[at : at + _TOGETHER]]
            left = codes << np.maximum(free, 0).astype(np.uint64)
            over = np.flatnonzero(free < 0)  # codes that reach into the next word
            left[over] = codes[over] >> (-free[over]).astype(np.uint64)
            firsts = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[firsts]] |= np.bitwise_or.reduceat(left, firsts)
            out[word[over] + 1] |= codes[over] << (64 + free[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: int(ends[-1] + 7 >> 3)], (ends - sizes)[::step]

    def decode(self, bits: bytes, checkpoints: np.ndarray, count: int, step: int = STEP) -> np.ndarray:
        """The ``count`` ids of a block."""
        if not count:
            return np.empty(0, np.int32)
        # Past a block's last id a stretch reads on; it then meets zeros, or stays on the last byte.
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at = np.array(checkpoints, np.int64)
        out = np.empty((step, len(at)), np.int32)
        shift, mask, last = 32 - self.longest, (1 << self.longest) - 1, len(window) - 1
        for k in range(min(step, count)):
            seen = window[np.minimum(at >> 3, last)].astype(np.int64)
            found = self.table[seen >> (shift - (at & 7)) & mask]
            out[k] = found >> 5
            at += found & 31
        return out.T.reshape(-1)[:count]

    def decode_part(self, bits: bytes, checkpoints: np.ndarray, first: int, count: int, step: int = STEP) -> np.ndarray:
        """Ids ``first`` to ``first + count`` of a block, from the checkpoint before them on."""
        begin = first // step
        end = -(-(first + count) // step)
        part = self.decode(bits, np.asarray(checkpoints)[begin:end], (end - begin) * step, step)
        return part[first - begin * step :][:count]


_BLOCK = {"shard": "int", "block": "int", "ids_before": "long"}


def token_blocks(
    docs: DataFrame, path: str, blanks_count: bool, end_id: int, doc_id: str, text: str
) -> DataFrame:
    """Blocks of whole documents in ascending id order, with plain ids.

    Documents are dealt out in ranges of (id, text hash) and sorted, then encoded where they are.
    """
    schema = schema_of(
        **_BLOCK, doc_ids=_array_of(id_type(docs, doc_id)), lengths="array<long>", ids="binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        names, lengths, held, size = [], [], [], 0
        library = encoder(path, blanks_count, end_id)
        width = library.kind.itemsize

        def closed() -> pa.RecordBatch:
            row = {"shard": shard, "block": block, "ids_before": before, "doc_ids": names}
            row |= {"lengths": lengths, "ids": b"".join(held)}
            return pa.RecordBatch.from_pylist([row], _arrow(schema))

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                found = library.ids(decoded(texts_of(part.column(1))))
                for name, ids in zip(part.column(0).to_pylist(), found):
                    names.append(name)
                    lengths.append(len(ids) // width)
                    held.append(ids)
                    size += lengths[-1]
                    if size >= BLOCK_IDS:
                        yield closed()
                        block, before = block + 1, before + size
                        names, lengths, held, size = [], [], [], 0
        if names:
            yield closed()

    return (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
        .repartitionByRange(F.col("_id"), F.xxhash64("_text"))
        .sortWithinPartitions("_id")
        .mapInArrow(run, schema)
    )


def _array_of(kind):
    return f"array<{kind.simpleString()}>"


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def id_counts(blocks: DataFrame, size: int, kind: np.dtype) -> np.ndarray:
    """How often each of the vocabulary's ``size`` ids occurs.  Every task sends one number per id,
    and the driver gets ``size`` numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(ids, kind), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    rows = blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in rows.collect():
        counts[row["id"]] = row["n"]
    return counts


def write_ids(
    docs: DataFrame,
    folder: str,
    path: str,
    blanks_count: bool,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    longest: int = 18,
) -> None:
    """Encode every text, count the ids, and write ``folder`` in the module's format.

    Null texts are empty and hold the end id alone; null ids come first; rows that repeat an id
    are documents of their own, side by side; an empty table gives a folder without blocks; other
    columns are not read.  A document is never split, so a very long one makes a long block.
    """
    library = encoder(path, blanks_count, end_id)
    size, kind = max(library.library.get_vocab_size(), end_id + 1), library.kind
    blocks = stored(token_blocks(docs, path, blanks_count, end_id, doc_id, text), "token-blocks")
    lengths = code_lengths(id_counts(blocks, size, kind), longest)
    code = docs.sparkSession.sparkContext.broadcast(lengths)
    written = {f.name: f.dataType for f in blocks.schema if f.name != "ids"}
    schema = schema_of(**written, checkpoints="array<long>", bits="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Code(code.value)
        for batch in batches:
            done = [coder.encode(np.frombuffer(x, kind)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = batch.columns[:-1]
            columns.append(pa.array([x[1] for x in done], pa.list_(pa.int64())))
            columns.append(pa.array([x[0] for x in done], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    blocks.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{folder}/blocks")
    used = np.flatnonzero(lengths)
    rows = [(int(i), int(lengths[i])) for i in used]
    codes = docs.sparkSession.createDataFrame(rows, "id long, bits long")
    codes.coalesce(1).write.parquet(f"{folder}/code")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids`` per document: its ids as unsigned 32-bit little-endian integers, and
    how many ids all documents before it have.

    Blocks are decoded where they are read.  ``start`` needs the ids of every shard before: one row
    per shard of the writing job, which is what is broadcast.
    """
    code = spark.read.parquet(f"{folder}/code").collect()
    lengths = np.zeros(max((r["id"] for r in code), default=0) + 1, np.int64)
    for row in code:
        lengths[row["id"]] = row["bits"]
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType
    totals = blocks.selectExpr("shard", "explode(lengths) AS n").groupBy("shard").agg(F.sum("n").alias("n"))
    before, starts = 0, {}
    for shard, n in sorted(totals.collect()):
        starts[shard], before = before, before + n
    schema = schema_of(doc_id=kind, start="long", ids="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Code(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["lengths"], np.int64)
                ids = coder.decode(row["bits"], row["checkpoints"], int(sizes.sum()))
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                first = ends - sizes
                texts = [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), ends.tolist())]
                place = first + row["ids_before"] + starts[row["shard"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], _arrow(schema)[0].type), pa.array(place), pa.array(texts, pa.binary())],
                    schema.fieldNames(),
                )

    return blocks.mapInArrow(run, schema)


def ids_written_and_read(docs: DataFrame, path: str, blanks_count: bool, end_id: int, **names) -> DataFrame:
    """:func:`write_ids` to a new shared folder, then :func:`read_ids`."""
    folder = shared_folder(docs.sparkSession, "token-ids")
    write_ids(docs, folder, path, blanks_count, end_id, **names)
    return read_ids(docs.sparkSession, folder)
