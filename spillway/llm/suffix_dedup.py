"""Removes every byte inside a long string that also starts elsewhere.

Batches go into a logarithmic family of sampled suffix arrays (see :mod:`suffixes`), whose scans
leave the suffixes that agree with another one for ``depth`` bytes.  Of these, equal contexts are
one class.  All strings around a class that occurs twice are repeated.  Where several classes share
a suffix, one example of each is fetched from its text, and strings of full length are compared at
every offset; strings that overlap a suffix differently never have to meet, since equal strings
hold the same suffix at the same place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import remove_all, stored
from .suffixes import IndexFamily, suffixes, text_key
from .texts import id_type, schema_of, texts_of

#: Classes of one suffix that a task compares at once; beyond, their strings are dealt out singly.
CLASSES = 8192
#: Contexts in a portion, at least; a portion ends with a suffix.
_PORTION = 6000
#: Contexts whose running sums are held at once.
_SUMMED = 256


def without_repeats(
    docs: DataFrame,
    least: int = 400,
    depth: int = 128,
    batches: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` per row of ``docs``: the removed stretches ``(first, end)`` of
    its UTF-8 bytes, and the bytes left, concatenated.

    A byte goes if a string of ``least`` bytes that covers it starts anywhere else too, in the same
    text or another row's; strings are judged on the input.  Stretches are maximal, in order.  The
    table is indexed in ``batches`` parts, which change nothing in the result.

    A null text is empty; texts shorter than ``least`` stay whole and remove nothing; of repeated
    rows and equal texts of ``least`` bytes or more nothing stays.  Null and repeated ids are ids
    like others.  A very long text is read in portions, and one that repeats a short pattern makes
    one row for each stretch of it.  There are no ties.  An empty table gives an empty one; other
    columns are not read.  Strings count as equal by 64-bit hashes of themselves, given that they
    hold suffixes of one 64-bit hash.
    """
    if not 8 <= depth < least:
        raise ValueError("a suffix is compared by 8 bytes or more, and by fewer than a string has")
    spark = docs.sparkSession
    early: list[str] = []  # read up to the suspects
    late: list[str] = []  # read up to the spans
    sampled = stored(suffixes(docs, least, depth, doc_id, text), "suffixes", early)
    family, found = IndexFamily(spark, early), []
    for n in range(batches):
        found.append(family.add(sampled.where(F.expr(f"pmod(xxhash64(text_key), {batches}) = {n}"))))
    family.remove()
    matched = found[0]
    for more in found[1:]:
        matched = matched.union(more)
    suspects = stored(
        sampled.join(matched.distinct(), ["head", "hash"], "left_semi")
        .groupBy("text_key", "pos", "last", "back", "ahead", "hash", "context")
        .agg(F.sum("n").alias("n"), F.min("who").alias("who")),
        "suspects",
        late,
    )
    remove_all(spark, early)
    classes = stored(
        suspects.groupBy("hash", "context", "back", "ahead").agg(
            F.sum("n").alias("n"), F.min(F.struct("text_key", "who", "pos")).alias("at")
        ),
        "suffix-classes",
        late,
    )
    crowds = classes.groupBy("hash").agg(F.count("*").alias("crowd")).where("crowd > 1")
    wanted = stored(_wanted(classes.join(crowds, "hash")), "wanted-contexts", early)
    contexts = stored(_contexts(docs, wanted, least, depth, doc_id, text), "contexts", late)
    remove_all(spark, early)
    small = contexts.where(f"crowd <= {CLASSES}").repartition("hash").sortWithinPartitions("hash", "context")
    compared = small.select("hash", "context", "back", "bytes").mapInArrow(_comparing(least, depth), _REACH)
    large = _dealt(contexts.where(f"crowd > {CLASSES}"), least, depth)
    certain = classes.where("n > 1").select("hash", "context", "back", "ahead")
    reaches = (
        certain.union(compared)
        .union(large)
        .groupBy("hash", "context")
        .agg(F.max("back").alias("reach_back"), F.max("ahead").alias("reach_ahead"))
    )
    spans = stored(
        suspects.join(reaches, ["hash", "context"])
        .groupBy("text_key")
        .agg(F.collect_list(F.expr("struct(pos - reach_back AS first, last + reach_ahead AS end)")).alias("spans")),
        "repeated-spans",
    )
    remove_all(spark, late)
    return _cut(docs, spans, doc_id, text)


_REACH = "hash long, context long, back int, ahead int"


def _wanted(classes: DataFrame) -> DataFrame:
    """``text_key, who, wanted``: the classes whose context is to come from a text."""
    return classes.groupBy(F.col("at.text_key").alias("text_key"), F.col("at.who").alias("who")).agg(
        F.collect_list(F.struct("at.pos", "hash", "context", "crowd")).alias("wanted")
    )


def _contexts(docs: DataFrame, wanted: DataFrame, least: int, depth: int, doc_id: str, text: str) -> DataFrame:
    """``hash, context, crowd, back, bytes``: each class's context, from one text that has it."""
    out = "hash long, context long, crowd long, back int, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set = set()  # rows that are repeated whole ask for the same contexts
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for own, asked in zip(texts_of(part.column(0)), part.column(1).to_pylist()):
                    for one in asked:
                        if (name := (one["hash"], one["context"])) not in met:
                            met.add(name)
                            back = min(one["pos"], least - depth)
                            rows.append((*name, one["crowd"], back, own[one["pos"] - back : one["pos"] + least]))
                if len(met) > 1 << 18:
                    met.clear()
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "context", "crowd", "back", "bytes"])

    return (
        docs.select(text_key(text).alias("text_key"), F.xxhash64(F.col(doc_id)).alias("who"), F.col(text).alias("_text"))
        .join(wanted, ["text_key", "who"])
        .select("_text", "wanted")
        .mapInArrow(run, out)
    )


def _windows(backs: np.ndarray, contexts: list[bytes], least: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A value of every string of ``least`` bytes over the suffix, by start (columns; the suffix is
    at ``least - depth``), and whether the context holds that string.  Values of one column compare."""
    reach = least - depth
    width = reach + least
    table = np.random.default_rng(12).integers(1 << 62, size=256, dtype=np.uint64)
    factors = np.empty(width, np.uint64)
    factor = 1
    for k in range(width):
        factors[k], factor = factor, factor * 0xD1342543DE82EF95 % (1 << 64)
    sizes = np.array([len(c) for c in contexts], np.int64)
    first = reach - backs
    values = np.empty((len(contexts), reach + 1), np.uint64, order="F")  # read by start
    for at in range(0, len(contexts), _SUMMED):
        part, own = contexts[at : at + _SUMMED], sizes[at : at + _SUMMED]
        flat = np.frombuffer(b"".join(part), np.uint8)
        ends = np.cumsum(own)
        place = np.arange(len(flat)) - np.repeat(ends - own - first[at : at + _SUMMED], own)
        sums = np.zeros((len(part), width + 1), np.uint64)
        sums[np.repeat(np.arange(len(part)), own), place + 1] = table[flat] * factors[place]
        np.cumsum(sums, axis=1, out=sums)
        values[at : at + _SUMMED] = sums[:, least:] - sums[:, : reach + 1]
    starts = np.arange(reach + 1)
    there = (starts >= first[:, None]) & (starts + least <= (first + sizes)[:, None])
    return values, there


def _comparing(least: int, depth: int):
    reach = least - depth

    def compare(portion: pa.Table) -> pa.RecordBatch:
        found = [portion.column(k).to_numpy() for k in range(3)]
        new = np.ones(len(found[0]), bool)  # a context may come from two tasks
        new[1:] = (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])
        portion = portion.filter(pa.array(new))
        names, contexts, backs = (x[new] for x in found)
        values, there = _windows(backs, portion.column(3).to_pylist(), least, depth)
        first, last = np.full(len(names), reach + 1), np.full(len(names), -1)
        for start in range(reach + 1):
            rows = np.flatnonzero(there[:, start])
            order = rows[np.argsort(values[rows, start])]
            same = values[order[1:], start] == values[order[:-1], start]
            twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
            first[twice] = np.minimum(first[twice], start)
            last[twice] = start
        some = last >= 0
        columns = [names[some], contexts[some]]
        columns += [(reach - first[some]).astype(np.int32), (last[some] + least - reach).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "context", "back", "ahead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, _PORTION):
                held.append(batch.slice(at, _PORTION))
                if sum(b.num_rows for b in held) < _PORTION:
                    continue
                rows = pa.Table.from_batches(held).combine_chunks()
                names = rows.column(0).to_numpy()
                last = int(np.searchsorted(names, names[-1]))  # the last suffix may go on
                if last:
                    yield compare(rows.slice(0, last))
                held = rows.slice(last).to_batches()
        if held and sum(b.num_rows for b in held):
            yield compare(pa.Table.from_batches(held).combine_chunks())

    return run


def _dealt(contexts: DataFrame, least: int, depth: int) -> DataFrame:
    """The same for suffixes with very many classes: their strings are dealt out by value, counted
    with sums taken before the shuffle, and the reach of a class is that of its repeated strings."""
    reach = least - depth
    contexts = contexts.dropDuplicates(["hash", "context"])
    schema = "hash long, context long, start int, value long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, own, backs = (part.column(k).to_numpy() for k in range(3))
                values, there = _windows(backs, part.column(3).to_pylist(), least, depth)
                row, start = np.nonzero(there)
                columns = [names[row], own[row], start.astype(np.int32), values[row, start].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "context", "start", "value"])

    strings = contexts.select("hash", "context", "back", "bytes").mapInArrow(run, schema)
    key = ["hash", "start", "value"]
    twice = strings.groupBy(*key).count().where("count > 1").drop("count")
    return (
        strings.join(twice, key)
        .groupBy("hash", "context")
        .agg(F.min("start").alias("first"), F.max("start").alias("last"))
        .selectExpr("hash", "context", f"{reach} - first AS back", f"last + {least - reach} AS ahead")
    )


def _cut(docs: DataFrame, spans: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every document without its spans, which may overlap."""
    schema = schema_of(
        doc_id=id_type(docs, doc_id), n_bytes="long", spans="array<struct<first: int, end: int>>", kept="binary"
    )
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, runs, kept = [], [], []
                for own, found in zip(texts_of(part.column(1)), part.column(2).to_pylist()):
                    merged: list[dict] = []
                    for span in sorted(found or [], key=lambda s: s["first"]):
                        if merged and span["first"] <= merged[-1]["end"]:
                            merged[-1]["end"] = max(merged[-1]["end"], span["end"])
                        else:
                            merged.append(dict(span))
                    cuts = [0, *(x for s in merged for x in (s["first"], s["end"])), len(own)]
                    sizes.append(len(own))
                    runs.append(merged)
                    kept.append(b"".join(own[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), text_key(text).alias("text_key"))
        .join(spans, "text_key", "left")
        .select("_id", "_text", "spans")
        .mapInArrow(run, schema)
    )
