"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample so that the signs of the rotated vectors are balanced
binary codes that keep angles; several rotations, from different starts, give a longer code.  The
code is cut into segments, and every segment is a table: vectors with an equal segment (and label)
meet in a bucket.  Every dimension that occurs has rotations and buckets of its own.  Inside a bucket the original vectors are compared in double precision, block by
block; a pair that also met in an earlier table is counted there only.  A large bucket is dealt out
as pairs of blocks, so no task gets a whole one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import stored
from .texts import schema_of


@dataclass(frozen=True)
class Quantiser:
    """``rotations`` from centred vectors to signs; segments of ``width`` bits (0: one table of all)."""

    mean: np.ndarray
    rotations: np.ndarray  # dimension x bits
    width: int

    @property
    def tables(self) -> int:
        return self.rotations.shape[1] // self.width if self.width else 1

    def signs(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.mean) @ self.rotations > 0

    def segments(self, vectors: np.ndarray) -> np.ndarray:
        """One row of segment values per vector; vectors of length one."""
        if not len(vectors):
            return np.empty((0, self.tables), np.int64)
        used = self.signs(vectors)[:, : self.tables * self.width].reshape(len(vectors), self.tables, self.width)
        return used @ (np.int64(1) << np.arange(self.width, dtype=np.int64))


def learn_rotation(vectors: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Principal axes, then the rotation that brings the projections closest to their signs."""
    _, axes = np.linalg.eigh(vectors.T @ vectors)
    projected = vectors @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=axes.shape))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(projected.T @ np.where(projected @ turn > 0, 1.0, -1.0))
        turn = left @ right
    return axes @ turn


def learn(vectors: np.ndarray, bits: int, width: int, rounds: int = 30) -> Quantiser:
    """A quantiser of at least ``bits`` bits."""
    mean = vectors.mean(axis=0)
    size = vectors.shape[1]
    turns = [learn_rotation(vectors - mean, rounds, seed) for seed in range(-(-bits // size))]
    return Quantiser(mean, np.concatenate(turns, axis=1)[:, :bits], width)


#: The least share of pairs at the limit that have to meet, measured on so many pairs of each kind,
#: and how many times the bits asked for may be used to reach it.
RECALL, _MEASURED, _LONGER = 0.999, 4000, 8


def at_limit(vectors: np.ndarray, least: float, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of a sample with partners at the cosine ``least``: apart in any direction, and in the
    directions in which the sample's vectors differ."""
    pick = np.random.default_rng(seed)
    own = vectors[pick.integers(len(vectors), size=_MEASURED)]
    for away in (pick.normal(size=own.shape), vectors[pick.integers(len(vectors), size=_MEASURED)]):
        away = away - (away * own).sum(axis=1, keepdims=True) * own
        long = np.linalg.norm(away, axis=1, keepdims=True)
        step = np.divide(away, long, out=np.zeros_like(own), where=long > 1e-6)
        yield own, np.where(long > 1e-6, least * own + np.sqrt(1 - least * least) * step, own)


def fitted(vectors: np.ndarray, least: float, width: int, tables: int, rows: int) -> Quantiser:
    """A quantiser under which at least :data:`RECALL` of the pairs at the limit meet in a table:
    ``tables`` of ``width`` bits if they do it, else the number and width that compare least for
    ``rows`` vectors of a label.  One table that holds a whole label always does it."""
    if not len(vectors):  # nothing to learn from
        return Quantiser(np.zeros(vectors.shape[1]), np.empty((vectors.shape[1], 0)), 0)
    model = learn(vectors, width * tables, width)
    if all((model.segments(a) == model.segments(b)).any(axis=1).mean() >= RECALL for a, b in at_limit(vectors, least)):
        return model
    some = vectors[np.random.default_rng(0).permutation(len(vectors))[: 2 * _MEASURED]]
    model = learn(some[::2], _LONGER * width * tables, width)
    others = some[1::2] if len(some) > 1 else some  # learned vectors lie farther from the cuts
    apart = [model.signs(a) != model.signs(b) for a, b in at_limit(others, least)]

    def cost(share: float, number: int) -> float:
        bucket = share * rows
        return number * (vectors.shape[1] * max(1.0, bucket / 1024) + bucket)

    best = (cost(1.0, 1), 0, 0)
    for bits in range(width, 0, -1):
        most = model.rotations.shape[1] // bits
        met = [~x[:, : most * bits].reshape(len(x), most, bits).any(axis=2) for x in apart]
        recall = np.min([np.logical_or.accumulate(x, axis=1).mean(axis=0) for x in met], axis=0)
        goal = (1 + RECALL) / 2  # other vectors than the sample's meet a little less often
        if recall[-1] >= goal:
            number = int(np.argmax(recall >= goal)) + 1
            _, found = np.unique(Quantiser(model.mean, model.rotations[:, :bits], bits).segments(some), return_counts=True)
            together = (found * (found - 1)).sum() / max(1, len(some) * (len(some) - 1))
            best = min(best, (cost(max(together, 0.5**bits), number), bits, number))
    _, bits, number = best
    return Quantiser(model.mean, model.rotations[:, : bits * number], bits)


def unit(rows: list, size: int) -> np.ndarray:
    vectors = np.array(rows, np.float64).reshape(-1, size)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


#: Which rows can link: an id, a label, and finite components that are not all zero.
_SOUND = """vector IS NOT NULL AND label IS NOT NULL AND id IS NOT NULL
    AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))
    AND exists(vector, x -> x != 0)"""


def near_vectors(
    vectors: DataFrame,
    least: float = 0.98,
    width: int = 16,
    tables: int = 20,
    sample: int = 20_000,
    block: int = 1024,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors``.

    Two rows link if their labels are equal, the cosine of their vectors is at least ``least`` and
    they meet in a table; equal vectors always do.  If the vectors' mean is near zero, a bit differs
    at the cosine 0.98 with probability 0.064 at most, so a pair shares one of 20 segments of 16 bits
    with probability 0.9998, and closer pairs more surely.  Centring widens the angles where the mean
    is large; so the share that meets is measured on pairs at the limit around the sample's vectors,
    and where ``tables`` of ``width`` bits give less than 0.999, more or narrower tables are used (see
    :func:`fitted`), up to one that holds a whole label.  ``width`` should grow with the logarithm of
    the rows of a label, and ``tables`` with it, to keep buckets small.  ``sample`` bounds what the driver learns from,
    over all dimensions; every row is indexed, by the quantiser of its vector's dimension.

    A null id, label or vector, a zero vector, and one with null or non-finite components link with
    nothing and are their own component; vectors of different dimensions never link.  Repeated rows are vectors of their own that link as copies; an
    empty table gives an empty one; other columns are not read.
    """
    base = vectors.select(
        F.col(vec_id).alias("id"), F.col(embedding).alias("vector"), F.col(label).alias("label")
    ).withColumn("label", F.expr(f"CASE WHEN {_SOUND} THEN label END"))
    grouped = base.where("label IS NOT NULL").groupBy("label", "vector")
    classes = stored(
        grouped.agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).withColumn(
            "class", F.monotonically_increasing_id()
        ),
        "vector-classes",
    )
    found = stored(_links(classes, least, width, tables, sample, block), "vector-links")
    forest = components(found.where("other IS NOT NULL").selectExpr("class AS a", "other AS b"), "vectors")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    placed = stored(
        classes.join(links, "class", "left")
        .join(forest.withColumnRenamed("node", "class"), "class", "left")
        .selectExpr(
            "label",
            "vector",
            "coalesce(links, 0) + copies - 1 AS n_links",
            "first_id",
            "coalesce(component, class) AS root",
        ),
        "vector-roots",
    )
    names = stored(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "vector-names")
    named = stored(placed.join(names, "root").drop("root", "first_id"), "vector-components")
    component = F.coalesce("component_id", "id")
    return base.join(named, ["label", "vector"], "left").select(
        F.col("id").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _sampled(classes: DataFrame, sample: int) -> dict[int, tuple[np.ndarray, int]]:
    """About ``sample`` vectors in all, by dimension: an equal number of each, or all it has, those
    with the smallest hashes; and the most vectors of one label."""
    sizes = classes.groupBy(F.size("vector").alias("size"), "label").count().groupBy("size")
    sizes = sizes.agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()
    counts, most = {r["size"]: r["n"] for r in sizes}, {r["size"]: r["most"] for r in sizes}
    chances = "".join(f" WHEN {d} THEN {min(1.0, sample / len(counts) / n)}D" for d, n in counts.items())
    if not counts:
        return {}
    hashed = f"pmod(xxhash64(vector), 1000000) < CASE size(vector){chances} END * 1000000"
    found: dict[int, list] = {d: [] for d in counts}
    for row in classes.where(hashed).select("vector").collect():
        found[len(row["vector"])].append(row["vector"])
    return {d: (unit(sorted(rows), d), most[d]) for d, rows in sorted(found.items())}


def _links(
    classes: DataFrame, least: float, width: int, tables: int, sample: int, block: int
) -> DataFrame:
    """``class, links, other``: how many rows of other classes a class links with, bucket by bucket,
    and the smallest class it is connected with inside that bucket (null if it is that itself)."""
    picked = _sampled(classes, sample)
    if not picked:
        return classes.sparkSession.createDataFrame([], _FOUND)
    models = {d: fitted(rows, least, width, tables, most) for d, (rows, most) in picked.items()}
    shared_models = classes.sparkSession.sparkContext.broadcast(models)
    label = classes.schema["label"].dataType
    coded = schema_of(
        **{"class": "long"}, label=label, copies="long", size="int", vector="array<double>", segments="array<long>"
    )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                rows = unit(part.column(4).to_pylist(), size)
                found = [pa.array(list(rows), pa.list_(pa.float64()))]
                found.append(pa.array(list(shared_models.value[size].segments(rows)), pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *found], coded.fieldNames())

    codes = stored(
        classes.select(
            "class", "label", "copies", F.size("vector").alias("size"), F.col("vector").cast("array<double>")
        ).mapInArrow(code, coded),
        "vector-codes",
    )
    bucket = ["size", "label", "table", "segment"]
    entries = codes.select("class", "size", "label", F.posexplode("segments").alias("table", "segment"))
    shared = stored(
        entries.groupBy(*bucket)
        .count()
        .where("count > 1")
        .select(*bucket, F.ceil(F.col("count") / block).cast("int").alias("blocks")),
        "vector-buckets",
    )
    met = (
        entries.join(shared, bucket)
        .groupBy("class")
        .agg(F.collect_list(F.struct("table", "segment", "blocks")).alias("met"))
    )
    dealt = (
        codes.join(met, "class")
        .select("class", "size", "label", "copies", "vector", "segments", F.inline("met"))
        .withColumn("own", F.expr("CAST(pmod(xxhash64(class), blocks) AS INT)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    )
    group = [*bucket, "low", "high"]
    columns = [*group, "own", "class", "copies", "segments", "vector"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in _whole_groups(batches, len(group)):
            for rows in _by_size(*portion):
                yield _compared(rows, least)

    return (
        dealt.select(*columns)
        .repartition(*group)
        .sortWithinPartitions(*group)
        .mapInArrow(compare, _FOUND)
    )


_FOUND = "class long, links long, other long"
#: Rows a task compares at once, at least; single pairs compared at once; groups compared as a matrix.
_ROWS, _PAIRS, _MATRIX = 20_000, 100_000, 48


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in portions that end with a group, and where the groups begin."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < _ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        begins = _begins(rows, keys)
        last = int(begins[-1])
        if last:
            yield rows.slice(0, last), begins[:-1]
        held = rows.slice(last).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, _begins(rows, keys)


def _begins(rows: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in range(keys):
        values = rows.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _by_size(rows: pa.Table, begins: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A portion in parts whose vectors have one dimension."""
    sizes = rows.column(0).to_numpy()[begins]
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(begins)]
    ends = np.append(begins, rows.num_rows)
    for a, b in zip(cuts, cuts[1:]):
        first = int(ends[a])
        yield rows.slice(first, int(ends[b]) - first), begins[a:b] - first


def _compared(portion: tuple[pa.Table, np.ndarray], least: float) -> pa.RecordBatch:
    rows, begins = portion
    number = rows.num_rows
    table, low, high, own, name, copies = (rows.column(k).to_numpy() for k in (2, 4, 5, 6, 7, 8))
    segments = _matrix(rows.column(9), np.int64)
    vectors = _matrix(rows.column(10), np.float64)
    sizes = np.diff(np.append(begins, number))
    links, root = np.zeros(number, np.int64), np.arange(number)
    for a, b in _pairs(vectors, begins, sizes, least):
        # Pairs of two blocks only, and of one block only, in their own group; earlier tables first.
        fits = (own[a] != own[b]) | (low[a] == high[a])
        a, b = a[fits], b[fits]
        same = segments[a] == segments[b]
        fits = np.argmax(same, axis=1) == table[a] if len(a) else np.empty(0, bool)
        a, b = a[fits], b[fits]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        _join(root, a, b)
    used = np.flatnonzero(links)
    other = name[root[used]]
    mask = other == name[used]
    columns = [pa.array(name[used]), pa.array(links[used]), pa.array(other, mask=mask)]
    return pa.RecordBatch.from_arrays(columns, ["class", "links", "other"])


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(values), -1)


def _pairs(vectors, begins, sizes, least) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), a before b in one group, whose cosine is large enough."""
    for start, size in zip(begins[sizes > _MATRIX].tolist(), sizes[sizes > _MATRIX].tolist()):
        own = vectors[start : start + size]
        a, b = np.nonzero(np.triu(own @ own.T >= least, 1))
        yield start + a, start + b
    begins, sizes = begins[sizes <= _MATRIX], sizes[sizes <= _MATRIX]
    for distance in range(1, _MATRIX):
        firsts, left = begins[sizes > distance], sizes[sizes > distance] - distance
        if not len(firsts):
            return
        step = np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
        every = np.repeat(firsts, left) + step
        for at in range(0, len(every), _PAIRS):
            a = every[at : at + _PAIRS]
            near = np.einsum("ij,ij->i", vectors[a], vectors[a + distance]) >= least
            yield a[near], a[near] + distance


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of linked rows until every pair has one root, the smallest row of its tree."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while True:
            shorter = root[root]
            if (shorter == root).all():
                break
            root[:] = shorter
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
