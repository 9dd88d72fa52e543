"""Whitened embeddings along the leading principal axes, found by spectrum slicing.

Sums and centred products are added up by Spark, dimension by dimension and entry by entry; the
driver gets one covariance matrix per vector length, which does not grow with the rows, and slices
its spectrum (see :mod:`spectrum`).  The projection is broadcast and every row is projected where
it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectrum import leading
from .storage import stored
from .texts import id_type, schema_of

#: Components of at most this size stay whole numbers in double precision after scaling.
_LARGEST = 2.0**40

_SOUND = f"""vector IS NOT NULL AND size(vector) > 0
    AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <= {_LARGEST:.1f}D)"""


def whitened(
    vectors: DataFrame,
    components: int = 8,
    scale: int = 1024,
    shift: int = 100_000,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error``, one row per sound vector.

    Entries ``c`` become whole numbers ``x = floor(scale * c) + shift``.  ``n`` and the sums S are
    those of all sound vectors; the covariance has divisor ``n`` and is centred before multiplying.
    ``whitened`` holds ``x - S/n`` along each of the leading unit eigenvectors, by falling
    eigenvalue, over the root of the eigenvalue; ``explained`` is each one's share of the trace;
    ``deviation`` is the exact sum of ``(n x - S)^2``, a decimal of 38 digits; ``identity_error`` is
    the largest entry of the whitened vectors' own covariance minus the identity.

    Rows whose vector is null or empty, or holds a null or non-finite entry or one beyond 2^40, are
    dropped.  Vectors of each length are a fit of their own.  There are fewer components where the
    covariance has fewer eigenvalues above rounding: none for a single row or equal rows, whose
    lists are empty.  Equal eigenvalues get some orthonormal basis of their space.  Repeated rows
    count as often as they occur, a null id stays null, an empty table gives an empty one, and other
    columns are not read.
    """
    spark = vectors.sparkSession
    sound = vectors.select(F.col(vec_id).alias("_id"), F.col(embedding).alias("vector")).where(_SOUND)
    sums = _sums(sound, scale, shift)
    shared = spark.sparkContext.broadcast(sums)
    models = {
        size: _model(n, total, products, components)
        for (size, (n, total)), products in zip(sorted(sums.items()), _products(sound, shared, scale, shift))
    }
    fits = spark.sparkContext.broadcast(models)
    schema = schema_of(
        vec_id=id_type(vectors, vec_id), size="int", n="long", deviation="decimal(38,0)", whitened="array<double>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, size, x in _numbers(batches, scale, shift):
            n, total, axes, _ = fits.value[size]
            projected = (x - _mean(n, total)) @ axes
            columns = [names, pa.array(np.full(len(x), size, np.int32)), pa.array(np.full(len(x), n))]
            columns.append(pa.array(_deviations(x, n, total), pa.decimal128(38, 0)))
            columns.append(pa.array(list(projected), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    rows = stored(sound.mapInArrow(run, schema), "whitened")
    errors = _identity_errors(rows, {size: model[3].size for size, model in models.items()})
    shares = "CASE size " + " ".join(
        f"WHEN {size} THEN struct({_doubles(model[3])} AS explained, {errors[size]!r}D AS identity_error)"
        for size, model in models.items()
    )
    fixed = f"{shares} END" if models else "struct(array(0D) AS explained, 0D AS identity_error)"
    return rows.withColumn("_fixed", F.expr(fixed)).select("vec_id", "n", "deviation", "whitened", "_fixed.*")


def _doubles(values: np.ndarray) -> str:
    inside = ", ".join(f"{float(v)!r}D" for v in values)
    return f"CAST(array({inside}) AS array<double>)"


def _mean(n: int, total: list[int]) -> np.ndarray:
    return np.array([t / n for t in total])  # whole numbers, rounded once


def _numbers(batches: Iterator[pa.RecordBatch], scale: int, shift: int):
    """Ids, vector length, and whole numbers in double precision, one matrix per vector length."""
    for batch in batches:
        column = batch.column(1)
        lengths = column.value_lengths().to_numpy()
        for size in np.unique(lengths).tolist():
            part = batch if (lengths == size).all() else batch.filter(pa.array(lengths == size))
            entries = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield part.column(0), size, np.floor(scale * entries).reshape(-1, size) + shift


def _sums(sound: DataFrame, scale: int, shift: int) -> dict[int, tuple[int, list[int]]]:
    """Vector length: rows, and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for _, size, x in _numbers(batches, scale, shift):
            n, total = found.get(size, (0, [0] * size))
            # Halves of the numbers, so that no sum of a batch leaves a long.
            high, low = np.divmod(x.astype(np.int64), 1 << 32)
            own = zip(total, high.sum(axis=0).tolist(), low.sum(axis=0).tolist())
            found[size] = n + len(x), [t + (h << 32) + m for t, h, m in own]
        rows = [(s, d, n, t) for s, (n, total) in found.items() for d, t in enumerate(total)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["size", "place", "n", "total"])

    parts = sound.mapInArrow(run, "size int, place int, n long, total decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    added = parts.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for row in sorted(added.collect()):
        n, total = out.setdefault(row["size"], (row["n"], []))
        total.append(int(row["total"]))
    return out


def _products(sound: DataFrame, sums, scale: int, shift: int) -> list[np.ndarray]:
    """By vector length: the sums of products of centred dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for _, size, x in _numbers(batches, scale, shift):
            centred = x - _mean(*sums.value[size])
            found[size] = found.get(size, 0.0) + centred.T @ centred
        for size, products in found.items():
            upper = np.triu_indices(size)
            columns = [np.full(len(upper[0]), size, np.int32), *(u.astype(np.int32) for u in upper), products[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["size", "a", "b", "total"])

    parts = sound.mapInArrow(run, "size int, a int, b int, total double")
    out = {size: np.zeros((size, size)) for size in sorted(sums.value)}
    for row in parts.groupBy("size", "a", "b").agg(F.sum("total").alias("total")).collect():
        out[row["size"]][row["a"], row["b"]] = out[row["size"]][row["b"], row["a"]] = row["total"]
    return list(out.values())


def _model(n: int, total: list[int], products: np.ndarray, components: int) -> tuple:
    """``n``, sums, axes divided by the roots of their eigenvalues, and shares of the trace."""
    covariance = products / n
    pairs = leading(covariance, components)
    return n, total, pairs.vectors / np.sqrt(pairs.values), pairs.values / max(np.trace(covariance), 1e-300)


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Exact sums of ``(n x - S)^2``."""
    reach = n * max(1.0, float(np.abs(x).max(initial=0))) + max(map(abs, total))
    if reach * reach * x.shape[1] < 2.0**62:
        return ((n * x.astype(np.int64) - np.array(total)) ** 2).sum(axis=1).tolist()
    centre = round(total[0] / n)  # most numbers lie near each other
    offset = [t - n * centre for t in total]
    return [
        sum((n * (int(v) - centre) - o) ** 2 for v, o in zip(row, offset)) for row in x.astype(np.int64).tolist()
    ]


def _identity_errors(rows: DataFrame, numbers: dict[int, int]) -> dict[int, float]:
    """By vector length: the largest entry of the whitened vectors' covariance minus the identity."""
    most = max(numbers.values(), default=0)
    if not most:
        return dict.fromkeys(numbers, 0.0)
    means = rows.groupBy("size").agg(*[F.expr(f"avg(get(whitened, {k}))").alias(f"m{k}") for k in range(most)])
    pairs = [(a, b) for a in range(most) for b in range(a, most)]
    centred = rows.join(F.broadcast(means), "size")  # a row per vector length
    entries = centred.groupBy("size").agg(
        *[F.expr(f"avg((get(whitened, {a}) - m{a}) * (get(whitened, {b}) - m{b}))").alias(f"c{a}_{b}") for a, b in pairs]
    )
    out = dict.fromkeys(numbers, 0.0)
    for row in entries.collect():
        own = [(a, b) for a, b in pairs if b < numbers[row["size"]]]
        out[row["size"]] = max((abs(row[f"c{a}_{b}"] - (a == b)) for a, b in own), default=0.0)
    return out
