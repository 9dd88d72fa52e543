"""Hard negatives by a secondary sort: packed keys, sorted partitions, and one pass over them.

Anchors meet all rows in blocks, and exact inner products are taken block by block.  Two sweeps over
the blocks leave, per anchor and block, only rows that can count: first the best rows of the
anchor's own label, which name its positives, then the best rows of other labels inside each
positive's window of scores.  These go through a secondary-sort shuffle, the data-frame form of
``repartitionAndSortWithinPartitions``: dealt by anchor, sorted by (anchor, descending score,
positives first, id).  A streaming iterator opens a window at each positive, emits the negatives
that fall into open windows, and closes a window that is full or left behind; it holds a few windows
and no anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .texts import schema_of

#: Rows of a block and anchors of a block, at most on average; scores a task holds at once.
ROWS, ANCHORS, SCORES = 32_768, 16_384, 1 << 20

#: Which rows take part.
_SOUND = """id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL
    AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"""

_MET = "anchor long, row long, id long, score long"


def hard_negatives(
    vectors: DataFrame,
    is_anchor: str = "id % 50 = 0",
    positives: int = 5,
    negatives: int = 3,
    least_percent: int = 50,
    most_percent: int = 95,
    scale: int = 256,
    label_rule: str = "label",
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``; a row's score for an anchor is their integer inner
    product, higher first, ties by the smaller id.  An anchor's positives are its first ``positives``
    other rows of its label; each gets the first ``negatives`` rows of other labels whose score lies
    between ``least_percent`` and ``most_percent`` of its own (all, if there are fewer).
    ``is_anchor`` and ``label_rule`` are SQL over ``id`` and ``label``.

    Rows with a null id, label or vector, or a null or non-finite component take no part; rows only
    meet rows of their own dimension; vectors without components score 0.  Repeated rows are rows of
    their own: a copy of an anchor is another row to it, and copies of an anchor are mined each.
    Ties between rows of one id go by an internal row number.  A positive whose score is below 0 has
    no window.  Scores beyond a long raise an error.  An empty table gives an empty one; other
    columns are not read.
    """
    base = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("vector")
    ).where(_SOUND)
    rows = stored(
        base.withColumn("label", F.expr(label_rule))
        .where("label IS NOT NULL")
        .withColumn("anchor", F.expr(f"coalesce({is_anchor}, false)"))
        .withColumn("size", F.size("vector"))
        .withColumn("row", F.monotonically_increasing_id()),
        "negatives-rows",
    )
    sizes = rows.groupBy("size").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).collect()
    workers = rows.sparkSession.sparkContext.defaultParallelism
    parts = {r["size"]: (max(workers, -(-r["n"] // ROWS)), max(1, -(-r["anchors"] // ANCHORS))) for r in sizes}
    if not parts:
        parts = {0: (1, 1)}
    window = "PARTITION BY anchor ORDER BY score DESC, id, row"
    first = stored(
        _swept(rows, None, parts, positives, scale)
        .selectExpr("*", f"row_number() OVER ({window}) AS place")
        .where(f"place <= {positives}"),
        "negatives-positives",
    )
    windows = first.where("score >= 0").groupBy("anchor").agg(
        F.sort_array(
            F.collect_list(  # of the few positives of an anchor
                F.expr(
                    f"struct(CAST(ceil(score * CAST({least_percent} AS DECIMAL(9)) / 100) AS BIGINT) AS low,"
                    f" CAST(floor(score * CAST({most_percent} AS DECIMAL(9)) / 100) AS BIGINT) AS high)"
                )
            )
        ).alias("windows")
    )
    others = _swept(rows, windows, parts, negatives, scale)
    packed = (
        first.selectExpr("anchor", "score", "0 AS kind", "id", "row")
        .union(others.selectExpr("anchor", "score", "1 AS kind", "id", "row"))
        .selectExpr("struct(anchor, -score AS falling, kind, id, row) AS key")
    )
    mined = (
        packed.repartition("key.anchor")
        .sortWithinPartitions("key")
        .select("key.*")
        .mapInArrow(_mining(negatives, least_percent, most_percent), _MINED)
    )
    names = rows.where("anchor").selectExpr("row AS anchor", "id AS anchor_id")
    return mined.join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


_MINED = """anchor long, positive_id long, rank int, negative_id long, positive_score long,
    negative_score long"""


def _mining(negatives: int, least: int, most: int):
    """The streaming iterator over (anchor, falling score, kind, id, row) in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            out = []
            for own, falling, kind, name in zip(*(batch.column(k).to_pylist() for k in range(4))):
                score = -falling
                if own != anchor:
                    anchor, windows = own, []
                if not kind:
                    windows.append([name, score, 0])
                    continue
                for window in windows:
                    positive, high, found = window
                    if 100 * score <= most * high and 100 * score >= least * high:
                        window[2] = found + 1
                        out.append((anchor, positive, found + 1, name, high, score))
                # Full windows, and those whose lower end lies above this score, are closed.
                windows = [w for w in windows if w[2] < negatives and 100 * score >= least * w[1]]
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in _MINED.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _swept(rows: DataFrame, windows: DataFrame | None, parts: dict[int, tuple[int, int]], keep: int, scale: int) -> DataFrame:
    """``anchor, row, id, score`` of each block's best ``keep`` rows per anchor: of the anchor's label
    (without ``windows``), else of other labels and inside each of its windows.

    A group is one block of rows and one block of anchors of a dimension; its anchors come first,
    and rows then stream past them in the order of their ids.
    """
    tall = "CASE size " + " ".join(f"WHEN {s} THEN {r}" for s, (r, _) in parts.items()) + " END"
    wide = "CASE size " + " ".join(f"WHEN {s} THEN {a}" for s, (_, a) in parts.items()) + " END"
    spread = "CAST(pmod(xxhash64(row), {}) AS INT)"
    none = "CAST(array() AS array<struct<low: bigint, high: bigint>>) AS windows"
    own = rows.selectExpr(
        "size", f"{spread.format(tall)} AS tall", f"explode(sequence(0, {wide} - 1)) AS wide", "1 AS kind", "id", "row", "label", "vector", none
    )
    asked = rows.where("anchor").select("size", "id", "row", "label", "vector")
    if windows is None:
        asked = asked.selectExpr("*", none)
    else:
        asked = asked.join(windows.withColumnRenamed("anchor", "row"), "row")
    asked = asked.selectExpr(
        "size", f"explode(sequence(0, {tall} - 1)) AS tall", f"{spread.format(wide)} AS wide", "0 AS kind", "id", "row", "label", "vector", "windows"
    )
    group, others = ["size", "tall", "wide"], windows is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, now = None, None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if b <= a:
                    continue
                part, key = batch.slice(a, b - a), tuple(keys[a])
                if key[:3] != now:
                    if block:
                        yield block.leaders()
                    now, block, held = key[:3], None, []
                if key[3] == 0:
                    held.append(part)
                elif held or block:
                    if block is None:
                        block, held = _Block(held, others, keep, scale), []
                    block.take(part)
        if block:
            yield block.leaders()

    columns = [*group, "kind", "id", "row", "label", "vector", "windows"]
    both = asked.select(*columns).union(own.select(*columns))
    return both.repartition(*group).sortWithinPartitions(*group, "kind", "id", "row").mapInArrow(run, _MET)


class _Block:
    """The anchors of one group, and the best rows met so far per anchor and window."""

    def __init__(self, batches: list[pa.RecordBatch], others: bool, keep: int, scale: int):
        self.others, self.keep, self.scale = others, keep, scale
        self.rows = np.concatenate([b.column(5).to_numpy() for b in batches])
        self.labels = np.concatenate([b.column(6).to_numpy() for b in batches])
        self.vectors = np.concatenate([_scaled(b.column(7), scale) for b in batches])
        limits = [w for b in batches for w in b.column(8).to_pylist()]
        many = max([1, *map(len, limits)])
        #: Bounds per anchor and window; an absent window lets nothing in.
        self.low = np.full((len(self.rows), many), _MOST)
        self.high = np.full((len(self.rows), many), -_MOST)
        for n, own in enumerate(limits):
            for k, window in enumerate(own):
                self.low[n, k], self.high[n, k] = window["low"], window["high"]
        if not others:
            self.low[:], self.high[:] = -_MOST, _MOST
        self.found = np.empty((0, 3), np.int64)  # anchor and window, score, row
        self.ids = np.empty(0, np.int64)

    def take(self, part: pa.RecordBatch) -> None:
        """Rows in ascending (id, row) order: of equal scores, those met earlier come first."""
        step = max(16, SCORES // max(1, len(self.rows)))
        for at in range(0, part.num_rows, step):
            self._take(part.slice(at, step))

    def _take(self, part: pa.RecordBatch) -> None:
        names, rows, labels = (part.column(k).to_numpy() for k in (4, 5, 6))
        scores = _products(self.vectors, _scaled(part.column(7), self.scale))
        fits = self.labels[:, None] == labels
        fits = ~fits if self.others else fits & (self.rows[:, None] != rows)
        kind, number, score, place = [], [], [], []
        for k in range(self.low.shape[1]):
            a, b = np.nonzero(fits & (scores >= self.low[:, k, None]) & (scores <= self.high[:, k, None]))
            kind.append(a * self.low.shape[1] + k)
            score.append(scores[a, b].astype(np.int64))
            place.append(b)
        kind, score, place = (np.concatenate(x) for x in (kind, score, place))
        if not len(kind):
            return
        found = np.concatenate([self.found, np.stack([kind, score, rows[place]], axis=1)])
        ids = np.concatenate([self.ids, names[place]])
        order = np.lexsort((-found[:, 1], found[:, 0]))  # stable: earlier rows stay in front
        found, ids = found[order], ids[order]
        begins = np.flatnonzero(np.diff(found[:, 0], prepend=-1))
        sizes = np.diff(np.append(begins, len(found)))
        rank = np.arange(len(found)) - np.repeat(begins, sizes)
        full = begins[sizes >= self.keep] + self.keep - 1
        # A window that is full only lets in what is better than its last row.
        self.low.reshape(-1)[found[full, 0]] = found[full, 1] + 1
        self.found, self.ids = found[rank < self.keep], ids[rank < self.keep]

    def leaders(self) -> pa.RecordBatch:
        """The rows found, each once per anchor."""
        anchor = self.rows[self.found[:, 0] // self.low.shape[1]]
        _, only = np.unique(np.stack([anchor, self.found[:, 2]], axis=1), axis=0, return_index=True)
        columns = [anchor[only], self.found[only, 2], self.ids[only], self.found[only, 1]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "row", "id", "score"])


#: Above every score.
_MOST = np.iinfo(np.int64).max - 1


def _scaled(column: pa.Array, scale: int) -> np.ndarray:
    """``floor(scale * x)`` in double precision, one row per vector."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * values).reshape(len(column), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``a`` and ``b``."""
    largest = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if largest < 2.0**53:  # every partial sum is exact
        return (a @ b.T).astype(np.int64)
    if largest < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[int(x) for x in row] for row in b.tolist()]
    exact = [[sum(int(x) * y for x, y in zip(row, other)) for other in whole] for row in a.tolist()]
    return np.array(exact, dtype=np.int64).reshape(len(a), len(b))
