"""Subword lattice likelihood: a text's probability over all ways to cut it into pieces.

The vocabulary is an existing one.  Every piece has a log probability; the probability of a text is
the sum, over all its segmentations, of the products of their pieces, and then of its end.  No piece
crosses the blank in front of a word, so the lattice of a text falls apart into those of its words,
and a word's marginal is worked out once wherever it occurs: a forward recursion in log space over
many words of one length at a time.  A long word (unbroken text) is swept alone, stretch by stretch:
numpy finds the pieces of a stretch, and the recursion runs along them.

The piece probabilities are learned by expectation maximisation over the distinct words of the
corpus and their counts, which a shuffle gathers; backward values give the expected piece counts.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, inf, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .texts import held_out, id_type, schema_of, texts_of

#: The end of a text as a token: no word is empty.
END = b""
#: Words counted in a task before they go to the shuffle, and words whose values a worker keeps.
COUNTED, KEPT = 300_000, 200_000
#: Bytes of words held for these at once, beside one word of any length.
HELD = 1 << 26
#: Words whose lattices a task works through at once.
TOGETHER = 100_000
#: Words this frequent, and no longer, may be broadcast: at most this many.
HEAD, HEAD_BYTES = 1 << 17, 64
#: Bytes from which a word is swept alone, and bytes of it whose pieces are held at once.
LONG, STRETCH = 256, 1 << 14
#: Bytes of words of one length worked through together.
BLOCK = 1 << 18
_LN10 = np.log(10)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


@dataclass(frozen=True)
class Pieces:
    """Distinct byte strings, a blank standing for the start of a word, and natural log
    probabilities that sum to one together with ``end``."""

    surfaces: tuple[bytes, ...]
    logs: np.ndarray
    end: float

    def scored(self, logs: np.ndarray, end: float) -> Pieces:
        return Pieces(self.surfaces, logs, end)


def pieces_of(path: str) -> Pieces:
    """The pieces of a sentencepiece file.  Byte pieces become single bytes, so every text has a
    segmentation.  Scores that are log probabilities are used as such; scores that are whole
    numbers are ranks, and a piece of rank r starts with a weight of 1 / (r + 10)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    scores = [model.get_score(i) for i in range(model.get_piece_size())]
    ranks = all(s == int(s) for s in scores)
    for i, score in enumerate(scores):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            surface = bytes([int(re.fullmatch("<0x(..)>", piece)[1], 16)])
        else:
            surface = piece.replace("▁", " ").encode()
        if surface and b" " not in surface[1:]:
            weight = 1 / (10 - score) if ranks else np.exp(score)
            found[surface] = found.get(surface, 0.0) + weight
    weights = np.array(list(found.values()))
    end = weights.max()
    total = weights.sum() + end
    return Pieces(tuple(found), np.log(weights / total), float(np.log(end / total)))


class Lattice:
    """Finds the pieces inside words, many words of one length at a time."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.longest = max(map(len, pieces.surfaces))
        self.tables = []
        for size in range(1, self.longest + 1):
            ids = np.array([i for i, s in enumerate(pieces.surfaces) if len(s) == size], np.int64)
            texts = b"".join(pieces.surfaces[i] for i in ids)
            raw = np.frombuffer(texts, np.uint8).reshape(-1, size)
            keys = np.zeros(len(ids), np.uint64)
            for k in range(size):
                keys = _extended(keys, raw[:, k])
            order = np.argsort(keys)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces share a hash")
            self.tables.append((keys[order], ids[order]))

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """The natural log probability of each word, the blank before it included."""
        out = np.empty(len(words))
        for places, raw in _by_length(words):
            if raw.shape[1] > LONG:
                out[places] = [self._swept(row) for row in raw]
            else:
                out[places] = self._forward(raw)[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece occurs in the words, over all segmentations."""
        out = np.zeros(len(self.pieces.surfaces))
        for places, raw in _by_length(words):
            if raw.shape[1] > LONG:
                for place, row in zip(places, raw):
                    self._swept_back(row, counts[place], out)
                continue
            edges: list[tuple] = []
            forward = self._forward(raw, edges)
            backward = [np.full(len(raw), -np.inf) for _ in forward]
            backward[-1] = np.zeros(len(raw))
            for begin, end, rows, ids in reversed(edges):
                through = self.pieces.logs[ids] + backward[end][rows]
                backward[begin][rows] = np.logaddexp(backward[begin][rows], through)
            weights = counts[places]
            for begin, end, rows, ids in edges:
                logs = forward[begin][rows] + self.pieces.logs[ids] + backward[end][rows] - forward[-1][rows]
                out += np.bincount(ids, np.exp(logs) * weights[rows], len(out))
        return out

    def _forward(self, raw: np.ndarray, edges: list[tuple] | None = None) -> list[np.ndarray]:
        """Log sums up to each byte; ``edges`` gets the pieces: (begin, end, rows, piece ids), by begin."""
        number, size = raw.shape
        forward = [np.full(number, -np.inf) for _ in range(size + 1)]
        forward[0] = np.zeros(number)
        for begin in range(size):
            keys = np.zeros(number, np.uint64)
            for end in range(begin + 1, min(size, begin + self.longest) + 1):
                keys = _extended(keys, raw[:, end - 1])
                rows, own = self._known(keys, end - begin)
                if len(rows):
                    if edges is not None:
                        edges.append((begin, end, rows, own))
                    through = forward[begin][rows] + self.pieces.logs[own]
                    forward[end][rows] = np.logaddexp(forward[end][rows], through)
        return forward

    def _known(self, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes of ``size`` bytes are pieces, and which pieces."""
        known, ids = self.tables[size - 1]
        if not len(known):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        rows = np.flatnonzero(known[at] == keys)
        return rows, ids[at[rows]]

    def _stretch(self, word: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, ...]:
        """Begins and ends (from ``start``) and ids of the pieces that begin in a stretch, by begin."""
        keys = np.zeros(stop - start, np.uint64)
        found = []
        for size in range(1, min(self.longest, len(word) - start) + 1):
            keys = keys[: len(word) - size + 1 - start]
            keys = _extended(keys, word[start + size - 1 : start + size - 1 + len(keys)])
            rows, ids = self._known(keys, size)
            found.append((rows, rows + size, ids))
        begins, ends, ids = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(begins, kind="stable")
        return begins[order], ends[order], ids[order]

    def _swept(self, word: np.ndarray, values: np.ndarray | None = None) -> float:
        """The log sum of one word; ``values`` gets the log sums up to each byte."""
        ahead = [0.0] + [-inf] * (STRETCH + self.longest)
        for start in range(0, len(word), STRETCH):
            stop = min(start + STRETCH, len(word))
            begins, ends, ids = self._stretch(word, start, stop)
            for begin, end, log in zip(begins.tolist(), ends.tolist(), self.pieces.logs[ids].tolist()):
                ahead[end] = _added(ahead[end], ahead[begin] + log)
            if values is not None:
                values[start:stop] = ahead[: stop - start]
            ahead = ahead[stop - start :] + [-inf] * (stop - start)
        if values is not None:
            values[len(word)] = ahead[0]
        return ahead[0]

    def _swept_back(self, word: np.ndarray, count: float, out: np.ndarray) -> None:
        """Adds to ``out`` how often each piece occurs in ``count`` times one word."""
        values = np.empty(len(word) + 1)
        total = self._swept(word, values)
        behind = [0.0] + [-inf] * self.longest
        for start in reversed(range(0, len(word), STRETCH)):
            stop = min(start + STRETCH, len(word))
            begins, ends, ids = self._stretch(word, start, stop)
            logs = self.pieces.logs[ids]
            behind = [-inf] * (stop - start) + behind
            for begin, end, log in zip(begins[::-1].tolist(), ends[::-1].tolist(), logs[::-1].tolist()):
                behind[begin] = _added(behind[begin], log + behind[end])
            through = values[start + begins] + logs + np.array(behind)[ends] - total
            out += np.bincount(ids, np.exp(through) * count, len(out))
            del behind[self.longest + 1 :]


def _added(a: float, b: float) -> float:
    """The logarithm of the sum of two numbers given by theirs."""
    if a < b:
        a, b = b, a
    return a if b == -inf else a + log1p(exp(b - a))


def _extended(keys: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The hash of a byte string and one byte more; exact for strings of up to seven bytes."""
    return keys * np.uint64(257) + byte.astype(np.uint64) + np.uint64(1)


def _by_length(words: list[bytes], together: int = 4096):
    """(places, bytes with the blank in front as a matrix) of words of equal length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for a, b in zip(cuts, cuts[1:]):
        step = min(together, max(1, BLOCK // (int(sizes[order[a]]) + 1)))
        for c in range(a, b, step):
            places = order[c : min(b, c + step)]
            raw = np.frombuffer(b"".join([b" " + words[i] for i in places]), np.uint8)
            yield places, raw.reshape(len(places), -1)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, c``: lower-cased words, and :data:`END` once per text.  Tasks count before the
    shuffle, and only hold so many words, and bytes of long ones, at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[bytes] = Counter()
        held = 0

        def flushed() -> pa.RecordBatch:
            words, counts = pa.array(tally.keys(), pa.binary()), pa.array(tally.values(), pa.int64())
            return pa.RecordBatch.from_arrays([words, counts], ["word", "c"])

        for batch in batches:
            for found in texts_of(batch.column(0)):
                words = words_of(found)
                tally.update(words)
                tally[END] += 1
                if max(map(len, words), default=0) > LONG:
                    held += len(found)
                if len(tally) > COUNTED or held > HELD:
                    yield flushed()
                    tally.clear()
                    held = 0
        yield flushed()

    counted = docs.select(text).mapInArrow(run, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def learned(
    pieces: Pieces, counts: DataFrame, texts: int, rounds: int = 4, smoothing: float = 0.1
) -> Pieces:
    """``pieces`` with probabilities from ``counts`` (of :func:`word_counts`, over ``texts`` texts),
    by ``rounds`` of expectation maximisation with ``smoothing`` added to every expected count.
    The driver gets one number per piece and round."""
    words = counts.where(F.col("word") != F.lit(END))
    size = len(pieces.surfaces)
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(pieces)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(shared.value)
            total, found, times, held = np.zeros(size), [], [], 0
            for batch in batches:
                found += batch.column(0).to_pylist()
                times += batch.column(1).to_pylist()
                held += batch.column(0).nbytes
                if len(found) > TOGETHER or held > HELD:
                    total += lattice.expected(found, np.array(times))
                    found, times, held = [], [], 0
            total += lattice.expected(found, np.array(times, np.int64))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

        rows = words.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        expected = np.full(size, smoothing)
        for row in rows.collect():
            expected[row["piece"]] += row["n"]
        end = texts + smoothing
        total = expected.sum() + end
        pieces = pieces.scored(np.log(expected / total), float(np.log(end / total)))
    return pieces


def lattice_scores(
    docs: DataFrame,
    pieces: Pieces,
    folds: int = 5,
    rounds: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    ``score`` is log10 of the probability of the text's lower-cased words and its end under the
    lattice, with piece probabilities learned from the rows outside the held-out fold.
    ``base_score`` is that of single words (and the end) with counts from the same rows and half a
    count added.  A null or empty text is its end alone; a null id is never held out; repeated rows
    each count and each get a row; without training rows the pieces keep their first scores; an
    empty table gives an empty one; other columns are not read.  Ties cannot arise: each text is
    scored alone.  A very long text is held by one task; its words are scored one by one, an unbroken
    one in time that grows with its bytes.

    Frequent words, at most :data:`HEAD`, are broadcast with their values; the others of each text
    are looked up by a join on the word.  A word's marginal needs no look-up.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    base = base.withColumn("_held", held_out("_id", folds))
    counts = stored(word_counts(base.where("NOT _held"), "_text"), "word-counts")
    ends = F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))
    total, distinct, texts = counts.agg(F.sum("c"), F.count("*"), ends).first()
    total, texts = total or 0, texts or 0
    divisor = total + 0.5 * (distinct + 1)
    pieces = learned(pieces, counts, texts, rounds) if total else pieces
    head = {bytes(r["word"]): r["c"] for r in counts.where(_frequent(counts)).collect()} | {END: texts}
    model, key = spark.sparkContext.broadcast((pieces, head, divisor)), uuid.uuid4().hex
    schema = schema_of(
        _id=id_type(docs, doc_id), _held="boolean", n_tokens="long", known="long", base="double",
        score="double", tail="array<struct<word:binary,n:long>>",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(key, model)
        kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), kind]
        for batch in batches:
            texts = texts_of(batch.column(2))
            scorer.learn(texts)
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [scorer.score(t) for t in texts[at : at + 512]]
                columns = [pa.array(x, k) for x, k in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], schema.fieldNames())

    rows = base.select("_id", "_held", "_text").mapInArrow(run, schema)
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "scored-heads")
    tail = rows.select("_row", F.inline("tail")).select("_row", "word", "n")
    found = stored(
        tail.join(counts, "word", "left")
        .groupBy("_row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"),
            F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / divisor)).alias("tail_base"),
        ),
        "scored-tails",
    )
    return rows.join(found, "_row", "left").select(
        F.col("_id").alias(doc_id),
        F.col("_held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def _frequent(counts: DataFrame) -> str:
    """A condition that at most :data:`HEAD` words of bounded length meet: a count of at least the
    smallest power of two that leaves so few."""
    short = f"length(word) <= {HEAD_BYTES}"
    powers = counts.where(short).groupBy(F.length(F.bin("c")).alias("bits")).count().collect()
    least, size = 63, 0
    for row in sorted(powers, key=lambda r: -r["bits"]):
        size += row["count"]
        if size > HEAD:
            break
        least = row["bits"] - 1
    return f"{short} AND c >= {1 << least}"


_SCORERS: dict[str, Scorer] = {}


class Scorer:
    """Scores texts with frequent words' counts at hand; keeps the marginals of words it has met."""

    def __init__(self, pieces: Pieces, head: dict[bytes, int], divisor: float):
        self.lattice, self.end, self.head, self.divisor = Lattice(pieces), pieces.end, head, divisor
        #: Every kept word's place in the two arrays: its marginal, and its count if it is frequent.
        self.places: dict[bytes, int] = {}
        self.marginal, self.count = np.empty(0), np.empty(0, np.int64)
        self.held = 0

    @staticmethod
    def of(key: str, model) -> Scorer:
        """The worker's scorer for a broadcast model; that of another model is dropped."""
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(*model.value)
        return _SCORERS[key]

    def learn(self, texts: list[bytes]) -> None:
        """Take up the texts' words; once there are many, drop those that are not in these texts."""
        met: set[bytes] = set()
        for text in texts:
            met.update(words_of(text))
        if len(self.places) > KEPT or self.held > HELD:
            kept = [word for word in self.places if word in met]
            at = np.fromiter(map(self.places.__getitem__, kept), np.int64, len(kept))
            self.marginal, self.count = self.marginal[at], self.count[at]
            self.places = dict(zip(kept, range(len(kept))))
            self.held = sum(map(len, kept))
        new = list(met.difference(self.places))
        self.held += sum(map(len, new))
        counts = np.fromiter((self.head.get(word, 0) for word in new), np.int64, len(new))
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        self.marginal = np.append(self.marginal, self.lattice.marginals(new))
        self.count = np.append(self.count, counts)

    def score(self, text: bytes) -> tuple:
        """Tokens, known tokens, base score, score, and the words whose counts are not at hand
        (they are in neither of the two in between)."""
        found = Counter(words_of(text))
        at = np.fromiter(map(self.places.__getitem__, found), np.int64, len(found))
        times = np.fromiter(found.values(), np.int64, len(found))
        # Added up one after the other.
        score = np.add.accumulate(np.append(self.end, times * self.marginal[at]))[-1]
        counts, ends = self.count[at], self.head.get(END, 0)
        frequent = counts > 0
        words = list(found.items())
        tail = [words[i] for i in np.flatnonzero(~frequent).tolist()]
        known = np.append(1, times[frequent])
        logs = np.log10((np.append(ends, counts[frequent]) + 0.5) / self.divisor)
        base = float(np.dot(logs, known))
        return int(times.sum()) + 1, int(known.sum()) - (not ends), base, float(score) / _LN10, tail
