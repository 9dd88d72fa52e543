"""A text quality classifier: statistics of the text alone, and boosted trees over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Settings, Trees, fitted
from .texts import held_out, id_type, rows_kept, rows_per_text, schema_of, texts_of

_LOWER, _UPPER, _DIGIT, _BLANK = (np.zeros(256, bool) for _ in range(4))
_LOWER[ord("a") : ord("z") + 1] = True
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes whose share of the text is a statistic of its own.
_MARKS = b"#*$%&|<>!?.,:;@/=_-+'\"()"

FEATURES = (
    "log_bytes", "log_words", "mean_word", "spread_word", "longest_word", "upper", "lower", "digits",
    "beyond_ascii", "other_ascii", "byte_entropy", "distinct_words", "top_word", "same_next_word",
    "distinct_pairs", "capital_words", "marked_words", "repeated_lines", "words_per_line",
    "short_lines", *(f"mark_{m}" for m in _MARKS),
)


def statistics(text: bytes) -> np.ndarray:
    """The :data:`FEATURES` of one text; all zero for a text without words."""
    out = np.zeros(len(FEATURES))
    words = text.split()
    if not words:
        return out
    raw = np.frombuffer(text, np.uint8)
    found = np.bincount(raw, minlength=256)
    inked = max(1, int(found[~_BLANK].sum()))
    share = found[found > 0] / len(raw)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    count = len(words)
    seen: dict[bytes, int] = {}
    numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, count)
    lines = [line for line in text.split(b"\n") if line.strip()]
    begins = np.cumsum(lengths + 1) - lengths - 1
    joined = np.frombuffer(b" ".join(words), np.uint8)
    last = joined[begins + lengths - 1]
    pairs = numbers[:-1] * len(seen) + numbers[1:]
    out[:20] = (
        np.log1p(len(raw)),
        np.log1p(count),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        found[_UPPER].sum() / inked,
        found[_LOWER].sum() / inked,
        found[_DIGIT].sum() / inked,
        found[128:].sum() / inked,
        (inked - found[_UPPER | _LOWER | _DIGIT].sum() - found[128:].sum()) / inked,
        -(share * np.log2(share)).sum(),
        len(seen) / count,
        np.bincount(numbers).max() / count,
        (numbers[1:] == numbers[:-1]).sum() / count,
        len(np.unique(pairs)) / max(1, count - 1),
        _UPPER[joined[begins]].sum() / count,
        (~(_LOWER | _UPPER | _DIGIT)[last] & (last < 128)).sum() / count,
        1 - len(set(lines)) / len(lines),
        np.log1p(count / len(lines)),
        sum(len(line) < 20 for line in lines) / len(lines),
    )
    out[20:] = found[list(_MARKS)] / inked
    return out


def scores(model: Trees, texts: list[bytes]) -> np.ndarray:
    rows = np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))
    return model.probabilities(rows)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 3,
    sample: int = 20_000,
    settings: Settings = Settings(),
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> Trees:
    """Trees that tell label 1 from label 0, from labelled rows outside the held-out fold.

    At most about ``sample`` pairs of an id and a label are used, those with the smallest hashes of
    their ids, so what the driver gathers is ``sample`` rows of statistics at any input size, however
    often an id is repeated: a pair counts once, with the statistics of one of the texts of its id
    (the one with the least, compared from left to right).  Labels other than 0 and 1, and null ids,
    are left out; a document with both labels counts once for each.
    """
    usable = (
        labels.where(~held_out("doc_id", folds) & F.col(label).isin(0, 1))
        .select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
        .distinct()
    )
    total = usable.where("_id IS NOT NULL").count()
    chance = min(1.0, sample / max(1, total))
    hashed = "pmod(xxhash64(CAST(_id AS STRING), 'quality sample'), 1000000000000000L)"
    small_hash = f"{hashed} < CAST({chance} * 1e15D AS BIGINT)"
    chosen = F.broadcast(usable.where(small_hash))  # about ``sample`` rows by construction
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(chosen, "_id")
    names = [f"f{i}" for i in range(len(FEATURES))]
    schema = schema_of(_id="string", _label="int", **{n: "double" for n in names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t) for t in texts_of(batch.column(1))]).reshape(-1, len(names))
            columns = [batch.column(0).cast(pa.string()), batch.column(2), *map(pa.array, found.T)]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    measured = rows.select("_id", "_text", "_label").mapInArrow(run, schema)
    # Texts of one id are combined in the task: what is shuffled and gathered is a row per pair.
    one_each = measured.groupBy("_id", "_label").agg(F.min(F.struct(*names)).alias("least"))
    seen = one_each.select("_id", "_label", "least.*").toPandas()
    seen = seen.sort_values(["_id", "_label", *names], kind="stable")  # the same trees at any order
    return fitted(seen[names].to_numpy(np.float64), seen["_label"].to_numpy(np.float64), settings)


def quality_scores(
    docs: DataFrame, model: Trees, folds: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    Null and empty texts have the statistics of a text without words and get the score of such a
    text.  Equal texts get equal scores, repeated rows a row each; an empty table gives an empty
    one; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_of(
        **{doc_id: id_type(docs, doc_id)}, held_out="boolean", score="double", predicted="int"
    )

    def measure(texts: list[bytes]) -> dict:
        found = scores(shared.value, texts)
        return {"score": found, "predicted": (found >= 0.5).astype(np.int32)}

    return rows_per_text(docs, [F.col(doc_id), held_out(doc_id, folds)], text, measure, schema)


def accepted(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """The rows of ``docs`` the model scores at least one half, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows_kept(docs, text, lambda texts: scores(shared.value, texts) >= 0.5)
