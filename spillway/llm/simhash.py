"""SimHash fingerprints and their near duplicates by multi-index hashing.

A fingerprint is cut in segments, so few that prints within the wanted distance differ by at most one
bit (or none) in some segment.  There is a table per segment: every print is stored under its value of
the segment, and looks up all values of the small Hamming ball around that value.  What it meets is
verified by the complete distance.

A segment value that many prints share, as those of one large group of near copies do, would bring
all pairs of them together.  Such hot values are split by the rest of the print: there a print is
stored under the values of a ball around its rest too, and looks up what the distance leaves.  An
entry then holds few prints however many share the segment, and no link is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import small, stored
from .texts import id_type, rows_per_text, schema_of

BITS = 64


def shingles(text: bytes, size: int) -> list[bytes]:
    """The ``size``-word windows of the lower-cased text, space-joined, repeats included; the whole
    sequence if it is shorter; none for a text without words."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    joined = b" ".join(words)
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist())]


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64; 0 for a text without words."""
    found = shingles(text, size)
    hash64 = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(found), 1 << 16):
        part = found[at : at + (1 << 16)]
        hashes = np.fromiter((hash64(s, seed) for s in part), "<u8", len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(found), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, passed: tuple = ()
) -> DataFrame:
    """``doc_id, [passed columns], fingerprint`` (as a signed long) per row; null text as empty."""
    fields = {doc_id: id_type(docs, doc_id), **{c: k for c, k in passed}, "fingerprint": "long"}

    def measure(texts: list[bytes]) -> dict:
        prints = np.fromiter((fingerprint(t, size) for t in texts), np.uint64, len(texts))
        return {"fingerprint": prints.view(np.int64)}

    columns = [F.col(doc_id), *(F.col(c) for c, _ in passed)]
    return rows_per_text(docs, columns, text, measure, schema_of(**fields))


@dataclass(frozen=True)
class SegmentTables:
    """How prints are cut for a distance, and the bits that are flipped where."""

    most_bits: int

    @property
    def masks(self) -> list[int]:
        """The bits of each segment: enough of them that one differs by at most one bit."""
        count = max(2, self.most_bits // 2 + 1)
        ends = [BITS * n // count for n in range(count + 1)]
        return [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]

    @property
    def segment_radius(self) -> int:
        return self.most_bits // len(self.masks)

    @property
    def rest_radius(self) -> int:
        """How far from its rest a print is stored under a hot value."""
        return self.most_bits // 2


def ball(mask: int, radius: int) -> list[int]:
    """The whole numbers with at most ``radius`` bits set, all of them in ``mask``; signed."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    found = [sum(1 << b for b in own) for n in range(radius + 1) for own in combinations(bits, n)]
    return np.array(found, np.uint64).view(np.int64).tolist()


def _per_segment(lists: list[list[int]]) -> str:
    """SQL for the list of the row's ``segment``."""
    arrays = ", ".join(f"array({', '.join(f'{v}L' if v > -(1 << 63) else '-9223372036854775807L - 1L' for v in own)})" for own in lists)
    return f"element_at(array({arrays}), segment + 1)"


def near_links(prints: DataFrame, most_bits: int = 2, most_per_value: int = 64) -> DataFrame:
    """``a, b``: all pairs of distinct ``fingerprint`` values at most ``most_bits`` apart, with
    ``a < b``; a pair may come more than once.  Give distinct fingerprints, in a stored frame.

    A value of a segment that more than ``most_per_value`` prints share is hot.  Of two prints of
    which one lies under a hot value and the other does not, the latter does the looking up.
    """
    cut = SegmentTables(most_bits)
    whole = [(1 << BITS) - 1 ^ m for m in cut.masks]
    masks = _per_segment([[v] for v in np.array(cut.masks, np.uint64).view(np.int64).tolist()])
    cuts = prints.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(len(whole) - 1))).alias("segment")).selectExpr(
        "fingerprint", "segment", f"fingerprint & {masks}[0] AS value"
    )
    hot = stored(
        cuts.groupBy("segment", "value").count().where(F.col("count") > most_per_value).drop("count"),
        "hot-segments",
    )
    hot = small(hot)
    entry = ["segment", "value"]
    cold_prints, hot_prints = cuts.join(hot, entry, "left_anti"), cuts.join(hot, entry, "left_semi")

    def looking_up(rows: DataFrame) -> DataFrame:
        flips = _per_segment([ball(m, cut.segment_radius) for m in cut.masks])
        flipped = rows.selectExpr("fingerprint", "segment", "value", f"explode({flips}) AS flip")
        return flipped.selectExpr("fingerprint AS probe", "segment", "value ^ flip AS value", "bit_count(flip) AS flipped")

    shallow = cold_prints.join(looking_up(cold_prints).join(hot, entry, "left_anti"), entry)
    under = _per_segment([ball(w, cut.rest_radius) for w in whole])
    kept = hot_prints.selectExpr("fingerprint", "segment", "value", f"explode({under}) AS walk").selectExpr(
        "fingerprint", "segment", "fingerprint ^ walk AS place"
    )
    wanted = looking_up(cuts).join(hot, entry, "left_semi")
    parts = []
    for flipped in range(cut.segment_radius + 1):
        walks = _per_segment([ball(w, max(0, most_bits - flipped - cut.rest_radius)) for w in whole])
        parts.append(
            wanted.where(f"flipped = {flipped}")
            .selectExpr("probe", "segment", "value", f"explode({walks}) AS walk")
            .selectExpr("probe", "segment", f"((probe & ~{masks}[0]) | value) ^ walk AS place")
        )
    deep = kept.join(reduce(DataFrame.unionByName, parts), ["segment", "place"])
    met = shallow.select("fingerprint", "probe").unionByName(deep.select("fingerprint", "probe"))
    return met.where(f"fingerprint != probe AND bit_count(fingerprint ^ probe) <= {most_bits}").selectExpr(
        "least(fingerprint, probe) AS a", "greatest(fingerprint, probe) AS b"
    )


def simhash_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, most_bits: int = 2
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``.

    Rows with equal fingerprints, or linked by fingerprints at most ``most_bits`` apart, directly or
    through others, share a component, named by its smallest id.  Texts without words (null, empty)
    have fingerprint 0, linked like any other.  A null id never names a component unless it has no
    other; repeated rows are copies and each get a row; an empty table gives an empty one.
    """
    found = _grouped(docs, doc_id, text, size, most_bits, ())
    return found.select(doc_id, "fingerprint", "component_id")


def _grouped(docs, doc_id, text, size, most_bits, passed) -> DataFrame:
    prints = stored(fingerprints(docs, doc_id, text, size, passed), "fingerprints")
    classes = stored(
        prints.groupBy("fingerprint").agg(F.min(doc_id).alias("first_id")), "fingerprint-classes"
    )
    linked = components(near_links(classes, most_bits), "simhash").withColumnRenamed(
        "node", "fingerprint"
    )
    roots = stored(
        classes.join(linked, "fingerprint", "left").select(
            "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("root")
        ),
        "fingerprint-roots",
    )
    names = stored(
        roots.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-names"
    )
    named = stored(
        roots.join(names, "root").select("fingerprint", "root", "component_id"), "components"
    )
    return prints.join(named, "fingerprint")


def one_per_group(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, most_bits: int = 2
) -> DataFrame:
    """The documents, all columns as they were, without near copies: of each component the row with
    the smallest id stays (of several with that id, the one with the smallest text hash, once).

    A component whose ids are all null keeps one of its rows.
    """
    key = ["_near_copy_id", "_near_copy_text"]
    keyed = docs.withColumns(
        {
            key[0]: F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
            key[1]: F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        }
    )
    passed = ((key[0], "string"), (key[1], "long"))
    first = _grouped(keyed, doc_id, text, size, most_bits, passed).where(
        F.col(doc_id).eqNullSafe(F.col("component_id"))
    )
    staying = first.groupBy("root").agg(F.min(F.struct(*key)).alias("kept")).select("kept.*")
    return keyed.join(staying, key, "left_semi").dropDuplicates(key).select(*docs.columns)
