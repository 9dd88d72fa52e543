"""Fingerprints and their components against plain Python."""

import random
import re

import pytest
import xxhash
from llm_helpers import TEXTS, rows_of, table, words
from test_components import brute as components_of

from spillway.llm.simhash import fingerprint, near_links, one_per_group, simhash_near_duplicates


def brute(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    parts = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] if len(found) >= 3 else [" ".join(found)] * bool(found)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("number", range(len(TEXTS)))
def test_fingerprint(number):
    text = TEXTS[number][1]
    assert fingerprint((text or "").encode()) == brute(text)


def test_components_against_all_pairs(spark):
    texts = [*TEXTS, *((100 + n, words(20 + n // 3, 150) + f" end{n % 3}") for n in range(30))]
    rows = rows_of(simhash_near_duplicates(table(spark, texts)))
    prints = [brute(t) for _, t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a, len(texts)) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = components_of(links)
    ids = {}
    for n, (i, _) in enumerate(texts):
        if i is not None:
            ids[root[n]] = min(ids.get(root[n], i), i)
    expected = sorted((str(i), prints[n], str(ids.get(root[n]))) for n, (i, _) in enumerate(texts))
    got = sorted((str(r["doc_id"]), r["fingerprint"] % (1 << 64), str(r["component_id"])) for r in rows)
    assert got == expected


def signed(prints):
    return [(p - (1 << 64) if p >> 63 else p,) for p in prints]


def pairs_within(prints, most):
    return {tuple(sorted((a, b))) for n, (a,) in enumerate(prints) for (b,) in prints[:n] if bin((a ^ b) % (1 << 64)).count("1") <= most}


def found_pairs(spark, prints, most, per_value=64):
    links = near_links(spark.createDataFrame(prints, "fingerprint long"), most, per_value).collect()
    assert all(r["a"] < r["b"] for r in links)
    return {(r["a"], r["b"]) for r in links}


def scattered(seed, count=25):
    """Prints in small groups, up to six bits from a centre."""
    pick = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 1}
    for _ in range(count):
        centre = pick.getrandbits(64)
        out |= {centre ^ sum(1 << b for b in pick.sample(range(64), pick.randrange(7))) for _ in range(5)}
    return signed(sorted(out))


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_links_are_all_pairs_within_the_distance(spark, most):
    prints = scattered(most)
    assert found_pairs(spark, prints, most) == pairs_within(prints, most)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_a_segment_value_that_a_third_shares(spark, most):
    pick = random.Random(9)
    shared = pick.getrandbits(32)
    hot = {shared | (pick.getrandbits(5) << 32 | pick.getrandbits(3) << 60) for _ in range(60)}
    beside = {p ^ 1 << pick.randrange(32) for p in list(hot)[:20]} | {p ^ 1 << pick.randrange(64) for p in list(hot)[:20]}
    prints = sorted({*signed(hot | beside), *scattered(5, 12)})
    expected = pairs_within(prints, most)
    assert len(expected) > 20
    assert found_pairs(spark, prints, most, 8) == expected
    assert found_pairs(spark, prints, most, 1) == expected


def test_a_group_of_near_copies_meets_few(spark):
    """Prints that share one half in full: entries grow with their number, not its square."""
    pick = random.Random(3)
    prints = signed(sorted({pick.getrandbits(32) << 32 | 77 for _ in range(1500)}))
    links = near_links(spark.createDataFrame(prints, "fingerprint long"))
    assert {(r["a"], r["b"]) for r in links.collect()} == pairs_within(prints, 2)
    met = links._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in met


def test_one_row_of_each_group_stays(spark, docs, empty):
    kept = one_per_group(docs)
    assert kept.schema.names == docs.schema.names
    rows = rows_of(kept)
    prints = [brute(r["text"]) for r in rows]
    assert all((a ^ b).bit_count() > 2 for n, a in enumerate(prints) for b in prints[:n])
    groups = {(r["component_id"]) for r in simhash_near_duplicates(docs).collect()}
    assert len(rows) == len(groups)
    assert {r["doc_id"] for r in rows} == groups
    assert one_per_group(empty).count() == 0
