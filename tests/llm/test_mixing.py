"""Hierarchical budgets against plain recursion, and the seeded epochs of a leaf."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from llm_helpers import rows_of, table

from spillway.llm.mixing import Mix, budgets, mixed

LEVELS = (("domain", "domain"), ("lang", "lang"), ("source", "source"))


def fill(budget, children):
    """Share ``budget`` among (name, capacity, weight) by weight, capacities permitting."""
    out = {n: 0.0 for n, _, _ in children}
    open_ = [c for c in children if c[2] > 0 and c[1] > 0]
    while open_ and budget > 1e-9:
        total = sum(w for _, _, w in open_)
        full = [c for c in open_ if c[1] - out[c[0]] <= budget * c[2] / total + 1e-9]
        if not full:
            for n, _, w in open_:
                out[n] += budget * w / total
            break
        for n, cap, _ in full:
            budget -= cap - out[n]
            out[n] = cap
        open_ = [c for c in open_ if c not in full]
    return out


def brute(leaves, mix):
    weight = lambda level, value: mix.weights.get(mix.levels[level][0], {}).get(value, 1)

    def cap(path):
        return sum(
            s * mix.epochs
            for p, s in leaves.items()
            if p[: len(path)] == path and all(weight(k, v) > 0 for k, v in enumerate(p))
        )

    shares = {(): min(mix.share * sum(leaves.values()), cap(()))}
    for level in range(len(mix.levels)):
        for path in list(shares):
            if len(path) == level:
                names = sorted({p[level] for p in leaves if p[:level] == path})
                children = [(n, cap((*path, n)), weight(level, n)) for n in names]
                shares |= {(*path, n): b for n, b in fill(shares[path], children).items()}
    return {p: int(shares[p] + 1e-6) for p in leaves}


@pytest.mark.parametrize("seed", range(6))
def test_budgets(spark, seed):
    pick = random.Random(seed)
    leaves = {
        (f"d{a}", f"l{b}", f"s{c}"): pick.choice([0, pick.randrange(5), pick.randrange(1000), 100])
        for a in range(3) for b in range(3) for c in range(3) if pick.random() < 0.8
    }
    weights = {"domain": {"d0": 5, "d1": 0.5, "d2": seed % 2}, "lang": {"l0": 3}, "source": {"s1": 2}}
    mix = Mix(LEVELS, weights, share=pick.choice([0.2, 0.7, 1.0, 3.0]), epochs=1 + seed % 3)
    rows = spark.createDataFrame(
        [(*p, s) for p, s in leaves.items()], "_mix_domain string, _mix_lang string, _mix_source string, supply long"
    )
    got = {tuple(r[:3]): r["budget"] for r in budgets(rows, mix).collect()}
    expected = brute(leaves, mix)
    assert got.keys() == expected.keys()
    assert all(abs(got[p] - expected[p]) <= 1 for p in got)


def chosen(docs, leaf_of, mix):
    """Counter of (id, epoch), leaf by leaf."""
    leaves = defaultdict(list)
    for i, tokens, leaf in docs:
        leaves[leaf].append((i, tokens))
    plan = brute({p: sum(t for _, t in own) for p, own in leaves.items()}, mix)
    out = Counter()
    for path, own in leaves.items():
        supply = sum(t for _, t in own)
        whole = plan[path] // supply if supply else 0
        for i, _ in own:
            out.update((i, e) for e in range(whole))
        rest, begin = plan[path] - whole * supply, 0
        keyed = defaultdict(list)
        for i, tokens in own:
            text = f"{mix.seed}:{whole}:{'' if i is None else i}"
            keyed[hashlib.md5(text.encode()).hexdigest()].append((i, tokens))
        for key in sorted(keyed):
            if begin < rest:
                out.update((i, whole) for i, _ in keyed[key])
            begin += sum(t for _, t in keyed[key])
    return out


@pytest.mark.parametrize("share, epochs", [(0.3, 1), (0.9, 1), (1.0, 3), (5.0, 2)])
def test_epochs(spark, share, epochs):
    pick = random.Random(4)
    rows = [(n % 90 or None, "w " * pick.choice([0, 1, 7, 30]), pick.choice(["en", "de", None]), pick.choice(["src0", "src0", "src1", None])) for n in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'a' AS domain", "7 AS epoch")
    mix = Mix(LEVELS, {"lang": {"en": 3}}, share, epochs)
    got = mixed(frame, mix, "pass")
    assert got.columns == [*frame.columns, "pass"]
    place = lambda r: ("a", r[2] or "(none)", r[3] or "(none)")
    expected = chosen([(r[0], len(r[1].split()), place(r)) for r in rows], place, mix)
    assert Counter((r["doc_id"], r["pass"]) for r in got.collect()) == expected


def test_awkward_rows(docs, empty):
    mix = Mix((("lang", "lang"), ("source", "source")), share=1.0)
    rows = rows_of(mixed(docs, mix))
    assert {r["doc_id"] for r in rows} <= {None, *range(1, 14)} and rows
    assert mixed(empty, mix).count() == 0
    assert mixed(table(docs.sparkSession, [(1, None), (2, "")]), mix).count() == 0


def test_plan_is_native(docs):
    mix = Mix((("lang", "lang"),), share=0.5)
    plan = mixed(docs, mix)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
