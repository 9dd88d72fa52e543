"""Licence phrases against a plain search, notices with small changes."""

import random
import re

from llm_helpers import TEXTS, rows_of, table, words

from spillway.llm import licenses
from spillway.llm.license_texts import NOTICES, PHRASES
from spillway.llm.licenses import license_scan

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    found = plain(text)
    places = [
        (n, label)
        for phrase, label in PHRASES.items()
        for n in range(len(found))
        if found[n : n + len(phrase.split())] == phrase.split()
    ]
    starts = [n for n, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(found), len(places), min(starts, default=None), max(starts, default=None), labels


EXTRA = [
    (20, "CC BY-NC cc by nc CC/BY/NC under the MIT license under the mit-license Apache License, Version 2.0"),
    (21, "under the\nMIT\nLICENSE " * 700),
    (22, words(9, 400) + " apache license version " + words(10, 40) + " cc by, nc"),
    (23, "Apache License, Versionen 2 ünder the mit license cc_by_nc"),
    (24, "this work is licensed under the GNU General Public License, version 3."),
]


def test_base_phrases(spark, empty):
    texts = [*TEXTS, *EXTRA]
    rows = rows_of(license_scan(table(spark, texts)))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    got = sorted(str((r["doc_id"], *(r[n] for n in names))) for r in rows)
    assert got == sorted(str((i, *brute(t))) for i, t in texts)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[24]["labels"] == "gpl-3" and by_id[24]["base_labels"] == ""
    assert by_id[20]["score"] == 1.0 and by_id[1]["score"] == 0.0 and 0 < by_id[22]["score"] <= 1
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert license_scan(empty).count() == 0


#: Notices of which no half holds most of a phrase or of another notice.
LONG = ("mit", "apache-2", "gpl-3", "bsd-2", "isc", "unlicense")


def test_changed_notices(spark):
    pick = random.Random(2)
    texts = []
    for n, (label, notice) in enumerate((label, NOTICES[label]) for label in LONG):
        changed = notice.split()
        for _ in range(len(changed) // 25):
            at = pick.randrange(len(changed))
            changed[at : at + 1] = pick.choice([[], ["other"], [changed[at], "inserted"]])
        texts.append((n, f"{words(30 + n, 50)} {' '.join(changed)} {words(60 + n, 50)}"))
        texts.append((100 + n, " ".join(notice.split()[: len(notice.split()) // 2])))
    rows = {r["doc_id"]: r for r in rows_of(license_scan(table(spark, texts)))}
    for n, label in enumerate(LONG):
        assert label in rows[n]["labels"].split(",")
        span = next(s for s in rows[n]["spans"] if s["label"] == label and s["end"] - s["first"] > 20)
        assert span["share"] >= 0.8 and 45 <= span["first"] <= 60
        if label != "apache-2":  # its first half has the phrase
            assert label not in rows[100 + n]["labels"].split(",")
            assert 0.3 < rows[100 + n]["score"] < 0.8


def brute_findings(text, known, k=3, drift=8):
    """Label, share and place of every template found, by plain search of all its windows."""
    found, out = plain(text), []
    for template in known:
        own = [w.decode() for w in template.words]
        hits = {}
        for at in range(len(own) - k + 1):
            for place in range(len(found) - k + 1):
                if found[place : place + k] == own[at : at + k]:
                    hits.setdefault(place - at, []).append(at)
        groups = []
        for diagonal in sorted(hits):
            if groups and not template.exact and diagonal - groups[-1][-1] <= drift:
                groups[-1].append(diagonal)
            else:
                groups.append([diagonal])
        for group in groups:
            places = {
                (at, d + at)
                for d in group
                for at in range(min(hits[d]), max(hits[d]) + k)
                if found[d + at] == own[at]
            }
            there = {at for at, _ in places}
            begin, end = min(p for _, p in places), max(p for _, p in places) + 1
            out.append((template, begin, end, len(there), there))
    return out


def brute_labels(text, known):
    findings = brute_findings(text, known)
    score = max((n / len(t.words) for t, _, _, n, _ in findings), default=0.0)
    sound = [f for f in findings if f[3] / len(f[0].words) >= (1 if f[0].exact else 0.8)]
    sound = [f for f in sound if all(n in f[4] for n in f[0].decisive)]
    labels = {f[0].label for f in sound if f[0].exact}
    left = [f for f in sound if not f[0].exact]
    while left:
        best = min(left, key=lambda f: (-f[3], -f[3] / len(f[0].words), f[0].label, f[1]))
        labels.add(best[0].label)
        left = [
            f for f in left
            if f is not best and 2 * len({*range(*f[1:3])} & {*range(*best[1:3])}) <= min(f[2] - f[1], best[2] - best[1])
        ]
    return ",".join(sorted(labels)), score


ADDRESS = "See the license for details. Copyright 2020 the authors. "


def test_notices_that_differ_in_a_word_get_one_label(spark):
    # The Creative Commons words of some notices are phrases of their own, which stay.
    alone = [label for label in NOTICES if not label.startswith("cc-by-nc-")]
    texts = [(n, ADDRESS + NOTICES[label] + " " + words(90 + n, 30)) for n, label in enumerate(alone)]
    texts.append((100, NOTICES["gpl-3"].replace("version 3", "version 4")))
    texts.append((101, NOTICES["gpl-2"] + words(3, 40) + NOTICES["mit"]))
    texts.append((102, NOTICES["lgpl"].replace("2.1", "3")))
    rows = {r["doc_id"]: r for r in rows_of(license_scan(table(spark, texts)))}
    assert {label: rows[n]["labels"] for n, label in enumerate(alone)} == {label: label for label in alone}
    assert rows[100]["labels"] == "" and rows[100]["score"] > 0.9
    assert rows[101]["labels"] == "gpl-2,mit" and rows[102]["labels"] == "lgpl"


def test_labels_and_score_by_plain_search(spark):
    pick = random.Random(8)
    texts = [t for t in (*TEXTS, *EXTRA) if len(t[1] or "") < 20_000]
    for n in range(60):
        parts = []
        for label in pick.sample(sorted(NOTICES), 2):
            changed = NOTICES[label].split()
            for _ in range(pick.randrange(6)):
                at = pick.randrange(len(changed))
                changed[at : at + 1] = pick.choice([[], ["other"], [changed[at], "inserted"], ["2"], ["Affero"]])
            parts += changed[: pick.choice([len(changed), len(changed) - 4])] + words(n, pick.randrange(12)).split()
        texts.append((1000 + n, " ".join(parts)))
    known = licenses.templates()
    rows = sorted((str(r["doc_id"]), r["labels"], round(r["score"], 9)) for r in rows_of(license_scan(table(spark, texts))))
    plainly = [(str(i), *brute_labels(t, known)) for i, t in texts]
    assert rows == sorted((i, labels, round(score, 9)) for i, labels, score in plainly)


def test_many_hits_are_not_broadcast(spark, monkeypatch):
    phrase = "Released under the MIT License. "
    docs = table(spark, [(1, phrase * 300), (2, "no licence here at all")])
    hinted = lambda f: "strategy=broadcast" in f._jdf.queryExecution().analyzed().toString()
    usual = license_scan(docs)
    monkeypatch.setattr(licenses, "MOST_HITS", 200)
    many = license_scan(docs)
    assert hinted(usual) and not hinted(many)
    assert sorted(map(str, usual.collect())) == sorted(map(str, many.collect()))
