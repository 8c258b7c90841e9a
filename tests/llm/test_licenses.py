import random
import re

from tributary.llm import licenses as L

from .conftest import ODD, make

CASES = [
    (1, "Foo. Licensed under the Apache License, Version 2.0.", "en", "a"),
    (2, "licensed under the brand new Apache License Version 2.0", "en", "a"),  # two words more
    (3, "CC-BY and cc by, all rights reserved. ALL RIGHTS RESERVED", "en", "a"),
    (4, "the GNU General Public License", "en", "a"),
    (5, "general public librarian license, cc", "en", "a"),
    (6, "of the to the in the under the", "en", "a"),
    (7, "Permission is hereby granted, free of charge, to any human obtaining a copy of this software", "en", "a"),
    (8, "éall rights reserved all rights reserved", "en", "a"),
]


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def base(rows):
    out = set()
    for d, t, *_ in rows:
        w = words(t)
        found = [(i, label) for phrase, label in L.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in found]
        out.add((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    return out


def edits(a, b):
    """Edit distance of two lists of words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def labels(text, k=3, slack=3, gap=6, coverage=0.6, likeness=0.6):
    """Labels and score of a text, diagonal by diagonal."""
    w, got, best = words(text), set(), 0.0
    for phrase, label in L.BASE:
        n = len(phrase.split())
        if any(w[i : i + n] == phrase.split() for i in range(len(w))):
            got.add(label)
            best = 1.0
    for phrase, label in L.TEMPLATES:
        t = phrase.split()
        n = min(k, len(t))
        diagonals = {}
        for p in range(len(w) - n + 1):
            for q in range(len(t) - n + 1):
                if w[p : p + n] == t[q : q + n]:
                    diagonals.setdefault(p - q, []).append((p, q))
        runs, last = [], None
        for d, votes in sorted(diagonals.items(), key=lambda x: (min(x[1])[0], x[0])):
            first, end = min(votes)[0], max(votes)[0] + n - 1
            if last is None or first - last[0] > gap or abs(d - last[1]) > slack:
                runs.append([])
            runs[-1].append((first, end, {q for _, q in votes}))
            last = end, d
        for run in runs:
            if len(set.union(*(q for *_, q in run))) >= coverage * (len(t) - n + 1):
                like = 1 - edits(w[min(r[0] for r in run) : max(r[1] for r in run) + 1], t) / len(t)
                if like >= likeness:
                    got.add(label)
                    best = max(best, like)
    return ",".join(sorted(got)), round(best, 9)


def run(spark, df, monkeypatch):
    monkeypatch.setattr(L, "documents", lambda *a: df)
    return L.op3_license_scan(spark, "").collect()


def test_base_places(spark, odd, monkeypatch):
    rows = CASES + ODD
    got = run(spark, make(spark, rows), monkeypatch)
    assert {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got} == base(rows)


def test_labels(spark, monkeypatch):
    got = {r["doc_id"]: r for r in run(spark, make(spark, CASES), monkeypatch)}
    assert [got[i]["labels"] for i in range(1, 9)] == ["apache-2.0", "apache-2.0", "cc-by,reserved", "gpl", "", "", "mit", "reserved"]
    assert {(i, r["labels"], round(r["score"], 9)) for i, r in got.items()} == {(d, *labels(t)) for d, t, *_ in CASES}
    assert got[1]["score"] == 1.0 and got[5]["score"] == 0.0 and 0.6 <= got[2]["score"] < 1


def test_repeated_grams_are_no_license(spark, monkeypatch):
    rows = [(1, "released under the released under the", "en", "a"), (2, "released under the mit released under the mit license", "en", "a"), (3, "the mit license released under", "en", "a"), (4, "released under the new mit license", "en", "a")]
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in run(spark, make(spark, rows), monkeypatch)}
    assert got == {d: labels(t) for d, t, *_ in rows} and got[1] == ("", 0.0) and got[3] == ("", 0.0)


def test_damaged_licenses_equal_brute_force(spark, monkeypatch):
    r = random.Random(5)
    rows = []
    for i in range(150):
        w = " and ".join(r.choice(L.TEMPLATES)[0] for _ in range(r.randint(1, 2))).split()
        for _ in range(r.randint(0, 7)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = r.choice(([], ["new"], ["the"], [w[r.randrange(len(w))]]))
        rows.append((i, " ".join(w), "en", "a"))
    got = {(x["doc_id"], x["labels"], round(x["score"], 9)) for x in run(spark, make(spark, rows), monkeypatch)}
    assert got == {(d, *labels(t)) for d, t, *_ in rows} and len({g[1] for g in got}) > 5


def test_empty_clash_and_repeated_rows(spark, empty, monkeypatch):
    assert run(spark, empty, monkeypatch) == []
    names = ("key", "words", "rows", "pos", "w0", "template", "t", "k", "h", "label", "first", "score", "text_hash", "x`y")
    got = run(spark, make(spark, ODD, names), monkeypatch)
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r[0] for r in ODD), key=repr)


def test_equals_brute_force_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    done = L.op3_license_scan(spark, sf).collect()
    assert {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in done} == base(rows)
    assert {(r["doc_id"], r["labels"], round(r["score"], 9)) for r in done} == {(d, *labels(t)) for d, t in rows}


def test_native(spark, sf):
    assert "Python" not in L.op3_license_scan(spark, sf)._jdf.queryExecution().toString()
