import hashlib
import re

from tributary.llm import secret_scan as S

from .conftest import ODD, make

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
LIVE = "token = 9fK2mQ7xLp0ZrT4v"
CASES = [
    (1, f"é {LIVE} x", "en", "own"),
    (2, f"{LIVE}", "en", "own"),
    (3, "password: hunter2 Password='hunter22' secret=token:abcdefgh", "en", "a"),
    (4, "AKIA" + "A1B2C3D4E5F6G7H8" + " AKIA123", "en", "a"),
    (5, "deadbeef" * 4 + " 0123456789abcdef01234567 abc", "en", "b"),
    (6, "api_key=Zz9Yy8Xx7Ww6Vv5 apikey = Zz9Yy8Xx7Ww6Vv5", "en", "a"),
    (7, "API_KEY='Zz9Yy8Xx7Ww6Vv5'", "en", "b"),
    (8, "API_KEY='Zz9Yy8Xx7Ww6Vv5'", "en", None),
]


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def expected(rows):
    out = set()
    for d, t, *_ in rows:
        b = base(t)
        joined = ",".join(f"{S.NAMES[k]}:{s}:{e}" for s, k, e in b)
        out.add((d, *(sum(k == i for _, k, _ in b) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest()))
    return out


def run(spark, df, monkeypatch):
    monkeypatch.setattr(S, "documents", lambda *a: df)
    return S.op7_secret_scan(spark, "").collect()


def test_base(spark, monkeypatch):
    rows = CASES + ODD
    got = run(spark, make(spark, rows), monkeypatch)
    assert {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got} == expected(rows)


def test_ownership_tells_live_from_copied(spark, monkeypatch):
    got = {r["doc_id"]: r["spans"].split(",") for r in run(spark, make(spark, CASES), monkeypatch)}
    assert got[1] == ["assign:2:26", "live:10:26"] and got[2] == ["assign:0:24", "live:8:24"]  # one owner, two documents
    assert not any(s.startswith("live") for i in (6, 7, 8) for s in got[i])  # several owners
    for (d, t, *_) in CASES:
        assert {f"{S.NAMES[k]}:{s}:{e}" for s, k, e in base(t)} <= set(got[d])


def plain_spans(rows):
    """All spans of each row of (id, text, lang, owner), by loops."""
    found = []
    for d, t, _, owner in rows:
        text = t or ""
        for kind, pattern, least, group in ((0, ASSIGN, 6, 2), (1, re.compile("AKIA[A-Z0-9]+"), 20, 0), (2, re.compile("[0-9a-f]{24,}"), 24, 0), (3, re.compile("[A-Za-z0-9+/_-]{32,}"), 32, 0)):
            found += [(d, owner, kind, m.start(), m.end(), m.start(group), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    owners, holders = {}, {}
    for d, owner, *_, value in found:
        owners.setdefault(value, set()).add(owner)
        holders.setdefault(value, set()).add(d)
    out = {d: set() for d, *_ in rows}
    for d, _, kind, start, end, begin, value in found:
        if kind < 3:
            out[d].add((start, kind, end))
        good = len(value) >= 12 and len(set(value)) >= 8 and re.search("[0-9]", value) and re.search("[A-Za-z]", value) and not re.search(S.EXAMPLES, value)
        if good and len(owners[value]) <= S.MAX_OWNERS and len(holders[value]) <= S.MAX_REPOSITORIES:
            out[d].add((begin, S.LIVE, end))
    return {d: ",".join(f"{S.NAMES[k]}:{s}:{e}" for s, k, e in sorted(v)) for d, v in out.items()}


def test_spans_equal_brute_force(spark, monkeypatch):
    assert {r["doc_id"]: r["spans"] for r in run(spark, make(spark, CASES), monkeypatch)} == plain_spans(CASES)


def test_what_many_repositories_hold_is_copied(spark, monkeypatch):
    rows = [(i, "key AKIA" + "A1B2C3D4E5F6G7H8", "en", "own") for i in range(50)] + [(100 + i, f"{LIVE}", "en", "own") for i in range(S.MAX_REPOSITORIES)]
    got = {r["doc_id"]: r for r in run(spark, make(spark, rows), monkeypatch)}
    assert all("live" not in got[i]["spans"] and got[i]["most_repositories"] == 50 and got[i]["most_owners"] == 1 for i in range(50))
    assert all("live" in got[100 + i]["spans"] and got[100 + i]["most_repositories"] == S.MAX_REPOSITORIES for i in range(S.MAX_REPOSITORIES))


def test_no_table_holds_a_secret(spark):
    found = S.candidates(make(spark, CASES))
    assert "9fK2mQ7xLp0ZrT4v" not in repr(found.collect()) and {len(r["value"]) for r in found.collect()} == {64}


def test_empty_clash_and_repeated_rows(spark, empty, monkeypatch):
    assert run(spark, empty, monkeypatch) == []
    names = ("key", "x", "kind", "value", "owner", "repository", "rows", "random", "n", "before", "text_hash", "x`y")
    got = run(spark, make(spark, ODD + CASES[:1] * 3, names), monkeypatch)
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted([r[0] for r in ODD] + [1] * 3, key=repr)


def test_equals_brute_force_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in S.op7_secret_scan(spark, sf).collect()} == expected(rows)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert {r["doc_id"]: r["spans"] for r in S.op7_secret_scan(spark, sf).collect()} == plain_spans(rows)
