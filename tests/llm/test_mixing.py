import re
from collections import Counter, defaultdict

from tributary.llm import mixing as M

from .conftest import ODD, make, prose


def plain_targets(sizes, percent=150, limit=2):
    """Shares by weight; what is over a limit is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, got, free = sum(sizes.values()) * percent / 100, {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > limit * sizes[s]}
        if not over:
            return got | {s: level * weight[s] for s in free}
        for s in over:
            got[s] = float(limit * sizes[s])
            left -= got[s]
        free -= over
    return got


def size(t):
    return len(re.findall("[^\x20\x09-\x0d]+", t or ""))


def corpus():
    return [(i, prose(i, 5 + i * 7 % 90), "en", f"s{i % 5}" if i % 11 else None) for i in range(400)]


def test_targets_and_takes(spark):
    rows = corpus()
    got = M.copies(make(spark, rows), bin_rows=20).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    want = plain_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["source_size"] == sizes[r["source"]] and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert {r["doc_id"]: r["size"] for r in got} == {r[0]: size(r[1]) for r in rows}
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.05 * want[s] + 90


def test_copies_are_the_expectation_rounded(spark):
    for r in M.copies(make(spark, corpus())).collect():
        rate = r["target"] / r["source_size"]
        assert int(rate) <= r["copies"] <= int(rate) + (rate % 1 > 0)


def test_reruns_and_partitions_agree(spark):
    key = lambda df: sorted(((r["doc_id"], r["taken"]) for r in M.copies(df).collect()))
    assert key(make(spark, corpus())) == key(make(spark, corpus()[::-1]).repartition(7))


def test_odd_rows(spark, odd, empty, clash):
    got = M.copies(odd).collect()
    assert len(got) == len(ODD) and {r["source"] for r in got} == {"a", "b", "c", None}
    assert M.copies(empty).count() == 0 and M.mix(empty).count() == 0
    assert M.copies(clash).columns.count("size") == 1


def test_the_mixture_repeats_documents(spark):
    df = make(spark, corpus())
    often = {r["doc_id"]: r["copies"] for r in M.copies(df).collect()}
    seen = defaultdict(int)
    mixed = M.mix(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        seen[r["doc_id"]] += 1
    assert seen == {d: n for d, n in often.items() if n}


NAMES = ("start", "rate", "bins", "offset", "s", "level", "bin", "rank", "t_", "k_", "n_", "n", "tie", "row", "copies", "size", "taken", "a", "b", "a.b", "x`y")


def test_extra_columns_of_any_name_are_carried(spark):
    rows = corpus()[:60]
    plain, df = make(spark, rows), make(spark, rows, NAMES)
    assert sorted(M.copies(df).select("doc_id", "taken").collect()) == sorted(M.copies(make(spark, rows, [f"other{i}" for i in range(len(NAMES))])).select("doc_id", "taken").collect())
    assert all(r[c] == "mine" for r in M.copies(df).collect() for c in NAMES if c not in ("copies", "size", "taken"))
    mixed = M.mix(df)
    assert mixed.columns == df.columns and all(r[c] == "mine" for r in mixed.collect() for c in NAMES)
    assert M.mix(plain).columns == plain.columns


def test_rows_of_one_id_and_text_that_differ_elsewhere_all_count(spark):
    rows = [(1, "a b c d", "en", "a"), (1, "a b c d", "de", "b"), (1, "a b c d", "fr", "b"), (1, "a b c d", "fr", "b")]
    got = Counter(tuple(r) for r in M.mix(make(spark, rows)).select("lang", "source").collect())
    want = plain_targets({"a": 4, "b": 12})
    assert abs(4 * got["en", "a"] - want["a"]) < 4 and abs(4 * (got["de", "b"] + got["fr", "b"]) - want["b"]) < 4


def test_only_empty_texts(spark):
    got = M.copies(make(spark, [(1, "", "en", "a"), (2, None, "en", "b")])).collect()
    assert [(r["size"], r["taken"]) for r in got] == [(0, 0), (0, 0)]
