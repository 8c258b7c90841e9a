import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.llm import suffix_dedup as X
from tributary.llm.bwt import END, merge_all, transform

from .conftest import ODD, make, prose


def brute(rows):
    """One result for each row, ids in order, nulls first; rows of one id and text are one document."""
    seen, out = set(), {}
    for d, t in sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - X.LENGTH + 1):
            w = b[i : i + X.LENGTH]
            if w in seen:
                gone[i : i + X.LENGTH] = True
            seen.add(w)
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
        out[d, t] = (d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return sorted((out[r[0], r[1] or ""] for r in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_odd_rows(spark, odd):
    assert got(X.remove_repeats(odd)) == brute(ODD)


def test_empty_and_clash(spark, empty, clash):
    assert X.remove_repeats(empty).count() == 0
    assert got(X.remove_repeats(clash)) == brute(ODD[5:11])


def test_passages_edits_and_runs(spark):
    r = random.Random(3)
    shared = [prose(500 + i, 40) for i in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(i, r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randrange(0, len(s) // 2)
            parts.append(s[a : a + r.randint(60, 260)])
            parts.append(prose(r.random(), r.randint(0, 9)))
        rows.append((i, "".join(parts), "en", "a"))
    rows += [(100, "a" * 700, "en", "a"), (101, "a" * 150, "en", "a"), (102, "ab" * 200, "en", "a"), (103, "x" + "é" * 120 + "y" + "é" * 90, "en", "a")]
    rows += [(104, shared[0][:99], "en", "a"), (105, shared[0][:100], "en", "a"), (106, shared[0][:100], "en", "a"), (107, rows[0][1] + "!" + rows[1][1], "en", "a")]
    assert got(X.remove_repeats(make(spark, rows), bucket_bytes=2000)) == brute(rows)
    assert got(X.remove_repeats(make(spark, rows[::-1]).repartition(5))) == brute(rows)


def test_repeated_rows_keep_their_first_occurrence(spark):
    passage = prose(70, 40)
    first, second = prose(71, 20) + " " + passage + " " + prose(72, 20), prose(73, 20) + " " + passage + " " + prose(74, 20)
    rows = [(1, first, "en", "a"), (1, first, "en", "a"), (2, second, "en", "a"), (2, second, "en", "b"), (None, prose(75, 30) + passage[:150], "en", "a"), (None, prose(75, 30) + passage[:150], "en", "a")]
    for some in (rows[:3], rows):
        assert got(X.remove_repeats(make(spark, some))) == brute(some)


def test_hot_anchors_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(X, "HOT", 3)
    r = random.Random(8)
    passage = prose(900, 60)
    rows = [(i, prose(i, r.randint(0, 12)) + passage[r.randint(0, 20) : r.randint(200, 330)] + prose(1000 + i % 7, r.randint(0, 20)), "en", "a") for i in range(60)]
    rows += [(100, "a" * 400, "en", "a"), (101, passage, "en", "a"), (101, passage, "en", "a"), (102, passage + passage, "en", "a")]
    assert got(X.remove_repeats(make(spark, rows), bucket_bytes=2000)) == brute(rows)
    assert got(X.remove_repeats(make(spark, rows[::-1]).repartition(6))) == brute(rows)
    spot = np.zeros(1, X._SPOT)
    spot["first"], spot["run"], spot["skip"], spot["hot"] = 5, 30, 40, 1
    raw = np.frombuffer(prose(1, 100).encode(), np.uint8)
    parts, _, keys = X._split(spot, np.zeros(1, np.int64), raw, np.zeros(1, np.int64))
    windows = sorted((int(p["first"]) + i, int(p["skip"]) - i) for p in parts for i in range(int(p["run"]) + 1))
    assert windows == [(5 + i, 40 - i) for i in range(31)] and len(keys) == len(parts) == 5


SYMBOLS = st.lists(st.lists(st.integers(0, 2), max_size=6), max_size=4)


@settings(max_examples=200, deadline=None)
@given(st.lists(SYMBOLS, min_size=1, max_size=5), st.integers(1, 4))
def test_merged_transforms_equal_a_sort(collections, depth):
    parts, truth, at = [], [], 0
    for strings in collections:
        flat = np.array([x for s in strings for x in [*s, END]], np.int64)
        parts.append(transform(flat, np.arange(at, at + len(flat)), depth))
        at += len(flat)
        for s in strings:
            truth += [tuple([*s, int(END)][i : i + depth]) for i in range(len(s) + 1)]
    merged, block = merge_all(parts, depth)
    order = [truth[i] for i in merged.place]
    assert order == sorted(truth)
    assert block.tolist() == np.cumsum([i > 0 and order[i] != order[i - 1] for i in range(len(order))]).tolist()


def test_every_window_has_its_anchor():
    raw = np.frombuffer((prose(1, 200) + "a" * 300).encode(), np.uint8)
    offsets = np.array([0, 50, 50, 400, len(raw)])
    h, row, first, last, skip = X.anchors(raw, offsets)
    assert (X.piece_hashes(raw, X.ANCHOR)[offsets[row] + first + skip] == h).all()
    windows = {(r, s) for r, a, b in zip(row, first, last) for s in range(a, b + 1)}
    assert windows == {(r, s) for r in range(4) for s in range(offsets[r + 1] - offsets[r] - X.LENGTH + 1)}
    assert sum(b - a + 1 for a, b in zip(first, last)) == len(windows)
