import random
from collections import defaultdict

import numpy as np
import pytest

from tributary.llm import ngram_join as N
from tributary.llm.components import components

from .conftest import ODD, make, prose


def brute(rows):
    """(n_shingles, component) of each row, in order."""
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = defaultdict(lambda: None)
    for i, l in enumerate(label):
        d = rows[i][0]
        if d is not None and (least[l] is None or d < least[l]):
            least[l] = d
    return [(rows[i][0], len(sets[i]), least[label[i]] if sets[i] else rows[i][0]) for i in range(len(rows))]


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join("changed" + str(r.random()) if r.random() < share else w for w in text.split())


def test_odd_rows(spark, odd):
    assert got(N.join_groups(odd)) == sorted(brute(ODD), key=repr)


def test_empty(spark, empty):
    assert N.join_groups(empty).count() == 0
    assert N.keep_one_of_each(spark, empty).count() == 0


def test_extra_columns(spark, clash):
    assert got(N.join_groups(clash)) == sorted(brute(ODD[5:11]), key=repr)


@pytest.mark.parametrize("block", [3_000_000, 900])
def test_near_copies_at_the_threshold(spark, block):
    """Copies with few to many edits, a passage that all share, chains; also with blocks cut into chunks."""
    passage = prose(99, 70)
    rows = []
    for g in range(6):
        text = prose(g, 150)
        for i in range(14):
            rows.append((len(rows), edited(text, i, i * 0.006) + (" " + passage if g % 2 else ""), "en", "s"))
    rows += [(len(rows) + i, prose(1000 + i, 40) + " " + passage, "en", "s") for i in range(12)]
    assert got(N.join_groups(make(spark, rows), block_tokens=block)) == sorted(brute(rows), key=repr)


def test_one_of_each_stays(spark, odd):
    kept = sorted((r["doc_id"] for r in N.keep_one_of_each(spark, odd).collect()), key=repr)
    want = [d for d, _, c in brute(ODD) if d == c]
    assert kept == sorted(set(want), key=repr)


def test_one_row_of_each_component_stays_with_null_and_shared_ids(spark):
    a, b, c = prose(301, 80), prose(302, 80), prose(303, 80)
    rows = [(None, a), (None, a + " tail"), (None, b), (7, b + " tail"), (8, c), (8, prose(304, 80)), (9, c + " tail"), (None, None), (None, " "), (3, prose(305, 80)), (3, prose(305, 80) + " end")]
    kept = N.keep_one_of_each(spark, make(spark, [(*r, "en", "s") for r in rows]))
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == 7 and (7, rows[3][1]) in got and (8, c) in got and rows[5] in got and (None, None) in got and (None, " ") in got
    assert sum(g in rows[:2] for g in got) == 1 and sum(g in rows[9:] for g in got) == 1


def test_tree_join_equals_all_pairs():
    rng = np.random.default_rng(1)
    for trial in range(40):
        sets = []
        for _ in range(int(rng.integers(1, 5))):
            core = rng.integers(0, 1 << 62, int(rng.integers(1, 60))).astype(np.uint64)
            for _ in range(int(rng.integers(1, 12))):
                keep = core[rng.random(len(core)) > 0.08]
                sets.append(np.unique(np.append(keep, rng.integers(0, 1 << 62, int(rng.integers(0, 6))).astype(np.uint64))) if len(keep) else np.unique(core))
        want = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if N.linked(sets[i], sets[j]):
                    a, b = sorted((want[i], want[j]))
                    want[want == b] = a
        assert (N.tree_join(sets) == want).all()
        half = len(sets) // 2
        cross = N.tree_join(sets, half) if half else None
        if half:
            assert all(N.linked(sets[i], sets[j]) is False or cross[i] == cross[j] for i in range(half) for j in range(half, len(sets)))


def test_tree_join_of_chunks_with_sets_of_different_widths():
    rng = np.random.default_rng(4)
    for small, large in ((100, 600), (600, 100), (20, 5000), (128, 129)):
        x = np.unique(rng.integers(0, 1 << 62, small).astype(np.uint64))
        y = np.unique(rng.integers(0, 1 << 62, large).astype(np.uint64))
        sets = [x, x[2:], y, x[1:], y[3:]]
        label = N.tree_join(sets, 2)
        assert label[0] == label[1] == label[3] and label[2] != label[0]
        label = N.tree_join(sets, 3)
        assert label[0] == label[1] == label[3] and label[2] == label[4] != label[0]


def test_chunked_block_of_mixed_lengths(spark):
    """One block whose chunks' largest sets lie on different sides of a bitmap's width."""
    long = prose(7, 1500)
    rows = [(i, edited(long, i, 0.004), "en", "s") for i in range(3)]
    for n in (1200, 950, 740, 580, 450, 350, 270, 210, 160, 125, 100, 80, 62):  # each begins the one before, so all are one component
        rows.append((len(rows), " ".join(long.split()[:n]), "en", "s"))
    assert got(N.join_groups(make(spark, rows), block_tokens=900)) == sorted(brute(rows), key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (200, 200), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    roots = dict(map(tuple, components(df).collect()))
    assert {roots[i] for i in range(41)} == {0} and roots[102] == 100 and roots[200] == 200
    assert components(df.where("false")).count() == 0
