import random
import re
import tracemalloc

import numpy as np
import pytest

from tributary.llm import decontamination as D

from .conftest import ODD, make, prose

ITEM = "item_id long, text string"


def edit(text, k, seed):
    r = random.Random(seed)
    for _ in range(k):
        i = r.randrange(len(text))
        text = r.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1 :]])
    return text


def distance(item, text):
    """Fewest edits between item and any stretch of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, a in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (a != c)))
        row = new
        best = min(best, row[-1])
    return best


def folded(t):
    raw = np.frombuffer((t or "").encode(), np.uint8)
    return D.fold(raw, np.array([0, len(raw)]))[0].tobytes().decode()


def test_fold():
    assert folded("  The—ÉTÉ,\n x_1! ") == "the—été x 1" and folded("") == "" and folded("...") == ""


def test_exact_and_edited_items_are_found(spark):
    items = [(i, prose(1000 + i, 30 + i)) for i in range(6)]
    rows, want = [], set()
    for i, text in items:
        budget = int(len(folded(text)) * D.RATE)
        for n, k in enumerate((0, budget // 2, budget, 6 * budget)):
            d = len(rows)
            rows.append((d, prose(d, 80) + " " + edit(text.upper() if n == 0 else text, k, d) + " " + prose(d + 50, 60), "en", "a"))
    rows += [(100 + i, prose(7000 + i, 100), "en", "a") for i in range(20)]  # clean
    for d, t, *_ in rows:
        for i, text in items:
            it = folded(text)
            if distance(it, folded(t)) <= int(len(it) * D.RATE):
                want.add((d, i))
    got = D.find(make(spark, rows), spark.createDataFrame(items, ITEM)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) >= 18
    for r in got:
        it, t = folded(dict(items)[r["item_id"]]), folded(rows[r["doc_id"]][1])
        assert distance(it, t[r["first"] : r["last"]]) <= r["edits"]


def test_blocks_of_the_benchmark_change_nothing(spark):
    items = [(i, prose(1000 + i, 30)) for i in range(20)]
    rows = [(i, prose(i, 30) + " " + items[i][1], "en", "a") for i in range(20)]
    bench = spark.createDataFrame(items, ITEM)
    one = sorted(map(tuple, D.find(make(spark, rows), bench).collect()))
    assert one == sorted(map(tuple, D.find(make(spark, rows), bench, block_bytes=700).collect())) and len(one) == 20
    assert D.clean(make(spark, rows), bench, block_bytes=700).count() == 0


def brute(rows, items):
    return {(d, i) for d, t, *_ in rows for i, text in items if distance(folded(text), folded(t)) <= int(len(folded(text)) * D.RATE)}


def test_short_items_have_their_whole_budget(spark):
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = [(n, "".join(r.choice(letters) for _ in range(n))) for n in range(10, 44)]
    rows = [(i * 10 + k, "".join(r.choice(letters) for _ in range(30)) + edit(text, k, 100 * i + k) + "".join(r.choice(letters) for _ in range(20)), "en", "a") for i, text in items for k in range(4)]
    got = {(x["doc_id"], x["item_id"]) for x in D.find(make(spark, rows), spark.createDataFrame(items, ITEM)).collect()}
    assert got == brute(rows, items) and (201, 20) in got and (231, 23) in got


def test_items_with_one_wording_in_common(spark, monkeypatch):
    """Every text shares most of every item; few hold one."""
    monkeypatch.setattr(D, "AT_ONCE", 20_000)
    monkeypatch.setattr(D, "ALIGNED", 300)
    wording = "what is the answer to the following question about the history of the town on the river called "
    items = [(i, wording + prose(i, 3)) for i in range(40)]
    rows = [(i, prose(i, 4) + " " + wording + prose(i if i % 3 == 0 else 5000 + i, 3) + " " + prose(i + 9, 5), "en", "a") for i in range(60)]
    rows.append((900, " ".join(text for _, text in items[:12]), "en", "a"))
    rows.append((901, wording * 30, "en", "a"))
    got = {(x["doc_id"], x["item_id"]) for x in D.find(make(spark, rows), spark.createDataFrame(items, ITEM)).collect()}
    assert got == brute(rows, items) and len(got) > 20


def test_many_items_and_texts_of_one_wording_in_bounded_memory():
    wording = "what is the answer to the following question about the history of the town on the river called "
    index = D.index([(i, wording + prose(i, 4)) for i in range(400)])
    texts = [(prose(10_000 + i, 6) + " " + wording + prose(i if i % 50 == 0 else 20_000 + i, 4)).encode() for i in range(400)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    low, at = D.fold(raw, np.cumsum([0, *map(len, texts)]))
    tracemalloc.start()
    got = {(r, i) for r, i, *_ in D.matches(low, at, index)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(i, i) for i in range(0, 400, 50)} <= got and peak < 600e6
    some = random.Random(1).sample([(r, i) for r in range(400) for i in range(400)], 150)
    assert all(((r, i) in got) == (distance(index.texts[i].decode(), low[at[r] : at[r + 1]].tobytes().decode()) <= index.budgets[i]) for r, i in some)


def test_a_q_beyond_the_bound_is_refused():
    with pytest.raises(ValueError):
        D.index([(1, "x" * 20)], q=12)


def test_odd_rows_and_items(spark, odd, empty):
    items = [(1, None), (2, ""), (3, "ein"), (4, prose(10, 120)), (None, prose(6, 40)), (5, "...")]
    bench = spark.createDataFrame(items, ITEM)
    got = {(r["doc_id"], r["item_id"]) for r in D.find(odd, bench).collect()}
    assert got == {(9, 3), (10, 4), (11, 4)}
    kept = sorted((r["doc_id"] for r in D.clean(odd, bench).collect()), key=repr)
    assert kept == sorted((r[0] for r in ODD if r[0] not in (9, 10, 11)), key=repr)
    assert D.find(empty, bench).count() == 0 and D.clean(odd, spark.createDataFrame([], ITEM)).count() == len(ODD)


def test_extra_columns_stay(spark, clash):
    out = D.clean(clash, spark.createDataFrame([(1, "nothing of the kind here")], ITEM))
    assert out.columns == clash.columns and out.count() == clash.count()


def test_table_equals_plain_search(spark, sf):
    bench = {r["item_id"]: folded(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: folded(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, it in bench.items() if re.search(re.escape(it), t)}
    got = {(r["doc_id"], r["item_id"]) for r in D.op9_decontamination(spark, sf).collect()}
    assert want <= got and want
