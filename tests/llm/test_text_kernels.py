import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.llm import common
from tributary.llm.common import arrow_bytes, row_ranges, word_hashes

TEXT = st.text(alphabet="abcABC \t\n\x0b\x1c\x85é", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.integers(1, 12))
def test_words_are_those_of_a_split(texts, chunk):
    raw, offsets = arrow_bytes(pa.array(texts, pa.string()))
    hashes, at = word_hashes(raw, offsets, chunk)
    names = {}
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        own = hashes[at[i] : at[i + 1]].tolist()
        assert len(own) == len(words)
        for w, h in zip(words, own):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_row_ranges_cover_all():
    import numpy as np

    offsets = np.array([0, 5, 5, 30, 31])
    got = row_ranges(offsets, 10)
    assert got[0][0] == 0 and got[-1][1] == 4 and all(a[1] == b[0] for a, b in zip(got, got[1:]))


def test_the_filter_of_texts_loses_none(spark):
    docs = spark.range(5000).selectExpr("CASE WHEN id = 7 THEN NULL ELSE id END AS doc_id", "'x' AS text")
    wanted = docs.where("doc_id % 50 = 3 OR doc_id IS NULL").selectExpr("doc_id AS least")
    kept = [r["doc_id"] for r in common.perhaps(docs, "doc_id", wanted).collect()]
    assert {r["least"] for r in wanted.collect()} <= set(kept) and len(kept) < 130 and kept.count(None) == 1
    assert common.perhaps(docs, "doc_id", wanted.limit(0)).count() == 0
