"""The pipeline against plain versions of its stages."""

from collections import Counter

import corpus_pipeline
from tributary.llm import mixing
from tributary.llm.common import written

from .conftest import ODD, make, prose
from .test_decontamination import folded
from .test_ngram_join import brute


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    step = written(corpus_pipeline.language_id(spark, docs, sf))
    kept = {r["doc_id"] for r in step.collect()}
    assert kept == {d for d, r in rows.items() if any(c.isalpha() for c in r["text"])} and step.columns == docs.columns
    step = written(corpus_pipeline.ngram_jaccard_join(spark, step, sf))
    plain = [(d, rows[d]["text"]) for d in sorted(kept)]
    want = {d for d, _, c in brute(plain) if c == d}
    assert {r["doc_id"] for r in step.collect()} == want and step.columns == docs.columns
    step = written(corpus_pipeline.benchmark_decontamination(spark, step, sf))
    bench = [folded(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {d for d in want if not any(b in folded(rows[d]["text"]) for b in bench)}
    assert {r["doc_id"] for r in step.collect()} == want
    often = {r["doc_id"]: r["copies"] for r in mixing.copies(step).collect() if r["copies"]}
    step = written(corpus_pipeline.mixing(spark, step, sf))
    assert Counter(r["doc_id"] for r in step.collect()) == Counter(often) and step.columns == docs.columns
    last = corpus_pipeline.sharding(spark, step, sf)
    assert Counter(r["doc_id"] for r in last.collect()) == Counter(often)
    assert set(last.columns) == {*docs.columns, "shard", "slot"}


NAMES = ("start", "rate", "bins", "offset", "s", "level", "bin", "rank", "tie", "row", "bucket", "place", "record", "key", "kept_id", "kept_digest", "digest", "id", "root", "score", "spans", "lang_pred", "label", "size", "copies", "taken", "c", "d", "n", "x`y", "a.b")


def test_extra_columns_of_any_name_come_through_all_stages(spark, sf):
    rows = [(i, prose(i, 60), "en", f"s{i % 2}") for i in range(40)] + [(100, prose(3, 60) + " more", "en", "s0"), (101, None, None, None)]
    df = make(spark, rows, NAMES)
    plain = make(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        df, plain = written(stage(spark, df, sf), name), written(stage(spark, plain, sf), name)
        assert [c for c in df.columns if c not in NAMES] == plain.columns
        if name in ("language_id", "ngram_jaccard_join", "benchmark_decontamination"):
            assert sorted(r["doc_id"] for r in df.collect()) == sorted(r["doc_id"] for r in plain.collect())
        assert all(r[c] == "mine" for r in df.collect() for c in NAMES)


def test_odd_and_empty_tables(spark, empty, odd, sf):
    for df, most in ((odd, len(ODD)), (empty, 0)):
        for name, stage in corpus_pipeline.STAGES:
            df = written(stage(spark, df, sf), name)
            assert df.count() <= 2 * most


def test_clean_documents_stay(spark, sf):
    rows = [(i, prose(i, 60) + f" unique {i}", "en", "a") for i in range(30)]
    df = make(spark, rows)
    for stage in (corpus_pipeline.language_id, corpus_pipeline.ngram_jaccard_join, corpus_pipeline.benchmark_decontamination):
        df = stage(spark, df, sf)
    assert df.count() == 30
