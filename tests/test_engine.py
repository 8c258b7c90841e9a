"""Laws and scenarios on small atoms, many cases in one table."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tributary.functions import hlc, scalars
from tributary.operators import audit, delta, identity, merge, review, vectors, views
from tributary.operators.merge import GROUP, STAMP
from tributary import shared
from tributary.schema import BENCH, DEDUP_COLUMNS, DIAMOND, GSET, STATUS, TOTAL_ORDER, Field, Schema
from tributary.sources import atoms

ENTRY = "replica_id string, record_id string, field string, value long, taken_at string, recorded_by string, pt long, c long, node string, supersedes string"
OBS = "replica_id string, record_id string, field string, vtag string, vtext string, author string, pt long, c long, node string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def test_hlc_replay_equals_fold(spark):
    rng, events, want = random.Random(1), [], []
    for node in "abc":
        pt = c = 0
        for i in range(120):
            phys, remote = rng.choice([0, 1000, 1001, 1002]), rng.choice([None, (rng.choice([1000, 1001, 1003]), rng.randrange(4))])
            now = max(pt, phys, remote[0] if remote else 0)
            c = max([n + 1 for n, p in ((c, pt), *([(remote[1], remote[0])] if remote else [])) if p == now], default=0)
            pt = now
            events.append((node, i, phys, *(remote or (None, None))))
            want.append((node, i, pt, c))
    df = spark.createDataFrame(events, "node string, i long, phys long, rpt long, rc long")
    for blocks in ("1", "3", "40"):  # of 40 blocks, runs span several
        spark.conf.set("spark.sql.shuffle.partitions", blocks)
        got = hlc.replay(df.repartition(2), remote_pt="rpt", remote_c="rc")
        assert rows(got, "node", "i", "pt", "c") == sorted(want, key=repr)
        sends = df.select("node", "i", "phys", F.lit(None).cast("long").alias("rpt"), F.lit(None).cast("long").alias("rc"))
        assert rows(hlc.replay(sends), "node", "i", "pt", "c") == rows(hlc.replay(sends, remote_pt="rpt", remote_c="rc"), "node", "i", "pt", "c")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    import pandas as pd

    from tributary.streaming.incremental import clock_step

    streamed = []
    for node in "abc":
        last = None
        for a in range(0, 120, 50):  # state carries over batches
            part = pd.DataFrame([e for e in events if e[0] == node and a <= e[1] < a + 50], columns=["node", "i", "phys", "rpt", "rc"])
            out, last = clock_step(part, last)
            streamed += [tuple(r) for r in out.itertuples(index=False)]
    assert sorted(streamed, key=repr) == sorted(want, key=repr)


def test_hlc_text(spark):
    wide = spark.createDataFrame([(10**17, 7, "a:b"), (5, 0, "é")], "pt long, c long, node string")
    back = wide.select(hlc.encode().alias("t")).select("t", hlc.decode(F.col("t")).alias("h")).select("t", "h.*")
    assert rows(back) == [("0000000000000005:0000000000:é", 5, 0, "é"), ("100000000000000000:0000000007:a:b", 10**17, 7, "a:b")]


VECTORS = [
    # (name, schema, replicas, expected codes, check)
    ("two_readings_one_day", "m_a", {"A": [(92, "2026-05-01T10:15", "w1", 1000, 0, "dev_a", None)], "B": [(94, "2026-05-01T16:40", "w2", 1001, 0, "dev_b", None)]}, {"multiple_weights_same_day"}, 2),
    ("same_reading_twice", "m_a", {"A": [(92, "2026-05-01T10:15", "w1", 1000, 0, "dev_a", None)], "B": [(92, "2026-05-01T10:15", "w1", 1005, 0, "dev_b", None)]}, set(), 1),
    ("chain", "m_a", {"A": [(92, "2026-05-01T10:15", "w1", 1000, 0, "d", None)], "B": [(97, "2026-05-01T10:20", "w1", 1001, 0, "d", "0000000000001000:0000000000:d")]}, set(), 2),
    ("fork", "m_a", {"A": [(92, "2026-05-01T10:15", "w1", 1000, 0, "d", None), (95, "2026-05-02T10:20", "w1", 1001, 0, "d", "0000000000001000:0000000000:d")], "B": [(96, "2026-05-03T10:20", "w2", 1001, 0, "e", "0000000000001000:0000000000:d")]}, {"superseded_fork"}, 3),
]


def test_series_vectors_in_any_order(spark):
    data = [(r, name, "m_a", *e) for name, _, reps, _, _ in VECTORS for r, es in reps.items() for e in es]
    prints = set()
    for seed, parts in ((1, 1), (2, 3), (3, 8)):
        shuffled = data * 2
        random.Random(seed).shuffle(shuffled)
        df = spark.createDataFrame(shuffled, ENTRY).repartition(parts)
        merged = merge.series_of(BENCH, df)
        prints.add(str(rows(views.canonical(merged, ["value", "taken_at", "recorded_by", *STAMP, "supersedes"]))))
    assert len(prints) == 1
    sizes = dict(rows(merged.groupBy("record_id").count()))
    assert sizes == {name: n for name, _, _, _, n in VECTORS}
    found = review.same_day(merged).unionByName(review.superseded_fork(merged))
    assert {(r[0], r[1]) for r in rows(found, "record_id", "code")} == {(name, c) for name, _, _, codes, _ in VECTORS for c in codes}
    kept = rows(merged.where("record_id = 'same_reading_twice'"), *STAMP)
    assert kept == [(1000, 0, "dev_a")]


def test_registers_keep_losers_and_null_wins(spark):
    data = [
        ("A", "x", "d_a", "3str", "alpha", "w1", 1000, 0, "a"),
        ("B", "x", "d_a", "0null", "", "w2", 1002, 0, "b"),
        ("A", "y", "d_a", "1bool", "true", "w1", 1000, 0, "a"),
        ("B", "y", "d_a", "2int", "+" + "1".zfill(20), "w1", 1000, 0, "a"),
    ]
    merged = merge.register(spark.createDataFrame(data, OBS))
    assert merged.count() == 4  # true and 1 stay apart
    now = {r["record_id"]: r for r in views.register_current(merged).collect()}
    assert now["x"]["vtag"] == "0null" and now["x"]["n_losers"] == 1 and now["x"]["contested"] and not now["y"]["contested"]
    signal = review.contested(merged, BENCH).collect()
    assert [(r["record_id"], r["evidence"]) for r in signal] == [("x", ["w1='alpha'", "w2=null"])]
    assert review.contested(merged, Schema("q", (Field("d_a", "LWWRegister", review_when_contested=False),))).count() == 0


def test_orset_add_wins_and_readd(spark):
    add, rem = f"record_id string, field string, element string, {'pt long, c long, node string'}", "record_id string, field string, pt long, c long, node string"
    adds = spark.createDataFrame([("r", "s", "t1", 1001, 0, "a"), ("r", "s", "t1", 1000, 0, "b"), ("r", "s", "t2", 1000, 1, "b")], add)
    removes = spark.createDataFrame([("r", "s", 1000, 0, "b"), ("r", "s", 1000, 1, "b")], rem)
    assert rows(views.orset_members(adds, removes)) == [("r", "s", "t1", 1)]


def test_orset_observed_makes_no_pairs_within_a_group(spark):
    schema = "replica_id string, record_id string, field string, element string, pt long, c long, node string, seq long"
    data = [("A", "r", "s", f"t{i % 2}", 1000 + i, i % 3, "a", i) for i in range(400)] + [("B", "r", "s", "t0", 5000, 0, "b", 1), ("A", "q", "s", "t0", 5001, 0, "b", 1)]
    adds = spark.createDataFrame([x for x in data if x[-1] % 4], schema)
    requests = spark.createDataFrame([x for x in data if x[-1] % 4 == 0], schema)
    got = views.orset_observed(adds, requests)
    asks = [x for x in data if x[-1] % 4 == 0]
    want = {(x[1], x[2], *x[4:7]) for x in data if x[-1] % 4 and any(r[:4] == x[:4] and x[-1] < r[-1] for r in asks)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    pairs = got._jdf.queryExecution().optimizedPlan().toString()
    assert "max(seq" in pairs  # the requests are one row a group and element before the join


def test_status_masks_equal_pairwise_join(spark):
    rng = random.Random(4)
    data = [(str(g), "st_a", rng.choice(DIAMOND.values)) for g in range(150) for _ in range(rng.randint(1, 4))]
    want = {}
    for g, _, v in data:
        want[g] = DIAMOND.table[want.get(g, v), v]
    df = spark.createDataFrame(data, "record_id string, field string, value string")
    assert dict(rows(merge.status(df, DIAMOND), "record_id", "value")) == want
    assert dict(rows(merge.status_by_table(df, DIAMOND), "record_id", "value")) == want
    pairs = {g for g in want if {"l", "r"} <= {v for h, _, v in data if h == g}}
    schema = Schema("d", (Field("st_a", STATUS, order=DIAMOND),))
    assert {r["record_id"] for r in review.status_transition(df, schema).collect()} == pairs


UNIVERSE = [(80 + i % 3, f"2026-01-0{1 + i % 2}T10:00", f"w{i % 2}", 1000 + i % 3, i % 4, "dev_a" if i % 2 else "dev_b") for i in range(12)]


def test_delta_law_with_gaps(spark):
    """join(peer, delta) == join(peer, full) for many subsets of one universe; a frontier filter breaks it."""
    rng, data = random.Random(7), []
    for case in range(60):
        for side in ("peer", "full"):
            for i in rng.sample(range(len(UNIVERSE)), rng.randint(0, 9)):
                v = UNIVERSE[i]
                data.append((side, str(case), "m_a", v[0], v[1], v[2], v[3] * 100 + i, v[4], v[5], None))
    df = spark.createDataFrame(data, ENTRY)
    peer, full = df.where("replica_id = 'peer'"), df.where("replica_id = 'full'")
    # seen-sets by case: the stamp is made unique by the case in the node
    tag = lambda x: x.withColumn("node", F.concat("node", F.lit("#"), "record_id"))
    peer, full = tag(peer), tag(full)
    cut = delta.record_delta({"entries": full}, delta.frontier_of(peer))
    got = delta.apply_delta({"entries": peer}, cut, DEDUP_COLUMNS)["entries"]
    want = merge.series(merge.union(peer, full), DEDUP_COLUMNS)
    assert rows(got, *merge.ENTRY) == rows(want, *merge.ENTRY)
    front = vectors.build(peer)
    late = vectors.has_seen(front, full.withColumn("replica_id", F.lit("peer"))).where("NOT covered")
    wrong = merge.series(merge.union(peer.select(*merge.ENTRY), late.select(*merge.ENTRY)), DEDUP_COLUMNS)
    assert rows(wrong, *merge.ENTRY) != rows(want, *merge.ENTRY)


def test_vectors(spark):
    v = spark.createDataFrame([("A", "x", 5, 0), ("A", "y", 1, 0), ("B", "x", 5, 0), ("C", "y", 2, 0), ("A", "x", 4, 9)], "replica_id string, node string, pt long, c long")
    built = vectors.build(v)
    assert rows(built.where("replica_id = 'A'")) == [("A", "x", 5, 0), ("A", "y", 1, 0)]
    cmp = {(r["mine"], r["theirs"]): (r["dominates"], r["concurrent"]) for r in vectors.compare(built).collect()}
    assert cmp["A", "B"] == (True, False) and cmp["B", "A"] == (False, False) and cmp["A", "C"] == (False, True)
    assert rows(vectors.missing_from(built.where("replica_id = 'B'"), built.where("replica_id = 'A'"))) == [("y", None, None)]
    assert rows(vectors.from_map(vectors.to_map(built))) == rows(built)
    n = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2)], "node string, seq long")
    assert rows(vectors.contiguous(n, ["node"])) == [("a", 2, 4), ("b", 0, 2)]


def test_chains_of_any_length_are_resolved(spark):
    chain = [(f"i{k:03}", f"i{k + 1:03}") for k in range(150)] + [("p", "q"), ("q", "p"), ("into", "p"), ("self", "self")]
    pointers = spark.createDataFrame(chain, "record_id string, target string")
    got = {r["record_id"]: (r["survivor"], r["hops"]) for r in identity.resolve(pointers).collect()}
    assert got == {f"i{k:03}": ("i150", 150 - k) for k in range(150)} | dict.fromkeys(("p", "q", "into", "self"), (None, None))
    assert rows(identity.cycles(pointers)) == [("into",), ("p",), ("q",), ("self",)]


def test_audits_can_fail(spark):
    log = spark.createDataFrame([("A", "r", "m_a", 1, "d1", "w", 10, 0, "a", 1), ("A", "r", "m_a", 2, "d2", "w", 9, 0, "a", 2), ("B", "r", "m_a", 3, "d3", "w", 9, 0, "b", 1)], "replica_id string, record_id string, field string, value long, taken_at string, recorded_by string, pt long, c long, node string, log_seq long")
    none = spark.createDataFrame([], "replica_id string, pt long, c long, node string")
    live = spark.createDataFrame([("A",), ("B",)], "replica_id string")
    present = merge.union(*(log.withColumn("replica_id", F.lit(r)) for r in "AB"))
    assert audit.no_measurement_lost(log, none, present, live, DEDUP_COLUMNS).count() == 0
    assert audit.no_measurement_lost(log, none, present.where("NOT (replica_id = 'B' AND value = 2)"), live, DEDUP_COLUMNS).count() == 1
    lost = spark.createDataFrame([("A", 9, 0, "a")], none.schema)
    gone = present.where("value <> 2")
    assert audit.no_measurement_lost(log, lost, gone, live, DEDUP_COLUMNS).count() == 0
    assert audit.no_phantom_measurements(log, present, DEDUP_COLUMNS).count() == 0  # what a crash lost may land later
    assert audit.no_phantom_measurements(log, present.withColumn("value", F.col("value") * 10), DEDUP_COLUMNS).count() == 6
    assert audit.no_phantom_measurements(log, present.union(present), DEDUP_COLUMNS).count() == 6
    assert [r["replica_id"] for r in audit.hlc_causality_respected(log).collect()] == ["A"]
    assert audit.no_duplicate_operation_ids(log.union(log)).count() == 3
    prints = views.canonical(present, ["value"], by=["replica_id", *GROUP])
    assert audit.all_converged(prints, live).count() == 0
    assert audit.all_converged(prints.where("replica_id = 'A'"), live).count() == 1


def test_forwarding(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x")], "record_id string, target string")
    assert rows(identity.resolve(p)) == [("a", "d", 3), ("b", "d", 2), ("c", "d", 1), ("x", None, None), ("y", None, None), ("z", None, None)]
    assert rows(identity.cycles(p)) == [("x",), ("y",), ("z",)]


def test_bloom_false_positives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("match_key"))
    others = spark.range(2000, 4000).select(F.concat(F.lit("k"), "id").alias("match_key"))
    f = identity.bloom_build(keys, rate=0.01)
    assert identity.bloom_probe(keys, f).count() == 2000
    assert identity.bloom_probe(others, f).count() < 60
    assert identity.bloom_probe(others, identity.bloom_build(keys, rate=1e-6)).count() < 3
    assert identity.bloom_probe(others, identity.bloom_build(keys.limit(0))).count() == 0
    assert identity.bloom_size(10**9, 0.01)[0] > 9 * 10**9


def test_shared_folder_of_a_cluster_must_be_named(spark):
    class Cluster:
        class sparkContext:
            master = "spark://somewhere:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        shared.shared_dir(Cluster)
    folder = shared.work_dir(spark)
    kept = shared.written(spark.range(3), "three", folder)
    assert kept.count() == 3 and shared.discard(spark) >= 1 and not os.path.exists(folder)


def test_vectors_are_compared_for_the_pairs_asked_for(spark):
    v = spark.createDataFrame([("A", "x", 5, 0), ("A", "y", 1, 0), ("B", "x", 5, 0), ("C", "z", 1, 0)], "replica_id string, node string, pt long, c long")
    asked = spark.createDataFrame([("A", "B"), ("A", "C")], "mine string, theirs string")
    assert rows(vectors.compare(v, asked)) == [("A", "B", True, False, False), ("A", "C", False, False, True)]
    assert vectors.compare(v).count() == 6


def test_records_of_different_schemas_do_not_merge(spark):
    empty = {"elements": spark.createDataFrame([], "record_id string, field string, element string")}
    with pytest.raises(ValueError):
        merge.records((BENCH, empty), (Schema("bench", (Field("g_a", GSET),)), empty))


VECTOR = {
    "name": "mixed",
    "kind": "merge",
    "replicas": {
        "A": {
            "m_a": [{"value": 92, "taken_at": "2026-05-01T10:15", "recorded_by": "w1", "hlc": [1000, 0, "dev:a"]}],
            "d_a": {"value": None, "hlc": [1001, 0, "dev_a"], "author": "w1", "history": [{"value": "it's", "hlc": [999, 0, "dev_a"], "author": "w2"}]},
            "d_b": {"value": True, "hlc": [1001, 1, "dev_a"], "author": "w1", "history": []},
            "set_a": {"adds": [{"element": "t1", "tag": [9, 0, "a"]}, {"element": "t1", "tag": [10, 0, "a"]}], "removed_tags": [[9, 0, "a"]]},
            "st_a": "s1",
            "g_a": ["e2", "e1"],
        },
        "B": {"d_b": {"value": -7, "hlc": [1002, 1, "dev_b"], "author": "w2", "history": []}, "oops": 1},
    },
}


def test_vector_files_and_codecs(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.json").write_text(json.dumps(VECTOR))
    (tmp_path / "schema.json").write_text("{}")
    found = atoms.read_vectors(spark, str(tmp_path), "merge")
    assert [r["name"] for r in found.collect()] == ["mixed"]
    reps = atoms.replicas(found).withColumnRenamed("name", "record_id")
    assert rows(atoms.unknown_fields(reps, BENCH)) == [("B", "oops")]
    kinds = atoms.decode_records(reps, BENCH)
    assert rows(kinds["entries"], "value", "pt", "c", "node", "supersedes") == [(92, 1000, 0, "dev:a", None)]
    assert rows(kinds["observations"], "replica_id", "field", "vtag", "vtext", "pt") == [("A", "d_a", "0null", "", 1001), ("A", "d_a", "3str", "it's", 999), ("A", "d_b", "1bool", "true", 1001), ("B", "d_b", "2int", "-" + "7".zfill(20), 1002)]
    assert rows(kinds["adds"], "element", "pt") == [("t1", 10), ("t1", 9)] and rows(kinds["removes"], "pt") == [(9,)]
    assert rows(kinds["positions"], "value") == [("s1",)] and rows(kinds["elements"], "element") == [("e1",), ("e2",)]
    texts = merge.union(atoms.encode_series(kinds["entries"]), atoms.encode_registers(merge.register(kinds["observations"])), atoms.encode_orset(kinds["adds"], kinds["removes"]), atoms.encode_gset(kinds["elements"]), atoms.encode_status(kinds["positions"]))
    whole = json.loads(atoms.encode_records(texts).first()["json"])
    assert list(whole) == sorted(whole) and whole["set_a"] == {"adds": [{"element": "t1", "tag": [9, 0, "a"]}, {"element": "t1", "tag": [10, 0, "a"]}], "removed_tags": [[9, 0, "a"]]}
    assert [o["value"] for o in whole["d_a"]] == ["it's", None] and [o["value"] for o in whole["d_b"]] == [True, -7]
    assert whole["m_a"] == [{"hlc": [1000, 0, "dev:a"], "recorded_by": "w1", "taken_at": "2026-05-01T10:15", "value": 92}]


def test_quarantine(spark):
    bad = spark.createDataFrame([("A", "r", "d_a", "3str", "x", "w", 1, 0, "n"), ("A", "r", "d_a", "3str", "x", "", 1, 0, "n"), ("A", "r", "d_a", None, None, "w", 1, 0, "n"), ("A", "r", "d_a", "3str", "x", "w", -1, 0, "n"), ("A", "r", "d_a", "3str", "x", "w", 1, 0, "")], OBS)
    good, rejects = atoms.quarantine(bad, "observations")
    assert good.count() == 1
    assert {r["reason"] for r in rejects.collect()} == {"author is empty", "value has no canonical form", "physical time is negative", "node is empty"}
    with pytest.raises(Exception, match="author is empty|negative|canonical|node is empty"):
        atoms.strict(bad, "observations").collect()
    statuses = spark.createDataFrame([("A", "r", "st_a", "s1"), ("A", "r", "st_a", "zz")], "replica_id string, record_id string, field string, value string")
    assert atoms.quarantine(statuses, "positions", BENCH)[1].count() == 1


def test_durable_copies_and_seeds(spark, tmp_path):
    df = spark.range(3)
    atoms.commit(df, str(tmp_path / "t"), 1)
    atoms.commit(df.limit(1), str(tmp_path / "t"), 2)
    assert atoms.restart(spark, str(tmp_path / "t")).count() == 1
    (tmp_path / "seeds.txt").write_text("# corpus\n49  # first\n\n1041\n")
    assert rows(atoms.read_seeds(spark, str(tmp_path / "seeds.txt"))) == [(1041,), (49,)]
    seen = spark.createDataFrame([("A", 1, 0, "x:y"), ("A", 2, 0, "z")], "replica_id string, pt long, c long, node string")
    assert rows(atoms.decoded_seen(atoms.encoded_seen(seen))) == rows(seen)


def test_scalars(spark):
    df = spark.createDataFrame([(-5, "2026-05-01T23:30:00"), (7, "T10:15")], "v long, t string")
    tagged = rows(df.select(scalars.tagged(F.col("v"), "int").alias("x")).select("x.*"))
    assert tagged == [("2int", "+" + "7".zfill(20)), ("2int", "-" + "5".zfill(20))]
    assert rows(df.select(scalars.day(F.col("t")), scalars.day(F.col("t"), "Asia/Tokyo"))) == [("", ""), ("2026-05-01", "2026-05-02")]
    assert rows(df.select(scalars.minor_units(F.col("v"), 1).cast("string"))) == [("-0.5",), ("0.7",)]
    with pytest.raises(ValueError):
        scalars.tagged(F.lit(1.5), "float")


def test_leq_and_absorption(spark):
    a = spark.createDataFrame([("r", "g", "x")], "record_id string, field string, element string")
    b = a.union(spark.createDataFrame([("r", "g", "y")], a.schema))
    assert merge.leq(a, b, a.columns) and not merge.leq(b, a, a.columns)


def test_signals_by_case(spark):
    s = "case_id string, code string"
    out = review.mismatches(spark.createDataFrame([("1", "a")], s), spark.createDataFrame([("2", "a")], s))
    assert rows(out) == [("1", "a", "spurious"), ("2", "a", "missing")]


def test_laws_over_all_orders(spark):
    """Registers and sets: any order and grouping of three replicas gives one state."""
    parts = [spark.createDataFrame([("A", "r", "d_a", "3str", v, w, p, 0, n)], OBS) for v, w, p, n in (("a", "w1", 1, "x"), ("b", "w2", 1, "y"), ("c", "w1", 2, "x"))]
    states = {str(rows(merge.register(merge.union(merge.register(merge.union(x, y)), z)))) for x, y, z in itertools.permutations(parts)}
    assert len(states) == 1


def test_status_identity(spark):
    spine = spark.createDataFrame([("r1",), ("r2",)], "record_id string")
    pos = spark.createDataFrame([("r1", "st_a", "s2")], "record_id string, field string, value string")
    assert rows(merge.with_identity(merge.status(pos, TOTAL_ORDER), spine, TOTAL_ORDER, "st_a")) == [("r1", "st_a", "s2"), ("r2", "st_a", "s0")]
