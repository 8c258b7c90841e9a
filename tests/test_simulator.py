"""Generated logs: clean sweeps find nothing, damaged states are found, streams equal batches."""

from collections import Counter

from pyspark.sql import functions as F

from tributary import simulator as S
from tributary.operators import merge
from tributary.operators.merge import GROUP
from tributary.schema import DEDUP_COLUMNS
from tributary.streaming import incremental


def test_seed_decides(spark):
    assert S.play(S.scenario(9)) == S.play(S.scenario(9)) != S.play(S.scenario(10))
    a, b = (sorted(map(repr, S.played(S.seeds(spark, 1, 9).repartition(n)).collect())) for n in (1, 5))
    assert a == b


def test_kinds_come_in_their_shares():
    kinds = Counter(r["kind"] for seed in range(1, 200) for r in S.play(S.scenario(seed))["log"])
    n = kinds.total()
    tags = kinds["tag"] + kinds["tag_remove"]
    for found, share in ((kinds["measurement"], 0.5), (kinds["register"], 0.3), (kinds["status"], 0.1), (tags, 0.1)):
        assert abs(found / n - share) < 0.02
    assert kinds["tag_remove"] > 0


def test_what_crashes_do_not_lose_is_held_somewhere():
    lost = 0
    for seed in range(1, 120):
        out = S.play(S.scenario(seed))
        marks = {(r["replica_id"], r["pt"], r["c"], r["node"]) for r in out["lost"]}
        held = {S.known_by(tuple(r[c] for c in S.SHAPE)) for r in out["state"]}
        lost += len(marks)
        assert all(r["key"] in held or (r["replica_id"], r["pt"], r["c"], r["node"]) in marks for r in out["log"])
    assert lost


def test_messages_go_through_open_windows_only():
    faults = Counter()
    for seed in range(1, 80):
        s = S.scenario(seed)
        for r in S.play(s)["delivery"]:
            faults[r["fault"]] += 1
            inside = any(a <= r["at"] < b and r["arrives"] <= b for a, b in S.windows(s, (r["replica_id"], r["dst"])))
            assert inside or r["fault"] in ("window", "cut")
            off = S.cuts(s, [f"dev_{chr(97 + i)}" for i in range(s.devices)]).get((r["replica_id"], r["dst"]), (0, 0))
            assert (off[0] <= r["at"] < off[1]) == (r["fault"] == "cut")
    assert set(faults) == {"none", "lost", "doubled", "held", "cut", "window"}


def test_quiet_networks_have_no_faults():
    assert {r["fault"] for seed in range(1, 30) for r in S.play(S.scenario(seed, "quiet"))["delivery"]} <= {"none", "window"}


def test_settling_uses_the_reducers(spark):
    table = S.played(S.seeds(spark, 1, 6))
    state = S.settled(S.rows_of(table, "state"))
    before = S.rows_of(table, "state")
    readings = before.where("kind = 'entry'").select(*GROUP, *DEDUP_COLUMNS).distinct().count()
    by = {r["replica_id"]: r["n"] for r in state.where("kind = 'entry'").groupBy("seed", "replica_id").agg(F.count("*").alias("n")).collect()}
    per_seed = {r["seed"]: r["n"] for r in before.where("kind = 'entry'").select("seed", *GROUP, *DEDUP_COLUMNS).distinct().groupBy("seed").agg(F.count("*").alias("n")).collect()}
    assert sum(per_seed.values()) == readings and all(n == per_seed[int(r.split("/")[0])] for r, n in by.items())
    assert S.judged(table).count() == 0


def test_damaged_states_are_found(spark):
    table = S.played(S.seeds(spark, 1, 12))
    log, lost, state = S.rows_of(table, "log"), S.rows_of(table, "lost"), S.settled(S.rows_of(table, "state")).cache()
    found = lambda damaged: {r["invariant"] for r in S.audits(log, lost, damaged).select("invariant").distinct().collect()}
    assert "no_measurement_lost" in found(state.where("NOT (kind = 'entry' AND replica_id LIKE '%dev_a')"))
    assert "no_tag_lost" in found(state.where("NOT (kind = 'add' AND replica_id LIKE '%dev_b')"))
    assert "all_converged" in found(state.where("NOT (kind = 'position' AND replica_id LIKE '%dev_b')"))
    invented = state.unionByName(state.where("kind = 'entry'").withColumn("value", F.col("value") + 10_000))
    assert "no_phantom_measurements" in found(invented)


def test_shrink_keeps_the_invariant():
    finds = lambda s: ({"lost"} if s.writes >= 4 and s.cuts > 0 else set()) | {"other"}
    small = S.shrink(S.scenario(3), "lost", finds)
    assert (small.writes, small.devices, small.records, small.days, small.link, small.crashes, small.wrong_clocks) == (4, 2, 1, 1, "wire", 0.0, 0.0) and small.cuts > 0


def test_timeline_sweep_shards_and_stop(spark, monkeypatch):
    s = S.scenario(2)
    assert len(S.timeline(s)) == s.writes and 0 < len(S.timeline(s, "rec_0")) <= s.writes
    swept = S.sweep(spark, 1, 4)
    assert swept.count() == 4 and S.first_failing(swept) is None
    assert [r["seed"] for r in S.seeds(spark, 5, 10, (1, 3)).orderBy("seed").collect()] == [7, 10, 13]
    monkeypatch.setitem(S.REDUCERS, "entry", S.MUTATIONS["M1"][0]["entry"])
    monkeypatch.setattr(S.judged, "__defaults__", (S.REDUCERS,))
    stopped = S.sweep(spark, 1, 30, stop_after=1, at_once=10)
    assert stopped.count() == 10 and S.first_failing(stopped) is not None


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"r{i % 3}", "m_a", 80 + i % 4, "2026-01-01", "w1", 1000 + (i * 7) % 13, i % 2, "n", None) for i in range(40)]
    df = spark.createDataFrame(rows, "record_id string, field string, value long, taken_at string, recorded_by string, pt long, c long, node string, supersedes string")
    for part in (df.where("pt % 2 = 0"), df.where("pt % 2 = 1"), df):  # out of order, and everything a second time
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.read_log(spark, str(tmp_path / "in"), df.schema, 1)
    incremental.merge_into(stream, "entries", str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.count() == df.distinct().count()
    run = incremental.series(incremental.read_log(spark, str(tmp_path / "in"), df.schema, 1), DEDUP_COLUMNS).writeStream.outputMode("complete").format("memory").queryName("series_out").trigger(availableNow=True).start()
    run.awaitTermination()
    key = lambda d: sorted(map(tuple, d.select(*merge.ENTRY).collect()), key=repr)
    assert key(spark.table("series_out")) == key(merge.series(df, DEDUP_COLUMNS))


def test_stream_clock(spark, tmp_path):
    rows = [("a", i, 1000 + (i * 5) % 7, 1003 if i % 4 == 0 else None, i if i % 4 == 0 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "node string, i long, phys long, rpt long, rc long")
    for part in (df.where("i < 9"), df.where("i >= 9")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    run = incremental.clocks(incremental.read_log(spark, str(tmp_path / "in"), df.schema)).writeStream.outputMode("append").format("memory").queryName("clock_out").trigger(availableNow=True).start()
    run.awaitTermination()
    from tributary.functions import hlc

    want = hlc.replay(df, remote_pt="rpt", remote_c="rc").select("node", "i", "pt", "c")
    assert sorted(map(tuple, spark.table("clock_out").collect())) == sorted(map(tuple, want.collect()))
