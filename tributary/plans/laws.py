"""Registered queries of laws, codecs, sessions and retention: each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import hlc, scalars
from ..operators import audit, delta, merge, reporting, review, vectors, views
from ..operators.merge import GROUP, STAMP
from ..schema import BENCH, DEDUP_COLUMNS, GSET, TOTAL_ORDER, Field, Schema
from ..sources import adapters as A
from ..shared import work_dir
from ..sources import atoms
from .queries import ENC, ENTRIES, EV, G, LINKED, MERGED, ORSET as ORSET_SQL, REGISTERS, SEEN_B, VV, _live, positions_sql, query, rep

NO_STAMPS = "replica_id string, pt long, c long, node string"


def only(replicas: str) -> str:
    """MERGED of some replicas."""
    return MERGED.replace("FROM entries)", f"FROM entries WHERE replica_id IN ({replicas}))")


# --- deltas


@query("delta_orset_adds", f"{ORSET_SQL} SELECT * FROM adds")
def delta_orset_adds(spark, d):
    """Sets go whole: an add that the peer has seen may be one whose removal it lacks."""
    return delta.delta_since("ORSet", merge.orset_adds(A.orset(spark, d)[0]), A.events(spark, d).where("event_id % 3 = 0"))


@query("delta_orset_removes", f"{ORSET_SQL} SELECT * FROM removes")
def delta_orset_removes(spark, d):
    return delta.delta_since("ORSet", merge.orset_removes(A.orset(spark, d)[1]), A.events(spark, d).where("event_id % 3 = 0"))


@query("delta_gset", f"WITH {EV}, g0 AS (SELECT event_id, record_id, 'g_a' AS field, 'g' || (event_id % 50) AS element FROM ev), {rep('g1', 'g0')} SELECT DISTINCT record_id, field, element FROM g1")
def delta_gset(spark, d):
    return delta.delta_since("GSet", merge.gset(A.elements(spark, d)), A.events(spark, d))


@query("delta_status", f"{positions_sql(('s0', 's1', 's2', 's3'))} SELECT {G}, max(value) AS value FROM positions GROUP BY {G}")
def delta_status(spark, d):
    return delta.delta_since("StatusLattice", merge.status(A.positions(spark, d), TOTAL_ORDER), A.events(spark, d))


@query("delta_empty", f"{ENTRIES}, {MERGED}, s AS (SELECT DISTINCT pt, c, node FROM ev WHERE event_id % 10 <> 3), k AS (SELECT 'u' || pt % 60 AS record_id, pt, c, node FROM merged) SELECT record_id, bool_and(EXISTS (SELECT 1 FROM s WHERE s.pt = k.pt AND s.c = k.c AND s.node = k.node)) AS empty FROM k GROUP BY record_id")
def delta_empty(spark, d):
    state = merge.series_of(BENCH, A.entries(spark, d)).withColumn("record_id", F.concat(F.lit("u"), F.col("pt") % 60))
    sent = delta.record_delta({"entries": state}, A.events(spark, d).where("event_id % 10 <> 3"))
    return delta.emptiness({"entries": state}, sent)


@query("delta_composition", f"{ENTRIES}, {MERGED} SELECT {G}, value, taken_at, recorded_by, pt, c, node FROM merged")
def delta_composition(spark, d):
    """A peer that gets B's part of what it lacks and then the rest has what it would have from one delta; the SQL merges all replicas."""
    rows = A.entries(spark, d)
    part = lambda *names: {"entries": merge.series_of(BENCH, rows.where(F.col("replica_id").isin(*names)))}
    peer, seen = part("A"), delta.frontier_of(rows.where("replica_id = 'A'"))
    first = delta.record_delta(part("A", "B"), seen)
    peer = delta.apply_delta(peer, first, DEDUP_COLUMNS)
    second = delta.record_delta(part("A", "B", "C"), vectors.seen_join(seen, first["entries"]))
    return delta.apply_delta(peer, second, DEDUP_COLUMNS)["entries"].drop("supersedes")


@query("delta_registers_compose", f"{REGISTERS} SELECT * FROM obs")
def delta_registers_compose(spark, d):
    """Two deltas put together are one: the union of what each sends, applied at once."""
    rows = A.observations(spark, d)
    part = lambda *names: {"observations": merge.register(rows.where(F.col("replica_id").isin(*names)))}
    seen = delta.frontier_of(rows.where("replica_id = 'A'"))
    first = delta.record_delta(part("A", "B"), seen)
    second = delta.record_delta(part("A", "B", "C"), vectors.seen_join(seen, first["observations"]))
    both = {"observations": merge.union(first["observations"], second["observations"])}
    return delta.apply_delta(part("A"), both, DEDUP_COLUMNS)["observations"]


# --- laws of the merge


ORDERS = list(permutations("ABC"))


@query("merge_orders", f"{ENTRIES}, {MERGED}, n AS (SELECT count(*) AS n_atoms, sum(value) AS total FROM merged) SELECT o.o AS arrival, n_atoms, CAST(total AS BIGINT) AS total FROM n, (VALUES {', '.join('(' + chr(39) + ''.join(o) + chr(39) + ')' for o in ORDERS)}) o(o)")
def merge_orders(spark, d):
    """The state after replicas have arrived one by one, in every order: each arrival is merged into the state before."""
    rows = A.entries(spark, d)
    found = []
    for order in ORDERS:
        state = rows.where("false").drop("replica_id")
        for name in order:
            state = merge.series_of(BENCH, merge.union(state, rows.where(F.col("replica_id") == name).drop("replica_id")))
        found.append(state.agg(F.lit("".join(order)).alias("arrival"), F.count("*").alias("n_atoms"), F.sum("value").alias("total")))
    return merge.union(*found)


@query("merge_idempotent", f"{REGISTERS} SELECT * FROM obs")
def merge_idempotent(spark, d):
    once = merge.register(A.observations(spark, d))
    return merge.register(merge.union(once, once, A.observations(spark, d)))


@query("merge_inflationary", f"{ENTRIES}, {only(chr(39) + 'A' + chr(39))} SELECT count(DISTINCT ({G}, taken_at, recorded_by, value)) AS n_keys, CAST(0 AS BIGINT) AS n_missing FROM merged")
def merge_inflationary(spark, d):
    """No key of one replica is missing after others are merged in."""
    rows = A.entries(spark, d)
    own = merge.observations("MeasurementSeries", rows.where("replica_id = 'A'"), DEDUP_COLUMNS)
    after = merge.observations("MeasurementSeries", merge.series_of(BENCH, rows), DEDUP_COLUMNS).withColumn("there", F.lit(1))
    joined = own.join(after, [*GROUP, *DEDUP_COLUMNS], "left")
    return joined.agg(F.count("*").alias("n_keys"), F.count_if(F.col("there").isNull()).alias("n_missing"))


@query("merge_not_contained", f"{REGISTERS}, a AS (SELECT DISTINCT * EXCLUDE (replica_id, event_id) FROM r0 WHERE replica_id = 'A'), b AS (SELECT DISTINCT * EXCLUDE (replica_id, event_id) FROM r0 WHERE replica_id = 'B') SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b")
def merge_not_contained(spark, d):
    """How far two states are from being at or below one another: the atoms that the other has not absorbed."""
    rows = A.observations(spark, d)
    a, b = (merge.register(rows.where(F.col("replica_id") == n)) for n in "AB")
    n = lambda x, y, name: merge.absorbed(x, y, merge.REGISTER).agg(F.count("*").alias(name))
    return n(a, b, "only_a").crossJoin(n(b, a, "only_b"))  # one row each


@query("observed_atoms", f"{ORSET_SQL}, k AS (SELECT 'ORSet' AS lattice, {G}, concat_ws('|', element, pt, c, node) AS what FROM adds UNION ALL SELECT 'StatusLattice', record_id, field, s FROM (SELECT DISTINCT record_id, field, 's' || (event_id % 4) AS s FROM ev WHERE field = 'st_a')) SELECT * FROM k")
def observed_atoms(spark, d):
    """What must never be lost, of a set and of a status."""
    tags = merge.observations("ORSet", A.orset(spark, d)[0]).select(F.lit("ORSet").alias("lattice"), *GROUP, F.concat_ws("|", "element", *STAMP).alias("what"))
    statuses = merge.observations("StatusLattice", A.positions(spark, d)).select(F.lit("StatusLattice").alias("lattice"), *GROUP, F.col("value").alias("what"))
    return tags.unionByName(statuses)


# --- codecs


def _wire(rows, kind):
    encoded = {"entries": atoms.encode_series, "observations": atoms.encode_registers, "elements": atoms.encode_gset, "positions": atoms.encode_status}[kind](rows)
    return encoded.select(F.lit("A").alias("replica_id"), *GROUP, F.col("json").alias("value"))


@query("codec_series", f"{LINKED}, {MERGED} SELECT {G}, value, taken_at, recorded_by, pt, c, node, supersedes FROM merged")
def codec_series(spark, d):
    """Entries written as JSON and read back."""
    return atoms.decode_series(_wire(merge.series_of(BENCH, A.entries(spark, d, links=True)), "entries"), BENCH).drop("replica_id")


#: A register on the wire is its current observation with the others as its history.
@query("codec_register", f"{REGISTERS} SELECT * FROM obs")
def codec_register(spark, d):
    listed = atoms.encode_registers(merge.register(A.observations(spark, d)))
    items = F.from_json("json", "array<variant>")
    value = F.concat(F.regexp_replace(F.to_json(items[0]), r"\}$", ""), F.lit(',"history":'), F.to_json(F.slice(items, 2, 1 << 30)), F.lit("}"))
    return atoms.decode_registers(listed.select(F.lit("A").alias("replica_id"), *GROUP, value.alias("value")), BENCH).drop("replica_id")


def _sets(spark, d):
    adds, removes = A.orset(spark, d)
    encoded = atoms.encode_orset(merge.orset_adds(adds), merge.orset_removes(removes))
    return atoms.decode_orset(encoded.select(F.lit("A").alias("replica_id"), *GROUP, F.col("json").alias("value")), BENCH)


@query("codec_orset_adds", f"{ORSET_SQL} SELECT * FROM adds")
def codec_orset_adds(spark, d):
    return _sets(spark, d)[0].drop("replica_id")


@query("codec_orset_removes", f"{ORSET_SQL} SELECT * FROM removes")
def codec_orset_removes(spark, d):
    return _sets(spark, d)[1].drop("replica_id")


@query("codec_gset", f"WITH {EV}, g0 AS (SELECT event_id, record_id, 'g_a' AS field, 'g' || (event_id % 50) AS element FROM ev), {rep('g1', 'g0')} SELECT DISTINCT record_id, field, element FROM g1")
def codec_gset(spark, d):
    return atoms.decode_gset(_wire(merge.gset(A.elements(spark, d)), "elements"), BENCH).drop("replica_id")


@query("codec_status", f"{positions_sql(('s0', 's1', 's2', 's3'))} SELECT {G}, max(value) AS value FROM positions GROUP BY {G}")
def codec_status(spark, d):
    return atoms.decode_status(_wire(merge.status(A.positions(spark, d), TOTAL_ORDER), "positions"), BENCH).drop("replica_id")


@query("codec_wire_text", f"""WITH {EV}, g0 AS (SELECT event_id, record_id, 'g_a' AS field, 'g' || (event_id % 50) AS element FROM ev), {rep('g1', 'g0')},
    g AS (SELECT record_id, '[' || string_agg('"' || element || '"', ',' ORDER BY element) || ']' AS j FROM (SELECT DISTINCT record_id, element FROM g1) GROUP BY record_id),
    p AS (SELECT record_id, '"' || max('s' || (event_id % 4)) || '"' AS j FROM ev WHERE field = 'st_a' GROUP BY record_id)
    SELECT g.record_id, '{{"g_a":' || g.j || coalesce(',"st_a":' || p.j, '') || '}}' AS json FROM g LEFT JOIN p ON p.record_id = g.record_id""")
def codec_wire_text(spark, d):
    """Whole records as JSON text: fields in the order of their names, absent ones left out."""
    fields = merge.union(atoms.encode_gset(merge.gset(A.elements(spark, d))), atoms.encode_status(merge.status(A.positions(spark, d), TOTAL_ORDER)))
    return atoms.encode_records(fields)


@query("codec_seen", f"WITH {EV} SELECT DISTINCT 'B' AS replica_id, pt, c, node FROM ev WHERE event_id % 3 = 0")
def codec_seen(spark, d):
    seen = A.events(spark, d).where("event_id % 3 = 0").select(F.lit("B").alias("replica_id"), *STAMP)
    return atoms.decoded_seen(atoms.encoded_seen(seen))


@query("codec_vector", f"{VV} SELECT replica_id, node, pt, c FROM vv")
def codec_vector(spark, d):
    return vectors.from_map(vectors.to_map(vectors.build(A.replicated(A.events(spark, d)))))


@query("unknown_fields", "SELECT DISTINCT 'w' || (user_id % 3) AS replica_id, event_type AS field FROM events WHERE event_type NOT IN ('view', 'click')")
def unknown_fields(spark, d):
    schema = Schema("two", (Field("view", GSET), Field("click", GSET)))
    rows = A.table(spark, d, "events").select(F.concat(F.lit("w"), F.col("user_id") % 3).alias("replica_id"), F.col("event_type").alias("field"))
    return atoms.unknown_fields(rows, schema)


@query("quarantined", f"WITH {EV}, x AS (SELECT *, CASE WHEN event_id % 10 = 1 THEN -pt ELSE pt END AS p, CASE WHEN event_id % 10 = 2 THEN '' ELSE node END AS n, CASE WHEN event_id % 10 = 3 THEN '' ELSE author END AS a FROM ev WHERE field IN ('m_a', 'm_b')) SELECT CASE WHEN event_id % 10 = 1 THEN 'physical time is negative' WHEN event_id % 10 = 2 THEN 'node is empty' ELSE 'author is empty' END AS reason, count(*) AS n FROM x WHERE event_id % 10 IN (1, 2, 3) GROUP BY 1")
def quarantined(spark, d):
    rows = A.events(spark, d).where("field IN ('m_a', 'm_b')")
    last = F.col("event_id") % 10
    damaged = rows.select(*GROUP, "value", "taken_at", F.when(last == 3, "").otherwise(F.col("author")).alias("recorded_by"), F.when(last == 1, -F.col("pt")).otherwise(F.col("pt")).alias("pt"), "c", F.when(last == 2, "").otherwise(F.col("node")).alias("node"), F.lit(None).cast("string").alias("supersedes"))
    return atoms.quarantine(damaged, "entries", BENCH)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("schema_catalog", "SELECT * FROM (VALUES ('bench', 'm_a', 'MeasurementSeries', 1, true), ('bench', 'm_b', 'MeasurementSeries', 0, true), ('bench', 'd_a', 'LWWRegister', 0, true), ('bench', 'd_b', 'LWWRegister', 0, true), ('bench', 'st_a', 'StatusLattice', 0, true), ('bench', 'set_a', 'ORSet', 0, true), ('bench', 'g_a', 'GSet', 0, true)) t(schema_name, field, lattice, scale, review_when_contested)")
def schema_catalog(spark, d):
    """A schema written as a descriptor, read back, as rows."""
    return Schema.from_json(BENCH.to_json()).catalog(spark).drop("dedup_on", "order")


@query("codec_formats", f"{REGISTERS} SELECT f.f AS format, obs.* FROM obs, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) f(f)")
def codec_formats(spark, d):
    """Observations written in every file format and read back."""
    folder, merged, found = work_dir(spark), merge.register(A.observations(spark, d)), []
    for kind in sorted(atoms.FORMATS):
        atoms.write_atoms(merged, f"{folder}/{kind}", kind)
        found.append(atoms.read_atoms(spark, f"{folder}/{kind}", merged.schema, kind).withColumn("format", F.lit(kind)))
    return merge.union(*found)


# --- audits of views


@query("audit_series_views_agree", f"{ENTRIES}, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY replica_id, {G}, taken_at, recorded_by, value ORDER BY pt, c, node) AS rn FROM entries WHERE replica_id IN ('A', 'C')) WHERE rn = 1), f AS (SELECT replica_id, {G}, string_agg(value || '@' || {ENC.format('')}, ',' ORDER BY pt, c, node) AS s FROM m GROUP BY ALL) SELECT 'derived_views_agree:series' AS invariant, record_id, field, '' AS replica_id, count(DISTINCT s) || ' states, on ' || count(DISTINCT replica_id) || ' of 2 replicas' AS detail FROM f GROUP BY {G} HAVING count(DISTINCT s) > 1 OR count(DISTINCT replica_id) < 2")
def audit_series_views_agree(spark, d):
    rows = A.entries(spark, d)
    parts = [views.series_current(merge.series_of(BENCH, rows.where(F.col("replica_id") == r))).withColumn("replica_id", F.lit(r)) for r in ("A", "C")]
    prints = views.canonical(merge.union(*parts), ["value", *STAMP], by=["replica_id", *GROUP])
    return audit.views_agree("series", prints.withColumnRenamed("fingerprint", "view"), _live(spark))


@query("audit_set_views_agree", f"{ORSET_SQL}, a2 AS (SELECT DISTINCT replica_id, {G}, element, pt, c, node FROM s2 WHERE event_id % 4 <> 0 AND replica_id IN ('A', 'C')), r2 AS (SELECT DISTINCT replica_id, {G}, seen.pt AS pt, seen.c AS c, seen.node AS node FROM s2 WHERE event_id % 4 = 0 AND seen IS NOT NULL), l2 AS (SELECT replica_id, {G}, element, count(*) AS n FROM a2 a WHERE NOT EXISTS (SELECT 1 FROM r2 r WHERE r.replica_id = a.replica_id AND r.record_id = a.record_id AND r.field = a.field AND r.pt = a.pt AND r.c = a.c AND r.node = a.node) GROUP BY ALL), f AS (SELECT replica_id, {G}, string_agg(element || n, ',' ORDER BY element) AS s FROM l2 GROUP BY ALL) SELECT 'derived_views_agree:set' AS invariant, record_id, field, '' AS replica_id, count(DISTINCT s) || ' states, on ' || count(DISTINCT replica_id) || ' of 2 replicas' AS detail FROM f GROUP BY {G} HAVING count(DISTINCT s) > 1 OR count(DISTINCT replica_id) < 2")
def audit_set_views_agree(spark, d):
    adds, removes = A.orset(spark, d)
    own = lambda rows, r: rows.where(F.col("replica_id") == r)
    parts = [views.orset_members(merge.orset_adds(own(adds, r)), merge.orset_removes(own(removes, r))).withColumn("replica_id", F.lit(r)) for r in ("A", "C")]
    prints = views.canonical(merge.union(*parts), ["element", "n_tags"], by=["replica_id", *GROUP])
    return audit.views_agree("set", prints.withColumnRenamed("fingerprint", "view"), _live(spark))


@query("audit_differences", f"{REGISTERS}, x AS (SELECT {G}, concat_ws('|', vtag, vtext, author, pt, c, node) AS atom, bool_or(replica_id = 'A') AS a, bool_or(replica_id = 'C') AS c2 FROM r0 GROUP BY ALL) SELECT record_id, field, atom, CASE WHEN a THEN 'A' ELSE 'C' END AS held_by, CASE WHEN a THEN 'C' ELSE 'A' END AS absent_from FROM x WHERE a <> c2")
def audit_differences(spark, d):
    return audit.differences(A.observations(spark, d), _live(spark), merge.REGISTER)


@query("audit_all", f"{REGISTERS}, a AS (SELECT DISTINCT {G}, vtag, vtext, author, pt, c, node FROM r0 WHERE replica_id = 'A'), k AS (SELECT DISTINCT {G}, vtag, vtext, author, pt, c, node FROM r0 WHERE replica_id = 'C'), gone AS (SELECT 'no_observation_lost' AS invariant FROM (SELECT * FROM k EXCEPT SELECT * FROM a)), z AS (SELECT 'no_duplicate_operation_ids' AS invariant FROM (SELECT pt - pt % 3600000 AS p, node, 'R' || event_id % 5 AS r FROM ev GROUP BY ALL HAVING count(*) > 1)) SELECT invariant, count(*) AS n FROM (SELECT * FROM gone UNION ALL SELECT * FROM z) GROUP BY invariant")
def audit_all(spark, d):
    """All violations that several audits find, counted by invariant."""
    rows, none = A.observations(spark, d), spark.createDataFrame([], NO_STAMPS)
    lost = audit.no_observation_lost(rows.where("replica_id = 'C'"), none, rows, _live(spark))
    coarse = A.oplog(spark, d).withColumn("pt", F.col("pt") - F.col("pt") % 3_600_000).withColumn("c", F.lit(0).cast("bigint"))
    return audit.check_all(lost, audit.no_duplicate_operation_ids(coarse)).groupBy("invariant").agg(F.count("*").alias("n"))


@query("log_helpers", f"WITH {EV}, o AS (SELECT *, 'R' || event_id % 5 AS replica_id FROM ev) SELECT 'measurement_keys' AS what, count(*) AS n FROM (SELECT DISTINCT {G}, taken_at, author, value FROM o) UNION ALL SELECT 'originated_by', count(*) FROM o WHERE replica_id = 'R3' UNION ALL SELECT 'record_ids', count(DISTINCT record_id) FROM o")
def log_helpers(spark, d):
    log = A.oplog(spark, d)
    found = {"measurement_keys": audit.measurement_keys(log, DEDUP_COLUMNS), "originated_by": audit.originated_by(log, "R3"), "record_ids": audit.record_ids(log)}
    return merge.union(*[rows.agg(F.lit(name).alias("what"), F.count("*").alias("n")) for name, rows in found.items()])


@query("register_values", f"{REGISTERS} SELECT DISTINCT {G}, vtag, vtext FROM obs")
def register_values(spark, d):
    return audit.register_values(A.observations(spark, d))


@query("traffic_cube", f"WITH {EV} SELECT coalesce(record_id, 'all') AS record_id, coalesce(field, 'all') AS field, count(*) AS n, count(DISTINCT author) AS n_authors FROM ev GROUP BY CUBE (record_id, field)")
def traffic_cube(spark, d):
    """Writes and writers by record and field, with all totals."""
    by = A.events(spark, d).cube("record_id", "field").agg(F.count("*").alias("n"), F.count_distinct("author").alias("n_authors"))
    return by.select(F.coalesce("record_id", F.lit("all")).alias("record_id"), F.coalesce("field", F.lit("all")).alias("field"), "n", "n_authors")


# --- clocks and review


@query("hlc_transcript", f"WITH {EV}, p AS (SELECT event_id, node, max(greatest(0, pt)) OVER (PARTITION BY node ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS pt FROM ev), b AS (SELECT *, row_number() OVER (PARTITION BY node, pt ORDER BY event_id) - 1 AS c FROM p) SELECT event_id, node, pt, c FROM b WHERE event_id % 9 = 4")
def hlc_transcript(spark, d):
    """Steps whose stamp is not the one that a transcript expects: every ninth was written down one too high."""
    computed = hlc.replay(A.events(spark, d).select("event_id", "node", F.col("pt").alias("phys")), "event_id").select("event_id", *STAMP)
    expected = computed.select("event_id", F.col("pt").alias("expect_pt"), (F.col("c") + (F.col("event_id") % 9 == 4).cast("bigint")).alias("expect_c"), F.col("node").alias("expect_node"))
    return hlc.transcript_mismatches(computed, expected, ["event_id"]).select("event_id", "node", "pt", "c")


@query("hlc_rejects", f"WITH {EV} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'stamp is incomplete' WHEN event_id % 4 = 1 THEN 'counter is negative' END AS reason FROM ev")
def hlc_rejects(spark, d):
    last = F.col("event_id") % 4
    rows = A.events(spark, d).select("event_id", F.when(last != 0, F.col("pt")).alias("pt"), F.when(last == 1, F.lit(-1).cast("bigint")).otherwise(F.col("c")).alias("c"), "node")
    return rows.select("event_id", hlc.reject_reason().alias("reason"))


@query("signal_evidence", f"{LINKED}, {MERGED} SELECT 'superseded_fork' AS code, count(DISTINCT ({G})) AS n, CAST(count(*) AS BIGINT) AS n_evidence FROM (SELECT {G}, supersedes FROM merged WHERE supersedes IS NOT NULL GROUP BY {G}, supersedes HAVING count(*) > 1) HAVING count(*) > 0")
def signal_evidence(spark, d):
    """How many signals each code has and how much evidence they carry."""
    found = review.superseded_fork(merge.series_of(BENCH, A.entries(spark, d, links=True)))
    return found.groupBy("code").agg(F.count("*").alias("n"), F.sum(F.size("evidence")).alias("n_evidence"))


@query("signal_mismatches", "SELECT 'c' || (c_custkey % 40) AS case_id, 'superseded_fork' AS code, CASE WHEN min(c_custkey % 2) = 0 THEN 'missing' ELSE 'spurious' END AS problem FROM customer GROUP BY c_custkey % 40")
def signal_mismatches(spark, d):
    rows = A.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey") % 40).alias("case_id"), F.lit("superseded_fork").alias("code"), (F.col("c_custkey") % 2).alias("odd"))
    return review.mismatches(rows.where("odd = 1"), rows.where("odd = 0"))


@query("day_in_zone", "SELECT event_id, strftime(ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%d') AS day FROM events")
def day_in_zone(spark, d):
    """The calendar day of a reading where it was taken (Asia/Kolkata, five and a half hours ahead)."""
    taken = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return A.table(spark, d, "events").select("event_id", scalars.day(taken, "Asia/Kolkata").alias("day"))


# --- sessions, links, retention


@query("battery_per_session", "WITH s AS (SELECT (60 + event_id % 40 - (60 + event_id % 40 - event_id % 5)) * 3600000.0 / (60000 * (1 + event_id % 30)) AS x FROM events WHERE event_id % 4 <> 0) SELECT count(*) AS n, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95 FROM s")
def battery_per_session(spark, d):
    full = F.col("event_id") % 40 + 60
    rows = A.table(spark, d, "events").select(full.alias("start_pct"), (full - F.col("event_id") % 5).alias("end_pct"), (F.col("event_id") % 4 == 0).alias("charging"), (60_000 * (F.col("event_id") % 30 + 1)).alias("ms"))
    return reporting.battery(rows).select("n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("crash_free_sessions", "WITH s AS (SELECT CASE user_id % 3 WHEN 0 THEN 2048 WHEN 1 THEN 3072 ELSE 4096 END AS ram_mb, event_id % 17 = 0 AS crashed, event_id % 17 = 1 AS killed FROM events) SELECT ram_mb, count(*) AS n, count(*) FILTER (crashed) AS n_crashed, count(*) FILTER (killed) AS n_killed, CAST(floor((count(*) - count(*) FILTER (crashed OR killed)) * 1000 / count(*)) AS BIGINT) AS permille FROM s GROUP BY ram_mb")
def crash_free_sessions(spark, d):
    last = F.col("event_id") % 17
    rows = A.table(spark, d, "events").select(F.element_at(F.array(*map(F.lit, (2048, 3072, 4096))), (F.col("user_id") % 3 + 1).cast("int")).alias("ram_mb"), F.when(last == 0, "crash").when(last == 1, "killed").otherwise("done").alias("ended"))
    return reporting.crash_free(rows)


@query("sliding_traffic", "SELECT 'w' || (user_id % 3) AS replica_id, to_timestamp(w * 3600) AT TIME ZONE 'UTC' AS first_at, count(*) AS n FROM (SELECT user_id, unnest([epoch_us(ts) // 3600000000, epoch_us(ts) // 3600000000 - 1]) AS w FROM events) GROUP BY ALL")
def sliding_traffic(spark, d):
    rows = A.table(spark, d, "events").select(F.concat(F.lit("w"), F.col("user_id") % 3).alias("replica_id"), F.col("ts").cast("timestamp").alias("at"))
    return reporting.sliding(rows, "at", "2 hours", "1 hour").withColumn("first_at", F.col("first_at").cast("timestamp_ntz"))


@query("link_can_carry", f"WITH {EV}, t AS (SELECT event_id, user_id % 3 AS link, pt AS a, 60000 * (event_id % 90) AS ms FROM ev) SELECT event_id, a // 86400000 * 86400000 + 3600000 * (6 + link) <= a AND a + ms <= a // 86400000 * 86400000 + 3600000 * (18 + link) AS carried FROM t")
def link_can_carry(spark, d):
    """Each link is open twelve hours a day."""
    events = A.events(spark, d)
    transfers = events.select("event_id", (F.col("user_id") % 3).alias("link"), F.col("pt").alias("at"), (F.col("event_id") % 90 * 60_000).alias("ms"))
    day = F.floor(F.col("at") / 86_400_000) * 86_400_000
    windows = transfers.select("link", (day + 3_600_000 * (F.col("link") + 6)).alias("opens"), (day + 3_600_000 * (F.col("link") + 18)).alias("closes")).distinct()
    return reporting.can_carry(transfers, windows).select("event_id", "carried")


@query("retry_backoff", "WITH a AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS attempt FROM events WHERE event_type = 'error'), m AS (SELECT *, CAST(least(60000, 500 * pow(2.0, least(attempt, 40))) AS BIGINT) AS most, ('0x' || substr(md5(session_id || ':' || attempt), 1, 4))::BIGINT AS share FROM a) SELECT session_id, attempt, most // 2 + (most // 2) * share // 65535 AS wait_ms FROM m")
def retry_backoff(spark, d):
    errors = A.table(spark, d, "events").where("event_type = 'error'")
    attempts = errors.select(F.col("user_id").alias("session_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint").alias("attempt"))
    return reporting.backoff(attempts)


@query("in_flight", f"""WITH {EV}, s AS (SELECT 's' || user_id % 20 AS session_id, pt AS a, 1 AS step FROM ev UNION ALL SELECT 's' || user_id % 20, pt + 600000 * (1 + event_id % 50), -1 FROM ev WHERE event_id % 6 <> 0), b AS (SELECT session_id, a, sum(step) AS step FROM s GROUP BY ALL), r AS (SELECT session_id, a AS "at", CAST(sum(step) OVER (PARTITION BY session_id ORDER BY a) AS BIGINT) AS n FROM b) SELECT * FROM r WHERE n > 3""")
def in_flight(spark, d):
    acked = F.when(F.col("event_id") % 6 != 0, F.col("pt") + 600_000 * (F.col("event_id") % 50 + 1))
    return reporting.in_flight(A.events(spark, d).select(F.concat(F.lit("s"), F.col("user_id") % 20).alias("session_id"), F.col("pt").alias("sent_at"), acked.alias("acked_at")), 3)


OFFERS = "o AS (SELECT DISTINCT user_id AS session_id, 'p' || event_id % 2 AS peer, event_id % 7 AS version FROM events)"


@query("version_negotiation", f"WITH {OFFERS}, p AS (SELECT session_id, count(DISTINCT peer) AS n FROM o GROUP BY session_id), c AS (SELECT session_id, version FROM o JOIN p USING (session_id) GROUP BY session_id, version, n HAVING count(DISTINCT peer) = n) SELECT p.session_id, max(c.version) AS version FROM p LEFT JOIN c ON c.session_id = p.session_id GROUP BY p.session_id")
def version_negotiation(spark, d):
    return reporting.negotiated(A.table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.concat(F.lit("p"), F.col("event_id") % 2).alias("peer"), (F.col("event_id") % 7).alias("version")))


@query("lane_watermarks", "WITH n AS (SELECT DISTINCT 'w' || user_id % 5 AS replica_id, event_id % 4 AS lane, event_id // 20 + 1 AS seq FROM events WHERE event_id % 101 <> 60), r AS (SELECT *, seq - row_number() OVER (PARTITION BY replica_id, lane ORDER BY seq) AS island FROM n) SELECT replica_id, lane, coalesce(max(CASE WHEN island = 0 THEN seq END), 0) AS watermark, max(seq) AS highest FROM r GROUP BY ALL")
def lane_watermarks(spark, d):
    """The highest chunk of each lane up to which all are acknowledged."""
    rows = A.table(spark, d, "events").where("event_id % 101 <> 60")
    return vectors.contiguous(rows.select(F.concat(F.lit("w"), F.col("user_id") % 5).alias("replica_id"), (F.col("event_id") % 4).alias("lane"), (F.floor(F.col("event_id") / 20) + 1).alias("seq")), ["replica_id", "lane"])


@query("collectable_tombstones", f"{ORSET_SQL}, {rep('rp', 'ev')}, f AS (SELECT replica_id, node, max(pt) - CASE replica_id WHEN 'A' THEN 864000000 ELSE 0 END AS pt FROM rp GROUP BY replica_id, node), low AS (SELECT node, min(pt) AS low FROM f GROUP BY node HAVING count(DISTINCT replica_id) = (SELECT count(DISTINCT replica_id) FROM f)), h AS (SELECT max(pt) - 432000000 AS horizon FROM ev) SELECT r.record_id, r.field, r.pt, r.c, r.node FROM removes r JOIN low ON low.node = r.node, h WHERE r.pt <= low AND r.pt < horizon")
def collectable_tombstones(spark, d):
    """Tombstones older than five days that every replica has for certain."""
    frontier = vectors.build(A.replicated(A.events(spark, d))).withColumn("pt", F.col("pt") - F.when(F.col("replica_id") == "A", 864_000_000).otherwise(0))
    horizon = A.events(spark, d).agg(F.max("pt")).first()[0] - 432_000_000
    return reporting.collectable(merge.orset_removes(A.orset(spark, d)[1]), frontier, horizon)


@query("high_cardinality_registers", f"WITH {EV}, o AS (SELECT DISTINCT 'u' || user_id AS record_id, field, CAST(value AS VARCHAR) AS vtext, author, pt, c, node FROM ev), b AS (SELECT *, row_number() OVER (PARTITION BY record_id, field ORDER BY pt DESC, c DESC, node DESC, author DESC, vtext DESC) AS rn, count(*) OVER (PARTITION BY record_id, field) - 1 AS n_losers FROM o) SELECT record_id, field, pt, c, node, vtext, n_losers FROM b WHERE rn = 1")
def high_cardinality_registers(spark, d):
    """Current values with a record for each user and a field for each kind of event."""
    rows = A.events(spark, d).withColumn("record_id", F.concat(F.lit("u"), "user_id")).withColumn("vtag", F.lit("2int")).withColumn("vtext", F.col("value").cast("string"))
    return views.register_current(merge.register(rows)).select(*GROUP, *STAMP, "vtext", "n_losers")


@query("high_cardinality_series", f"WITH {EV}, e AS (SELECT *, 'u' || user_id AS rid FROM ev) SELECT rid AS record_id, field, value, taken_at, recorded_by, pt, c, node FROM (SELECT rid, field, value, taken_at, author AS recorded_by, pt, c, node, row_number() OVER (PARTITION BY rid, field, taken_at, author, value ORDER BY pt, c, node) AS rn FROM e) WHERE rn = 1")
def high_cardinality_series(spark, d):
    rows = A.events(spark, d).withColumn("record_id", F.concat(F.lit("u"), "user_id")).withColumn("recorded_by", F.col("author")).withColumn("supersedes", F.lit(None).cast("string"))
    return merge.series(rows, DEDUP_COLUMNS).drop("supersedes")
