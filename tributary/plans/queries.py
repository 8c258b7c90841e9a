"""Registered queries: each a DataFrame over the driver's tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import simulator
from ..functions import hlc, scalars
from ..operators import audit, delta, identity, merge, reporting, review, vectors, views
from ..operators.merge import GROUP, STAMP
from ..shared import work_dir
from ..schema import BENCH, DEDUP_COLUMNS, DIAMOND, REGISTER, STATUS, TOTAL_ORDER, Field, Schema
from ..sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIAMOND_SCHEMA = Schema("diamond", (Field("st_a", STATUS, order=DIAMOND),))
REGISTER_SCHEMA = Schema("registers", (Field("d_a", REGISTER),))

EV = """ev AS (SELECT event_id, user_id, event_type, 'r' || (user_id % 10) AS record_id,
  CASE event_type WHEN 'view' THEN 'm_a' WHEN 'click' THEN 'm_b' WHEN 'purchase' THEN 'd_a' WHEN 'signup' THEN 'st_a' WHEN 'error' THEN 'set_a' END AS field,
  epoch_us(ts) // 1000 AS pt, event_id % 1000 AS c, 'dev_' || (event_id % 5) AS node, 'w' || (user_id % 3) AS author,
  strftime(ts, '%Y-%m-%d') AS taken_at, CAST(floor(value / 10) AS BIGINT) AS value FROM events)"""
H = "{{'pt': {0}pt, 'c': {0}c, 'node': {0}node}}"
ENC = "printf('%016d:%010d:%s', {0}pt, {0}c, {0}node)"
G = "record_id, field"


def rep(name: str, source: str) -> str:
    """A CTE with a row for each replica that holds the event."""
    return f"{name} AS (SELECT 'A' AS replica_id, * FROM {source} WHERE event_id % 2 = 0 UNION ALL SELECT 'B', * FROM {source} WHERE event_id % 3 = 0 UNION ALL SELECT 'C', * FROM {source})"


ENTRIES = f"""WITH {EV}, e0 AS (SELECT *, author AS recorded_by, CAST(NULL AS VARCHAR) AS supersedes FROM ev WHERE field IN ('m_a', 'm_b')), {rep('entries', 'e0')}"""
LINKED = f"""WITH {EV}, e1 AS (SELECT *, author AS recorded_by, {ENC.format('')} AS id FROM ev WHERE field IN ('m_a', 'm_b')),
e0 AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN lag(id) OVER w WHEN event_id % 11 = 5 THEN lag(id, 2) OVER w END AS supersedes FROM e1 WINDOW w AS (PARTITION BY {G} ORDER BY pt, c, node)), {rep('entries', 'e0')}"""
MERGED = f"""merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {G}, taken_at, recorded_by, value ORDER BY pt, c, node, supersedes NULLS FIRST) AS rn FROM entries) WHERE rn = 1)"""
REGISTERS = f"""WITH {EV}, o0 AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN '0null' ELSE '2int' END AS vtag,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE (CASE WHEN value < 0 THEN '-' ELSE '+' END) || lpad(CAST(abs(value) AS VARCHAR), 20, '0') END AS vtext FROM ev WHERE field = 'd_a'),
{rep('r0', 'o0')}, obs AS (SELECT DISTINCT record_id, field, vtag, vtext, author, pt, c, node FROM r0)"""
ORSET = f"""WITH {EV}, s0 AS (SELECT *, 't' || (user_id % 7) AS element FROM ev WHERE field = 'set_a'),
s1 AS (SELECT *, max(CASE WHEN event_id % 4 <> 0 THEN {H.format('')} END) OVER (PARTITION BY {G}, element ORDER BY pt, c, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s0),
{rep('s2', 's1')}, adds AS (SELECT DISTINCT {G}, element, pt, c, node FROM s2 WHERE event_id % 4 <> 0),
removes AS (SELECT DISTINCT {G}, seen.pt AS pt, seen.c AS c, seen.node AS node FROM s2 WHERE event_id % 4 = 0 AND seen IS NOT NULL),
live AS (SELECT * FROM adds a WHERE NOT EXISTS (SELECT 1 FROM removes r WHERE r.record_id = a.record_id AND r.field = a.field AND r.pt = a.pt AND r.c = a.c AND r.node = a.node))"""


def positions_sql(names: tuple[str, ...], record: str = "record_id") -> str:
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"""WITH {EV}, p0 AS (SELECT event_id, {record} AS record_id, field, CASE event_id % {len(names)} {cases} END AS value FROM ev WHERE field = 'st_a'), {rep('positions', 'p0')}"""


def masks_sql(order, value: str = "value") -> str:
    return "CASE " + value + " " + " ".join(f"WHEN '{v}' THEN {m}" for v, m in order.masks.items()) + " END"


def unmask_sql(order, masked: str) -> str:
    return f"CASE {masked} " + " ".join(f"WHEN {m} THEN '{v}'" for v, m in order.masks.items()) + " END"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _evidence(signals: DataFrame) -> DataFrame:
    return signals.select("record_id", "field", "code", F.array_join("evidence", "|").alias("evidence"))


# --- clocks


@query("hlc_encode", f"WITH {EV} SELECT event_id, {ENC.format('')} AS encoded FROM ev")
def hlc_encode(spark, d):
    return A.events(spark, d).select("event_id", hlc.encode().alias("encoded"))


@query("hlc_decode", f"WITH {EV} SELECT event_id, pt, c, 'x:' || node AS node FROM ev")
def hlc_decode(spark, d):
    rows = A.events(spark, d).withColumn("node", F.concat(F.lit("x:"), "node"))
    return rows.select("event_id", hlc.decode(hlc.encode()).alias("h")).select("event_id", "h.*")


@query("hlc_order", f"WITH {EV} SELECT event_id, record_id, row_number() OVER (PARTITION BY {G} ORDER BY pt, c, node) AS position FROM ev")
def hlc_order(spark, d):
    return A.events(spark, d).select("event_id", "record_id", F.row_number().over(W.partitionBy(*GROUP).orderBy(hlc.stamp())).cast("bigint").alias("position"))


@query(
    "hlc_send_replay",
    f"""WITH {EV}, p AS (SELECT event_id, node, pt - (event_id % 3) * 86400000 AS phys FROM ev),
    a AS (SELECT *, max(greatest(0, phys)) OVER (PARTITION BY node ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS pt FROM p),
    b AS (SELECT *, row_number() OVER (PARTITION BY node, pt ORDER BY event_id) - 1 AS k FROM a)
    SELECT event_id, node, pt, k + CASE WHEN pt = 0 THEN 1 ELSE 0 END AS c FROM b""",
)
def hlc_send_replay(spark, d):
    rows = A.events(spark, d).select("event_id", "node", (F.col("pt") - F.col("event_id") % 3 * 86_400_000).alias("phys"))
    return hlc.replay(rows, "event_id").select("event_id", "node", "pt", "c")


@query(
    "hlc_receive_replay",
    f"""WITH {EV}, p AS (SELECT event_id, node, pt - (event_id % 3) * 86400000 AS phys,
      CASE WHEN event_id % 2 = 0 THEN lag(pt) OVER w END AS rpt, CASE WHEN event_id % 2 = 0 THEN lag(c) OVER w END AS rc FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    a AS (SELECT *, max(greatest(0, phys, rpt)) OVER (PARTITION BY node ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS pt FROM p),
    b AS (SELECT *, row_number() OVER (PARTITION BY node, pt ORDER BY event_id) - 1 AS k FROM a)
    SELECT event_id, node, pt, k + max(greatest(CASE WHEN pt = 0 THEN 1 ELSE 0 END, CASE WHEN rpt = pt THEN rc + 1 - k END)) OVER (PARTITION BY node, pt ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS c FROM b""",
)
def hlc_receive_replay(spark, d):
    order = W.partitionBy("user_id").orderBy("event_id")
    even = F.col("event_id") % 2 == 0
    rows = A.events(spark, d).select("event_id", "node", (F.col("pt") - F.col("event_id") % 3 * 86_400_000).alias("phys"), F.when(even, F.lag("pt").over(order)).alias("rpt"), F.when(even, F.lag("c").over(order)).alias("rc"))
    return hlc.replay(rows, "event_id", remote_pt="rpt", remote_c="rc").select("event_id", "node", "pt", "c")


@query("device_clock", "SELECT event_id, greatest(0, (epoch_us(ts) // 1000) % 864000000 + event_id % 7 * 3600000 - 7200000 + CAST(trunc(1500.0 * (((epoch_us(ts) // 1000) % 864000000) / 86400000.0)) AS BIGINT) + CASE WHEN (epoch_us(ts) // 1000) % 864000000 >= 432000000 THEN -172800000 ELSE 0 END) AS shown FROM events")
def device_clock(spark, d):
    now = F.col("pt") % 864_000_000
    jumps = F.array(F.struct(F.lit(432_000_000).cast("bigint").alias("at"), F.lit(-172_800_000).cast("bigint").alias("delta")))
    return A.events(spark, d).select("event_id", hlc.device_clock(now, F.col("event_id") % 7 * 3_600_000 - 7_200_000, F.lit(1500.0), jumps).alias("shown"))


# --- merges


@query("gset_merge", f"WITH {EV}, g0 AS (SELECT event_id, record_id, 'g_a' AS field, 'g' || (event_id % 50) AS element FROM ev), {rep('g1', 'g0')} SELECT DISTINCT record_id, field, element FROM g1")
def gset_merge(spark, d):
    return merge.gset(A.elements(spark, d))


@query("register_merge", f"{REGISTERS} SELECT * FROM obs")
def register_merge(spark, d):
    return merge.register(A.observations(spark, d))


@query("series_merge", f"{ENTRIES}, {MERGED} SELECT {G}, value, taken_at, recorded_by, pt, c, node FROM merged")
def series_merge(spark, d):
    return merge.series_of(BENCH, A.entries(spark, d)).drop("supersedes")


@query(
    "series_merge_lineitem",
    """SELECT record_id, field, pt, c, node, value, taken_at, recorded_by FROM (SELECT *, row_number() OVER (PARTITION BY record_id, field ORDER BY pt, c, node, value, taken_at, recorded_by) AS rn FROM
    (SELECT CAST(l_orderkey AS VARCHAR) AS record_id, CAST(l_linenumber AS VARCHAR) AS field, CAST(floor(l_extendedprice) AS BIGINT) AS value, l_returnflag AS taken_at, l_linestatus AS recorded_by, epoch_us(l_shipdate) // 1000 AS pt, l_partkey AS c, CAST(l_suppkey AS VARCHAR) AS node FROM lineitem)) WHERE rn = 1""",
)
def series_merge_lineitem(spark, d):
    return merge.series(A.lineitem_entries(spark, d), ()).drop("supersedes")


@query("orset_adds_merge", f"{ORSET} SELECT * FROM adds")
def orset_adds_merge(spark, d):
    return merge.orset_adds(A.orset(spark, d)[0])


@query("orset_removes_merge", f"{ORSET} SELECT * FROM removes")
def orset_removes_merge(spark, d):
    return merge.orset_removes(A.orset(spark, d)[1])


@query("status_total", f"{positions_sql(('s0', 's1', 's2', 's3'), record=chr(39) + 'u' + chr(39) + ' || user_id')} SELECT {G}, max(value) AS value FROM positions GROUP BY ALL")
def status_total(spark, d):
    return merge.status(A.positions(spark, d, by_user=True), TOTAL_ORDER)


@query("status_by_rank", f"{positions_sql(('s0', 's1', 's2', 's3'), record=chr(39) + 'u' + chr(39) + ' || user_id')} SELECT {G}, max(value) AS value FROM positions GROUP BY ALL")
def status_by_rank(spark, d):
    return merge.status_by_rank(A.positions(spark, d, by_user=True), TOTAL_ORDER)


PARTIAL = positions_sql(("bot", "l", "r"), record="'u' || user_id")


@query("status_partial", f"{PARTIAL} SELECT {G}, {unmask_sql(DIAMOND, f'bit_and({masks_sql(DIAMOND)})')} AS value FROM positions GROUP BY {G}")
def status_partial(spark, d):
    return merge.status(A.positions(spark, d, ("bot", "l", "r"), by_user=True), DIAMOND)


@query("status_by_table", f"{PARTIAL} SELECT {G}, {unmask_sql(DIAMOND, f'bit_and({masks_sql(DIAMOND)})')} AS value FROM positions GROUP BY {G}")
def status_by_table(spark, d):
    return merge.status_by_table(A.positions(spark, d, ("bot", "l", "r"), by_user=True), DIAMOND)


@query("status_incomparable", f"{PARTIAL} SELECT DISTINCT a.record_id, a.field, a.value AS a, b.value AS b FROM positions a JOIN positions b ON a.record_id = b.record_id AND a.field = b.field AND a.value = 'l' AND b.value = 'r'")
def status_incomparable(spark, d):
    return merge.incomparable_pairs(A.positions(spark, d, ("bot", "l", "r"), by_user=True), DIAMOND)


@query("status_identity", f"{positions_sql(('s0', 's1', 's2', 's3'))}, spine AS (SELECT DISTINCT 'r' || (user_id % 13) AS record_id FROM events) SELECT s.record_id, 'st_a' AS field, coalesce(max(p.value), 's0') AS value FROM spine s LEFT JOIN positions p ON p.record_id = s.record_id GROUP BY s.record_id")
def status_identity(spark, d):
    spine = A.table(spark, d, "events").select(F.concat(F.lit("r"), F.col("user_id") % 13).alias("record_id"))
    return merge.with_identity(merge.status(A.positions(spark, d), TOTAL_ORDER), spine, TOTAL_ORDER, "st_a")


@query(
    "record_merge",
    f"""{ENTRIES}, {MERGED}, {ORSET.split('WITH ' + EV + ',', 1)[1]}, {REGISTERS.split('WITH ' + EV + ',', 1)[1]}, {positions_sql(('s0', 's1', 's2', 's3')).split('WITH ' + EV + ',', 1)[1]}
    SELECT {G}, 'entries' AS kind, concat_ws('|', value, taken_at, recorded_by, pt, c, node) AS atom FROM merged UNION ALL SELECT {G}, 'adds', concat_ws('|', element, pt, c, node) FROM adds UNION ALL SELECT {G}, 'removes', concat_ws('|', pt, c, node) FROM removes
    UNION ALL SELECT {G}, 'observations', concat_ws('|', vtag, vtext, author, pt, c, node) FROM obs UNION ALL SELECT {G}, 'positions', max(value) FROM positions GROUP BY {G}""",
)
def record_merge(spark, d):
    """Whole records of three replicas merged, every atom a row."""
    adds, removes = A.orset(spark, d)
    kinds = {"entries": A.entries(spark, d), "adds": adds, "removes": removes, "observations": A.observations(spark, d), "positions": A.positions(spark, d)}
    states = [(BENCH, {kind: rows.where(F.col("replica_id") == r) for kind, rows in kinds.items()}) for r in ("A", "B", "C")]
    return merge.atoms_of(merge.records(*states)).select(*GROUP, "kind", "atom")


QUARTERS = " || '-' || ".join(f"CAST(sum(('0x' || substr(md5(t), {8 * i + 1}, 8))::BIGINT) AS VARCHAR)" for i in range(4))


@query("canonical_fingerprint", f"{ENTRIES}, {MERGED}, t AS (SELECT DISTINCT {G}, concat_ws('|', value, taken_at, recorded_by, pt, c, node) AS t FROM merged) SELECT {G}, {QUARTERS} AS fingerprint, count(*) AS n_atoms FROM t GROUP BY {G}")
def canonical_fingerprint(spark, d):
    return views.canonical(merge.series_of(BENCH, A.entries(spark, d)), ["value", "taken_at", "recorded_by", *STAMP])


@query("absorbed_atoms", f"{REGISTERS} SELECT DISTINCT record_id, field, vtag, vtext, author, pt, c, node FROM r0 n WHERE replica_id = 'C' AND NOT EXISTS (SELECT 1 FROM r0 s WHERE s.replica_id = 'A' AND s.record_id = n.record_id AND s.pt = n.pt AND s.c = n.c AND s.node = n.node AND s.vtext = n.vtext AND s.vtag = n.vtag AND s.author = n.author)")
def absorbed_atoms(spark, d):
    rows = A.observations(spark, d)
    own = merge.register(rows.where("replica_id = 'A'"))
    return merge.absorbed(merge.register(rows.where("replica_id = 'C'")), own, merge.REGISTER)


@query("customer_merge", "WITH a AS (SELECT c_custkey, c_mktsegment AS v, 'office' AS author, 1000 AS pt, 'hq' AS node FROM customer UNION ALL SELECT c_custkey, 'MOVED_' || c_mktsegment, 'field', 999 + c_custkey % 3, 'tablet' FROM customer WHERE c_custkey % 10 = 0) SELECT CAST(c_custkey AS VARCHAR) AS record_id, arg_max(v, {'pt': pt, 'c': 0, 'node': node}) AS segment, count(*) - 1 AS n_losers, count(DISTINCT author) > 1 AS contested FROM a GROUP BY c_custkey")
def customer_merge(spark, d):
    now = views.register_current(merge.register(A.customer_observations(spark, d)))
    return now.select("record_id", F.col("vtext").alias("segment"), "n_losers", "contested")


ORDER_STATUS = ("P", "O", "F")


@query("order_status_merge", "SELECT CAST(o_custkey AS VARCHAR) AS record_id, CASE bit_and(CASE o_orderstatus WHEN 'P' THEN 7 WHEN 'O' THEN 6 WHEN 'F' THEN 4 END) WHEN 7 THEN 'P' WHEN 6 THEN 'O' WHEN 4 THEN 'F' END AS value FROM orders GROUP BY o_custkey")
def order_status_merge(spark, d):
    from ..schema import StatusOrder

    rows = A.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("record_id"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"))
    return merge.status(rows, StatusOrder.total(ORDER_STATUS)).select("record_id", "value")


# --- views

BEST = f"SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY pt DESC, c DESC, node DESC, author DESC, vtag DESC, vtext DESC) AS rn, row_number() OVER (PARTITION BY {G} ORDER BY pt, c, node, author, vtag, vtext) AS position, count(*) OVER (PARTITION BY {G}) - 1 AS n_losers FROM obs"


@query("register_current", f"{REGISTERS}, k AS (SELECT {G}, count(DISTINCT author) > 1 AS contested FROM obs GROUP BY {G}) SELECT b.record_id, b.field, pt, c, node, author, vtag, vtext, n_losers, contested FROM ({BEST}) b JOIN k ON k.record_id = b.record_id AND k.field = b.field WHERE rn = 1")
def register_current(spark, d):
    return views.register_current(merge.register(A.observations(spark, d)))


@query("register_history", f"{REGISTERS} SELECT record_id, field, vtag, vtext, author, pt, c, node, position FROM ({BEST}) WHERE rn > 1")
def register_history(spark, d):
    return views.register_history(merge.register(A.observations(spark, d))).withColumn("position", F.col("position").cast("bigint"))


@query("register_contested", f"{REGISTERS} SELECT {G} FROM obs GROUP BY {G} HAVING count(DISTINCT author) > 1")
def register_contested(spark, d):
    return views.register_contested(merge.register(A.observations(spark, d)))


@query("register_clear_wins", f"{REGISTERS}, u AS (SELECT 'u' || pt % 97 AS record_id, field, vtag, vtext, author, pt, c, node FROM obs), b AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pt DESC, c DESC, node DESC, author DESC, vtag DESC, vtext DESC) AS rn FROM u) SELECT record_id, field, pt, c, node FROM b WHERE rn = 1 AND vtag = '0null'")
def register_clear_wins(spark, d):
    rows = merge.register(A.observations(spark, d)).withColumn("record_id", F.concat(F.lit("u"), F.col("pt") % 97))
    return views.register_current(rows).where(F.col("vtag") == scalars.NULL).select(*GROUP, *STAMP)


@query("series_current", f"{LINKED}, {MERGED} SELECT {G}, value, taken_at, recorded_by, pt, c, node, supersedes FROM merged m WHERE NOT EXISTS (SELECT 1 FROM merged s WHERE s.record_id = m.record_id AND s.field = m.field AND s.supersedes = {ENC.format('m.')})")
def series_current(spark, d):
    return views.series_current(merge.series_of(BENCH, A.entries(spark, d, links=True)))


@query("supersede_forks", f"{LINKED}, {MERGED} SELECT {G}, supersedes, count(*) AS n FROM merged WHERE supersedes IS NOT NULL GROUP BY {G}, supersedes HAVING count(*) > 1")
def supersede_forks(spark, d):
    return views.supersede_forks(merge.series_of(BENCH, A.entries(spark, d, links=True)))


@query("dangling_supersedes", f"{LINKED}, {MERGED} SELECT {G}, value, taken_at, recorded_by, pt, c, node, supersedes FROM merged m WHERE supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM merged s WHERE s.record_id = m.record_id AND s.field = m.field AND {ENC.format('s.')} = m.supersedes)")
def dangling_supersedes(spark, d):
    return views.dangling_supersedes(merge.series_of(BENCH, A.entries(spark, d, links=True)))


@query("series_positions", f"{ENTRIES}, {MERGED} SELECT {G}, pt, c, node, row_number() OVER (PARTITION BY {G} ORDER BY pt, c, node) AS position FROM merged")
def series_positions(spark, d):
    return views.series_positions(merge.series_of(BENCH, A.entries(spark, d))).select(*GROUP, *STAMP, F.col("position").cast("bigint").alias("position"))


@query("orset_members", f"{ORSET} SELECT {G}, element, count(*) AS n_tags FROM live GROUP BY {G}, element")
def orset_members(spark, d):
    return views.orset_members(merge.orset_adds(A.orset(spark, d)[0]), merge.orset_removes(A.orset(spark, d)[1]))


@query("orset_readd", f"{ORSET} SELECT DISTINCT l.record_id, l.field, l.element FROM live l JOIN adds a ON a.record_id = l.record_id AND a.field = l.field AND a.element = l.element JOIN removes r ON r.record_id = a.record_id AND r.field = a.field AND r.pt = a.pt AND r.c = a.c AND r.node = a.node")
def orset_readd(spark, d):
    adds, removes = A.orset(spark, d)
    adds, removes = merge.orset_adds(adds), merge.orset_removes(removes)
    removed = adds.join(removes, [*GROUP, *STAMP], "left_semi").select(*GROUP, "element").distinct()
    return views.orset_members(adds, removes).join(removed, [*GROUP, "element"], "left_semi").select(*GROUP, "element")


@query("orset_observed", f"""{ORSET.split(', s1 AS')[0] if ', s1 AS' in ORSET else ORSET.split('s1 AS')[0].rstrip().rstrip(',')}, a AS (SELECT {G}, element, pt, c, node, event_id FROM s0 WHERE event_id % 4 <> 0), q AS (SELECT {G}, element, event_id FROM s0 WHERE event_id % 4 = 0)
SELECT DISTINCT a.record_id, a.field, a.pt, a.c, a.node FROM a JOIN q ON a.record_id = q.record_id AND a.field = q.field AND a.element = q.element AND a.event_id < q.event_id""")
def orset_observed(spark, d):
    rows = A.events(spark, d).where("field = 'set_a'").withColumn("element", F.concat(F.lit("t"), F.col("user_id") % 7)).withColumn("replica_id", F.lit("A")).withColumn("seq", F.col("event_id"))
    return views.orset_observed(rows.where("event_id % 4 <> 0"), rows.where("event_id % 4 = 0"))


# --- deltas

SEEN_B = "seen AS (SELECT DISTINCT pt, c, node FROM ev WHERE event_id % 3 = 0)"


@query("delta_series", f"{ENTRIES}, {SEEN_B}, {MERGED.replace('FROM entries)', 'FROM entries WHERE replica_id <> ' + chr(39) + 'B' + chr(39) + ')')} SELECT {G}, value, taken_at, recorded_by, pt, c, node FROM merged m WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.pt = m.pt AND s.c = m.c AND s.node = m.node)")
def delta_series(spark, d):
    state = merge.series_of(BENCH, A.entries(spark, d).where("replica_id <> 'B'"))
    return delta.delta_since("MeasurementSeries", state, A.events(spark, d).where("event_id % 3 = 0")).drop("supersedes")


@query("delta_register", f"{REGISTERS}, {SEEN_B} SELECT * FROM obs m WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.pt = m.pt AND s.c = m.c AND s.node = m.node)")
def delta_register(spark, d):
    return delta.delta_since("LWWRegister", merge.register(A.observations(spark, d)), A.events(spark, d).where("event_id % 3 = 0"))


@query("delta_full_law", f"{ENTRIES}, {MERGED.replace('FROM entries)', 'FROM entries WHERE replica_id <> ' + chr(39) + 'C' + chr(39) + ')')} SELECT {G}, value, taken_at, recorded_by, pt, c, node FROM merged")
def delta_full_law(spark, d):
    """The peer joined with its delta; the SQL joins it with the whole state."""
    rows = A.entries(spark, d)
    peer, state = merge.series_of(BENCH, rows.where("replica_id = 'B'")), merge.series_of(BENCH, rows.where("replica_id = 'A'"))
    seen = delta.frontier_of(rows.where("replica_id = 'B'"))
    return delta.apply_delta({"entries": peer}, delta.record_delta({"entries": state}, seen), DEDUP_COLUMNS)["entries"].drop("supersedes")


@query("seen_frontier", f"WITH {EV} SELECT DISTINCT pt, c, node FROM ev WHERE (event_id % 2 = 0 OR event_id % 3 = 0) AND field IN ('m_a', 'm_b', 'd_a')")
def seen_frontier(spark, d):
    return delta.frontier_of(A.entries(spark, d).where("replica_id <> 'C'"), A.observations(spark, d).where("replica_id <> 'C'"))


@query("wire_size", "SELECT sum(octet_length(encode('{\"c\":' || (event_id % 1000) || ',\"node\":\"dev_' || (event_id % 5) || '\",\"pt\":' || (epoch_us(ts) // 1000) || '}'))) AS bytes, count(*) AS n_rows FROM events")
def wire_size(spark, d):
    return delta.wire_size(A.events(spark, d).select(*STAMP))


# --- version vectors

VV = f"WITH {EV}, {rep('rep', 'ev')}, best AS (SELECT replica_id, node, max({{'pt': pt, 'c': c}}) AS h FROM rep GROUP BY replica_id, node), vv AS (SELECT replica_id, node, h.pt AS pt, h.c AS c, h FROM best)"
PAIRS = f"{VV}, ids AS (SELECT DISTINCT replica_id FROM vv), dom AS (SELECT a.replica_id AS mine, b.replica_id AS theirs, (SELECT bool_and(coalesce(m.h >= t.h, false)) FROM vv t LEFT JOIN vv m ON m.node = t.node AND m.replica_id = a.replica_id WHERE t.replica_id = b.replica_id) AS dominates FROM ids a JOIN ids b ON a.replica_id <> b.replica_id)"


def _vv(spark, d):
    return vectors.build(A.replicated(A.events(spark, d)))


@query("vv_build", f"{VV} SELECT replica_id, node, pt, c FROM vv")
def vv_build(spark, d):
    return _vv(spark, d)


@query("vv_join", f"{VV}, j AS (SELECT node, max(h) AS h FROM vv WHERE replica_id IN ('A', 'B') GROUP BY node) SELECT node, h.pt AS pt, h.c AS c FROM j")
def vv_join(spark, d):
    v = _vv(spark, d)
    return vectors.join(v.where("replica_id = 'A'"), v.where("replica_id = 'B'"))


@query("vv_join_maps", f"{VV}, j AS (SELECT node, max(h) AS h FROM vv WHERE replica_id IN ('A', 'B') GROUP BY node) SELECT node, h.pt AS pt, h.c AS c FROM j")
def vv_join_maps(spark, d):
    wire = vectors.to_map(_vv(spark, d).where("replica_id IN ('A', 'B')"))
    both = wire.where("replica_id = 'A'").selectExpr("vector AS a").join(wire.where("replica_id = 'B'").selectExpr("vector AS b"))
    return both.select(F.explode(vectors.join_maps(F.col("a"), F.col("b"))).alias("node", "h")).select("node", "h.pt", "h.c")


@query("vv_dominates", f"{PAIRS} SELECT d.mine, d.theirs, d.dominates, e.dominates AS dominated FROM dom d JOIN dom e ON d.mine = e.theirs AND d.theirs = e.mine")
def vv_dominates(spark, d):
    return vectors.compare(_vv(spark, d)).drop("concurrent")


@query("vv_concurrent", f"{PAIRS} SELECT d.mine, d.theirs FROM dom d JOIN dom e ON d.mine = e.theirs AND d.theirs = e.mine WHERE NOT d.dominates AND NOT e.dominates")
def vv_concurrent(spark, d):
    return vectors.compare(_vv(spark, d)).where("concurrent").select("mine", "theirs")


@query("vv_missing", f"{VV} SELECT t.node, m.pt, m.c FROM vv t LEFT JOIN vv m ON m.node = t.node AND m.replica_id = 'A' WHERE t.replica_id = 'C' AND (m.h IS NULL OR m.h < t.h)")
def vv_missing(spark, d):
    v = _vv(spark, d)
    return vectors.missing_from(v.where("replica_id = 'A'"), v.where("replica_id = 'C'"))


@query("vv_has_seen", f"{VV} SELECT e.event_id, coalesce({{'pt': e.pt, 'c': e.c}} <= v.h, false) AS covered FROM ev e LEFT JOIN vv v ON v.replica_id = 'B' AND v.node = e.node")
def vv_has_seen(spark, d):
    stamps = A.events(spark, d).select("event_id", F.lit("B").alias("replica_id"), *STAMP)
    return vectors.has_seen(_vv(spark, d), stamps).select("event_id", "covered")


NUMBERED = f"WITH {EV}, n AS (SELECT DISTINCT node, event_id // 5 + 1 AS seq FROM ev WHERE event_id % 97 <> 50)"


@query("frontier_contiguous", f"{NUMBERED}, r AS (SELECT *, seq - row_number() OVER (PARTITION BY node ORDER BY seq) AS island FROM n) SELECT node, coalesce(max(CASE WHEN island = 0 THEN seq END), 0) AS watermark, max(seq) AS highest FROM r GROUP BY node")
def frontier_contiguous(spark, d):
    return vectors.contiguous(A.events(spark, d).where("event_id % 97 <> 50").select("node", (F.floor(F.col("event_id") / 5) + 1).alias("seq")), ["node"])


@query("sequence_gaps", f"{NUMBERED}, r AS (SELECT *, coalesce(lag(seq) OVER (PARTITION BY node ORDER BY seq), 0) AS p FROM n) SELECT node, p + 1 AS first, seq - 1 AS last FROM r WHERE seq > p + 1")
def sequence_gaps(spark, d):
    return vectors.gaps(A.events(spark, d).where("event_id % 97 <> 50").select("node", (F.floor(F.col("event_id") / 5) + 1).alias("seq")), ["node"])


# --- review signals

CURRENT = f"cur AS (SELECT * FROM merged m WHERE NOT EXISTS (SELECT 1 FROM merged s WHERE s.record_id = m.record_id AND s.field = m.field AND s.supersedes = {ENC.format('m.')}))"
SAME_DAY = f"SELECT DISTINCT {G}, 'multiple_weights_same_day' AS code, '' AS evidence FROM (SELECT {G}, taken_at FROM cur GROUP BY {G}, taken_at HAVING count(*) > 1)"
FORK = f"SELECT {G}, 'superseded_fork' AS code, string_agg(supersedes, '|' ORDER BY supersedes) AS evidence FROM (SELECT {G}, supersedes FROM merged WHERE supersedes IS NOT NULL GROUP BY {G}, supersedes HAVING count(*) > 1) GROUP BY {G}"
SHOWN = "author || '=' || CASE vtag WHEN '0null' THEN 'null' ELSE CAST(CAST(vtext AS BIGINT) AS VARCHAR) END"
CONTESTED = f"SELECT {G}, 'concurrent_demographic_edit' AS code, string_agg({SHOWN}, '|' ORDER BY {SHOWN}) AS evidence FROM obs GROUP BY {G} HAVING count(DISTINCT author) > 1"


@query("signal_same_day", f"{LINKED}, {MERGED}, {CURRENT} {SAME_DAY}")
def signal_same_day(spark, d):
    return _evidence(review.same_day(merge.series_of(BENCH, A.entries(spark, d, links=True))))


@query("signal_fork", f"{LINKED}, {MERGED} {FORK}")
def signal_fork(spark, d):
    return _evidence(review.superseded_fork(merge.series_of(BENCH, A.entries(spark, d, links=True))))


@query("signal_contested", f"{REGISTERS} {CONTESTED}")
def signal_contested(spark, d):
    return _evidence(review.contested(merge.register(A.observations(spark, d)), REGISTER_SCHEMA))


@query("signal_status", f"{PARTIAL} SELECT {G}, 'concurrent_status_transition' AS code, 'l|r' AS evidence FROM positions GROUP BY {G} HAVING bool_or(value = 'l') AND bool_or(value = 'r')")
def signal_status(spark, d):
    return _evidence(review.status_transition(A.positions(spark, d, ("bot", "l", "r"), by_user=True), DIAMOND_SCHEMA))


@query("signal_terminal", f"{positions_sql(('s0', 's1', 's2', 's3'), record=chr(39) + 'u' + chr(39) + ' || user_id')} SELECT {G}, 'reenrolment_after_graduation' AS code, string_agg(DISTINCT value, '|' ORDER BY value) FILTER (WHERE value <> 's3') AS evidence FROM positions GROUP BY {G} HAVING bool_or(value = 's3') AND count(DISTINCT value) > 1")
def signal_terminal(spark, d):
    return _evidence(review.left_terminal(A.positions(spark, d, by_user=True), BENCH))


@query("signal_implausible", f"WITH {EV}, p AS (SELECT {G}, pt - (event_id % 4) * 86400000 AS pt, taken_at FROM ev WHERE field IN ('m_a', 'm_b')) SELECT {G}, 'implausible_taken_at' AS code, string_agg(DISTINCT taken_at, '|' ORDER BY taken_at) AS evidence FROM p WHERE epoch_ms(CAST(taken_at AS TIMESTAMP)) - pt > 129600000 GROUP BY {G}")
def signal_implausible(spark, d):
    rows = A.events(spark, d).where("field IN ('m_a', 'm_b')").withColumn("pt", F.col("pt") - F.col("event_id") % 4 * 86_400_000)
    return _evidence(review.implausible(rows, 129_600_000))


@query("signal_duplicates", "SELECT min('c' || c_custkey) AS record_id, '' AS field, 'duplicate_candidate' AS code, string_agg('c' || c_custkey, '|' ORDER BY 'c' || c_custkey) AS evidence FROM customer GROUP BY c_nationkey, CAST(floor(c_acctbal / 100) AS BIGINT), c_mktsegment HAVING count(*) > 1")
def signal_duplicates(spark, d):
    key = F.concat_ws("|", "c_nationkey", F.floor(F.col("c_acctbal") / 100), "c_mktsegment")
    return _evidence(review.duplicate_candidate(A.table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("record_id"), key.alias("match_key"))))


@query("signal_stale", f"WITH {EV}, m AS (SELECT 'u' || user_id AS record_id, max(pt) AS pt FROM ev GROUP BY user_id), n AS (SELECT max(pt) AS now FROM ev) SELECT record_id, '' AS field, 'stale_replica_beyond_retention' AS code, CAST(pt AS VARCHAR) AS evidence FROM m, n WHERE pt < now - 43200000")
def signal_stale(spark, d):
    rows = A.events(spark, d)
    now = rows.agg(F.max("pt")).first()[0]
    return _evidence(review.stale_replica(rows.select(F.concat(F.lit("u"), "user_id").alias("replica_id"), "pt"), now, 43_200_000))


@query(
    "signal_regressed",
    f"""WITH {EV}, was AS (SELECT 'R' || user_id % 50 AS replica_id, node, max({{'pt': pt, 'c': c}}) AS r FROM ev GROUP BY ALL),
    cut AS (SELECT * FROM ev WHERE NOT (user_id % 50 < 10 AND event_id % 3 = 0) AND NOT (user_id % 50 = 11 AND node = 'dev_1')), now AS (SELECT 'R' || user_id % 50 AS replica_id, node, max({{'pt': pt + CASE WHEN user_id % 50 = 3 THEN 1000000000 ELSE 0 END, 'c': c}}) AS h FROM cut GROUP BY ALL),
    b AS (SELECT coalesce(n.replica_id, w.replica_id) AS replica_id, coalesce(n.node, w.node) AS node, h, r FROM now n FULL JOIN was w ON n.replica_id = w.replica_id AND n.node = w.node)
    SELECT replica_id AS record_id, '' AS field, 'replica_state_regressed' AS code, string_agg(node, '|' ORDER BY node) FILTER (WHERE r IS NOT NULL AND (h IS NULL OR h < r)) AS evidence FROM b GROUP BY replica_id
    HAVING bool_and(coalesce(h <= r, h IS NULL)) AND bool_or(r IS NOT NULL AND (h IS NULL OR h < r))""",
)
def signal_regressed(spark, d):
    slot = F.col("user_id") % 50
    rows = A.events(spark, d).withColumn("replica_id", F.concat(F.lit("R"), slot))
    cut = rows.where(~((slot < 10) & (F.col("event_id") % 3 == 0)) & ~((slot == 11) & (F.col("node") == "dev_1")))
    now = vectors.build(cut.withColumn("pt", F.col("pt") + F.when(slot == 3, 1_000_000_000).otherwise(0)))
    return _evidence(review.state_regressed(now, vectors.build(rows)))


@query("signal_device", "SELECT 'dev_' || user_id % 40 AS record_id, '' AS field, 'duplicate_device_id' AS code, string_agg(DISTINCT 'k' || user_id, '|' ORDER BY 'k' || user_id) AS evidence FROM events WHERE event_type <> 'error' GROUP BY user_id % 40 HAVING count(DISTINCT user_id) > 1")
def signal_device(spark, d):
    rows = A.table(spark, d, "events").select(F.concat(F.lit("dev_"), F.col("user_id") % 40).alias("device_id"), F.concat(F.lit("k"), "user_id").alias("device_key"), (F.col("event_type") != "error").alias("live"))
    return _evidence(review.duplicate_device(rows))


@query("signal_delete_update", f"WITH {EV}, t AS (SELECT DISTINCT record_id, 'del_' || record_id AS delete_id, 10 * CAST(substr(record_id, 2) AS BIGINT) AS cut FROM ev WHERE event_id % 10 = 3) SELECT t.record_id, '' AS field, 'delete_update_conflict' AS code, string_agg({ENC.format('e.')}, '|' ORDER BY {ENC.format('e.')}) AS evidence FROM t JOIN ev e ON e.record_id = t.record_id WHERE e.field = 'd_a' AND e.event_id % 100 < t.cut GROUP BY t.record_id")
def signal_delete_update(spark, d):
    rows = A.events(spark, d)
    tombs = rows.where("event_id % 10 = 3").select("record_id", F.concat(F.lit("del_"), "record_id").alias("delete_id")).distinct()
    writes = rows.where("field = 'd_a'")
    observed = writes.where("event_id % 100 >= 10 * cast(substr(record_id, 2) AS long)").select(F.concat(F.lit("del_"), "record_id").alias("delete_id"), *STAMP)
    return _evidence(review.delete_update(tombs, writes, observed))


@query("signal_detect", f"{LINKED}, {MERGED}, {CURRENT}, {REGISTERS.split('WITH ' + EV + ',', 1)[1]} {SAME_DAY} UNION ALL {FORK} UNION ALL {CONTESTED}")
def signal_detect(spark, d):
    found = review.detect(BENCH, merge.series_of(BENCH, A.entries(spark, d, links=True)), merge.register(A.observations(spark, d)), A.positions(spark, d))
    return _evidence(found)


@query("signal_volume_per_100", f"{LINKED}, {MERGED}, {CURRENT}, s AS ({SAME_DAY} UNION ALL {FORK}), n AS (SELECT count(DISTINCT record_id) AS n_records FROM ev) SELECT code, count(*) AS n_signals, any_value(n_records) AS n_records, CAST(floor(count(*) * 100 / any_value(n_records)) AS BIGINT) AS per_100 FROM s, n GROUP BY ROLLUP (code)")
def signal_volume(spark, d):
    series = merge.series_of(BENCH, A.entries(spark, d, links=True))
    return review.volume(review.same_day(series).unionByName(review.superseded_fork(series)), A.events(spark, d))


@query("signal_unresolved", f"{LINKED}, {MERGED}, {CURRENT} SELECT * FROM ({SAME_DAY}) WHERE record_id NOT IN ('r1', 'r2')")
def signal_unresolved(spark, d):
    found = review.same_day(merge.series_of(BENCH, A.entries(spark, d, links=True)))
    return _evidence(review.without_resolved(found, found.where("record_id IN ('r1', 'r2')")))


# --- audits

LOG = f"WITH {EV}, log AS (SELECT 'R' || (event_id % 5) AS replica_id, record_id, field, event_id AS log_seq, value, taken_at, author AS recorded_by, pt, c, node, event_id, user_id FROM ev)"
KEY = "record_id, field, taken_at, recorded_by, value"
LOST = f"{LOG}, crash AS (SELECT * FROM log WHERE event_id % 50 = 7), want AS (SELECT DISTINCT {KEY} FROM log WHERE field = 'm_a' AND event_id % 50 <> 7), live AS (SELECT 'A' AS replica_id UNION ALL SELECT 'C'), {rep('have', 'log').replace('SELECT ' + chr(39) + 'A' + chr(39) + ' AS replica_id, *', 'SELECT ' + chr(39) + 'A' + chr(39) + ' AS replica, *')}"


def _log(spark, d):
    return A.oplog(spark, d)


def _live(spark):
    return spark.createDataFrame([("A",), ("C",)], "replica_id string")


@query("audit_lost", f"{LOST} SELECT 'no_measurement_lost' AS invariant, w.record_id, w.field, l.replica_id, concat_ws('|', w.taken_at, w.recorded_by, w.value) AS detail FROM want w, live l WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.replica = l.replica_id AND h.record_id = w.record_id AND h.field = w.field AND h.taken_at = w.taken_at AND h.recorded_by = w.recorded_by AND h.value = w.value)")
def audit_lost(spark, d):
    log = _log(spark, d).where("field = 'm_a'")
    present = A.replicated(log.drop("replica_id"))
    return audit.no_measurement_lost(log, log.where("event_id % 50 = 7"), present, _live(spark), DEDUP_COLUMNS)


@query("audit_phantom", f"{LOG}, w AS (SELECT DISTINCT {KEY} FROM log WHERE field = 'm_a'), p AS (SELECT 'A' AS replica_id, record_id, field, taken_at, recorded_by, value + CASE WHEN event_id % 40 = 0 THEN 1000 ELSE 0 END AS value FROM log WHERE field = 'm_a') SELECT DISTINCT 'no_phantom_measurements' AS invariant, record_id, field, replica_id, 'invented ' || concat_ws('|', taken_at, recorded_by, value) AS detail FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.record_id = p.record_id AND w.field = p.field AND w.taken_at = p.taken_at AND w.recorded_by = p.recorded_by AND w.value = p.value) UNION ALL SELECT 'no_phantom_measurements', record_id, field, replica_id, count(*) || ' entries of ' || concat_ws('|', taken_at, recorded_by, value) FROM p GROUP BY replica_id, record_id, field, taken_at, recorded_by, value HAVING count(*) > 1")
def audit_phantom(spark, d):
    log = _log(spark, d).where("field = 'm_a'")
    present = log.withColumn("replica_id", F.lit("A")).withColumn("value", F.col("value") + F.when(F.col("event_id") % 40 == 0, 1000).otherwise(0))
    return audit.no_phantom_measurements(log, present, DEDUP_COLUMNS)


@query("audit_resurrected", f"{ORSET} SELECT 'removals_are_honoured' AS invariant, a.record_id, a.field, 'A' AS replica_id, {ENC.format('a.')} AS detail FROM adds a JOIN removes r ON r.record_id = a.record_id AND r.field = a.field AND r.pt = a.pt AND r.c = a.c AND r.node = a.node WHERE a.c % 2 = 0 AND r.c % 7 <> 2")
def audit_resurrected(spark, d):
    adds, removes = A.orset(spark, d)
    kept = merge.orset_adds(adds).where("c % 2 = 0").withColumn("replica_id", F.lit("A"))
    log = removes.select("replica_id", *GROUP, F.col("pt").alias("removed_pt"), F.col("c").alias("removed_c"), F.col("node").alias("removed_node"), *STAMP)
    return audit.removals_are_honoured(log, log.where("c % 7 = 2"), kept)


@query("audit_regressed_hlc", f"{LOG}, m AS (SELECT * REPLACE (pt - CASE WHEN event_id % 50 = 7 THEN 86400000 ELSE 0 END AS pt) FROM log), l AS (SELECT *, lag({{'pt': pt, 'c': c, 'node': node}}) OVER (PARTITION BY replica_id ORDER BY log_seq) AS b FROM m) SELECT 'hlc_causality_respected' AS invariant, record_id, field, replica_id, {ENC.format('')} AS detail FROM l WHERE b IS NOT NULL AND NOT b < {{'pt': pt, 'c': c, 'node': node}}")
def audit_regressed_hlc(spark, d):
    clocks_set_back = F.col("pt") - F.when(F.col("event_id") % 50 == 7, 86_400_000).otherwise(0)
    return audit.hlc_causality_respected(_log(spark, d).withColumn("pt", clocks_set_back))


@query("audit_dup_op", f"{LOG}, z AS (SELECT replica_id, pt - pt % 3600000 AS pt, 0 AS c, node FROM log) SELECT 'no_duplicate_operation_ids' AS invariant, '' AS record_id, '' AS field, replica_id, count(*) || ' x ' || {ENC.format('')} AS detail FROM z GROUP BY replica_id, pt, c, node HAVING count(*) > 1")
def audit_dup_op(spark, d):
    coarse = _log(spark, d).withColumn("pt", F.col("pt") - F.col("pt") % 3_600_000).withColumn("c", F.lit(0).cast("bigint"))
    return audit.no_duplicate_operation_ids(coarse)


OBS_LOST = f"{REGISTERS}, live AS (SELECT 'A' AS replica_id UNION ALL SELECT 'C'), want AS (SELECT DISTINCT {G}, vtag, vtext, author, pt, c, node FROM o0 WHERE event_id % 50 <> 7)"


@query("audit_observation_lost", f"{OBS_LOST} SELECT 'no_observation_lost' AS invariant, w.record_id, w.field, l.replica_id, concat_ws('|', vtag, vtext, author, pt, c, node) AS detail FROM want w, live l WHERE NOT EXISTS (SELECT 1 FROM r0 h WHERE h.replica_id = l.replica_id AND h.record_id = w.record_id AND h.pt = w.pt AND h.c = w.c AND h.node = w.node)")
def audit_observation_lost(spark, d):
    log = A.observations(spark, d).where("replica_id = 'C'")
    stamps = A.events(spark, d).where("event_id % 50 = 7").select(F.lit("C").alias("replica_id"), *STAMP)
    return audit.no_observation_lost(log, stamps, A.observations(spark, d), _live(spark))


@query("audit_tag_lost", f"{ORSET}, a2 AS (SELECT DISTINCT replica_id, {G}, element, pt, c, node FROM s2 WHERE event_id % 4 <> 0), live2 AS (SELECT 'A' AS replica_id UNION ALL SELECT 'C') SELECT 'no_tag_lost' AS invariant, w.record_id, w.field, l.replica_id, concat_ws('|', w.element, w.pt, w.c, w.node) AS detail FROM adds w, live2 l WHERE w.c % 7 <> 2 AND NOT EXISTS (SELECT 1 FROM a2 h WHERE h.replica_id = l.replica_id AND h.record_id = w.record_id AND h.field = w.field AND h.element = w.element AND h.pt = w.pt AND h.c = w.c AND h.node = w.node)")
def audit_tag_lost(spark, d):
    adds, _ = A.orset(spark, d)
    log = adds.where("replica_id = 'C'")
    return audit.no_tag_lost(log, log.where("c % 7 = 2"), adds, _live(spark))


@query("audit_converged", f"{REGISTERS}, f AS (SELECT replica_id, {G}, string_agg(vtext || pt, ',' ORDER BY pt, c, node) AS s FROM r0 WHERE replica_id IN ('A', 'C') GROUP BY ALL) SELECT 'all_converged' AS invariant, record_id, field, '' AS replica_id, count(DISTINCT s) || ' states, on ' || count(DISTINCT replica_id) || ' of 2 replicas' AS detail FROM f GROUP BY {G} HAVING count(DISTINCT s) > 1 OR count(DISTINCT replica_id) < 2")
def audit_converged(spark, d):
    prints = views.canonical(A.observations(spark, d), ["vtag", "vtext", "author", *STAMP], by=["replica_id", *GROUP])
    return audit.all_converged(prints, _live(spark))


@query("audit_views_agree", f"{REGISTERS}, f AS (SELECT replica_id, {G}, max({{'pt': pt, 'c': c, 'node': node, 'v': vtext}}) AS s FROM r0 WHERE replica_id IN ('A', 'C') GROUP BY ALL) SELECT 'derived_views_agree:register' AS invariant, record_id, field, '' AS replica_id, count(DISTINCT s) || ' states, on ' || count(DISTINCT replica_id) || ' of 2 replicas' AS detail FROM f GROUP BY {G} HAVING count(DISTINCT s) > 1 OR count(DISTINCT replica_id) < 2")
def audit_views_agree(spark, d):
    rows = A.observations(spark, d)
    now = rows.groupBy("replica_id", *GROUP).agg(F.max(F.struct(*STAMP, "author", "vtag", "vtext")).alias("view"))
    return audit.views_agree("register", now.withColumn("view", F.to_json("view")), _live(spark))


@query("audit_signals_deterministic", f"{REGISTERS}, s AS (SELECT replica_id, {G}, string_agg({SHOWN}, '|' ORDER BY {SHOWN}) AS e FROM r0 WHERE replica_id IN ('A', 'C') GROUP BY replica_id, {G} HAVING count(DISTINCT author) > 1) SELECT 'review_signals_deterministic' AS invariant, record_id, field, '' AS replica_id, 'concurrent_demographic_edit|' || e AS detail FROM s GROUP BY {G}, e HAVING count(DISTINCT replica_id) < 2")
def audit_signals_deterministic(spark, d):
    rows = A.observations(spark, d)
    found = [review.contested(rows.where(F.col("replica_id") == r), REGISTER_SCHEMA).withColumn("replica_id", F.lit(r)) for r in ("A", "C")]
    return audit.review_signals_deterministic(merge.union(*found), _live(spark))


@query("audit_status_at_least", f"{positions_sql(('s0', 's1', 's2', 's3'), record=chr(39) + 'u' + chr(39) + ' || user_id')}, want AS (SELECT {G}, max(value) AS w FROM p0 WHERE length(record_id) <> 3 GROUP BY {G}), held AS (SELECT replica_id, {G}, max(value) AS v FROM positions GROUP BY ALL), live AS (SELECT 'A' AS replica_id UNION ALL SELECT 'C') SELECT 'status_at_least' AS invariant, w.record_id, w.field, l.replica_id, coalesce(v, 'missing') AS detail FROM want w CROSS JOIN live l LEFT JOIN held h ON h.replica_id = l.replica_id AND h.record_id = w.record_id AND h.field = w.field WHERE v IS NULL OR v < w.w")
def audit_status_at_least(spark, d):
    rows = A.positions(spark, d, by_user=True)
    log = rows.where("replica_id = 'C'").withColumns({"pt": F.lit(0).cast("bigint"), "c": F.length("record_id").cast("bigint"), "node": F.lit("n")})
    held = rows.groupBy("replica_id", *GROUP).agg(F.max("value").alias("value"))
    return audit.status_at_least(log, log.where("c = 3"), held, _live(spark), TOTAL_ORDER)


@query("crash_losses", f"{LOG} SELECT DISTINCT replica_id, pt, c, node FROM log l WHERE replica_id IN ('R1', 'R3') AND NOT (event_id % 3 = 0) AND NOT EXISTS (SELECT 1 FROM log o WHERE o.event_id % 4 = 0 AND o.pt = l.pt AND o.c = l.c AND o.node = l.node)")
def crash_losses(spark, d):
    log = _log(spark, d)
    crashed = spark.createDataFrame([("R1",), ("R3",)], "replica_id string")
    return audit.crash_losses(log, log.where("event_id % 3 = 0"), log.where("event_id % 4 = 0"), crashed, STAMP)


@query("session_transitions", "WITH s AS (SELECT user_id AS session_id, event_id AS seq, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) SELECT session_id, seq, was, state FROM s WHERE was IS NOT NULL AND NOT (was = 'view' OR state = 'view' OR (was = 'click' AND state = 'purchase'))")
def session_transitions(spark, d):
    kinds = tuple(A.FIELD_OF)
    legal = [(a, b) for a in kinds for b in kinds if a == "view" or b == "view" or (a, b) == ("click", "purchase")]
    log = A.table(spark, d, "events").selectExpr("user_id AS session_id", "event_id AS seq", "event_type AS state")
    return audit.session_transitions(log, spark.createDataFrame(legal, "was string, state string"))


# --- identity

POINTERS = "SELECT 'c' || c_custkey AS record_id, 'c' || (c_custkey // 3) AS target FROM customer WHERE c_custkey % 3 = 0 AND c_custkey > 0"


@query("forwarding_resolve", f"WITH RECURSIVE p AS ({POINTERS}), w AS (SELECT record_id, target AS top, 1 AS hops FROM p UNION ALL SELECT w.record_id, p.target, w.hops + 1 FROM w JOIN p ON w.top = p.record_id) SELECT record_id, top AS survivor, CAST(hops AS INTEGER) AS hops FROM w WHERE top NOT IN (SELECT record_id FROM p)")
def forwarding_resolve(spark, d):
    return identity.resolve(_pointers(spark, d))


def _pointers(spark, d):
    return A.table(spark, d, "customer").where("c_custkey % 3 = 0 AND c_custkey > 0").select(F.concat(F.lit("c"), "c_custkey").alias("record_id"), F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 3)).alias("target"))


@query("forwarding_cycles", "SELECT 'n' || n_nationkey AS record_id FROM nation WHERE n_nationkey IN (0, 1, 2, 4, 5, 6, 7, 8)")
def forwarding_cycles(spark, d):
    key = F.col("n_nationkey")
    target = F.concat(F.lit("n"), F.when(key < 6, (key + 1) % 3).otherwise(key - 1))
    return identity.cycles(A.table(spark, d, "nation").where(~key.isin(3, 9)).select(F.concat(F.lit("n"), key).alias("record_id"), target.alias("target")))


CUSTOMERS = "a AS (SELECT c_custkey, c_mktsegment AS v, 'office' AS author, 1000 AS pt, 'hq' AS node FROM customer UNION ALL SELECT c_custkey, 'MOVED_' || c_mktsegment, 'field', 999 + c_custkey % 3, 'tablet' FROM customer WHERE c_custkey % 10 = 0)"


@query("merge_through_forwarding", f"WITH RECURSIVE p AS ({POINTERS}), w AS (SELECT record_id, target AS top, 1 AS hops FROM p UNION ALL SELECT w.record_id, p.target, w.hops + 1 FROM w JOIN p ON w.top = p.record_id), r AS (SELECT record_id, top FROM w WHERE top NOT IN (SELECT record_id FROM p)), {CUSTOMERS} SELECT DISTINCT coalesce(r.top, 'c' || c_custkey) AS record_id, v AS segment, author, pt, node FROM a LEFT JOIN r ON r.record_id = 'c' || c_custkey")
def merge_through_forwarding(spark, d):
    """All observations of merged records, under their survivors' ids: the ordinary register merge of the resolved atoms."""
    atoms = A.customer_observations(spark, d).withColumn("record_id", F.concat(F.lit("c"), "record_id"))
    return merge.register(identity.resolved(atoms, _pointers(spark, d))).select("record_id", F.col("vtext").alias("segment"), "author", F.col("pt").cast("bigint").alias("pt"), "node")


@query("match_key_collisions", "SELECT c_nationkey || '|' || c_mktsegment AS match_key, count(*) AS n, string_agg('c' || c_custkey, ',' ORDER BY 'c' || c_custkey) AS record_ids FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1")
def match_key_collisions(spark, d):
    rows = A.table(spark, d, "customer").withColumn("record_id", F.concat(F.lit("c"), "c_custkey"))
    return identity.collisions(rows, F.concat_ws("|", "c_nationkey", "c_mktsegment"))


@query("bloom_no_false_negatives", "SELECT count(DISTINCT c_custkey) AS n FROM customer")
def bloom(spark, d):
    keys = A.table(spark, d, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("match_key"))
    return identity.bloom_probe(keys, identity.bloom_build(keys)).agg(F.count("*").alias("n"))


# --- reports

ITEMS = "items AS (SELECT 'w' || user_id AS replica_id, event_id AS seq, event_id % 4 AS lane, 100 + event_id % 900 AS bytes FROM events)"


def _items(spark, d):
    return A.table(spark, d, "events").select(F.concat(F.lit("w"), "user_id").alias("replica_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("lane"), (F.col("event_id") % 900 + 100).alias("bytes"))


@query("windows_to_drain", f"WITH {ITEMS} SELECT replica_id, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(ceil(sum(bytes) / 5000) AS BIGINT) AS n_windows FROM items GROUP BY replica_id")
def windows_to_drain(spark, d):
    return reporting.windows_to_drain(_items(spark, d), 5000)


@query("lane_schedule", f"WITH {ITEMS}, s AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY replica_id, lane >= 3 ORDER BY lane, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM items) SELECT replica_id, seq, lane, upto FROM s WHERE upto <= CASE WHEN lane >= 3 THEN 2000 ELSE 8000 END")
def lane_schedule(spark, d):
    return reporting.schedule(_items(spark, d), 10_000, 20, by="replica_id").select("replica_id", "seq", "lane", "upto")


@query("concurrency_rate", f"WITH {EV}, n AS (SELECT user_id, count(DISTINCT node) AS n FROM ev GROUP BY user_id) SELECT count(*) AS n_records, count(*) FILTER (WHERE n >= 2) AS n_shared FROM n")
def concurrency_rate(spark, d):
    return reporting.concurrency_rate(A.events(spark, d).withColumn("record_id", F.col("user_id")))


@query("traffic_sessions", f"WITH {EV}, l AS (SELECT 'u' || user_id AS replica_id, pt, CASE WHEN pt - lag(pt) OVER (PARTITION BY user_id ORDER BY pt) > 7200000 THEN 1 ELSE 0 END AS n FROM ev), s AS (SELECT replica_id, pt, sum(n) OVER (PARTITION BY replica_id ORDER BY pt RANGE UNBOUNDED PRECEDING) AS session FROM l) SELECT replica_id, CAST(session AS BIGINT) AS session, min(pt) AS first_pt, max(pt) AS last_pt, count(*) AS n FROM s GROUP BY ALL")
def traffic_sessions(spark, d):
    return reporting.sessions(A.events(spark, d).select(F.concat(F.lit("u"), "user_id").alias("replica_id"), "pt"), 7_200_000)


@query("sync_success_rate", "SELECT count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS n_ok, CAST(floor(count(*) FILTER (WHERE event_type <> 'error') * 1000 / count(*)) AS BIGINT) AS permille FROM events")
def sync_success_rate(spark, d):
    return reporting.success_rate(A.table(spark, d, "events").select((F.col("event_type") != "error").alias("ok")))


@query("bytes_per_record", f"WITH {ITEMS}, r AS (SELECT replica_id, sum(bytes) / count(*) AS x FROM items GROUP BY replica_id) SELECT CAST(round(quantile_cont(x, 0.5), 6) AS VARCHAR) AS p50, CAST(round(quantile_cont(x, 0.95), 6) AS VARCHAR) AS p95 FROM r")
def bytes_per_record(spark, d):
    by = _items(spark, d).groupBy("replica_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_records"))
    return reporting.bytes_per_record(by).select(F.round("p50", 6).cast("string").alias("p50"), F.round("p95", 6).cast("string").alias("p95"))


@query("time_to_converge", "WITH t AS (SELECT event_id % 17 AS days FROM events), n AS (SELECT days, count(*) AS n FROM t GROUP BY days) SELECT days, n, CAST(sum(n) OVER (ORDER BY days) AS BIGINT) AS n_by_then FROM n")
def time_to_converge(spark, d):
    rows = A.table(spark, d, "events").select((F.col("event_id") % 3).alias("written_day"), (F.col("event_id") % 3 + F.col("event_id") % 17).alias("converged_day"))
    return reporting.time_to_converge(rows)


@query("retransmission", "SELECT 's' || user_id AS session_id, count(*) AS n_sent, count(DISTINCT event_id % 20) AS n_chunks FROM events GROUP BY user_id")
def retransmission(spark, d):
    return reporting.retransmission(A.table(spark, d, "events").select(F.concat(F.lit("s"), "user_id").alias("session_id"), (F.col("event_id") % 20).alias("chunk")))


@query("fault_counts", "SELECT event_type AS fault, count(*) AS n FROM events GROUP BY event_type")
def fault_counts(spark, d):
    return reporting.fault_counts(A.table(spark, d, "events").select(F.col("event_type").alias("fault")))


@query("transfer_time", f"WITH {ITEMS} SELECT seq, bytes * 8000 // 20000 AS ms FROM items")
def transfer_time(spark, d):
    return _items(spark, d).select("seq", scalars.transfer_ms(F.col("bytes"), F.lit(20_000)).alias("ms"))


@query("provenance_audit", f"WITH {EV} SELECT pt - pt % 3600000 AS pt, 0 AS c, node, count(DISTINCT author) AS n FROM ev GROUP BY 1, node HAVING count(DISTINCT author) > 1")
def provenance_audit(spark, d):
    return reporting.provenance(A.events(spark, d).withColumn("pt", F.col("pt") - F.col("pt") % 3_600_000).withColumn("c", F.lit(0).cast("int")))


@query("blob_store", "SELECT sha256(props) AS digest, octet_length(encode(any_value(props))) AS bytes, count(*) AS n_refs FROM events GROUP BY props")
def blob_store(spark, d):
    return reporting.blobs(A.table(spark, d, "events").select(F.col("props").alias("payload"))).select("digest", "bytes", "n_refs")


@query("minor_units", f"WITH {EV} SELECT event_id, CAST(CAST(value AS DECIMAL(38,1)) / 10 AS DECIMAL(38,1))::VARCHAR AS shown FROM ev WHERE field = 'm_a'")
def minor_units(spark, d):
    return A.events(spark, d).where("field = 'm_a'").select("event_id", scalars.minor_units(F.col("value"), 1).cast("string").alias("shown"))


# --- streams and generated logs


def _streamed(spark: SparkSession, d: str, build) -> DataFrame:
    """The final result of a streaming aggregate over the events file, run to its end."""
    from ..streaming import incremental as S

    folder = work_dir(spark)
    source = S.read_log(spark, d, A.table(spark, d, "events").schema, pattern="events.parquet")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result")  # the whole result each time; a batch that is run again writes the same

    run = build(A.shaped(source)).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/result")


@query("stream_register_current", f"{REGISTERS} SELECT record_id, field, pt, c, node, author, vtag, vtext FROM ({BEST}) WHERE rn = 1")
def stream_register_current(spark, d):
    from ..streaming import incremental as S

    def build(events):
        tag = scalars.tagged(F.when(F.col("event_id") % 7 != 0, F.col("value")), "int")
        rows = events.where("field = 'd_a'").withColumn("t", tag).select(*GROUP, "t.vtag", "t.vtext", "author", *STAMP)
        return S.register_current(rows)

    return _streamed(spark, d, build)


@query("stream_series_merge", f"{ENTRIES}, {MERGED} SELECT {G}, value, taken_at, recorded_by, pt, c, node FROM merged")
def stream_series_merge(spark, d):
    from ..streaming import incremental as S

    def build(events):
        rows = events.where("field IN ('m_a', 'm_b')").withColumn("recorded_by", F.col("author")).withColumn("supersedes", F.lit(None).cast("string"))
        return S.series(rows, DEDUP_COLUMNS).drop("supersedes")

    return _streamed(spark, d, build)


@query("stream_vectors", f"WITH {EV}, best AS (SELECT 'C' AS replica_id, node, max({{'pt': pt, 'c': c}}) AS h FROM ev GROUP BY node) SELECT replica_id, node, h.pt AS pt, h.c AS c FROM best")
def stream_vectors(spark, d):
    from ..streaming import incremental as S

    return _streamed(spark, d, lambda events: S.vector(events.withColumn("replica_id", F.lit("C"))))


SWEPT = 2000


@query("sim_sweep", f"SELECT range AS seed, CAST(0 AS BIGINT) AS n_violations FROM range(1, {SWEPT + 1})")
def sim_sweep(spark, d):
    """Generated logs of many seeds, settled by the reducers and audited; what is expected is that nothing is found."""
    return simulator.sweep(spark, 1, SWEPT).drop("n_operations")


FOUND = ", ".join(f"('{name}', '{invariant}')" for name, (_, invariant) in simulator.MUTATIONS.items() if invariant)


@query("sim_mutations", f"SELECT * FROM (VALUES {FOUND}) t(mutation, invariant)")
def sim_mutations(spark, d):
    """Wrong variants and the invariants that must notice them; variants that are blind spots have none."""
    must = [(name, invariant) for name, (_, invariant) in simulator.MUTATIONS.items() if invariant]
    expected = spark.createDataFrame(must, "mutation string, invariant string")
    return simulator.survey(spark, tuple(name for name, _ in must)).join(expected, ["mutation", "invariant"], "left_semi").select("mutation", "invariant")


@query("sim_blind_spots", "SELECT CAST(NULL AS VARCHAR) AS mutation, CAST(NULL AS VARCHAR) AS invariant WHERE false")
def sim_blind_spots(spark, d):
    """What audits find of the right reducers, and of the variants that they cannot notice: nothing."""
    blind = tuple(name for name, (_, invariant) in simulator.MUTATIONS.items() if invariant is None)
    right = simulator.judged(simulator.played(simulator.seeds(spark, 1, 60))).select(F.lit("none").alias("mutation"), "invariant")
    return simulator.survey(spark, blind).select("mutation", "invariant").unionByName(right)


@query("sim_shards", "SELECT shard, count(*) AS n_seeds FROM (SELECT range % 3 AS shard FROM range(5, 65)) GROUP BY shard")
def sim_shards(spark, d):
    """Three shards of a sweep play each seed once."""
    return merge.union(*[simulator.seeds(spark, 5, 60, (i, 3)).agg(F.lit(i).cast("bigint").alias("shard"), F.count_distinct("seed").alias("n_seeds")) for i in range(3)])


@query("sim_one_way", "SELECT true AS cut_one_way, true AS other_way_open")
def sim_one_way(spark, d):
    """Links that are cut off in one direction deliver in the other."""
    log = simulator.rows_of(simulator.played(simulator.seeds(spark, 1, 200)), "delivery")
    by = log.groupBy("seed", F.least("replica_id", "dst").alias("a"), F.greatest("replica_id", "dst").alias("b")).agg(F.count_if((F.col("fault") == "cut") & F.col("replica_id").endswith("dev_a")).alias("cut"), F.count_if((F.col("fault") == "none") & F.col("dst").endswith("dev_a")).alias("back"))
    return by.agg((F.max("cut") > 0).alias("cut_one_way"), (F.max(F.when(F.col("cut") > 0, F.col("back"))) > 0).alias("other_way_open"))


@query("sim_fault_counts")
def sim_fault_counts(spark, d):
    return simulator.fault_counts(spark, 1, 20)
