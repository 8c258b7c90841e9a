"""Log audits: each returns the rows that violate an invariant, as (invariant, record_id, field, replica_id, detail).

Expectations come from the operation log alone, never from the merge that is judged. What was lost in a crash is not expected to be present, but it is not invented either: a message in
flight can still land. So loss excludes crash-lost operations, and phantoms are judged against all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hlc import encode, stamp
from ..schema import StatusOrder
from .merge import GROUP, REGISTER, STAMP, mask, union

COLUMNS = ["invariant", "record_id", "field", "replica_id", "detail"]


def violation(rows: DataFrame, name: str, detail: Column, record: str | None = "record_id", field: str | None = "field", replica: str | None = "replica_id") -> DataFrame:
    column = lambda c: F.col(c) if c else F.lit("")
    return rows.select(F.lit(name).alias("invariant"), column(record).alias("record_id"), column(field).alias("field"), column(replica).alias("replica_id"), detail.cast("string").alias("detail"))


def survivors(log: DataFrame, crash_lost: DataFrame) -> DataFrame:
    """Operations that no crash has lost."""
    return log.join(crash_lost.select("replica_id", *STAMP), ["replica_id", *STAMP], "left_anti")


def measurement_keys(log: DataFrame, dedup_on: tuple[str, ...]) -> DataFrame:
    """The readings that a log wrote, whoever wrote them and however often."""
    return log.select(*GROUP, *dedup_on).distinct()


def register_values(log: DataFrame) -> DataFrame:
    """(record_id, field, vtag, vtext) that a log wrote."""
    return log.select(*GROUP, "vtag", "vtext").distinct()


def originated_by(log: DataFrame, replica_id: str) -> DataFrame:
    """The operations of one replica, in the order of its log."""
    return log.where(F.col("replica_id") == replica_id).orderBy("log_seq")


def record_ids(log: DataFrame) -> DataFrame:
    return log.select("record_id").distinct()


def crash_losses(log: DataFrame, durable: DataFrame, elsewhere: DataFrame, crashed: DataFrame, key: list[str]) -> DataFrame:
    """Operations of crashed replicas whose effect (key) is neither in their durable state nor in that of any other live replica."""
    own = log.join(F.broadcast(crashed.select("replica_id")), "replica_id", "left_semi")
    kept = own.join(durable.select("replica_id", *key).distinct(), ["replica_id", *key], "left_anti")
    return kept.join(elsewhere.select(*key).distinct(), key, "left_anti").select("replica_id", *STAMP).distinct()


def _live(live: DataFrame) -> DataFrame:
    """One row: all live replicas. As many as a deployment has devices; it is what each short key is compared with."""
    return live.select("replica_id").distinct().agg(F.sort_array(F.collect_set("replica_id")).alias("live"))


def lost(name: str, expected: DataFrame, present: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Keys that a live replica should have and has not. Each key's holders are gathered once; only keys that are short of some replica are expanded, to those replicas."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key if k not in GROUP])
    holders = present.groupBy(*key).agg(F.collect_set("replica_id").alias("holders"))
    held = expected.select(*key).distinct().join(holders, key, "left").crossJoin(F.broadcast(_live(live)))
    absent = F.array_except("live", F.coalesce("holders", F.array().cast("array<string>")))
    return violation(held.select(*key, F.explode(absent).alias("replica_id")), name, text)


def no_measurement_lost(log: DataFrame, crash_lost: DataFrame, present: DataFrame, live: DataFrame, dedup_on: tuple[str, ...]) -> DataFrame:
    return lost("no_measurement_lost", survivors(log, crash_lost), present, live, [*GROUP, *dedup_on])


def no_observation_lost(log: DataFrame, crash_lost: DataFrame, present: DataFrame, live: DataFrame) -> DataFrame:
    return lost("no_observation_lost", survivors(log, crash_lost), present, live, REGISTER)


def no_tag_lost(log: DataFrame, crash_lost: DataFrame, present: DataFrame, live: DataFrame) -> DataFrame:
    """Tags, not elements: another add of the element does not make up for a lost one."""
    return lost("no_tag_lost", survivors(log, crash_lost), present, live, [*GROUP, "element", *STAMP])


def no_phantom_measurements(log: DataFrame, present: DataFrame, dedup_on: tuple[str, ...]) -> DataFrame:
    """Keys that no operation wrote, and keys held more than once."""
    key = [*GROUP, *dedup_on]
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in dedup_on])
    invented = present.select("replica_id", *key).distinct().join(log.select(*key).distinct(), key, "left_anti")
    twice = present.groupBy("replica_id", *key).agg(F.count("*").alias("n")).where("n > 1")
    return union(violation(invented, "no_phantom_measurements", F.concat(F.lit("invented "), text)), violation(twice, "no_phantom_measurements", F.concat(F.col("n").cast("string"), F.lit(" entries of "), text)))


def removals_are_honoured(log_removes: DataFrame, crash_lost: DataFrame, live_tags: DataFrame) -> DataFrame:
    """Tags that an operation removed (one row a tag: removed_pt, removed_c, removed_node) and that are live somewhere."""
    removed = survivors(log_removes, crash_lost).select(*GROUP, F.col("removed_pt").alias("pt"), F.col("removed_c").alias("c"), F.col("removed_node").alias("node")).distinct()
    return violation(live_tags.join(removed, [*GROUP, *STAMP], "left_semi"), "removals_are_honoured", encode())


def hlc_causality_respected(log: DataFrame) -> DataFrame:
    """Operations whose stamp is not above that of the one before in their replica's log."""
    before = F.lag(stamp()).over(W.partitionBy("replica_id").orderBy("log_seq"))
    return violation(log.withColumn("_b", before).where(F.col("_b").isNotNull() & ~(F.col("_b") < stamp())), "hlc_causality_respected", encode())


def no_duplicate_operation_ids(log: DataFrame) -> DataFrame:
    twice = log.groupBy("replica_id", *STAMP).agg(F.count("*").alias("n")).where("n > 1")
    return violation(twice, "no_duplicate_operation_ids", F.concat(F.col("n").cast("string"), F.lit(" x "), encode()), record=None, field=None)


def all_converged(fingerprints: DataFrame, live: DataFrame) -> DataFrame:
    """Groups whose fingerprint is not the same on all live replicas, or that one of them lacks."""
    n = live.select("replica_id").distinct().agg(F.count("*").alias("n_live"))
    held = fingerprints.join(F.broadcast(live.select("replica_id").distinct()), "replica_id")
    by = held.groupBy(*GROUP).agg(F.count_distinct("fingerprint").alias("n_states"), F.count_distinct("replica_id").alias("n_holders"))
    bad = by.join(F.broadcast(n)).where("n_states > 1 OR n_holders < n_live")
    return violation(bad, "all_converged", F.format_string("%d states, on %d of %d replicas", "n_states", "n_holders", "n_live"), replica=None)


def views_agree(name: str, views: DataFrame, live: DataFrame) -> DataFrame:
    """As all_converged, of derived views (replica_id, group, view)."""
    bad = all_converged(views.withColumnRenamed("view", "fingerprint"), live)
    return bad.withColumn("invariant", F.lit(f"derived_views_agree:{name}"))


def differences(atoms: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """(record_id, field, atom, held_by, absent_from) of atoms that some live replicas hold and others don't: why a field has not converged."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key if k not in GROUP])
    held = atoms.groupBy(*GROUP, text.alias("atom")).agg(F.sort_array(F.collect_set("replica_id")).alias("holders")).crossJoin(F.broadcast(_live(live)))
    have, absent = F.array_intersect("live", "holders"), F.array_except("live", "holders")
    return held.where((F.size(have) > 0) & (F.size(absent) > 0)).select(*GROUP, "atom", F.array_join(have, ",").alias("held_by"), F.array_join(absent, ",").alias("absent_from"))


def review_signals_deterministic(signals: DataFrame, live: DataFrame) -> DataFrame:
    """Signals that some live replicas raise and others don't."""
    n = live.select("replica_id").distinct().agg(F.count("*").alias("n_live"))
    text = F.array_join("evidence", "|")
    by = signals.groupBy("record_id", "field", "code", text.alias("e")).agg(F.count_distinct("replica_id").alias("n_holders"))
    return violation(by.join(F.broadcast(n)).where("n_holders < n_live"), "review_signals_deterministic", F.concat_ws("|", "code", "e"), replica=None)


def status_at_least(log: DataFrame, crash_lost: DataFrame, present: DataFrame, live: DataFrame, order: StatusOrder) -> DataFrame:
    """Statuses that are not at or above every position that was written."""
    want = survivors(log, crash_lost).groupBy(*GROUP).agg(F.bit_and(mask(F.col("value"), order)).alias("w"))
    held = present.groupBy(*GROUP).agg(F.collect_set(F.struct("replica_id", "value", mask(F.col("value"), order).alias("h"))).alias("held"))
    both = want.join(held, GROUP, "left").crossJoin(F.broadcast(_live(live))).withColumn("held", F.coalesce("held", F.array().cast("array<struct<replica_id:string,value:string,h:bigint>>")))
    low = F.filter("held", lambda x: F.array_contains(F.col("live"), x["replica_id"]) & (x["h"].isNull() | (x["h"].bitwiseAND(F.col("w")) != x["h"])))
    absent = F.array_except("live", F.transform("held", lambda x: x["replica_id"]))
    rows = F.concat(F.transform(low, lambda x: F.struct(x["replica_id"].alias("replica_id"), x["value"].alias("value"))), F.transform(absent, lambda r: F.struct(r.alias("replica_id"), F.lit(None).cast("string").alias("value"))))
    return violation(both.select(*GROUP, F.explode(rows).alias("x")).select(*GROUP, "x.*"), "status_at_least", F.coalesce("value", F.lit("missing")))


def check_all(*parts: DataFrame) -> DataFrame:
    """All violations of all audits."""
    return union(*parts)


def session_transitions(log: DataFrame, legal: DataFrame) -> DataFrame:
    """Steps of session logs (session_id, seq, state) that no legal transition (was, state) allows."""
    steps = log.withColumn("was", F.lag("state").over(W.partitionBy("session_id").orderBy("seq"))).where("was IS NOT NULL")
    return steps.join(F.broadcast(legal.select("was", "state")), ["was", "state"], "left_anti").select("session_id", "seq", "was", "state")
