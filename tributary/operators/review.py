"""Review signals: merges that a person should look at. A closed set of eleven codes, one function each, joined by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day, shown
from ..schema import REGISTER, SERIES, STATUS, Schema
from . import merge, views

#: The codes that signals may have.
CODES = (
    "multiple_weights_same_day",
    "superseded_fork",
    "implausible_taken_at",
    "concurrent_demographic_edit",
    "reenrolment_after_graduation",
    "concurrent_status_transition",
    "delete_update_conflict",
    "duplicate_candidate",
    "stale_replica_beyond_retention",
    "replica_state_regressed",
    "duplicate_device_id",
)
COLUMNS = ["record_id", "field", "code", "evidence"]


def _signal(rows: DataFrame, code: str, evidence: Column | None = None, record: Column | None = None, field: Column | None = None) -> DataFrame:
    if code not in CODES:
        raise ValueError(f"unknown review signal {code!r}; the set is closed")
    return rows.select(
        (F.col("record_id") if record is None else record).alias("record_id"),
        (F.col("field") if field is None else field).alias("field"),
        F.lit(code).alias("code"),
        (F.array().cast("array<string>") if evidence is None else F.sort_array(evidence)).alias("evidence"),
    )


def same_day(merged_series: DataFrame, zone: str | None = None) -> DataFrame:
    """Several current entries of one field on one day."""
    days = views.series_current(merged_series).groupBy(*merge.GROUP, day(F.col("taken_at"), zone).alias("day")).agg(F.count("*").alias("n"))
    return _signal(days.where("n > 1").select(*merge.GROUP).distinct(), "multiple_weights_same_day")


def superseded_fork(merged_series: DataFrame) -> DataFrame:
    forks = views.supersede_forks(merged_series).groupBy(*merge.GROUP).agg(F.collect_set("supersedes").alias("e"))
    return _signal(forks, "superseded_fork", F.col("e"))


def contested(merged_register: DataFrame, schema: Schema, strict: bool = False) -> DataFrame:
    """Contested registers of fields that ask for review, with every author=value."""
    names = [f.name for f in schema.of(REGISTER) if f.review_when_contested]
    rows = merged_register.where(F.col("field").isin(names))
    hit = rows.join(views.register_contested(rows, strict), merge.GROUP)
    text = F.concat(F.col("author"), F.lit("="), shown(F.col("vtag"), F.col("vtext")))
    return _signal(hit.groupBy(*merge.GROUP).agg(F.collect_list(text).alias("e")), "concurrent_demographic_edit", F.col("e"))


def status_transition(positions: DataFrame, schema: Schema) -> DataFrame:
    """Operands of a status that are incomparable; the evidence is the least such pair."""
    parts = [merge.incomparable_pairs(positions.where(F.col("field") == f.name), f.order) for f in schema.of(STATUS)]
    if not parts:
        return _signal(positions.where("false"), "concurrent_status_transition")
    return _signal(merge.union(*parts), "concurrent_status_transition", F.array("a", "b"))


def implausible(entries: DataFrame, bound_ms: int) -> DataFrame:
    """Readings dated later than their receipt (pt) by more than bound_ms."""
    ahead = F.unix_millis(F.try_to_timestamp("taken_at")) - F.col("pt") > bound_ms
    hit = entries.where(ahead).groupBy(*merge.GROUP).agg(F.collect_set("taken_at").alias("e"))
    return _signal(hit, "implausible_taken_at", F.col("e"))


def left_terminal(positions: DataFrame, schema: Schema) -> DataFrame:
    """Attempts to take another value where a terminal one is held."""
    parts = []
    for f in schema.of(STATUS):
        held = positions.where(F.col("field") == f.name).groupBy(*merge.GROUP).agg(F.collect_set("value").alias("v"))
        ends = F.array(*map(F.lit, f.order.terminal))
        parts.append(held.where(F.arrays_overlap("v", ends) & (F.size("v") > 1)).select(*merge.GROUP, F.array_except("v", ends).alias("e")))
    if not parts:
        return _signal(positions.where("false"), "reenrolment_after_graduation")
    return _signal(merge.union(*parts).where(F.size("e") > 0), "reenrolment_after_graduation", F.col("e"))


def delete_update(tombstones: DataFrame, operations: DataFrame, observed: DataFrame) -> DataFrame:
    """Records deleted while an update was under way that the delete had not observed. Both are kept.

    tombstones (record_id, delete_id); observed (delete_id, pt, c, node): what each delete knew; operations (record_id, field, pt, c, node).
    """
    updates = tombstones.join(operations, "record_id").join(observed, ["delete_id", *merge.STAMP], "left_anti")
    hit = updates.groupBy("record_id").agg(F.collect_set(F.format_string("%016d:%010d:%s", "pt", "c", "node")).alias("e"))
    return _signal(hit, "delete_update_conflict", F.col("e"), field=F.lit(""))


def duplicate_candidate(keys: DataFrame) -> DataFrame:
    """Records that share a match key (record_id, match_key). They are shown, never merged."""
    hit = keys.where("match_key IS NOT NULL").groupBy("match_key").agg(F.collect_set("record_id").alias("e")).where(F.size("e") > 1)
    return _signal(hit, "duplicate_candidate", F.col("e"), record=F.array_min("e"), field=F.lit(""))


def stale_replica(seen: DataFrame, now_ms: Column | int, retention_ms: int) -> DataFrame:
    """Replicas whose newest stamp is older than the retention that the caller sets."""
    newest = seen.groupBy("replica_id").agg(F.max("pt").alias("pt"))
    hit = newest.where(F.col("pt") < (now_ms if isinstance(now_ms, Column) else F.lit(now_ms)) - retention_ms)
    return _signal(hit, "stale_replica_beyond_retention", F.array(F.col("pt").cast("string")), record=F.col("replica_id"), field=F.lit(""))


def state_regressed(vectors: DataFrame, recorded: DataFrame) -> DataFrame:
    """Replicas whose vector (replica_id, node, pt, c) is strictly below the one on record."""
    now = vectors.select("replica_id", "node", F.struct("pt", "c").alias("h"))
    was = recorded.select("replica_id", "node", F.struct("pt", "c").alias("r"))
    both = now.join(was, ["replica_id", "node"], "full_outer")
    # all of now at or below the record, and something strictly below
    judged = both.groupBy("replica_id").agg(
        F.bool_and(F.coalesce(F.col("h") <= F.col("r"), F.col("h").isNull())).alias("below"),
        F.bool_or(F.col("r").isNotNull() & (F.col("h").isNull() | (F.col("h") < F.col("r")))).alias("strict"),
        F.collect_set(F.when(F.col("r").isNotNull() & (F.col("h").isNull() | (F.col("h") < F.col("r"))), F.col("node"))).alias("e"),
    )
    return _signal(judged.where("below AND strict"), "replica_state_regressed", F.col("e"), record=F.col("replica_id"), field=F.lit(""))


def duplicate_device(bindings: DataFrame) -> DataFrame:
    """Device ids bound to several keys that are live (device_id, device_key, live)."""
    hit = bindings.where("live").groupBy("device_id").agg(F.collect_set("device_key").alias("e")).where(F.size("e") > 1)
    return _signal(hit, "duplicate_device_id", F.col("e"), record=F.col("device_id"), field=F.lit(""))


def detect(schema: Schema, entries: DataFrame, observations: DataFrame, positions: DataFrame, zone: str | None = None) -> DataFrame:
    """All signals that merged atoms warrant by themselves. positions are the operands, not the merged status."""
    series = entries.where(F.col("field").isin([f.name for f in schema.of(SERIES)]))
    return merge.union(same_day(series, zone), superseded_fork(series), contested(observations, schema), status_transition(positions, schema))


def without_resolved(signals: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Signals that no one has resolved. Evidence is part of the key: new evidence opens a signal again."""
    key = ["record_id", "field", "code"]
    text = F.array_join("evidence", "|")
    done = resolutions.select(*key, text.alias("_e"))
    return signals.withColumn("_e", text).join(done, [*key, "_e"], "left_anti").drop("_e")


def mismatches(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, code, problem) where signals by case differ from those expected, both ways."""
    missing = expected.select("case_id", "code").distinct().join(found.select("case_id", "code").distinct(), ["case_id", "code"], "left_anti")
    spurious = found.select("case_id", "code").distinct().join(expected.select("case_id", "code").distinct(), ["case_id", "code"], "left_anti")
    return missing.withColumn("problem", F.lit("missing")).unionByName(spurious.withColumn("problem", F.lit("spurious")))


def volume(signals: DataFrame, records: DataFrame) -> DataFrame:
    """Signals of each code, and of all (code null), by hundred records."""
    total = records.select("record_id").distinct().agg(F.count("*").alias("n_records"))
    counts = signals.rollup("code").agg(F.count("*").alias("n_signals"))
    return counts.join(F.broadcast(total)).select("code", "n_signals", "n_records", F.floor(F.col("n_signals") * 100 / F.col("n_records")).cast("bigint").alias("per_100"))
