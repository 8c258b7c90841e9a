"""Deltas: what a peer is missing, by the exact set of stamps it has seen.

A frontier (greatest stamp of each node) must not filter a delta: after reordering, at or below the maximum is not the same as received. So the filter is an anti join on whole stamps.
Sets and statuses are sent whole: a removal that the peer lacks can concern an add that it has, and a status is one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import ADD, ENTRY, GROUP, REGISTER, REMOVE, STAMP, gset, orset_adds, orset_removes, register, series, status, union

#: How each lattice's delta is cut.
UNSEEN, WHOLE = "unseen", "whole"
CUT = {"MeasurementSeries": UNSEEN, "LWWRegister": UNSEEN, "ORSet": WHOLE, "GSet": WHOLE, "StatusLattice": WHOLE}


def frontier_of(*stamped: DataFrame) -> DataFrame:
    """All stamps that atoms carry: the seen-set of a state (entries, observations, adds and removes)."""
    return union(*(s.select(*STAMP) for s in stamped)).distinct()


def unseen(atoms: DataFrame, seen: DataFrame) -> DataFrame:
    """Atoms whose stamp the peer has not seen; a register's losers are ordinary rows and come along."""
    return atoms.join(seen.select(*STAMP).distinct(), STAMP, "left_anti")


def delta_since(lattice: str, atoms: DataFrame, seen: DataFrame) -> DataFrame:
    if lattice not in CUT:
        raise ValueError(f"no delta for {lattice!r}")
    return unseen(atoms, seen) if CUT[lattice] == UNSEEN else atoms


def record_delta(state: dict[str, DataFrame], seen: DataFrame) -> dict[str, DataFrame]:
    """The delta of a state given as {kind: atoms}; kinds are entries, observations, adds, removes, elements, positions."""
    cut = {"entries", "observations"}
    return {kind: unseen(rows, seen) if kind in cut else rows for kind, rows in state.items()}


def emptiness(state: dict[str, DataFrame], delta: dict[str, DataFrame]) -> DataFrame:
    """(record_id, empty) of every record of a state: whether its delta has nothing to send. Kinds that are sent whole count only where they have atoms."""
    records = union(*(rows.select("record_id") for rows in state.values())).distinct()
    sent = union(*(rows.select("record_id") for rows in delta.values())).distinct().withColumn("some", F.lit(True))
    return records.join(sent, "record_id", "left").select("record_id", F.col("some").isNull().alias("empty"))


def apply_delta(state: dict[str, DataFrame], delta: dict[str, DataFrame], dedup_on: tuple[str, ...], order=None) -> dict[str, DataFrame]:
    """state joined with delta. A kind that the delta lacks stays as it is."""
    reducers = {
        "entries": lambda d: series(d.select(*ENTRY), dedup_on),
        "observations": lambda d: register(d.select(*REGISTER)),
        "adds": lambda d: orset_adds(d.select(*ADD)),
        "removes": lambda d: orset_removes(d.select(*REMOVE)),
        "elements": gset,
        "positions": lambda d: status(d.select(*GROUP, "value"), order),
    }
    return {kind: reducers[kind](union(rows, delta[kind]) if kind in delta else rows) for kind, rows in state.items()}


def incremental(state: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Groups that new atoms touch: all that an incremental merge has to rewrite."""
    return new.join(state.select(*key).distinct(), key, "left_anti").select(*GROUP).distinct()


def wire_size(rows: DataFrame) -> DataFrame:
    """Bytes of rows as JSON text."""
    return rows.select(F.octet_length(F.to_json(F.struct(*sorted(rows.columns)))).alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.count("*").alias("n_rows"))
