"""Merges of any number of replicas: one reducer a lattice, over rows of atoms.

Each reducer is commutative, associative and idempotent, so it plans as partial and final aggregation and repeated or reordered input changes nothing. Atoms keep their
(record_id, field); replica_id is dropped, because a merge does not depend on where an atom came from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hlc import stamp
from ..schema import SERIES, STATUS, Schema, StatusOrder, same_schema

GROUP = ["record_id", "field"]
STAMP = ["pt", "c", "node"]
REGISTER = [*GROUP, "vtag", "vtext", "author", *STAMP]
ENTRY = [*GROUP, "value", "taken_at", "recorded_by", *STAMP, "supersedes"]
ADD = [*GROUP, "element", *STAMP]
REMOVE = [*GROUP, *STAMP]


def union(*states: DataFrame) -> DataFrame:
    """Rows of all states, by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), states)


def gset(elements: DataFrame) -> DataFrame:
    """Grow-only sets: the distinct elements."""
    return elements.select(*GROUP, "element").distinct()


def register(observations: DataFrame) -> DataFrame:
    """Registers: all distinct observations; losers are kept."""
    return observations.select(*REGISTER).distinct()


def orset_adds(adds: DataFrame) -> DataFrame:
    return adds.select(*ADD).distinct()


def orset_removes(removes: DataFrame) -> DataFrame:
    return removes.select(*REMOVE).distinct()


def entry_order() -> Column:
    """The total order of entries of one key: by stamp, then everything else, nulls first."""
    return F.struct(*STAMP, "supersedes", "taken_at", "recorded_by", "value")


def series(entries: DataFrame, dedup_on: tuple[str, ...]) -> DataFrame:
    """Measurement series: of the entries of one key the one with the least stamp."""
    if set(dedup_on) & set(STAMP):
        raise ValueError("a stamp in the key would make every entry its own")
    rest = [c for c in ENTRY if c not in (*GROUP, *dedup_on)]
    first = F.min(F.struct(*STAMP, "supersedes", *[c for c in rest if c not in (*STAMP, "supersedes")])).alias("e")
    return entries.groupBy(*GROUP, *dedup_on).agg(first).select(*GROUP, *dedup_on, *[f"e.{c}" for c in rest]).select(*ENTRY)


def series_of(schema: Schema, entries: DataFrame) -> DataFrame:
    """series() for every series field: one branch for each different key."""
    keys: dict[tuple[str, ...], list[str]] = {}
    for f in schema.of(SERIES):
        keys.setdefault(f.dedup_on, []).append(f.name)
    if not keys:
        return entries.select(*ENTRY).where("false")
    return union(*(series(entries.where(F.col("field").isin(names)), key) for key, names in keys.items()))


def mask(value: Column, order: StatusOrder) -> Column:
    """The up-set mask of a status value; null for an undeclared one."""
    pairs = [x for v, m in order.masks.items() for x in (F.lit(v), F.lit(m).cast("bigint"))]
    return F.try_element_at(F.create_map(*pairs), value)


def unmask(masked: Column, order: StatusOrder) -> Column:
    pairs = [x for v, m in order.masks.items() for x in (F.lit(m).cast("bigint"), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), masked)


def status(positions: DataFrame, order: StatusOrder) -> DataFrame:
    """Statuses: the least upper bound. Upper bounds of a set are the intersection of the up-sets, so this is one hash aggregate of ``bit_and``."""
    both = positions.groupBy(*GROUP).agg(F.bit_and(mask(F.col("value"), order)).alias("m"))
    return both.select(*GROUP, unmask(F.col("m"), order).alias("value"))


def status_by_rank(positions: DataFrame, order: StatusOrder) -> DataFrame:
    """status() of a total order: the value with the greatest rank."""
    ranks = F.create_map(*[x for i, v in enumerate(order.values) for x in (F.lit(v), F.lit(i))])
    best = positions.groupBy(*GROUP).agg(F.max(F.try_element_at(ranks, F.col("value"))).alias("r"))
    return best.select(*GROUP, F.element_at(F.array(*map(F.lit, order.values)), F.col("r") + 1).alias("value"))


def status_by_table(positions: DataFrame, order: StatusOrder) -> DataFrame:
    """status() of an order of any size: distinct values of a group (at most as many as are declared) folded over the tabulated join."""
    table = F.create_map(*[x for (a, b), c in order.table.items() for x in (F.lit(f"{a}\0{b}"), F.lit(c))])
    values = positions.groupBy(*GROUP).agg(F.array_sort(F.collect_set("value")).alias("v"))
    joined = F.aggregate(F.slice("v", 2, len(order.values)), F.col("v")[0], lambda a, b: F.element_at(table, F.concat(a, F.lit("\0"), b)))
    return values.select(*GROUP, joined.alias("value"))


def with_identity(merged: DataFrame, spine: DataFrame, order: StatusOrder, field: str) -> DataFrame:
    """Statuses of all records of spine: a record without a position is at the bottom. An order without a bottom is an error."""
    if order.bottom is None:
        raise ValueError("the order has no bottom, so a missing status has no value")
    known = merged.where(F.col("field") == field).select("record_id", "value")
    return spine.select("record_id").distinct().join(known, "record_id", "left").select("record_id", F.lit(field).alias("field"), F.coalesce("value", F.lit(order.bottom)).alias("value"))


def incomparable_pairs(positions: DataFrame, order: StatusOrder) -> DataFrame:
    """Groups whose operands hold values none of which is above the other, with the least such pair."""
    pairs = [(a, b) for a in order.values for b in order.values if a < b and not order.comparable(a, b)]
    held = positions.groupBy(*GROUP).agg(F.collect_set("value").alias("v"))
    if not pairs:
        return held.select(*GROUP, F.lit("").alias("a"), F.lit("").alias("b")).where("false")
    choices = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(pairs)])
    first = F.filter(choices, lambda p: F.array_contains(F.col("v"), p["a"]) & F.array_contains(F.col("v"), p["b"]))
    return held.withColumn("p", F.get(first, F.lit(0))).where("p IS NOT NULL").select(*GROUP, "p.a", "p.b")


#: The atoms of a state by kind, and their columns.
KINDS = {"entries": ENTRY, "observations": REGISTER, "adds": ADD, "removes": REMOVE, "elements": [*GROUP, "element"], "positions": [*GROUP, "value"]}


def records(*states: tuple[Schema, dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Whole records merged field by field: each state is a schema and atoms by kind. Schemas must agree in all they declare, not in name only."""
    schema = reduce(same_schema, [s for s, _ in states])
    held = {kind: union(*(atoms[kind].select(*columns) for _, atoms in states if kind in atoms)) for kind, columns in KINDS.items() if any(kind in atoms for _, atoms in states)}
    reducers = {"entries": lambda d: series_of(schema, d), "observations": register, "adds": orset_adds, "removes": orset_removes, "elements": gset}
    out = {kind: reducers[kind](rows) for kind, rows in held.items() if kind in reducers}
    if "positions" in held:
        parts = [status(held["positions"].where(F.col("field") == f.name), f.order) for f in schema.of(STATUS)]
        out["positions"] = union(*parts) if parts else held["positions"].where("false")
    return out


def atoms_of(state: dict[str, DataFrame]) -> DataFrame:
    """(record_id, field, kind, atom): a state of several kinds as rows of one shape; the atom's text leaves out nulls."""
    shaped = [rows.select(*GROUP, F.lit(kind).alias("kind"), F.concat_ws("|", *[F.col(c).cast("string") for c in KINDS[kind] if c not in GROUP]).alias("atom")) for kind, rows in state.items()]
    return union(*shaped)


def absorbed(new: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new that state does not have: nothing to write if there are none."""
    condition = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key])
    return new.alias("n").join(state.alias("s"), condition, "left_anti")


def leq(a: DataFrame, b: DataFrame, key: list[str]) -> bool:
    """Whether state a is at or below state b, for lattices whose join is union."""
    return absorbed(a, b, key).isEmpty()


def series_leq(a: DataFrame, b: DataFrame, dedup_on: tuple[str, ...]) -> bool:
    """Whether joining a to b changes nothing. Not a subset test, because of the deduplication."""
    joined, own = series(union(a, b), dedup_on), series(b, dedup_on)
    return absorbed(joined, own, ENTRY).isEmpty() and absorbed(own, joined, ENTRY).isEmpty()


def observations(lattice: str, atoms: DataFrame, dedup_on: tuple[str, ...] = ()) -> DataFrame:
    """What must never be lost of a lattice's atoms: distinct elements, observations, keys, tags or values."""
    keys = {"GSet": [*GROUP, "element"], "LWWRegister": REGISTER, "MeasurementSeries": [*GROUP, *dedup_on], "ORSet": ADD, "StatusLattice": [*GROUP, "value"]}
    return atoms.select(*keys[lattice]).distinct()


def latest_stamp(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest stamp of each key."""
    return rows.groupBy(*keys).agg(F.max(stamp()).alias("h")).select(*keys, "h.*")
