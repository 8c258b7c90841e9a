"""Seeded scenarios of replicas with bad clocks and bad networks, as tables.

What happens is declared as data: kinds of writes, link profiles, presets. A seed decides the rest; every entity has a stream of random numbers of its own, so that one does not shift the others. A
seed is played by a small Python loop on an executor. All it yields (log, deliveries, states of the replicas before they settle, what crashes lost) comes back as rows of one table that is written once.
Settling and auditing are queries over that table: the network heals, every replica gets every other's state, and the reducers of ``operators.merge`` do the merging. ``MUTATIONS`` are wrong reducers and a wrong clock;
``survey`` shows which audits notice them.

``python -m tributary.simulator --preset hostile --count 100`` sweeps seeds and prints what the audits find.
"""

from __future__ import annotations

import argparse
import heapq
import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b
from itertools import accumulate
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .operators import audit, merge, views
from .operators.merge import GROUP, STAMP
from .schema import DEDUP_COLUMNS, TOTAL_ORDER
from .shared import work_dir, written

HOUR, DAY = 3_600_000, 86_400_000
EPOCH = 1_750_000_000_000


@dataclass(frozen=True)
class Kind:
    """A kind of write: its share, its fields, the values to choose from, and how often it goes back to an earlier write."""

    name: str
    tenths: int
    fields: tuple[str, ...]
    values: tuple
    again: float = 0.0


#: Shares of the kinds, and how often a reading is written down again.
KINDS = (
    Kind("measurement", 5, ("m_a", "m_b"), tuple(range(300, 340)), again=0.25),
    Kind("register", 3, ("d_a", "d_b"), ("north", "south", "east", None)),
    Kind("status", 1, ("st_a",), TOTAL_ORDER.values),
    Kind("tag", 1, ("set_a",), ("red", "green", "blue", "grey"), again=0.4),
)
UPTO = list(accumulate(k.tenths for k in KINDS))


@dataclass(frozen=True)
class Link:
    """A profile: speed and latency, shares of messages that are lost, doubled or held back, and hours a day in which the link is open."""

    bits_per_second: int
    latency_ms: int
    lost: float
    doubled: float
    held: float
    open_hours: int


LINKS = {"wire": Link(1_000_000, 40, 0.0, 0.0, 0.0, 24), "village": Link(20_000, 900, 0.1, 0.04, 0.12, 9), "storm": Link(9_600, 2_500, 0.22, 0.12, 0.25, 5)}


@dataclass(frozen=True)
class Scenario:
    seed: int
    devices: int
    records: int
    writes: int
    link: str
    days: int
    crashes: float
    cuts: float
    wrong_clocks: float


#: Presets by name: link, days, and shares of devices that crash, of pairs that are cut off for a while, and of clocks that are wrong.
PRESETS = {"quiet": ("wire", 1, 0.0, 0.0, 0.0), "hostile": ("storm", 4, 0.35, 0.35, 0.6), "six_months_offline": ("village", 180, 0.05, 0.1, 0.8)}


def stream(*names: object) -> Random:
    """The random numbers of one entity: seeded by a digest of its name."""
    return Random(int.from_bytes(blake2b(repr(names).encode(), digest_size=8).digest(), "big"))


def scenario(seed: int, preset: str = "hostile") -> Scenario:
    r = stream(seed, "size")
    return Scenario(seed, 2 + r.randrange(4), 1 + r.randrange(4), 12 + r.randrange(60), *PRESETS[preset])


class Clock:
    """A device's clock: an offset, a drift by day and sudden changes, if it is one of the wrong ones. Issues stamps."""

    def __init__(self, s: Scenario, name: str, stuck: bool = False):
        r = stream(s.seed, name, "clock")
        wrong = r.random() < s.wrong_clocks
        self.name, self.stuck = name, stuck
        self.offset, self.drift = (r.randrange(-2 * DAY, 2 * DAY), r.uniform(-1500, 1500)) if wrong else (0, 0.0)
        self.changes = sorted((r.randrange(s.days * DAY), r.randrange(-DAY, DAY)) for _ in range(r.randrange(3) if wrong else 0))
        self.last = (0, 0)

    def shown(self, now: int) -> int:
        return max(0, EPOCH + now + self.offset + int(self.drift * now / DAY) + sum(by for at, by in self.changes if at <= now))

    def tick(self, now: int, heard: tuple[int, int] | None = None) -> tuple[int, int]:
        """The next stamp: after all that was issued or heard. A stuck counter is mutation M6."""
        pt = max(self.shown(now), self.last[0], heard[0] if heard else 0)
        c = max((c + 1 for p, c in (self.last, heard or (0, -1)) if p == pt), default=0)
        self.last = (pt, 0 if self.stuck else c)
        return self.last


#: The columns of an atom; those that its kind does not have are null. A replica's state is a set of atoms; it is the reducers that know which of them stand for one another.
SHAPE = ("kind", "record_id", "field", "value", "taken_at", "recorded_by", "vtag", "vtext", "author", "element", "status", *STAMP)


def atom(kind: str, record: str, field: str, **columns) -> tuple:
    return tuple({"kind": kind, "record_id": record, "field": field, **columns}.get(c) for c in SHAPE)


def known_by(a: tuple) -> tuple:
    """What has to survive of an atom: an entry's reading, and everything else itself."""
    return a[:6] if a[0] == "entry" else a


class Replica:
    def __init__(self, s: Scenario, number: int, stuck: bool):
        self.name = f"dev_{chr(97 + number)}"
        self.clock = Clock(s, self.name, stuck)
        self.state: set[tuple] = set()
        self.durable: set[tuple] = set()
        self.written = 0

    def write(self, s: Scenario, r: Random, now: int) -> dict:
        """One write of a declared kind, applied to the own state; returns its log row, with what its atom is known by under ``key``."""
        kind = KINDS[bisect_right(UPTO, r.randrange(UPTO[-1]))]
        record, field, value, who, again = f"rec_{r.randrange(s.records)}", r.choice(kind.fields), r.choice(kind.values), f"w{r.randrange(3)}", r.random() < kind.again
        pt, c = self.clock.tick(now)
        self.written += 1
        stamp = {"pt": pt, "c": c, "node": self.name}
        row = {"seed": s.seed, "replica_id": self.name, "record_id": record, "field": field, "kind": kind.name, "log_seq": self.written, "at": now, **stamp}
        mine = [a for a in self.state if a[1] == record and a[2] == field]
        more: dict = {}
        if kind.name == "measurement":
            reading = {"value": value, "taken_at": f"day {now // DAY}, {6 + r.randrange(12)}:00", "recorded_by": who}
            if again and mine:
                reading = dict(zip(SHAPE[3:6], r.choice(sorted(mine, key=repr))[3:6]))
            what, more = ("entry", reading | stamp), reading
        elif kind.name == "register":
            more = {"vtag": "0null" if value is None else "3str", "vtext": value or "", "author": who}
            what = ("observation", more | stamp)
        elif kind.name == "status":
            what, more = ("position", {"status": value}), {"status": value}
        else:
            gone = {a[-3:] for a in mine if a[0] == "remove"}
            tags = sorted(a[-3:] for a in mine if a[0] == "add" and a[9] == value and a[-3:] not in gone)
            more = {"element": value}
            if again and tags:
                tag = dict(zip(STAMP, r.choice(tags)))
                row["kind"], what = "tag_remove", ("remove", tag)
                more |= {f"removed_{k}": v for k, v in tag.items()}
            else:
                what = ("add", {"element": value} | stamp)
        a = atom(what[0], record, field, **what[1])
        self.state.add(a)
        return row | more | {"key": known_by(a)}


def windows(s: Scenario, link: tuple) -> list[tuple[int, int]]:
    """The hours in which a link is open, laid out for the whole run."""
    r, hours = stream(s.seed, "windows", *sorted(link)), LINKS[s.link].open_hours
    return [(day * DAY + start * HOUR, day * DAY + (start + hours) * HOUR) for day in range(s.days) for start in [r.randrange(25 - hours)]]


def cuts(s: Scenario, names: list[str]) -> dict[tuple[str, str], tuple[int, int]]:
    """Directions that are cut off for a while; the other direction of a pair may stay open."""
    out = {}
    for a in names:
        for b in names:
            r = stream(s.seed, "cut", a, b)
            if a != b and r.random() < s.cuts:
                start = r.randrange(s.days * DAY)
                out[a, b] = (start, start + r.randrange(1, 2 * DAY))
    return out


def play(s: Scenario, stuck: bool = False, most: int = 5_000_000) -> dict[str, list[dict]]:
    """A scenario's rows: log, delivery, state (before anything settles) and lost (operations that a crash left nowhere)."""
    replicas = [Replica(s, i, stuck) for i in range(s.devices)]
    link, end = LINKS[s.link], s.days * DAY
    opened = {(a.name, b.name): windows(s, (a.name, b.name)) for a in replicas for b in replicas if a is not b}
    cut = cuts(s, [d.name for d in replicas])
    plan, net = stream(s.seed, "plan"), stream(s.seed, "net")
    todo: list[tuple] = []
    number = 0

    def put(at: int, what: str, *args) -> None:
        nonlocal number
        number += 1
        if number > most:
            raise RuntimeError(f"seed {s.seed} made more than {most} events")
        heapq.heappush(todo, (at, number, what, args))

    for _ in range(s.writes):
        put(plan.randrange(end), "write", plan.choice(replicas))
    for a, b in opened:
        for start, stop in plan.sample(opened[a, b], min(len(opened[a, b]), 5)):
            put(start + plan.randrange(stop - start), "send", a, b)
        put(plan.randrange(end), "send", a, b)  # whether the link is open or not
    for d in replicas:
        r = stream(s.seed, d.name, "power")
        for _ in range(3):
            put(r.randrange(end), "commit", d)
        if r.random() < s.crashes:
            put(r.randrange(end), "crash", d)
    named = {d.name: d for d in replicas}
    out: dict[str, list[dict]] = {"log": [], "delivery": [], "state": [], "lost": []}
    missing: set[tuple] = set()
    while todo:
        now, _, what, args = heapq.heappop(todo)
        if what == "write":
            (d,) = args
            out["log"].append(d.write(s, stream(s.seed, d.name, "write", d.written), now))
        elif what == "send":
            a, b = args
            size = 2 + 48 * len(named[a].state)
            arrives = now + size * 8000 // link.bits_per_second + int(link.latency_ms * (0.5 + net.random()))
            chance = [net.random() for _ in range(4)]  # drawn whatever happens
            closes = next((stop for start, stop in opened[a, b] if start <= now < stop), now)
            off = cut.get((a, b), (0, 0))
            fault = "cut" if off[0] <= now < off[1] else "window" if arrives > closes else "lost" if chance[0] < link.lost else "doubled" if chance[1] < link.doubled else "held" if chance[2] < link.held else "none"
            out["delivery"].append({"seed": s.seed, "replica_id": a, "dst": b, "at": now, "arrives": arrives, "bytes": size, "fault": fault})
            if fault in ("none", "doubled", "held"):
                late = int(chance[3] * 5 * HOUR)
                put(arrives + (late if fault == "held" else 0), "arrive", named[b], frozenset(named[a].state), named[a].clock.last)
                if fault == "doubled":
                    put(arrives + late, "arrive", named[b], frozenset(named[a].state), named[a].clock.last)
        elif what == "arrive":
            d, state, heard = args
            d.clock.tick(now, heard)
            d.state |= state
        elif what == "commit":
            args[0].durable = set(args[0].state)
        else:
            (d,) = args
            flying = [e[3][1] for e in todo if e[2] == "arrive"]
            kept = set().union(d.durable, *(x.state | x.durable for x in replicas if x is not d), *flying)
            missing |= set(map(known_by, d.state)) - set(map(known_by, kept))
            d.state = set(d.durable)
    out["state"] = [{"seed": s.seed, "replica_id": d.name} | dict(zip(SHAPE, a)) for d in replicas for a in sorted(d.state, key=repr)]
    out["lost"] = [{c: row[c] for c in ("seed", "replica_id", *STAMP)} for row in out["log"] if row["key"] in missing]
    return out


#: One table holds all rows; ``what`` says of which kind each is.
TABLE = "what string, seed long, replica_id string, record_id string, field string, kind string, pt long, c long, node string, log_seq long, at long, value long, taken_at string, recorded_by string, vtag string, vtext string, author string, element string, status string, removed_pt long, removed_c long, removed_node string, dst string, arrives long, bytes long, fault string"
_NAMES = [(f.split()[0], pa.int64() if f.endswith(" long") else pa.string()) for f in TABLE.split(", ")]
_OF = {
    "log": "seed replica_id record_id field kind pt c node log_seq at value taken_at recorded_by vtag vtext author element status removed_pt removed_c removed_node".split(),
    "state": ["seed", "replica_id", *SHAPE],
    "lost": ["seed", "replica_id", *STAMP],
    "delivery": "seed replica_id dst at arrives bytes fault".split(),
}


def seeds(spark: SparkSession, start: int, count: int, shard: tuple[int, int] = (0, 1)) -> DataFrame:
    """Seeds from start on; of shard (i, n) only each n-th."""
    i, n = shard
    first = start + (i - start) % n
    tasks = max(1, min(count, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(first, start + count, n, tasks).withColumnRenamed("id", "seed")


def played(of: DataFrame, preset: str = "hostile", stuck: bool = False) -> DataFrame:
    """All rows of the seeds' scenarios, generated once: a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                rows = [{"what": what, **r} for what, some in play(scenario(seed, preset), stuck).items() for r in some]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _NAMES], names=[n for n, _ in _NAMES])

    return written(of.select("seed").mapInArrow(run, TABLE), "played")


def rows_of(table: DataFrame, what: str) -> DataFrame:
    """The log, states, losses or deliveries of a played table. Ids are made unique over seeds, so that one query judges a whole sweep."""
    out = table.where(F.col("what") == what).select(*_OF[what])
    for c in ("record_id", "replica_id", "node", "removed_node", "dst"):
        if c in out.columns:
            out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.concat_ws("/", F.col("seed").cast("string"), F.col(c))))
    return out


def _entries(d: DataFrame) -> DataFrame:
    return merge.series(d.withColumn("supersedes", F.lit(None).cast("string")), DEDUP_COLUMNS).drop("supersedes")


#: Reducers by kind of atom. They see atoms with source, the replica they come from, and replica_id, the one that merges them; record ids hold both.
REDUCERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "entry": _entries,
    "observation": merge.register,
    "add": merge.orset_adds,
    "remove": merge.orset_removes,
    "position": lambda d: merge.status(d.withColumn("value", F.col("status")), TOTAL_ORDER).withColumnRenamed("value", "status"),
}


def settled(state: DataFrame, reducers: dict[str, Callable[[DataFrame], DataFrame]] = REDUCERS) -> DataFrame:
    """States after the network has healed: every replica merges its own state with every other's of its seed."""
    names = state.select("seed", "replica_id").distinct().groupBy("seed").agg(F.collect_set("replica_id").alias("names"))
    sent = state.withColumnRenamed("replica_id", "source").join(names, "seed").withColumn("replica_id", F.explode("names")).drop("names")
    held = sent.withColumn("record_id", F.concat_ws("|", "replica_id", "record_id"))
    out = merge.union(*[reduce(held.where(F.col("kind") == kind)).drop("source", "seed", "replica_id").withColumn("kind", F.lit(kind)) for kind, reduce in reducers.items()])
    parts = F.split("record_id", r"\|", 2)
    out = out.withColumn("replica_id", parts[0]).withColumn("record_id", parts[1]).withColumn("seed", F.split(parts[0], "/")[0].cast("bigint"))
    return out.select("seed", "replica_id", *SHAPE)


def audits(log: DataFrame, lost: DataFrame, state: DataFrame) -> DataFrame:
    """All violations of settled states, with their seed."""
    live = state.select("seed", "replica_id").distinct().groupBy("seed").agg(F.sort_array(F.collect_set("replica_id")).alias("live"))
    kept, of = audit.survivors(log, lost), lambda kind: state.where(F.col("kind") == kind)
    none = F.array().cast("array<string>")

    def missing(name: str, kind: str, of_kind: str, key: list[str]) -> DataFrame:
        holders = of(of_kind).groupBy(*key).agg(F.collect_set("replica_id").alias("holders"))
        short = kept.where(F.col("kind") == kind).select("seed", *key).distinct().join(holders, key, "left").join(live, "seed")
        gone = short.select(*key, F.explode(F.array_except("live", F.coalesce("holders", none))).alias("replica_id"))
        return audit.violation(gone, name, F.concat_ws("|", *[F.col(k).cast("string") for k in key if k not in GROUP]))

    removed = of("remove").select("replica_id", *GROUP, *STAMP)
    prints = views.canonical(state, [c for c in SHAPE if c not in GROUP], by=["seed", "replica_id", *GROUP])
    by = prints.groupBy("seed", *GROUP).agg(F.count_distinct("fingerprint").alias("n"), F.count_distinct("replica_id").alias("h"))
    apart = by.join(live, "seed").withColumn("all", F.size("live")).where("n > 1 OR h < all")
    found = audit.check_all(
        missing("no_measurement_lost", "measurement", "entry", [*GROUP, *DEDUP_COLUMNS]),
        missing("no_observation_lost", "register", "observation", [*GROUP, "vtag", "vtext", "author", *STAMP]),
        missing("no_tag_lost", "tag", "add", [*GROUP, "element", *STAMP]),
        audit.no_phantom_measurements(log.where("kind = 'measurement'"), of("entry"), DEDUP_COLUMNS),
        audit.removals_are_honoured(log.where("kind = 'tag_remove'"), lost, of("add").join(removed, ["replica_id", *GROUP, *STAMP], "left_anti")),
        audit.hlc_causality_respected(log),
        audit.no_duplicate_operation_ids(log),
        audit.violation(apart, "all_converged", F.format_string("%d states, on %d of %d replicas", "n", "h", "all"), replica=None),
    )
    whose = F.when(F.col("record_id") != "", F.col("record_id")).otherwise(F.col("replica_id"))
    return found.withColumn("seed", F.split(whose, "/")[0].cast("bigint"))


def judged(table: DataFrame, reducers: dict[str, Callable[[DataFrame], DataFrame]] = REDUCERS) -> DataFrame:
    """The violations in a played table, after settling with the given reducers (settled states are written once)."""
    state = written(settled(rows_of(table, "state"), reducers), "settled")
    return audits(rows_of(table, "log"), rows_of(table, "lost"), state)


def _own(d: DataFrame) -> DataFrame:
    return d.where(F.col("source") == F.col("replica_id"))


def _current_only(d: DataFrame) -> DataFrame:
    best = W.partitionBy(*GROUP).orderBy(*[F.desc(c) for c in (*STAMP, "author", "vtext")])
    return merge.register(d).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def _by_element(d: DataFrame) -> DataFrame:
    """A replica deletes the tags that it knows to be removed from its own state only, and keeps no note of it."""
    return merge.orset_adds(d)


#: Names of the wrong variants. Each is a set of reducers (or the stuck clock, M6) and the invariant that must notice it; None marks a blind spot of the audits.
MUTATIONS: dict[str, tuple[dict, str | None]] = {
    "M1": ({"entry": lambda d: _entries(_own(d))}, "no_measurement_lost"),
    "M2": ({"observation": _current_only}, "no_observation_lost"),
    "M3": ({"entry": lambda d: d.groupBy(*GROUP, *DEDUP_COLUMNS).agg(F.min_by(F.struct(*STAMP), F.struct("pt", "c")).alias("h")).select(*GROUP, *DEDUP_COLUMNS, "h.*")}, None),
    "M3b": ({"observation": lambda d: merge.register(d)}, None),
    "M4": ({"add": _by_element, "remove": lambda d: merge.orset_removes(d).where("false")}, "removals_are_honoured"),
    "M5": ({"entry": lambda d: d.select(*GROUP, *DEDUP_COLUMNS, *STAMP).distinct()}, "no_phantom_measurements"),
    "M6": ({}, "no_duplicate_operation_ids"),
}


def survey(spark: SparkSession, names: tuple[str, ...] = tuple(MUTATIONS), start: int = 1, count: int = 60, preset: str = "hostile") -> DataFrame:
    """(mutation, invariant, n): what the audits find of each wrong variant, over the same seeds; a variant that no audit notices has no row."""
    table, parts = played(seeds(spark, start, count), preset), []
    for name in names:
        wrong, _ = MUTATIONS[name]
        of = played(seeds(spark, start, count), preset, stuck=True) if name == "M6" else table
        parts.append(judged(of, REDUCERS | wrong).groupBy("invariant").agg(F.count("*").alias("n")).select(F.lit(name).alias("mutation"), "invariant", "n"))
    return merge.union(*parts)


def sweep(spark: SparkSession, start: int, count: int, preset: str = "hostile", shard: tuple[int, int] = (0, 1), stop_after: int | None = None, at_once: int = 5_000) -> DataFrame:
    """(seed, n_operations, n_violations) of each seed, some at a time; no more are begun once stop_after seeds have failed."""
    folder, parts, failed = work_dir(spark), [], 0
    for n, first in enumerate(range(start, start + count, at_once)):
        table = played(seeds(spark, first, min(at_once, start + count - first), shard), preset)
        bad = judged(table).groupBy("seed").agg(F.count("*").alias("n_violations"))
        by = table.groupBy("seed").agg(F.count_if(F.col("what") == "log").alias("n_operations"))
        parts.append(written(by.join(bad, "seed", "left").withColumn("n_violations", F.coalesce("n_violations", F.lit(0))), f"part{n}", folder))
        if stop_after is not None:
            failed += parts[-1].where("n_violations > 0").count()
            if failed >= stop_after:
                break
    return merge.union(*parts)


def fault_counts(spark: SparkSession, start: int, count: int, preset: str = "hostile") -> DataFrame:
    return rows_of(played(seeds(spark, start, count), preset), "delivery").groupBy("fault").agg(F.count("*").alias("n"))


def first_failing(results: DataFrame) -> int | None:
    return results.where("n_violations > 0").agg(F.min("seed")).first()[0]


#: What shrinking tries, dimension by dimension: smaller numbers, calmer networks, fewer faults.
SMALLER: dict[str, Callable] = {
    "writes": lambda n: (n // 2, n - 1) if n > 1 else (),
    "devices": lambda n: (2, n - 1) if n > 2 else (),
    "records": lambda n: (1, n - 1) if n > 1 else (),
    "days": lambda n: (1, n // 2) if n > 1 else (),
    "link": lambda n: [x for x in LINKS if list(LINKS).index(x) < list(LINKS).index(n)],
    "crashes": lambda n: (0.0,) if n else (),
    "cuts": lambda n: (0.0,) if n else (),
    "wrong_clocks": lambda n: (0.0,) if n else (),
}


def shrink(s: Scenario, invariant: str, finds: Callable[[Scenario], set[str]], most: int = 300) -> Scenario:
    """A smaller scenario that still violates the same invariant; finds(scenario) gives the invariants that it violates."""
    tries, moved = 0, True
    while moved:
        moved = False
        for name, choices in SMALLER.items():
            for value in choices(getattr(s, name)):
                tries += 1
                if tries > most:
                    return s
                smaller = replace(s, **{name: value})
                if invariant in finds(smaller):
                    s, moved = smaller, True
                    break
    return s


def timeline(s: Scenario, record: str | None = None) -> list[str]:
    """The log of a scenario as lines, of one record if given."""
    found = sorted(play(s)["log"], key=lambda r: (r["at"], r["replica_id"], r["log_seq"]))
    return [f"{r['at']:>12}  {r['replica_id']}  {r['record_id']}.{r['field']}  {r['kind']} at ({r['pt']}, {r['c']})" for r in found if record in (None, r["record_id"])]


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Sweep seeds and audit them.")
    p.add_argument("--preset", choices=sorted(PRESETS), default="hostile")
    p.add_argument("--start", type=int, default=1)
    p.add_argument("--count", type=int, default=20)
    p.add_argument("--shard", default="0/1", help="i/n: only each n-th seed")
    p.add_argument("--stop-after", type=int, help="begin no more seeds after so many have failed")
    p.add_argument("--replay", type=int, help="print the timeline of this seed instead")
    p.add_argument("--record")
    p.add_argument("--failures", help="write failing seeds as JSON to this folder")
    a = p.parse_args(args)
    if a.replay is not None:
        print("\n".join(timeline(scenario(a.replay, a.preset), a.record)))
        return 0
    spark = SparkSession.builder.getOrCreate()
    i, n = map(int, a.shard.split("/"))
    results = sweep(spark, a.start, a.count, a.preset, (i, n), a.stop_after)
    total = results.agg(F.count("*").alias("seeds"), F.sum("n_operations").alias("operations"), F.count_if(F.col("n_violations") > 0).alias("failing")).first()
    print(json.dumps(total.asDict() | {"first_failing": first_failing(results)}))
    if a.failures and total["failing"]:
        results.where("n_violations > 0").write.mode("overwrite").json(a.failures)
    return 1 if total["failing"] else 0


if __name__ == "__main__":
    raise SystemExit(main())
