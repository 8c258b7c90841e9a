"""Streaming merges and clocks.

Replicas deliver late, twice and out of order, and no write may disappear. So there is no watermark on a merge stream: late data is ordinary data and results are re-emitted. Device time
is skewed by days and is never an event time. Each lattice's reducer is an aggregate, so a streaming merge is the same group-by in update mode; a merge into a table is an
idempotent upsert by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.merge import ADD, ENTRY, GROUP, REGISTER, REMOVE, STAMP, mask, unmask
from ..schema import StatusOrder


def read_log(spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int | None = None, pattern: str = "*.parquet") -> DataFrame:
    """A log folder as a stream: new Parquet files whose name fits the pattern are new operations."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def series(entries: DataFrame, dedup_on: tuple[str, ...]) -> DataFrame:
    """Streaming series merge: the entry with the least stamp of each key. State grows with distinct keys, and only with them."""
    rest = [c for c in ENTRY if c not in (*GROUP, *dedup_on, *STAMP, "supersedes")]
    first = F.min(F.struct(*STAMP, "supersedes", *rest)).alias("e")
    return entries.groupBy(*GROUP, *dedup_on).agg(first).select(*GROUP, *dedup_on, *[f"e.{c}" for c in (*STAMP, "supersedes", *rest)])


def register_current(observations: DataFrame) -> DataFrame:
    """Streaming current value: the observation with the greatest stamp."""
    best = F.max(F.struct(*STAMP, "author", "vtag", "vtext")).alias("o")
    return observations.groupBy(*GROUP).agg(best).select(*GROUP, "o.*")


def status(positions: DataFrame, order: StatusOrder) -> DataFrame:
    both = positions.groupBy(*GROUP).agg(F.bit_and(mask(F.col("value"), order)).alias("m"))
    return both.select(*GROUP, unmask(F.col("m"), order).alias("value"))


def vector(stamps: DataFrame) -> DataFrame:
    """Streaming version vectors."""
    return stamps.groupBy("replica_id", "node").agg(F.max(F.struct("pt", "c")).alias("h")).select("replica_id", "node", "h.*")


KEYS = {"entries": ENTRY, "observations": REGISTER, "adds": ADD, "removes": REMOVE, "elements": [*GROUP, "element"], "positions": [*GROUP, "value"], "seen": STAMP}


#: Folders of a table of atoms, by a hash of their record.
PARTS = 64


def upsert(kind: str, path: str, parts: int = PARTS):
    """A foreachBatch function that adds the atoms of a batch which the table at path lacks. A batch that is run again adds nothing.

    The table is in folders by a hash of the record, so a batch is compared with the folders that it touches and with no others.
    """
    key = KEYS[kind]
    by = F.pmod(F.xxhash64("record_id" if "record_id" in key else key[-1]), F.lit(parts)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*key).distinct().withColumn("part", by)
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most as many as there are folders
        try:
            have = spark.read.parquet(path).where(F.col("part").isin(touched))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            have = None
        if have is not None:
            same = [F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*key, "part")]
            condition = same[0]
            for s in same[1:]:
                condition = condition & s
            new = new.alias("n").join(have.alias("h"), condition, "left_anti")
        new.write.mode("append").partitionBy("part").parquet(path)

    return write


def merge_into(stream: DataFrame, kind: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Ingest a stream of atoms into a table of distinct ones; persisted before it is acknowledged, by the checkpoint."""
    writer = stream.writeStream.foreachBatch(upsert(kind, path)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


CLOCK_OUT = "node string, i long, pt long, c long"


def clock_step(events: pd.DataFrame, last: tuple[int, int] | None) -> tuple[pd.DataFrame, tuple[int, int]]:
    """The stamps of a node's events (node, i, phys, rpt, rc; null for a send) after its last stamp, and the new last one: the closed form of the replay on whole columns."""
    events = events.sort_values("i", kind="stable")
    pt0, c0 = last or (0, -1)
    rpt, rc = events["rpt"].fillna(-1).to_numpy("int64"), events["rc"].fillna(-1).to_numpy("int64")
    pt = np.maximum.accumulate(np.maximum(np.maximum(events["phys"].to_numpy("int64"), rpt), pt0))
    begin = np.flatnonzero(np.append(True, pt[1:] != pt[:-1]))
    run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(pt))))
    k = np.arange(len(pt)) - begin[run]
    least = np.where(pt == 0, 1, 0)
    least = np.where((run == 0) & (pt == pt0), np.maximum(least, c0 + 1), least)  # the first run may go on from the last stamp
    lift = np.maximum(least, np.where(rpt == pt, rc + 1 - k, 0))
    wide = int(lift.max()) + 1
    c = k + np.maximum.accumulate(lift + run * wide) - run * wide  # a running maximum within each run
    return pd.DataFrame({"node": events["node"].to_numpy(), "i": events["i"].to_numpy("int64"), "pt": pt, "c": c}), (int(pt[-1]), int(c[-1]))


class _Clock(StatefulProcessor):
    """One state of two numbers a node."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "pt long, c long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, last = clock_step(pd.concat(list(rows)), tuple(self.last.get()) if self.last.exists() else None)
        self.last.update(last)
        yield out

    def close(self) -> None:
        pass


def clocks(events: DataFrame) -> DataFrame:
    """Streaming clock replay of (node, i, phys, rpt, rc; null for a send). It needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    return events.groupBy("node").transformWithStateInPandas(_Clock(), CLOCK_OUT, "Append", "None")


def connectivity(stream: DataFrame, time: str = "ingest_ts", gap: str = "2 hours", delay: str = "1 day") -> DataFrame:
    """Session windows of a replica's traffic by arrival time. The only place with a watermark: it is a report, not a merge."""
    return stream.withWatermark(time, delay).groupBy("replica_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select("replica_id", F.col("w.start").alias("first_at"), F.col("w.end").alias("until"), "n")



