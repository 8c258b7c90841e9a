"""Hybrid logical clocks as column expressions.

A stamp is three flat columns (pt, c, node). Its one order is that of the struct of the three; the encoded text is for output only, because its fixed widths stop
preserving order for large parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shared import written

#: Digits of the two numbers in the encoded form.
PT_DIGITS, C_DIGITS = 16, 10


def stamp(prefix: str = "") -> Column:
    """The comparable form: a struct of pt, c, node."""
    return F.struct(F.col(f"{prefix}pt").alias("pt"), F.col(f"{prefix}c").alias("c"), F.col(f"{prefix}node").alias("node"))


def encode(prefix: str = "") -> Column:
    """pt and c zero-padded, then the node as it is; wider numbers are not cut."""
    return F.format_string(f"%0{PT_DIGITS}d:%0{C_DIGITS}d:%s", F.col(f"{prefix}pt"), F.col(f"{prefix}c"), F.col(f"{prefix}node"))


def decode(text: Column) -> Column:
    """struct(pt, c, node) of an encoded stamp; the node may hold colons."""
    parts = F.split(text, ":", 3)
    return F.struct(parts[0].cast("bigint").alias("pt"), parts[1].cast("bigint").alias("c"), parts[2].alias("node"))


def reject_reason(prefix: str = "") -> Column:
    """Why a stamp is invalid, or null."""
    pt, c, node = (F.col(f"{prefix}{x}") for x in ("pt", "c", "node"))
    return (
        F.when(pt.isNull() | c.isNull() | node.isNull(), "stamp is incomplete")
        .when(pt < 0, "physical time is negative")
        .when(c < 0, "counter is negative")
        .when(node == "", "node is empty")
    )


def replay(events: DataFrame, order: str = "i", node: str = "node", phys: str = "phys", remote_pt: str | None = None, remote_c: str | None = None) -> DataFrame:
    """events with the (pt, c) their clock issues: sends, and receives where a remote stamp is given.

    A closed form instead of a fold: the physical part is a running maximum; within a run of equal physical parts each event adds one to the counter and a remote
    of the same part lifts it above its own. No UDF. Both are found in two levels, as one node may hold most events: events are dealt by ranges of (node, order) into blocks, which are written;
    a block's own maximum, and how often its first and last physical part occur, are carried over to the blocks that follow (two rows a block), and windows stay within a block.
    """
    cut = events.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = written(events.repartitionByRange(int(cut), node, order).withColumn("_b", F.spark_partition_id()), "blocks")
    block = [node, "_b"]
    seen = F.greatest(F.lit(0).cast("bigint"), F.col(phys), *([F.col(remote_pt)] if remote_pt else []))
    earlier = W.partitionBy(node).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    floor = rows.groupBy(*block).agg(F.max(seen).alias("_m")).withColumn("_m", F.coalesce(F.max("_m").over(earlier), F.lit(0).cast("bigint")))
    upto = W.partitionBy(*block).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(floor, block).withColumn("pt", F.greatest("_m", F.max(seen).over(upto))).drop("_m")
    run = W.partitionBy(*block, "pt").orderBy(order)
    out = out.withColumn("_k", (F.row_number().over(run) - 1).cast("bigint"))
    lift = F.when(F.col(remote_pt) == F.col("pt"), F.col(remote_c) + 1 - F.col("_k")) if remote_pt else F.lit(None).cast("bigint")
    out = out.withColumn("_l", F.max(lift).over(run.rowsBetween(W.unboundedPreceding, 0)))
    ends = out.groupBy(*block).agg(F.min("pt").alias("_first"), F.max("pt").alias("_last"))
    edges = out.join(ends, block).where("pt = _first OR pt = _last").groupBy(*block, "pt").agg(F.count("*").alias("_n"), F.max("_l").alias("_top"))
    before = W.partitionBy(node, "pt").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = edges.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint"))).withColumn("_lifted", F.max(F.col("_top") - F.col("_base")).over(before))
    both = out.join(carried.select(*block, "pt", "_base", "_lifted"), [*block, "pt"], "left").withColumn("_base", F.coalesce("_base", F.lit(0).cast("bigint")))
    least = F.when(F.col("pt") == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    c = F.col("_base") + F.col("_k") + F.greatest(least, F.col("_lifted"), F.col("_l") - F.col("_base"))
    return both.withColumn("c", c).drop("_b", "_k", "_l", "_base", "_lifted")


def transcript_mismatches(computed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Steps of a clock transcript whose stamp differs from what is expected (expect_pt, expect_c, expect_node)."""
    return computed.join(expected, keys).where((stamp() != stamp("expect_")) | F.col("expect_pt").isNull())


def device_clock(now: Column, offset: Column, drift_per_day: Column, jumps: Column) -> Column:
    """What a distorted device clock shows: now, its offset, drift for each day (rounded toward zero) and the jumps due; never below zero.

    jumps: array of structs (at, delta).
    """
    due = F.aggregate(F.filter(jumps, lambda j: j["at"] <= now), F.lit(0).cast("bigint"), lambda a, j: a + j["delta"])
    drift = (drift_per_day * (now / F.lit(86_400_000.0))).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), now + offset + drift + due)
