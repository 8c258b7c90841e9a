"""The driver's tables as atoms: select-only, one event one stamp.

events: record r0 to r9 by user, node by event, field by type; each event is copied to the replicas that hold it (A: every second, B: every third, C: all). Values and days are
coarse so that keys collide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hlc import encode
from ..functions.scalars import tagged
from ..operators.merge import GROUP, STAMP

#: The field that each type of event writes.
FIELD_OF = {"view": "m_a", "click": "m_b", "purchase": "d_a", "signup": "st_a", "error": "set_a"}
REPLICAS = ("A", "B", "C")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event, with its stamp, author, day, coarse value and field."""
    return shaped(table(spark, sf_dir, "events"))


def shaped(raw: DataFrame) -> DataFrame:
    """events() of the events table, or of a stream of it."""
    fields = F.create_map(*[F.lit(x) for pair in FIELD_OF.items() for x in pair])
    return raw.select(
        "event_id",
        "user_id",
        F.concat(F.lit("r"), F.col("user_id") % 10).alias("record_id"),
        F.element_at(fields, F.col("event_type")).alias("field"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("pt"),
        (F.col("event_id") % 1000).alias("c"),
        F.concat(F.lit("dev_"), F.col("event_id") % 5).alias("node"),
        F.concat(F.lit("w"), F.col("user_id") % 3).alias("author"),
        F.date_format("ts", "yyyy-MM-dd").alias("taken_at"),
        F.floor(F.col("value") / 10).cast("bigint").alias("value"),
    )


def replicated(rows: DataFrame) -> DataFrame:
    """A row for each replica that holds the event."""
    held = F.array_compact(F.array(F.when(F.col("event_id") % 2 == 0, "A"), F.when(F.col("event_id") % 3 == 0, "B"), F.lit("C")))
    return rows.withColumn("replica_id", F.explode(held))


def entries(spark: SparkSession, sf_dir: str, links: bool = False) -> DataFrame:
    """Series entries of m_a and m_b. links: each eleventh supersedes the one before, or before that, so that chains and forks occur."""
    rows = events(spark, sf_dir).where("field IN ('m_a', 'm_b')").withColumn("recorded_by", F.col("author"))
    if links:
        order = W.partitionBy(*GROUP).orderBy(*STAMP)
        # two windowed looks back in one sort
        rows = rows.withColumn("id", encode()).withColumn("supersedes", F.when(F.col("event_id") % 11 == 0, F.lag("id").over(order)).when(F.col("event_id") % 11 == 5, F.lag("id", 2).over(order))).drop("id")
    else:
        rows = rows.withColumn("supersedes", F.lit(None).cast("string"))
    return replicated(rows).select("replica_id", *GROUP, "value", "taken_at", "recorded_by", *STAMP, "supersedes")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of d_a; each seventh event clears it."""
    rows = events(spark, sf_dir).where("field = 'd_a'").withColumn("t", tagged(F.when(F.col("event_id") % 7 != 0, F.col("value")), "int"))
    return replicated(rows).select("replica_id", *GROUP, "t.vtag", "t.vtext", "author", *STAMP)


def orset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(adds, removes) of set_a: each fourth event removes the newest tag of its element in its record that came before it."""
    rows = events(spark, sf_dir).where("field = 'set_a'").withColumn("element", F.concat(F.lit("t"), F.col("user_id") % 7))
    before = W.partitionBy(*GROUP, "element").orderBy(*STAMP).rowsBetween(W.unboundedPreceding, -1)
    adding = F.col("event_id") % 4 != 0
    rows = rows.withColumn("seen", F.max(F.when(adding, F.struct(*STAMP))).over(before))
    adds = replicated(rows.where(adding)).select("replica_id", *GROUP, "element", *STAMP)
    removes = replicated(rows.where(~adding & F.col("seen").isNotNull())).select("replica_id", *GROUP, "seen.*")
    return adds, removes


def positions(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("s0", "s1", "s2", "s3"), by_user: bool = False) -> DataFrame:
    """Status positions of st_a; by_user: a record for each user, so that some hold few."""
    value = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    rows = events(spark, sf_dir).where("field = 'st_a'").withColumn("value", value)
    if by_user:
        rows = rows.withColumn("record_id", F.concat(F.lit("u"), "user_id"))
    return replicated(rows).select("replica_id", *GROUP, "value")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grow-only set g_a of all events' kinds of element."""
    rows = events(spark, sf_dir).withColumn("field", F.lit("g_a")).withColumn("element", F.concat(F.lit("g"), F.col("event_id") % 50))
    return replicated(rows).select("replica_id", *GROUP, "element")


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation log: each event at the replica where it was written, in the order of event ids."""
    rows = events(spark, sf_dir).withColumn("replica_id", F.concat(F.lit("R"), F.col("event_id") % 5)).withColumnRenamed("author", "recorded_by")
    return rows.select("replica_id", *GROUP, F.col("event_id").alias("log_seq"), "value", "taken_at", "recorded_by", *STAMP, "event_id", "user_id")


def lineitem_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as entries: order and line number are the key, the shipping date the stamp."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("record_id"),
        F.col("l_linenumber").cast("string").alias("field"),
        F.floor("l_extendedprice").cast("bigint").alias("value"),
        F.col("l_returnflag").alias("taken_at"),
        F.col("l_linestatus").alias("recorded_by"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("pt"),
        F.col("l_partkey").alias("c"),
        F.col("l_suppkey").cast("string").alias("node"),
        F.lit(None).cast("string").alias("supersedes"),
    )


def customer_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as registers of two replicas: the table, and a copy in which every tenth moved to another segment."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record_id"), F.lit("segment").alias("field"), F.lit("3str").alias("vtag"), F.col("c_mktsegment").alias("vtext"), F.lit("office").alias("author"), F.lit(1000).cast("bigint").alias("pt"), F.lit(0).cast("bigint").alias("c"), F.lit("hq").alias("node"), "c_custkey")
    moved = base.where("c_custkey % 10 = 0").withColumn("vtext", F.concat(F.lit("MOVED_"), "vtext")).withColumn("author", F.lit("field")).withColumn("pt", F.lit(999).cast("bigint") + F.col("c_custkey") % 3).withColumn("node", F.lit("tablet"))
    return base.withColumn("replica_id", F.lit("A")).unionByName(moved.withColumn("replica_id", F.lit("B"))).drop("c_custkey")
