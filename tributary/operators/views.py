"""Views derived from merged atoms: current values, history, members, contested fields, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hlc import encode
from ..functions.scalars import fingerprint
from .merge import ENTRY, GROUP, REGISTER, STAMP


def register_current(merged: DataFrame) -> DataFrame:
    """The observation with the greatest stamp (ties by author and value), how many lost, and whether another author's is among them."""
    order = F.struct(*STAMP, "author", "vtag", "vtext")
    best = merged.groupBy(*GROUP).agg(F.max(order).alias("o"), (F.count("*") - 1).alias("n_losers"), (F.count_distinct("author") > 1).alias("contested"))
    return best.select(*GROUP, "o.*", "n_losers", "contested")


def register_history(merged: DataFrame) -> DataFrame:
    """All other observations, oldest first by position."""
    down = W.partitionBy(*GROUP).orderBy(*[F.desc(c) for c in (*STAMP, "author", "vtag", "vtext")])
    up = W.partitionBy(*GROUP).orderBy(*STAMP, "author", "vtag", "vtext")
    ranked = merged.select(*REGISTER).withColumn("_r", F.row_number().over(down)).withColumn("position", F.row_number().over(up))
    return ranked.where("_r > 1").drop("_r")


def register_contested(merged: DataFrame, strict: bool = False) -> DataFrame:
    """Groups that another author than the current one wrote to. strict: only where the loser's node differs as well, so a hand-over on one device does not count."""
    who = F.col("author") if not strict else F.struct("author", "node")
    by = merged.groupBy(*GROUP).agg(F.count_distinct(who).alias("n"), F.count_distinct("author").alias("a"), F.count_distinct("node").alias("d"))
    return by.where("n > 1 AND a > 1" + (" AND d > 1" if strict else "")).select(*GROUP)


def series_current(merged: DataFrame) -> DataFrame:
    """Entries that no other entry supersedes."""
    gone = merged.where("supersedes IS NOT NULL").select(*GROUP, F.col("supersedes").alias("entry_id")).distinct()
    return merged.withColumn("entry_id", encode()).join(gone, [*GROUP, "entry_id"], "left_anti").select(*ENTRY)


def supersede_forks(merged: DataFrame) -> DataFrame:
    """Entries that several others claim to supersede."""
    return merged.where("supersedes IS NOT NULL").groupBy(*GROUP, "supersedes").agg(F.count("*").alias("n")).where("n > 1")


def dangling_supersedes(merged: DataFrame) -> DataFrame:
    """Entries that supersede one that the merge no longer holds (deduplication kept its twin)."""
    known = merged.select(*GROUP, encode().alias("supersedes"))
    return merged.where("supersedes IS NOT NULL").join(known, [*GROUP, "supersedes"], "left_anti").select(*ENTRY)


def series_positions(merged: DataFrame) -> DataFrame:
    """Entries with their place in the order of stamps."""
    return merged.withColumn("position", F.row_number().over(W.partitionBy(*GROUP).orderBy(*STAMP)))


def orset_live_tags(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """Adds whose tag was not removed."""
    return adds.join(removes.select(*GROUP, *STAMP).distinct(), [*GROUP, *STAMP], "left_anti")


def orset_members(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """Elements with a live tag, and how many."""
    return orset_live_tags(adds, removes).groupBy(*GROUP, "element").agg(F.count("*").alias("n_tags"))


def orset_observed(adds: DataFrame, requests: DataFrame) -> DataFrame:
    """What each removal request (replica_id, group, element, seq) removes: the tags its replica had seen by then (adds with replica_id and seq).

    A removal names an element, but removes only tags that were observed; this turns the request into tags.
    """
    on = ["replica_id", *GROUP, "element"]
    asked = requests.groupBy(*on).agg(F.max("seq").alias("asked_at"))  # the last request has seen what any other has, so no pairs are made
    return adds.join(asked, on).where(F.col("seq") < F.col("asked_at")).select(*REMOVE_COLUMNS).distinct()


REMOVE_COLUMNS = [*GROUP, *STAMP]


def canonical(atoms: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """A digest of the distinct atoms of each group that does not depend on their order: sums of their hashes, so a group of any size is added up before it is shuffled."""
    by = by or GROUP
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    distinct = atoms.select(*by, text.alias("text")).distinct()
    return distinct.groupBy(*by).agg(fingerprint(F.col("text")).alias("fingerprint"), F.count("*").alias("n_atoms"))
