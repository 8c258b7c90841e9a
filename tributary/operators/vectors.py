"""Version vectors and seen-sets as rows (replica_id, node, pt, c): building, joining, comparing, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .merge import STAMP, union

ENTRY = ["replica_id", "node", "pt", "c"]


def build(seen: DataFrame) -> DataFrame:
    """The greatest stamp of each node that each replica has seen. Repeated entries of a node give their maximum, not the last."""
    best = seen.groupBy("replica_id", "node").agg(F.max(F.struct("pt", "c")).alias("h"))
    return best.select("replica_id", "node", "h.pt", "h.c")


def join(*vectors: DataFrame) -> DataFrame:
    """Pointwise maximum of vectors, whatever replica they are of."""
    best = union(*vectors).groupBy("node").agg(F.max(F.struct("pt", "c")).alias("h"))
    return best.select("node", "h.pt", "h.c")


def join_maps(a, b):
    """join() of two wire forms, maps from node to struct(pt, c)."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))


def to_map(vectors: DataFrame) -> DataFrame:
    """The wire form: one map a replica."""
    return vectors.groupBy("replica_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("node", F.struct("pt", "c").alias("h"))))).alias("vector"))


def from_map(wire: DataFrame) -> DataFrame:
    return wire.select("replica_id", F.explode("vector").alias("node", "h")).select("replica_id", "node", "h.pt", "h.c")


def has_seen(vectors: DataFrame, stamps: DataFrame) -> DataFrame:
    """stamps with covered: at or below the replica's entry. A summary only: it does not say that the stamp was received."""
    v = vectors.select("replica_id", "node", F.struct("pt", "c").alias("h"))
    found = stamps.join(v, ["replica_id", "node"], "left")
    return found.withColumn("covered", F.coalesce(F.struct("pt", "c") <= F.col("h"), F.lit(False))).drop("h")


def compare(vectors: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(mine, theirs, dominates, dominated, concurrent) for the given ordered pairs of replicas (mine, theirs), or for all.

    A vector dominates another if it is at or above it at as many nodes as that has; entries meet by node, and only those of pairs that are asked for.
    """
    ids = vectors.select("replica_id").distinct()
    if pairs is None:  # a matrix is asked for, so there is a row for each pair anyway
        pairs = ids.selectExpr("replica_id AS mine").crossJoin(ids.selectExpr("replica_id AS theirs")).where("mine <> theirs")
    pairs = pairs.select("mine", "theirs").distinct()
    sizes = vectors.groupBy("replica_id").agg(F.count("*").alias("n"))
    entries = vectors.select("replica_id", "node", F.struct("pt", "c").alias("h"))
    own = entries.select(F.col("replica_id").alias("mine"), "node", F.col("h").alias("m"))
    met = pairs.join(own, "mine").join(entries.select(F.col("replica_id").alias("theirs"), "node", "h"), ["theirs", "node"])
    counts = met.groupBy("mine", "theirs").agg(F.count_if(F.col("m") >= F.col("h")).alias("above"), F.count_if(F.col("m") <= F.col("h")).alias("below"))
    nothing = F.lit(0).cast("bigint")
    known = pairs.join(sizes.selectExpr("replica_id AS mine", "n AS n_mine"), "mine").join(sizes.selectExpr("replica_id AS theirs", "n AS n_theirs"), "theirs").join(counts, ["mine", "theirs"], "left")
    out = known.select("mine", "theirs", (F.coalesce("above", nothing) == F.col("n_theirs")).alias("dominates"), (F.coalesce("below", nothing) == F.col("n_mine")).alias("dominated"))
    return out.withColumn("concurrent", ~F.col("dominates") & ~F.col("dominated"))


def missing_from(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(node, pt, c) where mine trails theirs: the point mine has, null if it has nothing of the node."""
    m = mine.select("node", "pt", "c", F.struct("pt", "c").alias("m"))
    t = theirs.select("node", F.struct("pt", "c").alias("t"))
    return t.join(m, "node", "left").where("m IS NULL OR m < t").select("node", "pt", "c")


def seen_join(*seen: DataFrame) -> DataFrame:
    return union(*(s.select(*STAMP) for s in seen)).distinct()


def contiguous(numbered: DataFrame, by: list[str], number: str = "seq") -> DataFrame:
    """The highest number that is reached without a gap from 1, of each key; keys without 1 are at 0.

    Islands: in a run without gaps the number less its rank does not change.
    """
    rows = numbered.select(*by, number).distinct()
    rank = F.row_number().over(W.partitionBy(*by).orderBy(number))
    marked = rows.withColumn("_first", F.col(number) - rank == 0)
    return marked.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("_first"), F.col(number))), F.lit(0)).alias("watermark"), F.max(number).alias("highest"))


def gaps(numbered: DataFrame, by: list[str], number: str = "seq") -> DataFrame:
    """(first, last) of the numbers missing between those that are there."""
    rows = numbered.select(*by, number).distinct()
    before = F.coalesce(F.lag(number).over(W.partitionBy(*by).orderBy(number)), F.lit(0))
    return rows.withColumn("_p", before).where(F.col(number) > F.col("_p") + 1).select(*by, (F.col("_p") + 1).alias("first"), (F.col(number) - 1).alias("last"))
