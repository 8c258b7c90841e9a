"""Mixing sources to target weights: systematic sampling.

Targets are filled like connected vessels: each source gets its weight's share until it reaches its limit, and what is over goes to the others by
weight. Within a source the expected copies of its documents are summed up in a fixed order; a document is taken once for
each integer that this sum, plus one random offset of the source, passes in it. Copies are therefore the expectation rounded up or down, and because the order
goes by size, words taken come near the target as well.

The running sum is two-level, so a source with a third of all rows is not one task: rows are dealt into bins (size class and, by the class's number of rows, a hash), counted,
and the sum before each bin is added to the sum within it. All native; texts are scanned once for their sizes, and only ids and sizes are shuffled. The random offset comes from the
seed and the source's name, so reruns agree.

Cases: a null text has size 0; a null source is a source, sorted last; sources without words have target 0 and their documents are taken 0 times;
rows are ordered by size and a hash of all their columns, so ties are rows equal in every column, which are interchangeable (each is taken as often as its place says; all of one such row share a bin);
rows that differ in any column are told apart by that 64-bit hash; a very long text is one document, counted whole; empty tables stay empty; input columns named as outputs of ``copies`` are replaced,
all others are carried under any name. The sources are ranked in one window of one small row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import column, documents, words_in, written

#: Weights of the sources in the order of their code points, null last, repeating.
WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, limit: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    The level at which the vessels stand is found by trying each source, in the order in which they fill, as the first that is not full.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    pattern = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("weight", F.element_at(pattern, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    fill = W.orderBy(F.col("cap") * 1.0 / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    over = fill.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    stood = (
        ranked.withColumn("cap", F.col("source_size") * limit)
        .withColumn("want", F.sum("source_size").over(whole) * percent / 100.0)
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(over), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(over), F.lit(0)))
        .withColumn("level", (F.col("want") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap_before").alias("a"), F.col("level").alias("level")))).over(whole)["level"]
    target = F.when(F.col("free"), F.coalesce(level, F.lit(0.0)) * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return stood.select("source", "source_size", target.alias("target"))


def _row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; maps by their JSON."""
    parts = [F.to_json(F.struct(column(c))) if "map<" in kind or kind == "variant" else column(c) for c, kind in df.dtypes]
    marks = [column(c).isNull() for c in df.columns]
    return F.xxhash64(*parts, *marks)


def _dealt(df: DataFrame, carried: list[str], source: str, text: str, weights: tuple[int, ...], percent: int, limit: int, seed: int, bin_rows: int) -> DataFrame:
    """(row, tie, size, source_size, target, copies): row is a struct of the carried columns as f0, f1 and so on, so that none of their names matters here."""
    fields = [column(c).alias(f"f{i}") for i, c in enumerate(carried)] or [F.lit(0).alias("none")]
    rows = df.select(F.struct(*fields).alias("row"), column(source).alias("source"), words_in(column(text)).alias("size"), _row_hash(df).alias("tie"))
    rows = written(rows.withColumn("level", F.floor(F.log2(F.col("size") + 1) * 4)), "sizes")  # texts are scanned once
    cells = rows.groupBy("source", "level").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = cells.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(found, weights, percent, limit)
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    plan = cells.alias("a").join(aims.alias("b"), same).select(
        "a.source",
        "level",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        F.ceil(F.col("n") / F.lit(bin_rows)).alias("bins"),
        (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("a.source", F.lit("\0"))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)).alias("offset"),
    )
    dealt = rows.alias("a").join(plan.alias("b"), same & (F.col("a.level") == F.col("b.level"))).select("a.*", "source_size", "target", "rate", "offset", F.pmod("tie", "bins").alias("bin"))
    where = ["source", "level", "bin"]
    before = F.sum("n").over(W.partitionBy("source").orderBy("level", "bin")) - F.col("n")
    starts = dealt.groupBy(*where).agg(F.count("*").alias("n")).select(*where, before.alias("start"))
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy(*where).orderBy("size", "tie")))
    placed = ranked.alias("a").join(starts.alias("b"), same & (F.col("a.level") == F.col("b.level")) & (F.col("a.bin") == F.col("b.bin"))).select("a.*", "start")
    upto = (F.col("start") + F.col("rank")) * F.col("rate") + F.col("offset")
    upfrom = (F.col("start") + F.col("rank") - 1) * F.col("rate") + F.col("offset")
    return placed.select("row", "tie", "size", "source_size", "target", F.least(F.floor(upto) - F.floor(upfrom), F.lit(limit)).cast("bigint").alias("copies"))


def copies(df: DataFrame, source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, percent: int = 150, limit: int = 2, seed: int = 4, bin_rows: int = 10_000) -> DataFrame:
    """df without its text, and size, source_size, target, copies and taken (copies times size)."""
    added = ["size", "source_size", "target", "copies", "taken"]
    carried = [c for c in df.columns if c != text and c not in added]
    out = _dealt(df, carried, source, text, weights, percent, limit, seed, bin_rows)
    fields = [F.col("row").getField(f"f{i}").alias(c) for i, c in enumerate(carried)]
    return out.select(*fields, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(df: DataFrame, source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, percent: int = 150, limit: int = 2, seed: int = 4, bin_rows: int = 10_000) -> DataFrame:
    """The mixture itself: every row of df as often as it is taken. Rows that are equal in all columns count as one that has their copies."""
    often = _dealt(df, [], source, text, weights, percent, limit, seed, bin_rows).groupBy("tie").agg(F.sum("copies").cast("int").alias("n")).where("n > 0")
    one = df.select(_row_hash(df).alias("tie"), F.struct(*map(column, df.columns)).alias("row")).groupBy("tie").agg(F.first("row").alias("row"))
    both = one.join(often, "tie").select(F.explode(F.array_repeat("row", F.col("n"))).alias("row"))
    return both.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mixture takes."""
    return copies(documents(spark, sf_dir, "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and target of every source, and how many documents the mixture takes at most twice."""
    rows = copies(documents(spark, sf_dir, "doc_id", "source", "text"))
    limit = F.count_if((F.col("taken") < 0) | (F.col("taken") > 2 * F.col("size")))
    return rows.groupBy("source").agg(F.max("source_size").alias("source_size"), F.round(F.max("target"), 6).alias("target"), F.count("*").alias("n_documents"), limit.alias("n_beyond"))
