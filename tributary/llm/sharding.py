"""Sharding: a two-pass external shuffle.

Pass one scatters the records by seeded hashes into buckets that fit in memory; pass two shuffles each bucket (Fisher-Yates) and writes
it. The shard of a record follows from its key and the number of shards alone: the shard whose seeded hash with the key is largest.
One more shard therefore takes records only into itself. A shard is the run of its buckets, so places in it have no gaps.

A bucket is chosen by key and text, so one key that holds many different records still spreads over its shard's buckets; its records are brought into an order that is theirs alone (a hash of all columns). The number of buckets follows
from the shard's bytes (``bucket_bytes``); no task holds more than one bucket in Python. Results depend on the records and the seed only, so a
lost task is redone with the same result.

Cases: a null key has a shard like any other value; a null text has 0 bytes; ties are records equal in every column, which
are interchangeable and keep their number (all of one such record are in one bucket); a very long text is one record, moved whole; empty tables give empty results; an input column named ``shard`` or ``slot`` is replaced,
all others are carried under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import column, documents, dropping_shuffles, work_dir
from .mixing import _row_hash

#: What a record weighs besides its text.
OVERHEAD = 16


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard in 0 to shards - 1 with the largest seeded hash."""
    name = F.coalesce(key.cast("string"), F.lit("\0"))
    score = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.xxhash64(name, i, F.lit(seed)).alias("h"), i.alias("i")))
    return F.array_max(score)["i"]


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of 0 to n - 1."""
    order = np.arange(n)
    draws = np.random.Generator(np.random.PCG64(seed)).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def shuffle_to_shards(df: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", seed: int = 20, bucket_bytes: int = 12 << 20) -> DataFrame:
    """All records of df, whole, with ``shard`` and ``slot``: a table below the shared folder with a folder for each shard and a file for each bucket, in slot order, reread."""
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "slot")]
    record = F.struct(*[column(c).alias(f"f{i}") for i, c in enumerate(names)])  # under names of our own, so that none clashes
    rows = df.select(shard_of(column(key), shards, seed).alias("shard"), column(key).cast("string").alias("key"), column(text).alias("text"), _row_hash(df.select(*map(column, names))).alias("tie"), record.alias("record"))
    totals = {r["shard"]: r["b"] for r in rows.groupBy("shard").agg(F.sum(record_size(F.col("text"))).alias("b")).collect()}  # one row a shard
    pieces = [max(1, -(-totals.get(s, 0) // bucket_bytes)) for s in range(shards)]
    count = F.element_at(F.array(*map(F.lit, pieces)), F.col("shard") + 1)
    place = F.xxhash64(F.lit(seed + 1), F.coalesce("key", F.lit("\0")), "text")
    scattered = rows.select("shard", F.pmod(place, count.cast("bigint")).cast("int").alias("bucket"), "tie", "record")
    schema = T.StructType([*scattered.schema.fields, T.StructField("place", T.LongType())])

    def shuffled(table: pa.Table) -> pa.Table:
        shard, bucket = table["shard"][0].as_py(), table["bucket"][0].as_py()
        canonical = np.argsort(table["tie"].to_numpy(), kind="stable")  # rows with one hash are equal
        order = canonical[fisher_yates(table.num_rows, [seed, shard, bucket])]
        return table.take(pa.array(order)).append_column("place", pa.array(np.arange(table.num_rows), pa.int64()))

    done = scattered.groupBy("shard", "bucket").applyInArrow(shuffled, schema)
    fields = [F.col("record").getField(f"f{i}").alias(f"f{i}") for i in range(len(names))]
    path = f"{work_dir(spark)}/shards"
    flat = done.select(*fields, "place", "bucket", "shard").sortWithinPartitions("shard", "bucket", "place")
    with dropping_shuffles(spark):
        flat.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    stored = spark.read.schema(flat.schema).parquet(path)
    sizes = stored.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")
    starts = sizes.select("shard", "bucket", before.alias("start"))
    return stored.join(starts, ["shard", "bucket"]).select(*[F.col(f"f{i}").alias(c) for i, c in enumerate(names)], "shard", (F.col("start") + F.col("place")).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 and slot, and its shard if there were 41."""
    shards, seed = 40, 20
    done = shuffle_to_shards(documents(spark, sf_dir, "doc_id", "text").select("doc_id", "text", record_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")), shards, seed=seed)
    return done.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"))
