"""Identity: forwarding of merged records at read time, match keys, and a Bloom filter of keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from . import views


def forwarding_of(decisions: DataFrame) -> DataFrame:
    """Forwarding pointers (record_id, target) from concurrent decisions, which are registers: the greatest stamp wins everywhere."""
    return views.register_current(decisions).select("record_id", F.col("vtext").alias("target"))


def resolve(pointers: DataFrame) -> DataFrame:
    """(record_id, survivor, hops) of every id that forwards, transitively. Ids on a cycle or leading into one have no survivor (null).

    Pointer doubling: after round k each open walk has made 2^k hops, so a chain of n merges takes log2(n) joins. A walk that is open after more hops
    than there are ids is on a cycle. Each round is checkpointed to files, and stored rows are never rewritten.
    """
    pointers = written(pointers.select("record_id", "target").where("record_id IS NOT NULL").distinct())
    ids = pointers.select("record_id").distinct()
    n = ids.count()
    known = ids.withColumnRenamed("record_id", "known")
    at = F.col("at") == F.col("known")
    step = pointers.select("record_id", F.col("target").alias("at"), F.lit(1).cast("long").alias("hops"))
    ended = step.join(known, at, "left_anti")
    step = written(step.join(known, at, "left_semi"))
    done, hops = written(ended), 1
    while hops <= n and step.limit(1).count():
        # the second half of a walk is one of the walks of this round, ended or open
        every = done.unionByName(step).select(F.col("record_id").alias("known"), F.col("at").alias("end"), F.col("hops").alias("more"))
        both = step.join(every, at).select("record_id", F.col("end").alias("at"), (F.col("hops") + F.col("more")).alias("hops")).groupBy("record_id", "at").agg(F.min("hops").alias("hops"))
        both = written(both)
        done = written(done.unionByName(both.join(known, at, "left_anti")).groupBy("record_id", "at").agg(F.min("hops").alias("hops")))
        step = written(both.join(known, at, "left_semi"))
        hops *= 2
    ends = done.groupBy("record_id").agg(F.min("at").alias("survivor"), F.min("hops").cast("int").alias("hops"))
    return ids.join(ends, "record_id", "left").select("record_id", "survivor", "hops")


def cycles(pointers: DataFrame) -> DataFrame:
    """Ids that reach no survivor: decisions to refuse."""
    return resolve(pointers).where("survivor IS NULL").select("record_id")


def resolved(atoms: DataFrame, pointers: DataFrame) -> DataFrame:
    """A view of atoms under their survivors' ids; the ordinary merge then joins the records and loses nothing."""
    to = resolve(pointers).where("survivor IS NOT NULL").select("record_id", "survivor")
    return atoms.join(to, "record_id", "left").withColumn("record_id", F.coalesce("survivor", "record_id")).drop("survivor")


def collisions(records: DataFrame, match_key: Column) -> DataFrame:
    """(match_key, n, record_ids) of keys that several records share. The key is the caller's and opaque."""
    keyed = records.select("record_id", match_key.alias("match_key")).where("match_key IS NOT NULL")
    both = keyed.groupBy("match_key").agg(F.array_join(F.sort_array(F.collect_set("record_id")), ",").alias("record_ids"), F.count_distinct("record_id").alias("n"))
    return both.where("n > 1").select("match_key", "n", "record_ids")


def _bits(key: str, bits: int, hashes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in range(hashes)])


def bloom_size(n: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a filter of n keys that lets about rate of other keys pass; bits are whole parts of 32768."""
    bits = max(1, -(-int(-n * math.log(rate) / math.log(2) ** 2) // 32768)) * 32768
    return bits, max(1, round(bits / max(1, n) * math.log(2))) if n else 1


def bloom_build(keys: DataFrame, key: str = "match_key", rate: float = 0.01, most_hashes: int = 16) -> DataFrame:
    """(bucket, bitmap, bits, hashes): a Bloom filter in parts of 32768 bits, sized by the number of distinct keys. No key is missed; of other keys about rate pass."""
    distinct = keys.where(F.col(key).isNotNull()).select(key).distinct()
    bits, hashes = bloom_size(distinct.count(), rate)
    hashes = min(hashes, most_hashes)
    spots = distinct.select(F.explode(_bits(key, bits, hashes)).alias("bit"))
    parts = spots.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    return parts.withColumn("bits", F.lit(bits).cast("bigint")).withColumn("hashes", F.lit(hashes))


#: A filter of at most so many bits (16 MB) is broadcast; a larger one is joined by its parts.
BROADCAST_BITS = 1 << 27


def bloom_probe(keys: DataFrame, filter_: DataFrame, key: str = "match_key") -> DataFrame:
    """Distinct keys that may be in the filter."""
    size = filter_.select("bits", "hashes").first()
    if size is None:
        return keys.select(key).where("false")
    bits, hashes = size
    spots = keys.where(F.col(key).isNotNull()).select(key).distinct().select(key, F.explode(_bits(key, bits, hashes)).alias("bit"))
    where = F.bitmap_bit_position("bit").cast("int")
    side = filter_.select("bucket", "bitmap")
    found = spots.withColumn("bucket", F.bitmap_bucket_number("bit")).join(F.broadcast(side) if bits <= BROADCAST_BITS else side, "bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (where / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    on = F.coalesce(F.getbit(byte, (where % 8).cast("int")) == 1, F.lit(False))
    return found.groupBy(key).agg(F.bool_and(on).alias("maybe")).where("maybe").select(key)
