"""Reports over logs of transfers, windows and signals, and scheduling within byte budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def success_rate(sessions: DataFrame) -> DataFrame:
    """(n, n_ok, permille) of sync sessions (ok boolean)."""
    out = sessions.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))
    return out.withColumn("permille", F.floor(F.col("n_ok") * 1000 / F.col("n")).cast("bigint"))


def bytes_per_record(transfers: DataFrame) -> DataFrame:
    """Median and 95th percentile of bytes a record (bytes, n_records)."""
    return transfers.where("n_records > 0").agg(F.percentile(F.col("bytes") / F.col("n_records"), F.array(F.lit(0.5), F.lit(0.95))).alias("p")).select(F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


def time_to_converge(events: DataFrame) -> DataFrame:
    """For each number of days, how many records had converged by then (record_id, written_day, converged_day)."""
    took = events.withColumn("days", F.col("converged_day") - F.col("written_day")).groupBy("days").agg(F.count("*").alias("n"))
    return took.select("days", "n", F.sum("n").over(W.orderBy("days")).alias("n_by_then"))


def retransmission(chunks: DataFrame) -> DataFrame:
    """Chunks sent against distinct chunks, by session (session_id, chunk)."""
    return chunks.groupBy("session_id").agg(F.count("*").alias("n_sent"), F.count_distinct("chunk").alias("n_chunks"))


def windows_to_drain(items: DataFrame, budget: int, by: str = "replica_id") -> DataFrame:
    """How many connectivity windows of budget bytes each backlog needs, items sent by lane, then seq (lane, seq, bytes). An item begins in the window where its running total stands."""
    order = W.partitionBy(by).orderBy("lane", "seq")
    sent = items.withColumn("upto", F.sum("bytes").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return sent.groupBy(by).agg(F.sum("bytes").alias("bytes"), F.ceil(F.max("upto") / F.lit(budget)).cast("bigint").alias("n_windows"))


def schedule(items: DataFrame, budget: int, bulk_share: int = 0, by: str = "window_id", bulk_lane: int = 3) -> DataFrame:
    """Items that fit a window by strict priority of lanes (0 first), with bulk_share percent of it kept for the bulk lane."""
    bulk = F.col("lane") >= bulk_lane
    room = F.when(bulk, F.lit(budget * bulk_share // 100)).otherwise(F.lit(budget - budget * bulk_share // 100))
    order = W.partitionBy(by, bulk).orderBy("lane", "seq").rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("upto", F.sum("bytes").over(order)).where(F.col("upto") <= room)


def concurrency_rate(log: DataFrame) -> DataFrame:
    """(n_records, n_shared): records that several nodes wrote to."""
    return log.groupBy("record_id").agg(F.count_distinct("node").alias("n")).agg(F.count("*").alias("n_records"), F.count_if(F.col("n") >= 2).alias("n_shared"))


def fault_counts(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("fault").agg(F.count("*").alias("n"))


def sessions(log: DataFrame, gap_ms: int) -> DataFrame:
    """Connectivity windows from observed traffic: runs of events of a replica with no pause beyond gap_ms."""
    order = W.partitionBy("replica_id").orderBy("pt")
    new = F.when(F.col("pt") - F.lag("pt").over(order) > gap_ms, 1).otherwise(0)
    numbered = log.withColumn("_n", new).withColumn("session", F.sum("_n").over(order.rangeBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("replica_id", "session").agg(F.min("pt").alias("first_pt"), F.max("pt").alias("last_pt"), F.count("*").alias("n"))


def provenance(log: DataFrame) -> DataFrame:
    """Stamps to which several authors lay claim: attribution is fixed at the write."""
    return log.groupBy("pt", "c", "node").agg(F.count_distinct("author").alias("n")).where("n > 1").select("pt", "c", "node", "n")


def blobs(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Content-addressed payloads: one row for each digest. Records refer to the digest and merge without the payload."""
    return rows.withColumn("digest", F.sha2(payload, 256)).groupBy("digest").agg(F.first(payload).alias(payload), F.first(F.octet_length(payload)).cast("bigint").alias("bytes"), F.count("*").alias("n_refs"))


def can_carry(transfers: DataFrame, windows: DataFrame) -> DataFrame:
    """transfers (link, at, ms) with carried: whether one window of their link (opens, closes) is open from at until the transfer ends. Windows of a link do not overlap.

    The window that counts is the last to open by then, so transfers and windows are put in one order by link; nothing is joined by range.
    """
    both = transfers.withColumn("kind", F.lit(1)).unionByName(windows.select("link", F.col("opens").alias("at"), "closes", F.lit(0).alias("kind")), allowMissingColumns=True)
    until = F.last("closes", ignorenulls=True).over(W.partitionBy("link").orderBy("at", "kind"))
    marked = both.withColumn("until", until).where("kind = 1")
    return marked.withColumn("carried", F.coalesce(F.col("at") + F.col("ms") <= F.col("until"), F.lit(False))).drop("kind", "closes", "until")


def backoff(attempts: DataFrame, base_ms: int = 500, cap_ms: int = 60_000) -> DataFrame:
    """attempts (session_id, attempt from 0) with wait_ms: the doubled wait, capped, of which half is fixed and half spread by a hash, so that sessions do not retry at once and reruns agree."""
    most = F.least(F.lit(cap_ms).cast("double"), F.lit(base_ms) * F.pow(F.lit(2.0), F.least("attempt", F.lit(40)))).cast("bigint")
    share = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("session_id").cast("string"), F.col("attempt").cast("string")).cast("binary")), 1, 4), 16, 10).cast("bigint")
    half = F.floor(most / 2).cast("bigint")
    return attempts.withColumn("wait_ms", half + F.floor(half * share / F.lit(65_535)).cast("bigint"))


def in_flight(chunks: DataFrame, cap: int) -> DataFrame:
    """(session_id, at, n) where more than cap chunks (session_id, sent_at, acked_at, null if never) are on their way."""
    steps = chunks.select("session_id", F.col("sent_at").alias("at"), F.lit(1).alias("step")).unionByName(chunks.where("acked_at IS NOT NULL").select("session_id", F.col("acked_at").alias("at"), F.lit(-1).alias("step")))
    by = steps.groupBy("session_id", "at").agg(F.sum("step").alias("step"))
    running = F.sum("step").over(W.partitionBy("session_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return by.select("session_id", "at", running.alias("n")).where(F.col("n") > cap)


def negotiated(offers: DataFrame) -> DataFrame:
    """(session_id, version) of offers (session_id, peer, version): the highest version that all peers of a session offer, null if there is none."""
    peers = offers.groupBy("session_id").agg(F.count_distinct("peer").alias("n_peers"))
    common = offers.groupBy("session_id", "version").agg(F.count_distinct("peer").alias("n")).join(peers, "session_id").where("n = n_peers")
    return peers.select("session_id").join(common.groupBy("session_id").agg(F.max("version").alias("version")), "session_id", "left")


def sliding(traffic: DataFrame, time: str, width: str, slide: str, by: str = "replica_id") -> DataFrame:
    """(by, first_at, n) of sliding windows."""
    counted = traffic.groupBy(by, F.window(time, width, slide).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("w.start").alias("first_at"), "n")


def collectable(removes: DataFrame, frontiers: DataFrame, horizon: int) -> DataFrame:
    """Tombstones that may go: older than the horizon, and at or below what every replica is known to have received without a gap (replica_id, node, pt) of the tag's node.

    A replica that has nothing of a node holds back all tombstones of it. The rest must stay: a late add would come back to life.
    """
    n = frontiers.select("replica_id").distinct().agg(F.count("*").alias("n_all"))
    low = frontiers.groupBy("node").agg(F.min("pt").alias("low"), F.count_distinct("replica_id").alias("n")).crossJoin(F.broadcast(n)).where("n = n_all").select("node", "low")
    return removes.join(low, "node").where((F.col("pt") <= F.col("low")) & (F.col("pt") < horizon)).drop("low")


def battery(sessions: DataFrame) -> DataFrame:
    """(n, p50, p95): percent of battery an hour over sessions (start_pct, end_pct, charging, ms) that ran without a charger. A distribution and its size, because single readings are coarse."""
    used = sessions.where(~F.col("charging") & (F.col("ms") > 0)).select(((F.col("start_pct") - F.col("end_pct")) * 3_600_000.0 / F.col("ms")).alias("x"))
    return used.agg(F.count("*").alias("n"), F.percentile("x", F.lit(0.5)).alias("p50"), F.percentile("x", F.lit(0.95)).alias("p95"))


def crash_free(sessions: DataFrame) -> DataFrame:
    """(ram_mb, n, n_crashed, n_killed, permille) of sessions (ram_mb, ended): by memory of the device. A crash and a kill by the system are told apart; both count against the rate."""
    by = sessions.groupBy("ram_mb").agg(F.count("*").alias("n"), F.count_if(F.col("ended") == "crash").alias("n_crashed"), F.count_if(F.col("ended") == "killed").alias("n_killed"))
    return by.withColumn("permille", F.floor((F.col("n") - F.col("n_crashed") - F.col("n_killed")) * 1000 / F.col("n")).cast("bigint"))
