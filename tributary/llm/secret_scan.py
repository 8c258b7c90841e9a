"""Secret scans with corpus-wide ownership frequency, all native.

Regular expressions find candidate credentials with their places (code points). Of a candidate's value only a digest and whether it looks random leave the scan, so no table holds a secret.
The digests are counted over the whole corpus by distinct repositories and distinct owners: a value that several owners or more than ``MAX_REPOSITORIES`` repositories hold is a copied
example, one that is specific to its owner and looks random is reported as live. A place follows from the lengths of what a split by the same expression leaves between the matches, so no
Python is needed. Counting is in two steps (distinct holder, then value), so a value that a third of all rows hold is added up before it is
shuffled by value. Rows without a candidate take no part in the join by value.

Cases: a null text is empty; a null owner or id is a value; repeated rows are one row of the result each and one repository; texts without a candidate
stay, with zero counts and the digest of the empty text; a very long text is searched whole; spans are ordered by start, kind and end, so ties do not matter; empty tables stay empty;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import column, documents, written


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The expressions of the base kinds in their order, with the least length of what counts.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(?:" + "|".join(map(_either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}+"
OPAQUE = r"[A-Za-z0-9+/_-]{32,}+"
KINDS = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24), ("opaque", OPAQUE, 32))
LIVE = len(KINDS)
NAMES = (*(k for k, _, _ in KINDS), "live")
#: Words that mark a value as an example.
EXAMPLES = r"(?i)example|sample|dummy|changeme|placeholder|xxxx|12345678|abcdef"


#: A value with more owners or repositories than these is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 1, 5


def candidates(df: DataFrame, key: str = "doc_id", owner: str = "source", repository: str | None = None, text: str = "text") -> DataFrame:
    """One row for each match that counts, and one with kind null for each distinct row of df.

    Columns: key, text_hash, owner, repository, kind (place in KINDS), start and end (code points), value_start, value (its digest), random, rows (how often the row is there).
    """
    whole = F.coalesce(column(text), F.lit(""))

    def matches(i: int, pattern: str) -> Column:
        between = F.split(whole, pattern, -1)
        found = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))
        rows = F.transform(F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("s")), lambda x, n: F.struct(F.lit(i).alias("kind"), n.alias("n"), F.length(x["s"]).alias("before"), x["m"].alias("match")))
        return F.when(whole.rlike(pattern), rows)

    none = F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(0).alias("n"), F.lit(0).alias("before"), F.lit("").alias("match")))
    parts = [F.coalesce(matches(i, p), F.filter(none, lambda _: F.lit(False))) for i, (_, p, _) in enumerate(KINDS)]
    held = column(repository or key).cast("string")
    rows = df.select(column(key).alias("key"), F.xxhash64(column(text)).alias("text_hash"), column(owner).cast("string").alias("owner"), held.alias("repository"), F.explode(F.concat(none, *parts)).alias("x"))
    value = F.when(F.col("x.kind") == 0, F.regexp_extract("x.match", ASSIGN, 1)).otherwise(F.col("x.match"))
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in KINDS]), F.col("x.kind") + 1)
    rows = rows.select("key", "text_hash", "owner", "repository", F.col("x.kind").alias("kind"), F.col("x.n").alias("n"), F.col("x.before").alias("before"), F.length("x.match").alias("length"), value.alias("value"), least.alias("least"))
    number = F.length("value").alias("value_length")
    rows = rows.select("key", "text_hash", "owner", "repository", "kind", "n", "before", "length", number, (F.length("value") >= F.col("least")).alias("counts"), F.sha2("value", 256).alias("value"), looks_random(F.col("value")).alias("random"))
    # equal rows share a place in the order; each place adds its text once
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("rows"))
    order = W.partitionBy("key", "text_hash", "owner", "repository", "kind").orderBy("n")
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("length")).over(order))
    kept = rows.where("kind IS NULL OR counts")
    return kept.select("key", "text_hash", "owner", "repository", "kind", (F.col("end") - F.col("length")).alias("start"), "end", (F.col("end") - F.col("value_length")).alias("value_start"), "value", "random", "rows")


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repositories, n_owners) over all candidates. A repository counts once, whoever owns it."""
    holders = found.where("kind IS NOT NULL").select("value", "owner", "repository").distinct()
    by_owner = holders.groupBy("value", "owner").agg(F.lit(1).alias("one")).groupBy("value").agg(F.sum("one").alias("n_owners"))
    by_repository = holders.groupBy("value", "repository").agg(F.lit(1).alias("one")).groupBy("value").agg(F.sum("one").alias("n_repositories"))
    return by_owner.join(by_repository, "value")


def looks_random(value: Column) -> Column:
    """Letters and digits, many different characters, no word that marks an example."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 12) & (distinct >= 8) & ~value.rlike(EXAMPLES)


def scan(df: DataFrame, key: str = "doc_id", owner: str = "source", repository: str | None = None, text: str = "text", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """candidates() with n_repositories, n_owners and live (held by few owners and repositories, and random-looking)."""
    found = written(candidates(df, key, owner, repository, text), "candidates")
    few = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    held = found.where("kind IS NOT NULL").join(ownership(found), "value").withColumn("live", few & F.col("random"))
    nothing = [F.lit(None).cast("bigint").alias("n_owners"), F.lit(None).cast("bigint").alias("n_repositories"), F.lit(False).alias("live")]
    return held.unionByName(found.where("kind IS NULL").select("*", *nothing))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets of every document and the spans that ownership adds. A document is its own repository, its source the owner."""
    found = scan(documents(spark, sf_dir, "doc_id", "source", "text"))
    base = F.col("kind") < 3
    span = lambda kind, start: F.struct(start.cast("bigint").alias("start"), kind.alias("kind"), F.col("end").cast("bigint").alias("end"))
    all_spans = F.array_compact(F.array(F.when(base, span(F.col("kind"), F.col("start"))), F.when(F.col("live"), span(F.lit(LIVE), F.col("value_start")))))
    names = F.array(*map(F.lit, NAMES))
    text = lambda spans: F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    rows = found.select("key", "text_hash", "kind", "n_owners", "n_repositories", F.when(F.col("kind").isNull(), F.col("rows")).alias("rows"), F.when(base, span(F.col("kind"), F.col("start"))).alias("base"), all_spans.alias("spans"))
    grouped = rows.groupBy(F.col("key").alias("doc_id"), "text_hash").agg(
        *[F.size(F.collect_set(F.when(F.col("kind") == i, F.col("base")))).cast("bigint").alias(f"n_{n}") for i, n in enumerate(NAMES[:3])],
        F.sha2(text(F.collect_set("base")), 256).alias("base_sha256"),
        text(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.coalesce(F.max("n_repositories"), F.lit(0)).alias("most_repositories"),
        F.coalesce(F.max("n_owners"), F.lit(0)).alias("most_owners"),
        F.sum("rows").alias("rows"),
    )
    return grouped.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("text_hash", "rows", "row")
