"""Scalar functions: type-tagged values, days, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags in the order in which values of different types compare.
NULL, BOOL, INT, STR = "0null", "1bool", "2int", "3str"


def tagged(value: Column, kind: str) -> Column:
    """struct(vtag, vtext) of a value. A null is a value (the cleared register), so the struct itself is never null."""
    if kind == "int":
        sign = F.when(value < 0, "-").otherwise("+")
        some = F.struct(F.lit(INT).alias("vtag"), F.concat(sign, F.lpad(F.abs(value).cast("string"), 20, "0")).alias("vtext"))
    elif kind == "bool":
        some = F.struct(F.lit(BOOL).alias("vtag"), F.when(value, "true").otherwise("false").alias("vtext"))
    elif kind == "str":
        some = F.struct(F.lit(STR).alias("vtag"), value.alias("vtext"))
    else:
        raise ValueError(f"no canonical form for {kind}: values are null, boolean, integer or string")
    return F.when(value.isNull(), F.struct(F.lit(NULL).alias("vtag"), F.lit("").alias("vtext"))).otherwise(some)


def shown(vtag: Column, vtext: Column) -> Column:
    """A tagged value as evidence shows it: null, true, 12 or 'text' (quotes doubled)."""
    number = F.regexp_replace(F.regexp_replace(vtext, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(vtag == NULL, "null").when(vtag == BOOL, vtext).when(vtag == INT, number).otherwise(F.concat(F.lit("'"), F.replace(vtext, F.lit("'"), F.lit("''")), F.lit("'")))


def day(taken_at: Column, zone: str | None = None) -> Column:
    """The day of a reading: what precedes T, or with a zone, the calendar day there (unreadable times keep their prefix)."""
    prefix = F.substring_index(taken_at, "T", 1)
    if zone is None:
        return prefix
    dated = F.when(taken_at.rlike(r"^\d{4}-"), F.try_to_timestamp(taken_at))
    return F.coalesce(F.date_format(F.from_utc_timestamp(dated, zone), "yyyy-MM-dd"), prefix)


def minor_units(value: Column, scale: int) -> Column:
    """A presentation of an integer in minor units as a decimal; never used to calculate."""
    return (value.cast("decimal(38,0)") / F.lit(10**scale).cast("decimal(38,0)")).cast(f"decimal(38,{scale})")


def transfer_ms(size: Column, bits_per_second: Column) -> Column:
    """How long size bytes take on a link, rounded down."""
    return F.floor(size * 8000 / bits_per_second).cast("bigint")


def chunk_checksum(payload: Column) -> Column:
    return F.crc32(payload)


def fingerprint(text: Column) -> Column:
    """An aggregate: a digest of distinct texts that does not depend on their order. The four quarters of their hashes are added up, and the sums written as text."""
    quarter = lambda i: F.sum(F.conv(F.substring(F.md5(text.cast("binary")), 8 * i + 1, 8), 16, 10).cast("bigint"))
    return F.concat_ws("-", *[quarter(i).cast("string") for i in range(4)])
