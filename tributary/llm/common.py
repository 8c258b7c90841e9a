"""Helpers shared by the training-data operators: columns by name, words and byte kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, dropping_shuffles, work_dir, written  # noqa: F401  for the operators

#: Characters that end a word in the contracts: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A to Z and leaves every other character alone."""
    return F.translate(text, UPPER, LOWER)


def words_in(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def column(name: str) -> Column:
    """A column by its very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on, so that no name matters; toDF with the old names undoes it."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


#: Bits of the filter that keeps texts from being moved in vain: at most 262144 rows of 64 bits, whatever the size of the input.
FILTER_BITS = 1 << 24


def perhaps(df: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """df without most rows whose value of a column is not in the one column of values: a bitmap of hashes, which is broadcast; an exact join follows."""
    bit = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(FILTER_BITS))
    word, inside = F.expr("shiftright(bit_, 6)").alias("word_"), F.expr("CAST(bit_ & 63 AS INT)")
    bits = values.select(bit(values.columns[0]).alias("bit_")).select(word, F.expr("shiftleft(1L, CAST(bit_ & 63 AS INT))").alias("mask_"))
    bitmap = bits.groupBy("word_").agg(F.bit_or("mask_").alias("mask_"))
    marked = df.withColumn("bit_", bit(name)).withColumn("word_", word).join(F.broadcast(bitmap), "word_")
    return marked.where(F.getbit("mask_", inside) == 1).select(*df.columns)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer on an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_R = pow(0x9E3779B97F4A7C15, 1, 1 << 64)
_RINV = pow(_R, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_TABLE[65:91] = _TABLE[97:123]
_TABLE[_SPACE] = 0
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column of one record batch, and the n + 1 offsets of its rows. A null row is empty."""
    import pyarrow as pa

    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and offsets.size else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if len(at) < len(column) + 1:
        at = np.zeros(len(column) + 1, np.int64)
    return raw[at[0] : at[-1]], at - at[0]


def row_ranges(offsets: np.ndarray, size: int = 1 << 20) -> list[tuple[int, int]]:
    """Consecutive rows (from, until) of about size bytes; a longer row is alone."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out


def word_hashes(raw: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A to Z lower-cased) in the order of the text, and the n + 1 offsets of the rows' words.

    A word hash is a polynomial over per-byte random values, summed for all words of a chunk at once. Chunks end at word
    ends, so the temporary arrays stay small for a text of any length.
    """
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[raw]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = space[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(first & ~space)
    del first
    counts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), counts.astype(np.int64)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, a + chunk)))
        b = starts[j] if j < len(starts) else n
        part = _TABLE[raw[a:b]]
        part *= _power(_R, b - a)
        rel = starts[i:j] - a
        out[i:j] = np.add.reduceat(part, rel) * _power(_RINV, b - a)[rel]
        i = j
    return mix64(out), counts.astype(np.int64)
