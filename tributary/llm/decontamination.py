"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts are folded (letters lower-cased, everything else one space) and every q-gram of every text is looked up among the benchmark's. Shared
q-grams are counted by item and diagonal in overlapping bands. An alignment of an item of m letters with at most k edits keeps at least
m - q + 1 - k q of its q-grams in one band, so bands below that bound are dropped; what remains is verified by a banded alignment.

Shared q-grams are expanded to (text, item) pairs at most ``AT_ONCE`` at a time, by rows, then by items, so many items with one wording in common take time and not memory, and
the pairs that pass the bounds are aligned many at once.

The benchmark is a stated query set. It goes to the executors in blocks of at most ``block_bytes`` of text, one pass over the documents and one broadcast a block, whose result is
written before the next, so neither a task nor the driver holds more than one block however large the benchmark. Documents are never shuffled.

Cases: null and empty texts and items match nothing; items shorter than q folded bytes are matched exactly, as whole words; ties: of several places of an item in a
text the one with the fewest edits, then the first, is reported; repeated documents are each reported, repeated items each by their id; a very long text is searched whole, in one piece; empty tables give empty
results; extra columns of the documents are ignored by ``find`` and kept by ``clean``, whatever their names. Edits are RATE of an item's bytes, rounded down, at every length; a q too large for the bound to
hold at some length is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_bytes, column, documents, numbered, row_ranges, work_dir, written

Q = 10
#: Edits allowed for each letter of an item.
RATE = 0.05
BLOCK = 4 << 20
#: Shared q-grams expanded at once, and pairs aligned at once.
AT_ONCE, ALIGNED = 2_000_000, 4096
FILTER_BITS = 22
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _a, _b in ((0, 48), (58, 65), (91, 97), (123, 128)):
    _FOLD[_a:_b] = 32


def fold(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all rows: ASCII and Latin-1 letters in lower case, runs of other ASCII characters one space, none at a row's ends."""
    low = _FOLD[raw]
    if not len(low):
        return low, np.zeros(len(offsets), np.int64)
    capital = np.zeros(len(raw), bool)
    capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    low[capital] += 32
    space = low == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    keep[begins] = ~space[begins]
    kept = np.flatnonzero(keep)
    out, at = low[kept], np.searchsorted(kept, offsets)
    # a space that ends a row goes too
    last = at[1:][(at[1:] > at[:-1])] - 1
    tail = last[out[last] == 32]
    return np.delete(out, tail), at - np.searchsorted(tail, at)


def qgrams(low: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash for each place at which q bytes begin."""
    n = len(low) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight = np.lib.stride_tricks.as_strided(np.ascontiguousarray(low).view(np.uint8), (len(low) - 7, 8), (1, 1)).copy().view("<u8").ravel()
    code = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    code ^= eight[q - 8 : q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return code


@dataclass
class Index:
    """The q-grams of a block of items."""

    ids: np.ndarray
    texts: list[bytes]
    budgets: np.ndarray
    codes: np.ndarray  # sorted, distinct
    key: np.ndarray  # of each place: its code's rank and its item, sorted
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray
    short: list[int]
    bytes: np.ndarray  # all items' bytes
    at: np.ndarray  # where an item's bytes begin


def index(items: list[tuple[int, str | None]], q: int = Q, rate: float = RATE) -> Index:
    texts = []
    for _, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        texts.append(fold(raw, np.array([0, len(raw)]))[0].tobytes())
    sizes = np.array([len(t) for t in texts], np.int64)
    budgets = np.floor(sizes * rate).astype(np.int64)
    if ((sizes >= q) & (sizes - q + 1 - budgets * q < 1)).any():
        raise ValueError(f"with {q}-grams an item may have lost all of them at a rate of {rate}")
    long = [i for i, n in enumerate(sizes) if n >= q]
    codes = [qgrams(np.frombuffer(texts[i], np.uint8), q) for i in long]
    item = np.repeat(np.array(long, np.int64), [len(c) for c in codes]) if long else np.empty(0, np.int64)
    place = np.concatenate([np.arange(len(c)) for c in codes]) if long else np.empty(0, np.int64)
    every = np.concatenate(codes) if long else np.empty(0, np.uint64)
    order = np.lexsort((place, item, every))
    distinct, rank = np.unique(every[order], return_inverse=True)
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[distinct >> np.uint64(64 - FILTER_BITS)] = True
    item, place = item[order], place[order]
    short = [i for i, n in enumerate(sizes) if 0 < n < q]
    return Index(np.array([i for i, _ in items], np.int64), texts, budgets, distinct, rank * max(1, len(items)) + item, item, place, bits, short, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *sizes]))


def align(low: np.ndarray, index: Index, item: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair, fewest edits between an item and any stretch of the size bytes of low from start, on diagonals first to last, with its begin and end. Edits beyond the budget may be too many.

    All pairs advance one byte of their items at a time; a pair is dropped where all its diagonals are beyond its budget.
    """
    n = len(item)
    edits, begins, ends = np.full(n, 1 << 14, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    length, budget = np.diff(index.at)[item], index.budgets[item]
    order = np.lexsort((length, last - first))
    for x in range(0, n, ALIGNED):
        who = order[x : x + ALIGNED]
        step = np.arange(int((last - first)[who].max()) + 1, dtype=np.int16)
        big = np.int16(1 << 13)
        diagonal = (first[who, None] + step).astype(np.int32)
        usable = diagonal <= last[who, None]
        cost = np.where((diagonal >= 0) & (diagonal <= size[who, None]) & usable, np.int16(0), big)
        begin = diagonal.copy()
        for i in range(1, int(length[who].max()) + 1):
            j = diagonal + i  # bytes of text used
            inside = (j >= 0) & (j <= size[who, None]) & usable
            theirs = low[np.clip(start[who, None] + j - 1, 0, len(low) - 1)]
            own = index.bytes[np.minimum(index.at[item[who]] + i - 1, len(index.bytes) - 1)]
            best = np.where(inside & (j >= 1), cost + (theirs != own[:, None]), big).astype(np.int16)
            up = np.full_like(cost, big)
            up[:, :-1] = cost[:, 1:] + np.int16(1)
            source = np.zeros_like(begin)
            source[:, :-1] = begin[:, 1:]
            deleted = (up < best) & inside
            best, origin = np.where(deleted, up, best), np.where(deleted, source, begin)
            reach = np.minimum.accumulate(best - step, axis=1)
            came = np.maximum.accumulate(np.where(best - step == reach, step, np.int16(0)), axis=1)
            cost = np.where(inside, reach + step, big)
            begin = np.take_along_axis(origin, came.astype(np.int64), axis=1)
            done = length[who] == i
            if done.any():
                at = cost[done].argmin(axis=1)
                rows, to = np.arange(len(at)), who[done]
                edits[to], begins[to], ends[to] = cost[done][rows, at], np.maximum(0, begin[done][rows, at]), diagonal[done][rows, at] + i
            alive = ~done & (cost.min(axis=1) <= budget[who])
            if alive.mean() < 0.8 or i % 64 == 0:
                who, cost, begin, diagonal, usable = who[alive], cost[alive], begin[alive], diagonal[alive], usable[alive]
                if not len(who):
                    break
    return edits, begins, ends


def _slices(index: Index, near: np.ndarray, row: np.ndarray) -> Iterator[tuple[slice, int, int]]:
    """(hits, first item, last item) whose shared q-grams are at most AT_ONCE, unless one row's are with one item; hits are sorted by row."""
    items = len(index.ids)
    count = np.searchsorted(index.key, (near + 1) * items) - np.searchsorted(index.key, near * items)
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    upto = np.append(0, np.cumsum(count))
    ends = np.append(begin[1:], len(row))
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(upto[ends], upto[begin[i]] + AT_ONCE, "right")))
        hits, todo = slice(int(begin[i]), int(ends[j - 1])), [(0, items)]
        while todo:
            a, b = todo.pop()
            some = near[hits] * items
            n = int((np.searchsorted(index.key, some + b) - np.searchsorted(index.key, some + a)).sum())
            if n <= AT_ONCE or b - a == 1:
                if n:
                    yield hits, a, b
            else:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        i = j


def _pairs(index: Index, near: np.ndarray, row: np.ndarray, spot: np.ndarray, a: int, b: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, band, distinct places hit) of bands of items a to b that may hold an item; each is looked at with the next one."""
    items, sizes = len(index.ids), np.diff(index.at)
    begin = np.searchsorted(index.key, near * items + a)
    count = np.searchsorted(index.key, near * items + b) - begin
    base = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    row, spot = np.repeat(row, count), np.repeat(spot, count)
    item, place = index.item[base], index.place[base]
    least = sizes - q + 1 - index.budgets * q
    _, pair, often = np.unique(row * items + item, return_inverse=True, return_counts=True)
    good = often[pair] >= least[item]  # a pair that shares too few q-grams in all
    row, spot, item, place, pair = row[good], spot[good], item[good], place[good], pair[good]
    band = (spot - place) // (index.budgets[item] + 1)
    order = np.lexsort((place, band, pair))
    pair, band, place = pair[order], band[order], place[order]
    if not len(pair):
        return (np.empty(0, np.int64),) * 4
    other = np.append(True, (pair[1:] != pair[:-1]) | (band[1:] != band[:-1]))
    new = np.append(True, other[1:] | (place[1:] != place[:-1]))
    first = np.flatnonzero(other)
    n = np.add.reduceat(new.astype(np.int64), first)
    pair, band, row, item = pair[first], band[first], row[order][first], item[order][first]
    follows = np.zeros(len(first), bool)
    follows[:-1] = (pair[1:] == pair[:-1]) & (band[1:] == band[:-1] + 1)
    both = n + np.where(follows, np.append(n[1:], 0), 0)
    alone = np.append(True, ~follows[:-1])
    # the last of a run is also looked at with the one before, which that one's turn covers
    some = (both >= least[item]) & (follows | alone)
    return row[some], item[some], band[some], both[some]


def matches(low: np.ndarray, at: np.ndarray, index: Index, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """(row, item, begin, end, edits) of every item that a row holds, from folded rows."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    codes = qgrams(low, q)
    hit = np.flatnonzero(index.bits[codes >> np.uint64(64 - FILTER_BITS)]) if len(index.codes) else np.empty(0, np.int64)
    own = codes[hit]
    del codes
    if len(hit):
        near = np.minimum(np.searchsorted(index.codes, own), len(index.codes) - 1)
        good = index.codes[near] == own
        hit, near = hit[good], near[good]
        row = np.searchsorted(at, hit, "right") - 1
        good = hit + q <= at[row + 1]
        hit, near, row = hit[good], near[good], row[good]
    sizes = np.diff(index.at)
    for hits, a, b in _slices(index, near, row) if len(hit) else ():
        r, i, band, n = _pairs(index, near[hits], row[hits], hit[hits] - at[row[hits]], a, b, q)
        k, m = index.budgets[i], sizes[i]
        begin = band * (k + 1) - k
        start = np.maximum(0, begin)
        end = np.minimum(at[r + 1] - at[r], band * (k + 1) + 2 * (k + 1) + m + k)
        exact = np.zeros(len(r), bool)
        for g in np.flatnonzero(n >= m - q + 1).tolist():  # all q-grams are there
            x, y = int(at[r[g]] + start[g]), int(at[r[g]] + end[g])
            place = low[x:y].tobytes().find(index.texts[i[g]])
            if place >= 0:
                exact[g] = True
                key, got = (int(r[g]), int(i[g])), (0, int(start[g]) + place, int(start[g]) + place + int(m[g]))
                found[key] = min(found.get(key, got), got)
        todo = np.flatnonzero(~exact & (k > 0))
        if len(todo):
            r, i, k, start, end, begin, band = r[todo], i[todo], k[todo], start[todo], end[todo], begin[todo], band[todo]
            edits, x, y = align(low, index, i, at[r] + start, end - start, begin - start, band * (k + 1) + 2 * (k + 1) - 1 + k - start)
            for g in np.flatnonzero(edits <= k).tolist():
                key, got = (int(r[g]), int(i[g])), (int(edits[g]), int(start[g] + x[g]), int(start[g] + y[g]))
                found[key] = min(found.get(key, got), got)
    for i in index.short:
        word = b" " + index.texts[i] + b" "
        for r in range(len(at) - 1):
            x = (b" " + low[at[r] : at[r + 1]].tobytes() + b" ").find(word)
            if x >= 0:
                found[r, i] = (0, x, x + len(index.texts[i]))
    return [(r, i, x, y, edits) for (r, i), (edits, x, y) in sorted(found.items())]


def search(texts, index: Index, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """matches() of a string column, some rows at a time."""
    raw, offsets = arrow_bytes(texts)
    got = []
    for a, b in row_ranges(offsets):
        low, at = fold(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        got += [(r + a, *rest) for r, *rest in matches(low, at, index, q)]
    return got


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about block_bytes, dealt by a hash."""
    rows = benchmark.select(F.col(item).cast("bigint").alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL AND text <> ''")
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(8))).first()[0] or 0
    n = -(-size // block_bytes)
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield [(r["item"], r["text"]) for r in part.collect()]


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", q: int = Q, rate: float = RATE, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, first, last, edits) of every item in every document; first and last are places in the folded text."""
    schema = "doc_id long, item_id long, first long, last long, edits long"
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession)
    found = spark.createDataFrame([], schema)
    for n, items in enumerate(blocks(benchmark, block_bytes=block_bytes)):
        known = spark.sparkContext.broadcast(index(items, q, rate))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = search(batch.column(1), known.value, q)
                rows = pa.array([m[0] for m in got], pa.int64())
                ids = pa.array([int(known.value.ids[m[1]]) for m in got], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), ids, *(pa.array([m[c] for m in got], pa.int64()) for c in (2, 3, 4))], names=["doc_id", "item_id", "first", "last", "edits"])

        found = found.unionByName(written(docs.select(column(key).cast("bigint"), column(text)).mapInArrow(run, schema), f"found{n}", folder))
        known.unpersist()
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", q: int = Q, rate: float = RATE, block_bytes: int = BLOCK) -> DataFrame:
    """docs without those that hold an item of the benchmark. With several blocks, what is left after each but the last is written."""
    folder, known, names = work_dir(docs.sparkSession), None, docs.columns
    place, docs = names.index(text), numbered(docs)
    for n, items in enumerate(blocks(benchmark, block_bytes=block_bytes)):
        if known:
            docs = written(docs, f"kept{n}", folder)
            known.unpersist()
        known = docs.sparkSession.sparkContext.broadcast(index(items, q, rate))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[m[0] for m in search(batch.column(place), known.value, q)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return find(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
