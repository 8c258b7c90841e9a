"""LM scoring with a hierarchical Pitman-Yor model.

Restaurants: one for each previous word (by its 64-bit hash; the start of a text is one more), all with the same parent, the unigram restaurant, whose
base is uniform over the known words and one unknown word. A word's customers in a context (a dish) sit at tables; each table is a customer of the parent.
The seating is sampled by Gibbs. Scores need of a dish only the number of its tables, so a sweep draws that number anew for all customers of every dish:

* Given a restaurant's tables T, x ~ Gamma(strength / discount + T). Given x, its dishes are independent: P(t) is in proportion to C(n, t; discount) (x p)^t, with n customers
  and the word's probability p in the parent, so all dishes are drawn at once and exactly (``table_counts``).
* The parent's tables are drawn the same way, and then its probabilities: the words' shares are a Dirichlet with the customers less the discounted tables, what is left is spread
  evenly over the base.

Predictions are the mean probabilities given the seating, averaged over ``SAMPLES`` seatings; ``perplexity`` is 10 to minus the score by token.

Everything about a context (its dishes, and the documents' places that follow it) is in the bucket of its hash. A context with more tokens than a quarter of a bucket is dealt by word into several;
their tables are added up. The words' and such contexts' totals are at home in parts. A sweep is two written tables: the parts' (sums over buckets, parent tables,
probabilities, and replies to the buckets that have the word) and the buckets'. Dishes with one customer have one table for good and take no part in sweeps.
Random numbers are functions of the seed, the sweep and the dish, so scores depend neither on the number of buckets nor on partitions (but for the last digits of sums).

Passes: sizes of contexts in two counts (classes of hashes, then the words of large classes); counts and places dealt into buckets (one shuffle, pre-aggregated by pieces of text, written);
two written tables a sweep; scores, whose sums by document go back by batch. Executors hold one bucket or part at a time; their numbers follow the size of the input. The driver holds the list
of split contexts, at most 4 for each bucket.

Cases: a null text is empty (its end is its one token); a null id counts as the empty text in the fold; repeated rows are scored each; without training tokens
every probability is that of the unknown word; empty tables give empty results; a very long text is tokenized whole and its places are dealt like all others; there are no ties to break,
as every word and context counts; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_bytes, column, delete, documents, dropping_shuffles, fold_of, mix64, row_ranges, word_hashes, work_dir, written

SAMPLES = 3
BURN, BETWEEN = 6, 3
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
#: Buckets whose sums by document are added up before they are sent.
TOGETHER = 8
#: Bytes of text that are dealt at once.
PIECE = 6 << 20
END = np.uint64(0x1D8E4E27C47D124F)
START = 0


def context_of(words: np.ndarray) -> np.ndarray:
    """The restaurant that a word opens for the next one."""
    return mix64(words + np.uint64(77))


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, row) of every token, the end of each row included."""
    words, at = word_hashes(raw, offsets)
    n = np.diff(at)
    rows = len(n)
    row = np.repeat(np.arange(rows), n + 1)
    out = np.empty(len(row), np.uint64)
    ends = np.cumsum(n + 1) - 1
    is_end = np.zeros(len(row), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = END, words
    context = np.empty(len(row), np.uint64)
    context[1:] = context_of(out[:-1])
    context[ends[:-1] + 1] = START
    context[:1] = START
    return out, context, row


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = arrow_bytes(batch.column(column))
    for a, b in row_ranges(offsets, PIECE):
        for x in range(a, b, 1 << 16):
            y = min(b, x + (1 << 16))
            yield x, y, raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]


def large_contexts(docs: DataFrame, buckets: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Contexts with more than 1 / (4 buckets) of all tokens, sorted, and the number of pieces into which each is dealt. Exact: words are counted whose class of hashes is that large."""
    classes = 1 << max(10, min(20, (buckets * 256 - 1).bit_length()))

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(classes, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, raw, offsets in _pieces(batch, 0):
                n += np.bincount((word_hashes(raw, offsets)[0] & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
        blobs = [packed(part) for part in np.split(n, 64)]  # as many rows from every task, whatever the number of classes
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array(blobs, pa.binary()), pa.array([rows] + [0] * 63), pa.array([int(n.sum())] + [0] * 63)], names=["part", "n", "rows", "words"])

    def large_ones(table: pa.Table) -> pa.Table:
        n = np.sum([unpacked(x, np.int64) for x in table["n"].to_pylist()], axis=0)
        found = np.flatnonzero(n > least)
        return pa.table({"key": pa.array(found + table["part"][0].as_py() * (classes // 64), pa.int64())})

    def of_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in _pieces(batch, 0):
                words = word_hashes(raw, offsets)[0]
                key, n = np.unique(words[large[(words & np.uint64(classes - 1)).astype(np.int64)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    texts = docs.select("text")
    sums = written(texts.mapInArrow(by_class, "part int, n binary, rows long, words long"), "classes", folder)
    starts, words = sums.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    least = max(1, (starts + words) // (4 * buckets))
    large = np.zeros(classes, bool)
    large[[r["key"] for r in sums.select("part", "n").groupBy("part").applyInArrow(large_ones, "key long").collect()]] = True  # at most 4 for each bucket

    rows = texts.mapInArrow(of_large, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > least).collect() if large.any() else []
    found = context_of(np.array([r["key"] for r in rows], np.int64).view(np.uint64))
    n = np.array([r["n"] for r in rows], np.int64)
    if starts > least:
        found, n = np.append(found, np.uint64(START)), np.append(n, starts)
    by = np.argsort(found)
    return found[by], -(-n[by] // least)


def packed(x: np.ndarray) -> bytes:
    """An array as bytes, all first bytes first and so on, compressed, with its length before."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(data: bytes | None, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little") if data else 0
    if not size:
        return np.empty(0, kind)
    raw = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_ids(ids: np.ndarray) -> bytes:
    """Sorted ids by their differences: what sorting tells of a hash need not be stored."""
    return packed(np.diff(ids, prepend=np.uint64(0)))


def unpacked_ids(data: bytes | None) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def steps(x: np.ndarray) -> np.ndarray:
    """The differences of nearly sorted numbers below 2^32, which compress well; their running sum, modulo 2^32, gives them back."""
    return np.diff(x.astype(np.uint32), prepend=np.uint32(0))


def uniform(keys: np.ndarray, *salt: int) -> np.ndarray:
    """A number in (0, 1) for each key, by the salt."""
    at = np.zeros(1, np.uint64)
    for x in salt:
        at = mix64(at + np.uint64(x & 0xFFFFFFFFFFFFFFFF) + np.uint64(0x9E3779B97F4A7C15))
    return ((mix64(mix64(keys) + at) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gamma(shape: np.ndarray, keys: np.ndarray, *salt: int) -> np.ndarray:
    """A Gamma variable for each key by squeeze and rejection on a cubed normal; shapes below 1 are raised by 1 and scaled down."""
    shape = np.asarray(shape, np.float64)
    d = np.where(shape < 1, shape + 1, shape) - 1 / 3
    out = np.empty(len(d))
    todo, turn = np.arange(len(d)), 0
    while len(todo):
        k = keys[todo]
        a, b, c = (uniform(k, *salt, 3 * turn + i) for i in range(3))
        normal = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        v = (1 + normal / np.sqrt(9 * d[todo])) ** 3
        log_v = np.log(np.maximum(v, 1e-300))
        good = (v > 0) & (np.log(c) < normal**2 / 2 + d[todo] * (1 - v + log_v))
        out[todo[good]] = (d[todo] * v)[good]
        todo, turn = todo[~good], turn + 1
    small = np.flatnonzero(shape < 1)
    out[small] *= uniform(keys[small], *salt, -1) ** (1 / shape[small])
    return out


#: Up to this many customers all table counts are weighed by an exact table; above, NODES points of a contour give the same weight.
EXACT, NODES = 1024, 64
_counts: dict[float, np.ndarray] = {}


def _log_counts(discount: float) -> np.ndarray:
    """Logarithms of the generalized factorial coefficients C(n, t; discount), for n up to EXACT."""
    if discount not in _counts:
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[0, 0] = 0
        t = np.arange(1, EXACT + 1)
        for n in range(EXACT):
            rest = n - discount * t
            out[n + 1, 1:] = np.logaddexp(np.log(discount) + out[n, :-1], np.log(np.where(rest > 0, rest, 1)) + np.where(rest > 0, out[n, 1:], -np.inf))
        _counts[discount] = out
    return _counts[discount]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x >= 1, by Stirling's series at x + 8."""
    y = x + 8
    below = sum(np.log(x + i) for i in range(8))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - below


def _log_sum_is(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log P(X1 + ... + Xt = n) of Sibuya variables, which is log(C(n, t; d) t! / n!): the coefficient of z^n in (1 - (1 - z)^d)^t, by a parabola through the saddle."""
    low, high = np.log(np.minimum(0.5, 8 / n)), np.full(n.shape, -1e-12)
    for _ in range(26):  # any contour near the saddle gives the same value
        at = (low + high) / 2
        left = np.log(t * d) + (d - 1) * at + np.log(-np.expm1(at)) > np.log(n + 1) + np.log(-np.expm1(d * at))
        low, high = np.where(left, at, low), np.where(left, high, at)
    log_w0 = (low + high) / 2
    w0 = np.exp(log_w0)
    reach = np.sqrt(20 / ((1 - d) * (n + 1) * w0))
    y = (np.arange(NODES) + 0.5) / NODES * reach[..., None]  # w = w0 (1 + iy)^2 is 1 - z; in real numbers, which are faster
    square, angle = y * y, 2 * d * np.arctan(y)
    g = np.exp(d * (log_w0[..., None] + np.log1p(square)))
    a, b = 1 - g * np.cos(angle), g * np.sin(angle)  # 1 - w^d = a - ib
    c, e = 1 - w0[..., None] * (1 - square), 2 * w0[..., None] * y  # 1 - w = c - ie
    t_, n_ = t[..., None], n[..., None] + 1
    height = (t_ * np.log(a * a + b * b) - n_ * np.log(c * c + e * e)) / 2
    turn = n_ * np.arctan2(e, c) - t_ * np.arctan2(b, a)
    top = height.max(-1)
    total = (np.exp(height - top[..., None]) * (np.cos(turn) - y * np.sin(turn))).sum(-1) * reach / NODES * 2 / np.pi * w0
    return np.where(t >= n, n * np.log(d), top + np.log(np.maximum(total, 1e-300)))


def table_counts(n: np.ndarray, log_xp: np.ndarray, discount: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The number of tables of each dish with n customers: P(t) is in proportion to C(n, t; d) exp(t log_xp). u, v: a number in (0, 1) for each dish; v matters above EXACT."""
    out = np.minimum(n, 1).astype(np.int64)
    order = np.argsort(n, kind="stable")
    size = n[order]
    i, end = np.searchsorted(size, (2, EXACT + 1)).tolist()
    while i < end:  # dishes of like sizes at once; weights above a dish's own size are 0
        j = min(int(np.searchsorted(size, size[i] * 5 // 4, "right")), end)
        j = min(j, i + max(1, (1 << 18) // int(size[j - 1])))
        some, most = order[i:j], int(size[j - 1])
        log_w = log_xp[some, None] * np.arange(1, most + 1) + _log_counts(discount)[size[i:j], 1 : most + 1]
        log_w -= log_w.max(axis=1, keepdims=True)
        total = np.cumsum(np.exp(log_w, out=log_w), axis=1)
        out[some] = 1 + np.minimum((total < u[some, None] * total[:, -1:]).sum(axis=1), n[some] - 1)
        i = j
    large = np.flatnonzero(n > EXACT)
    for k in range(0, len(large), 64):
        some = large[k : k + 64]
        out[some] = _large_counts(n[some].astype(float), log_xp[some], discount, u[some], v[some])
    return out


def _large_counts(n: np.ndarray, log_xp: np.ndarray, d: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    def log_weight(t: np.ndarray) -> np.ndarray:
        up = (slice(None), *[None] * (t.ndim - 1))
        return _log_sum_is(np.broadcast_to(n[up], t.shape), t, d) - _log_gamma(t + 1) + t * log_xp[up]

    low, high, each = np.ones(len(n)), n.copy(), np.arange(len(n))
    while (low < high).any():  # the weights rise to one top and fall, so the top is beside the best of some points
        t = np.floor(low[:, None] + (high - low)[:, None] * np.arange(17) / 16)
        best = np.argmax(log_weight(t), axis=1)
        left, right = t[each, np.maximum(best - 1, 0)], t[each, np.minimum(best + 1, 16)]
        done = high - low <= 16
        low, high = np.where(done, t[each, best], left), np.where(done, t[each, best], right)
    h = np.minimum(np.maximum(1, np.floor(np.sqrt(low) / 2)), np.minimum(low - 1, n - low))
    fall = 2 * log_weight(low) - log_weight(low - h) - log_weight(low + h)
    step = np.where(h > 0, np.maximum(1, np.floor(h / np.sqrt(np.maximum(fall, 1e-12)) / 6)), 1)
    step = np.minimum(step, np.maximum(1, np.floor(n / 64)))
    t = low[:, None] + step[:, None] * np.arange(-32, 33)
    inside = (t >= 1) & (t <= n[:, None])
    log_w = np.where(inside, log_weight(np.clip(t, 1, n[:, None])), -np.inf)
    total = np.cumsum(np.exp(log_w - log_w.max(axis=1, keepdims=True)), axis=1)
    pick = np.minimum((total < u[:, None] * total[:, -1:]).sum(axis=1), 64)
    near = np.floor(v * step) - np.floor(step / 2)  # a step is a sixth of the deviation
    return np.clip(t[each, pick] + near, 1, n).astype(np.int64)


@dataclass
class Settings:
    discount: float
    parent_discount: float
    vocabulary: int
    tokens: int
    seed: int


@dataclass
class Totals:
    """What a step knows of the whole corpus: the parent's customers and tables, the words' shares together and the share of the base."""

    customers: int
    tables: int
    shares: float
    rest: float


#: Salts of random numbers: tables of dishes, x of contexts, tables of words, shares, x of the parent, share of the base.
DISH, CONTEXT, WORD, SHARE, PARENT, BASE = range(6)
ONE = np.zeros(1, np.uint64)


def x_of(contexts: np.ndarray, tables: np.ndarray, s: Settings, sweep: int) -> np.ndarray:
    return gamma(STRENGTH / s.discount + tables, contexts, s.seed, sweep, CONTEXT)


def dish_tables(context: np.ndarray, word: np.ndarray, customers: np.ndarray, x: np.ndarray, p: np.ndarray, s: Settings, sweep: int) -> np.ndarray:
    """Tables of dishes of (context, word) hashes, drawn anew given x of their contexts and the words' probabilities in the parent."""
    key = mix64(context) + word
    return table_counts(customers, np.log(x * p), s.discount, uniform(key, s.seed, sweep, DISH), uniform(key, s.seed, sweep, DISH, 1))


def word_tables(words: np.ndarray, customers: np.ndarray, x: float, s: Settings, sweep: int) -> np.ndarray:
    """Tables of words in the parent, drawn anew given the parent's x."""
    log_xp = np.full(len(words), np.log(x / (s.vocabulary + 1)))
    return table_counts(customers, log_xp, s.parent_discount, uniform(words, s.seed, sweep, WORD), uniform(words, s.seed, sweep, WORD, 1))


def shares_of(words: np.ndarray, customers: np.ndarray, tables: np.ndarray, s: Settings, sweep: int) -> np.ndarray:
    """The words' shares in the parent but for a common factor; 0 for unknown words."""
    some = customers > 0
    out = np.zeros(len(words))
    out[some] = gamma(customers[some] - s.parent_discount * tables[some], words[some], s.seed, sweep, SHARE)
    return out


def parent_x(tables: int, s: Settings, sweep: int) -> float:
    return float(gamma(np.array([PARENT_STRENGTH / s.parent_discount + tables]), ONE, s.seed, sweep, PARENT)[0])


def base_share(tables: int, s: Settings, sweep: int) -> float:
    return float(gamma(np.array([PARENT_STRENGTH + s.parent_discount * tables]), ONE, s.seed, sweep, BASE)[0])


def drawn(shares: np.ndarray, now: Totals, s: Settings) -> np.ndarray:
    """Probabilities of words in the parent as drawn."""
    return (shares + now.rest / (s.vocabulary + 1)) / (now.shares + now.rest)


def expected(customers: np.ndarray, tables: np.ndarray, now: Totals, s: Settings) -> np.ndarray:
    """Mean probabilities of words in the parent, given the seating."""
    below = (PARENT_STRENGTH + s.parent_discount * now.tables) / (s.vocabulary + 1)
    return (customers - s.parent_discount * tables + below) / (PARENT_STRENGTH + now.customers)


def prediction(customers: np.ndarray, tables: np.ndarray, all_customers: np.ndarray, all_tables: np.ndarray, p: np.ndarray, s: Settings) -> np.ndarray:
    """Probability of a dish given its own and its context's customers and tables."""
    return (customers - s.discount * tables + (STRENGTH + s.discount * all_tables) * p) / (STRENGTH + all_customers)


def homes(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part in which the totals of each word or split context are added up: a range of ids, which are hashes, so sorted ids are sorted by home."""
    return (((ids >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def cuts(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal keys."""
    begin = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.empty(0, np.int64)
    return list(zip(begin.tolist(), [*begin[1:].tolist(), len(sorted_keys)]))


def rows_of(schema: str, rows: list[dict]) -> pa.Table:
    """A table of a Spark schema of int, long, double and binary columns; what a row does not have is null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))})


DEALT = "bucket int, batch long, contexts binary, runs binary, words binary, which binary, rows binary, counts binary, train binary"


def deal(docs: DataFrame, large: np.ndarray, pieces: np.ndarray, buckets: int) -> DataFrame:
    """Places of words by bucket, from (text, train, doc_id); rows of buckets from ``buckets`` on list the documents of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            for x, y, raw, offsets in _pieces(batch, 0):
                word, context, row = tokens_of(raw, offsets)
                train = packed(np.packbits(batch.column(1).slice(x, y - x).to_numpy(zero_copy_only=False).astype(bool)))
                every, which = np.unique(word, return_inverse=True)
                befores, before = np.unique(context, return_inverse=True)
                at_row = np.uint64(16 if y - x > 1 else 0)  # a piece of several rows has fewer than 2^24 words; a longer row is alone
                half = (np.uint64(64) - at_row) // np.uint64(2)
                key = (((before.astype(np.uint64) << half) | which.astype(np.uint64)) << at_row) | row.astype(np.uint64)
                del word, context, which, before
                key, n = np.unique(key, return_counts=True)
                if n.max() > 65535:  # counts have 16 bits; larger ones come in parts
                    parts = -(-n // 65535)
                    key, last = np.repeat(key, parts), n - (parts - 1) * 65535
                    n = np.full(len(key), 65535)
                    n[np.cumsum(parts) - 1] = last
                c = (key >> (half + at_row)).astype(np.int64)
                w = ((key >> at_row) & ((np.uint64(1) << half) - np.uint64(1))).astype(np.int64)
                r = (key & ((np.uint64(1) << at_row) - np.uint64(1))).astype(np.uint16)
                home = befores[c]
                if len(large):
                    at = np.minimum(np.searchsorted(large, befores), len(large) - 1)
                    into = np.where(large[at] == befores, pieces[at], 1)[c]
                    split = into > 1
                    home[split] = mix64(home[split] + mix64(every[w[split]]) % into[split].astype(np.uint64) + np.uint64(1))
                bucket = ((mix64(home) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                out = []
                for i, j in cuts(bucket[order]):
                    take = order[i:j]
                    run_of = cuts(c[take])
                    runs = np.array([b - a for a, b in run_of], np.uint32)
                    contexts = befores[c[take[[a for a, _ in run_of]]]]
                    own, place = np.unique(w[take], return_inverse=True)
                    out.append((int(bucket[take[0]]), batch_id, packed_ids(contexts), packed(runs), packed_ids(every[own]), packed(place.astype(np.uint32)), packed(r[take]), packed(n[take].astype(np.uint16)), train))
                ids = batch.column(2).slice(x, y - x)
                known = np.packbits(ids.is_valid().to_numpy(zero_copy_only=False))
                tokens = np.bincount(row, minlength=y - x).astype(np.int64)
                out.append((buckets + batch_id % buckets, batch_id, packed(ids.fill_null(0).to_numpy().astype(np.int64)), packed(known), packed(tokens), b"", b"", b"", train))
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in DEALT.split(", ")])
                batch_id += 1

    return docs.mapInArrow(run, DEALT)


#: Rows of a bucket or part, by what they are.
LISTS, PLACES, STATE, ASK, SUMS, REPLY, TOTAL = range(7)
#: What is gathered once. LISTS: documents of a batch (a ids, b whether known, c tokens, d whether in training). PLACES of a bucket: a to d dishes (context, word, customers, split contexts' places),
#: e and f batches and places' batches, g to i places' dishes, rows and counts, w contexts' customers. STATE: what sweeps need, in a (see ``Active``). ASK of a bucket at part k: a words with
#: customers' dishes of one customer (b) and tokens (c), d split contexts with such dishes (e) and customers (f).
GATHERED = "what int, bucket int, k int, batch_id long, a binary, b binary, c binary, d binary, e binary, f binary, g binary, h binary, i binary, w binary, dishes long, ones long, twos long"


@dataclass
class Active:
    """The dishes with two or more customers in a bucket: context, word (places in the lists) and customers; words; contexts with their dishes of one customer, and which are split."""

    context: np.ndarray
    word: np.ndarray
    customers: np.ndarray
    words: np.ndarray
    contexts: np.ndarray
    singles: np.ndarray
    split: np.ndarray

    #: Of the lists above; contexts' places go by their differences.
    KINDS = (np.uint32, np.uint32, np.uint32, np.uint64, np.uint64, np.uint32, np.uint8)

    def to_bytes(self) -> bytes:
        blobs = [packed(x.astype(k)) for x, k in zip((steps(self.context), self.word, self.customers, self.words, self.contexts, self.singles, self.split), self.KINDS)]
        return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)

    @staticmethod
    def of(data: bytes) -> Active:
        found, at = [], 0
        for kind in Active.KINDS:
            size = int.from_bytes(data[at : at + 8], "little")
            found.append(unpacked(data[at + 8 : at + 8 + size], kind))
            at += 8 + size
        found[0] = np.cumsum(found[0], dtype=np.uint32)
        return Active(*(x.astype(np.int64) if i < 3 else x for i, x in enumerate(found)))


def gathered(table: pa.Table, buckets: int, parts: int, large: np.ndarray) -> pa.Table:
    """The rows of one bucket of ``deal``."""
    number = table["bucket"][0].as_py()
    rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
    if number >= buckets:
        return rows_of(GATHERED, [{"what": LISTS, "bucket": number, "batch_id": r["batch"], "a": r["contexts"], "b": r["runs"], "c": r["words"], "d": r["train"]} for r in rows])
    context = np.concatenate([np.repeat(unpacked_ids(r["contexts"]), unpacked(r["runs"], np.uint32)) for r in rows])
    word = np.concatenate([unpacked_ids(r["words"])[unpacked(r["which"], np.uint32)] for r in rows])
    own = [unpacked(r["rows"], np.uint16) for r in rows]
    count = np.concatenate([unpacked(r["counts"], np.uint16) for r in rows])
    train = np.concatenate([np.unpackbits(unpacked(r["train"], np.uint8))[x] for r, x in zip(rows, own)])
    batch = np.repeat(np.arange(len(rows), dtype=np.uint32), [len(x) for x in own])
    ids = np.array([r["batch"] for r in rows], np.int64)
    del rows, table
    row = np.concatenate(own)
    contexts, context = np.unique(context, return_inverse=True)
    words, word = np.unique(word, return_inverse=True)
    dishes, dish = np.unique((context << 32) | word, return_inverse=True)
    context, word = dishes >> 32, dishes & 0xFFFFFFFF
    customers = np.bincount(dish, count * train.astype(np.float64), len(dishes)).astype(np.int64)
    eaters = np.bincount(context, customers, len(contexts)).astype(np.int64)
    one, more = customers == 1, customers > 1
    singles = np.bincount(context[one], minlength=len(contexts))
    is_split = np.isin(contexts, large)
    asks = _asked(number, {"a": words, "b": np.bincount(word[one], minlength=len(words)).astype(np.uint32), "c": np.bincount(word, customers, len(words)).astype(np.uint32)}, parts)
    theirs = _asked(number, {"d": contexts[is_split], "e": singles[is_split].astype(np.uint32), "f": eaters[is_split].astype(np.uint32)}, parts)
    for k, row_of in theirs.items():
        asks[k] = asks.get(k, {}) | row_of
    places = {"a": steps(context), "b": word.astype(np.uint32), "c": customers.astype(np.uint32), "d": np.flatnonzero(is_split).astype(np.uint32), "e": ids, "f": batch, "g": steps(dish), "h": row, "i": count, "w": eaters.astype(np.uint32)}
    used, own_word = np.unique(word[more], return_inverse=True)
    seen, own_context = np.unique(np.append(context[more], np.flatnonzero(is_split)), return_inverse=True)
    active = Active(own_context[: more.sum()], own_word, customers[more], words[used], contexts[seen], singles[seen], is_split[seen])
    stats = {"dishes": int((customers > 0).sum()), "ones": int(one.sum()), "twos": int((customers == 2).sum())}
    out = [{"what": PLACES, "bucket": number, **{k: packed(x) for k, x in places.items()}, **stats}, {"what": STATE, "bucket": number, "a": active.to_bytes()}]
    return rows_of(GATHERED, [*out, *({"what": ASK, "bucket": number, "k": k} | r for k, r in sorted(asks.items()))])


def _asked(number: int, columns: dict[str, np.ndarray], parts: int) -> dict[int, dict]:
    """By part, the columns of the ids (the first column, by home) that are at home there."""
    first = next(iter(columns.values()))
    home = homes(first, parts)
    return {int(home[i]): {c: (packed_ids if x is first else packed)(x[i:j]) for c, x in columns.items()} for i, j in cuts(home)}


#: Rows of a bucket's step. STATE: a active dishes, b their tables, c the tables of samples so far. SUMS for part k: a words, b their tables here, d split contexts, e their tables here.
BUCKET_STEP = "what int, bucket int, k int, a binary, b binary, c binary, d binary, e binary"
#: Rows of a part's step. STATE: a words, b dishes of one customer, c tokens, d tables, e to h split contexts, their dishes of one customer, customers and tables; i and j what samples had of words (customers, tables)
#: and contexts (tables). REPLY to a bucket: a shares of words, b x of split contexts. TOTAL: parent customers x, tables y, shares z, known words n, tokens m, words of one dish and of two.
PART_STEP = "what int, bucket int, k int, a binary, b binary, c binary, d binary, e binary, f binary, g binary, h binary, i binary, j binary, x long, y long, z double, n long, m long, ones long, twos long"
#: The last reply: by sample, customers and tables of words (a), tokens of words (b), tables of split contexts (c) and their customers (d).
LAST_REPLY = "bucket int, k int, a binary, b binary, c binary, d binary"


def bucket_rows(number: int, a: Active, tables: np.ndarray, saved: bytes, parts: int, data: bytes) -> pa.Table:
    words = np.bincount(a.word, tables, len(a.words)).astype(np.uint32)
    sums = _asked(number, {"a": a.words, "b": words}, parts)
    here = (a.singles + np.bincount(a.context, tables, len(a.contexts))).astype(np.uint32)
    split = np.flatnonzero(a.split)
    for k, row in _asked(number, {"d": a.contexts[split], "e": here[split]}, parts).items():
        sums[k] = sums.get(k, {}) | row
    out = [{"what": STATE, "bucket": number, "a": data, "b": packed(tables.astype(np.uint32)), "c": saved}]
    return rows_of(BUCKET_STEP, [*out, *({"what": SUMS, "bucket": number, "k": k} | r for k, r in sorted(sums.items()))])


def first_tables(state: pa.Table, parts: int) -> pa.Table:
    """Every dish at one table."""
    (row,) = state.to_pylist()
    a = Active.of(row["a"])
    return bucket_rows(row["bucket"], a, np.ones(len(a.customers), np.int64), b"", parts, row["a"])


def bucket_step(state: pa.Table, replies: pa.Table, now: Totals, s: Settings, sweep: int, is_sample: bool, parts: int) -> pa.Table:
    """A sweep over a bucket's dishes, given the parts' replies."""
    (row,) = state.to_pylist()
    a, replies = Active.of(row["a"]), sorted(replies.to_pylist(), key=lambda r: r["k"])
    tables = unpacked(row["b"], np.uint32).astype(np.int64)
    x = np.empty(len(a.contexts))
    here = a.singles + np.bincount(a.context, tables, len(a.contexts)).astype(np.int64)
    whole, split = a.split == 0, np.flatnonzero(a.split)
    x[whole] = x_of(a.contexts[whole], here[whole], s, sweep)
    x[split] = np.concatenate([np.empty(0), *(unpacked(r["b"], np.float64) for r in replies)])
    p = drawn(np.concatenate([np.empty(0), *(unpacked(r["a"], np.float64) for r in replies)]), now, s)
    tables = dish_tables(a.contexts[a.context], a.words[a.word], a.customers, x[a.context], p[a.word], s, sweep)
    saved = (row["c"] or b"") + (_chunk(tables.astype(np.uint32)) if is_sample else b"")
    return bucket_rows(row["bucket"], a, tables, saved, parts, row["a"])


def _chunk(x: np.ndarray) -> bytes:
    data = packed(x)
    return len(data).to_bytes(8, "little") + data


def _chunks(data: bytes | None, kind: type) -> list[np.ndarray]:
    out, at = [], 0
    while data and at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(unpacked(data[at + 8 : at + 8 + size], kind))
        at += 8 + size
    return out


def _summed(rows: list[dict], ids: str, columns: dict[str, type]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct ids of all rows and the sums of columns."""
    asked = [unpacked_ids(r[ids]) for r in rows]
    every, which = np.unique(np.concatenate([np.empty(0, np.uint64), *asked]), return_inverse=True)
    return every, [np.bincount(which, np.concatenate([np.empty(0), *(unpacked(r[c], kind) for r in rows)]), len(every)).astype(np.int64) for c, kind in columns.items()]


def first_part(asks: pa.Table) -> pa.Table:
    """The words and split contexts at home in a part; no word has a table yet."""
    k = asks["k"][0].as_py()
    rows = asks.to_pylist()
    words, (singles, tokens) = _summed(rows, "a", {"b": np.uint32, "c": np.uint32})
    contexts, (theirs, eaters) = _summed(rows, "d", {"e": np.uint32, "f": np.uint32})
    state = {"what": STATE, "k": k, "a": words, "b": singles, "c": tokens, "d": np.zeros(len(words), np.int64), "e": contexts, "f": theirs, "g": eaters, "h": np.zeros(len(contexts), np.int64)}
    total = {"what": TOTAL, "k": k, "x": 0, "y": 0, "z": 0.0, "n": int((tokens > 0).sum()), "m": int(tokens.sum())}
    return rows_of(PART_STEP, [{c: packed(x) if isinstance(x, np.ndarray) else x for c, x in state.items()}, total])


def part_step(state: pa.Table, sums: pa.Table, x: float, s: Settings, sweep: int, save: bool) -> pa.Table:
    """Adds up the buckets' tables, draws the parent's tables and shares of the words and x of the split contexts, and replies to the buckets."""
    (row,) = state.to_pylist()
    sums = sorted(sums.to_pylist(), key=lambda r: r["bucket"])
    words, contexts = unpacked(row["a"], np.uint64), unpacked(row["e"], np.uint64)
    customers, eaters = unpacked(row["b"], np.int64).copy(), np.zeros(len(contexts), np.int64)
    asked, theirs = [], []
    for r in sums:  # ids are distinct in a row
        asked.append(np.searchsorted(words, unpacked_ids(r["a"])))
        theirs.append(np.searchsorted(contexts, unpacked_ids(r["d"])))
        customers[asked[-1]] += unpacked(r["b"], np.uint32)
        eaters[theirs[-1]] += unpacked(r["e"], np.uint32)
    tables = word_tables(words, customers, x, s, sweep)
    shares = shares_of(words, customers, tables, s, sweep)
    theirs_x = x_of(contexts, eaters, s, sweep)
    out = row | {"d": packed(tables), "h": packed(eaters)}
    if save:
        out |= {"i": (row["i"] or b"") + _chunk(customers.astype(np.uint32)) + _chunk(tables.astype(np.uint32)), "j": (row["j"] or b"") + _chunk(eaters)}
    total = {"what": TOTAL, "k": row["k"], "x": int(customers.sum()), "y": int(tables.sum()), "z": float(shares.sum()), "ones": int((customers == 1).sum()), "twos": int((customers == 2).sum())}
    replies = [{"what": REPLY, "bucket": r["bucket"], "k": row["k"], "a": packed(shares[i]), "b": packed(theirs_x[j])} for r, i, j in zip(sums, asked, theirs)]
    return rows_of(PART_STEP, [out, total, *replies])


def last_replies(state: pa.Table, asks: pa.Table) -> pa.Table:
    """To every bucket, what the samples had of its words and split contexts."""
    (row,) = state.to_pylist()
    words, contexts, tokens, eaters = (unpacked(row[c], k) for c, k in (("a", np.uint64), ("e", np.uint64), ("c", np.int64), ("g", np.int64)))
    of_words, of_contexts = _chunks(row["i"], np.uint32), _chunks(row["j"], np.int64)
    out = []
    for r in asks.to_pylist():
        i, j = np.searchsorted(words, unpacked_ids(r["a"])), np.searchsorted(contexts, unpacked_ids(r["d"]))
        out.append({"bucket": r["bucket"], "k": r["k"], "a": b"".join(_chunk(x[i]) for x in of_words), "b": packed(tokens[i].astype(np.uint32)), "c": b"".join(_chunk(x[j]) for x in of_contexts), "d": packed(eaters[j])})
    return rows_of(LAST_REPLY, out)


SENT = "bucket int, batch_id long, rows binary, known binary, base binary, score binary"


def scored(table: pa.Table, replies: pa.Table, samples: list[Totals], s: Settings) -> pa.Table:
    """Sums by document over some buckets. table: PLACES of buckets; replies: LAST_REPLY, and with k = -1 the samples' tables of a bucket's active dishes (a)."""
    held: list[list[np.ndarray]] = []
    unknown = 0.5 / (s.tokens + 0.5 * (s.vocabulary + 1))
    for i in np.argsort(table["bucket"].to_numpy()).tolist():
        row = table.slice(i, 1).to_pylist()[0]
        state, *own = sorted(replies.filter(pa.compute.equal(replies["bucket"], row["bucket"])).to_pylist(), key=lambda r: r["k"])
        context, word, customers, split = (unpacked(row[c], np.uint32).astype(np.int64) for c in "abcd")
        context = np.cumsum(context) % (1 << 32)
        eaters = unpacked(row["w"], np.uint32).astype(np.int64)
        eaters[split] = np.concatenate([np.empty(0, np.int64), *(unpacked(r["d"], np.int64) for r in own)])
        tokens = np.concatenate([np.empty(0, np.uint32), *(unpacked(r["b"], np.uint32) for r in own)])
        of_words, of_contexts = [_chunks(r["a"], np.uint32) for r in own], [_chunks(r["c"], np.int64) for r in own]
        more, p = customers > 1, np.zeros(len(customers))
        for k, (now, active) in enumerate(zip(samples, _chunks(state["a"], np.uint32))):
            tables = np.minimum(customers, 1)
            tables[more] = active
            all_tables = np.bincount(context, tables, len(eaters)).astype(np.int64)
            all_tables[split] = np.concatenate([np.empty(0, np.int64), *(x[k] for x in of_contexts)])
            parent = expected(np.concatenate([x[2 * k] for x in of_words]).astype(np.int64), np.concatenate([x[2 * k + 1] for x in of_words]).astype(np.int64), now, s)
            p += prediction(customers, tables, eaters[context], all_tables[context], parent[word], s)
        log_p, log_base = np.log10(p / len(samples)), np.log10(np.maximum(unknown, (tokens + 0.5) / (s.tokens + 0.5 * (s.vocabulary + 1))))
        dish, n = np.cumsum(unpacked(row["g"], np.uint32), dtype=np.uint32), unpacked(row["i"], np.uint16).astype(np.float64)
        w = word[dish]
        held.append([unpacked(row["e"], np.int64)[unpacked(row["f"], np.uint32)], unpacked(row["h"], np.uint16), n * (tokens[w] > 0), n * log_base[w], n * log_p[dish]])
        held = [_added(held)]
    batch, own, known, base, full = held[0]
    blobs = [own, known.astype(np.uint32), base, full]
    first = table["bucket"][0].as_py()
    return rows_of(SENT, [{"bucket": first, "batch_id": int(batch[i])} | {c: packed(x[i:j]) for c, x in zip(("rows", "known", "base", "score"), blobs)} for i, j in cuts(batch)])


def _added(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sums of all parts by (batch, row)."""
    batch, row = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    batches, which = np.unique(batch, return_inverse=True)
    keys, where = np.unique((which.astype(np.int64) << 16) | row, return_inverse=True)
    sums = [np.bincount(where, np.concatenate([p[i] for p in parts]), len(keys)) for i in (2, 3, 4)]
    return [batches[keys >> 16], (keys & 0xFFFF).astype(np.uint16), *sums]


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1, seed: int = 1, bucket_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row of docs."""
    spark = docs.sparkSession
    folder = work_dir(spark)
    docs = docs.select(column(text).alias("text"), (fold_of(column(key), folds) != held).alias("train"), column(key).cast("bigint").alias("doc_id"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // bucket_bytes))
    parts = max(8, buckets // 16)
    large, pieces = large_contexts(docs, buckets, folder)

    dealt = deal(docs, large, pieces, buckets).groupBy("bucket").applyInArrow(lambda table: gathered(table, buckets, parts, large), GATHERED)
    with dropping_shuffles(spark):
        dealt.write.option("compression", "zstd").partitionBy("what").parquet(f"{folder}/buckets")  # each kind can go when it is no longer read
    stored = spark.read.schema(dealt.schema).parquet(f"{folder}/buckets")
    asks = stored.where(F.col("what") == ASK).select("bucket", "k", "a", "b", "c", "d", "e", "f")
    home = written(asks.groupBy("k").applyInArrow(first_part, PART_STEP), "part0", folder)
    known = home.where(F.col("what") == TOTAL).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    counts = stored.where(F.col("what") == PLACES).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("dishes", "ones", "twos"))).first()
    discount = lambda a, b: float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a else 0.5
    settings = Settings(discount(counts["ones"], counts["twos"]), 0.5, known["n"], known["m"], seed)
    told = written(stored.where(F.col("what") == STATE).select("bucket", "a").groupBy("bucket").applyInArrow(lambda state: first_tables(state, parts), BUCKET_STEP), "bucket0", folder)
    delete(spark, f"{folder}/buckets/what={STATE}")

    def parts_after(home: DataFrame, told: DataFrame, sweep: int, before: Totals, save: bool) -> tuple[DataFrame, Totals]:
        x = parent_x(before.tables, settings, sweep)
        sums = told.where(F.col("what") == SUMS).select("bucket", "k", "a", "b", "d", "e")
        state = home.where(F.col("what") == STATE)
        home = written(state.groupBy("k").cogroup(sums.groupBy("k")).applyInArrow(lambda a, b: part_step(a, b, x, settings, sweep, save), PART_STEP), f"part{sweep}", folder)
        rows = home.where(F.col("what") == TOTAL).select("k", "x", "y", "z").orderBy("k").collect()  # one small row a part
        tables = sum(r["y"] for r in rows)
        return home, Totals(sum(r["x"] for r in rows), tables, float(sum(r["z"] for r in rows)), base_share(tables, settings, sweep))

    def swept(now: Totals, sweep: int):
        return lambda state, replies: bucket_step(state, replies, now, settings, sweep, sweep in taken, parts)

    now = Totals(0, known["n"], 0.0, 0.0)
    taken = {BURN + i * BETWEEN for i in range(SAMPLES)}
    samples = []
    for sweep in range(1, max(taken) + 2):
        home, now = parts_after(home, told, sweep, now, sweep - 1 in taken)
        delete(spark, f"{folder}/part{sweep - 1}")
        if sweep == 1:  # with one table a dish, the parent's customers are the contexts of words
            both = home.where(F.col("what") == TOTAL).agg(F.sum("ones"), F.sum("twos")).first()
            settings.parent_discount = discount(both[0] or 0, both[1] or 0)
        if sweep - 1 in taken:
            samples.append(now)
        if sweep > max(taken):
            break
        replies = home.where(F.col("what") == REPLY).select("bucket", "k", "a", "b")
        state = told.where(F.col("what") == STATE).select("bucket", "a", "b", "c")
        told = written(state.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(swept(now, sweep), BUCKET_STEP), f"bucket{sweep}", folder)
        delete(spark, f"{folder}/bucket{sweep - 1}")

    last = home.where(F.col("what") == STATE).select("k", "a", "c", "e", "g", "i", "j").groupBy("k").cogroup(asks.select("bucket", "k", "a", "d").groupBy("k")).applyInArrow(last_replies, LAST_REPLY)
    last = written(last, "replies", folder)
    delete(spark, f"{folder}/buckets/what={ASK}")
    delete(spark, f"{folder}/part{max(taken) + 1}")
    together = (F.col("bucket") / TOGETHER).cast("int").alias("together")
    places = stored.where(F.col("what") == PLACES).select(together, "bucket", *"abcdefghiw")
    states = told.where(F.col("what") == STATE).selectExpr("bucket", "-1 AS k", "c AS a", *[f"CAST(NULL AS binary) AS {c}" for c in "bcd"])
    answered = last.unionByName(states).select(together, "*")
    partial = places.groupBy("together").cogroup(answered.groupBy("together")).applyInArrow(lambda a, b: scored(a, b, samples, settings), SENT)
    lists = stored.where(F.col("what") == LISTS).selectExpr("bucket", "batch_id", "a AS rows", "b AS known", "c AS base", "d AS score")

    def finish(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        head = rows.pop()  # the list of documents has the largest number
        ids, tokens = unpacked(head["rows"], np.int64), unpacked(head["base"], np.int64)
        n = len(ids)
        valid, train = (np.unpackbits(unpacked(head[c], np.uint8))[:n].astype(bool) for c in ("known", "score"))
        known, base, full = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for r in rows:
            at = unpacked(r["rows"], np.uint16)
            known[at] += unpacked(r["known"], np.uint32)
            base[at] += unpacked(r["base"], np.float64)
            full[at] += unpacked(r["score"], np.float64)
        perplexity = 10 ** np.minimum(-full / tokens, 300)
        return pa.table({"doc_id": pa.array(ids, mask=~valid), "held_out": ~train, "n_tokens": tokens, "n_known": known, "train_tokens": np.full(n, settings.tokens, np.int64), "base_score": base, "score": full, "perplexity": perplexity})

    return partial.unionByName(lists).groupBy("batch_id").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities and perplexities of every document."""
    return score_documents(documents(spark, sf_dir, "doc_id", "text"))
