"""Exact removal of repeated byte strings with merged Burrows-Wheeler transforms.

Each byte that a string of LENGTH bytes covers which also starts earlier (smaller id, or further left in the same text) is removed.

A corpus-wide suffix order is never built. What must be ordered are windows of LENGTH bytes that have a twin, and twins are brought together by winnowing: the least of the hashes
of the ANCHOR-byte pieces in a window, an anchor, depends on the window's bytes alone. So

1. the anchors of all texts are dealt into buckets by hash (one shuffle; positions only). An anchor that only one text and place has ends here, as do all but
   the first of equal texts, which are wholly repeated anyway;
2. the windows of the remaining anchors are cut out of their texts, as snippets, and dealt by anchor hash again. Equal snippets go in once, for the first. An anchor that occurs very often
   (HOT) is dealt by the bytes around it instead, in parts of SPAN distances, and equal snippets of a piece of text are merged before they are sent;
3. in a bucket, the snippets of SHARDS groups of input batches are strings of SYMBOL-byte symbols. Each shard gets its Burrows-Wheeler transform; the transforms are merged
   by refining their interleave to LENGTH bytes. Blocks of the merged order are windows with a common prefix of LENGTH: all but the first start of a block are repeated;
4. the repeated starts go back to their texts as ranges.

Buckets follow the size of the input, so a task holds one bucket's positions or snippets. Texts move twice, and only those that have a twin anchor. Nothing reaches the driver but sizes.

Cases: a null text has 0 bytes; texts shorter than LENGTH keep everything; a null id comes before all ids; repeated rows (one id and text) are one document, with
a row of the result each; ties, which are different texts of one id, are ordered by a hash of the text; a very long text is cut into runs of windows like all others; empty tables give empty results;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import END, merge_all, transform
from .common import arrow_bytes, column, documents, mix64, row_ranges, work_dir, written

LENGTH, ANCHOR, SYMBOL = 100, 56, 50
REACH = LENGTH - ANCHOR  # a window has REACH + 1 pieces
SHARDS = 4
#: Buckets of snippets for each bucket of positions: sorting windows takes far more memory than sorting anchors.
SNIPPET_BUCKETS = 4
#: Windows sorted at once, unless more share an anchor at one distance.
AT_ONCE = 150_000
#: An anchor that occurs oftener is split by what surrounds it: its windows at SPAN distances each go by the bytes that all of these cover.
HOT, SPAN = 2000, 8
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as one number."""
    return np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1)).copy().view("<u8").ravel()


def piece_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """A hash of the length bytes that begin at each place (length at least 8)."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight = _eights(np.ascontiguousarray(raw))
    out = np.zeros(n, np.uint64)
    for i, at in enumerate([*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]):
        out ^= eight[at : at + n] * _M[i]
        out = (out << np.uint64(23)) | (out >> np.uint64(41))
        out *= _M[(i + 3) % 7]
    return mix64(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width consecutive elements."""
    n, done = len(x) - width + 1, 1
    while 2 * done <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[width - done : width - done + n])


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, row, first window, last window, how far the anchor is from the first) of the runs of windows that share an anchor; windows are numbered by their starts in the row."""
    none = np.empty(0, np.int64)
    if len(raw) < LENGTH:
        return np.empty(0, np.uint64), none, none, none, none
    hashes = piece_hashes(raw, ANCHOR)
    places = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    least = _least((hashes & ~low) | (places & low), REACH + 1)  # leftmost of equal ones
    sizes = np.diff(offsets)
    row_of = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= offsets[row_of + 1]
    start = np.flatnonzero(inside)
    if not len(start):
        return np.empty(0, np.uint64), none, none, none, none
    row, pick = row_of[start], least[start]
    new = np.flatnonzero(np.append(True, (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])))
    last = np.append(new[1:], len(start)) - 1
    at = start[new]
    spot = at + ((pick[new] & low).astype(np.int64) - at) % (1 << 24)
    return hashes[spot], row[new], at - offsets[row[new]], start[last] - offsets[row[new]], spot - at


def _deal(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for b, i, j in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        yield b, order[i:j]


def _batch(fields: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    pairs = [f.split() for f in fields.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i].tobytes() if isinstance(r[i], np.ndarray) else r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(pairs)], names=[n for n, _ in pairs])


def _cat(rows: list[dict], name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), kind)


POSITIONS = "bucket int, ids binary, digests binary, hashes binary, rows binary, firsts binary, runs binary, skips binary"


def positions(docs: DataFrame, buckets: int) -> DataFrame:
    """The anchors of (doc_id, digest, text), dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = arrow_bytes(batch.column(2))
            parts = []
            for a, b in row_ranges(offsets):
                h, r, f, e, k = anchors(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                parts.append((h, r + a, f, e - f, k.astype(np.uint8)))
            if not parts:
                continue
            h, r, f, n, k = (np.concatenate([p[i] for p in parts]) for i in range(5))
            rows = []
            for b, take in _deal(((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)):
                here, which = np.unique(r[take], return_inverse=True)
                rows.append((b, ids[here], digests[here], h[take], which.astype(np.uint32), f[take].astype(np.uint32), n[take].astype(np.uint8), k[take]))
            if rows:
                yield _batch(POSITIONS, rows)

    return docs.mapInArrow(run, POSITIONS)


FOUND = "doc_id long, digest long, found binary"
_SPOT = np.dtype([("hash", "<u8"), ("first", "<u4"), ("run", "u1"), ("skip", "u1"), ("hot", "u1")])


def _twins(table: pa.Table) -> pa.Table:
    """Anchors that occur again, of the first of equal texts, by document."""
    rows = table.to_pylist()
    ids, digests, spots, at = [], [], [], 0
    for r in rows:
        which = np.frombuffer(r["rows"], np.uint32)
        ids.append(np.frombuffer(r["ids"], np.int64)[which])
        digests.append(np.frombuffer(r["digests"], np.int64)[which])
        spot = np.empty(len(which), _SPOT)
        spot["hash"], spot["first"], spot["run"], spot["skip"] = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["firsts"], np.uint32), np.frombuffer(r["runs"], np.uint8), np.frombuffer(r["skips"], np.uint8)
        spots.append(spot)
    ids, digests, spots = np.concatenate(ids), np.concatenate(digests), np.concatenate(spots)
    # equal texts have equal anchors: the least id of a digest stands for all
    texts, which = np.unique(digests, return_inverse=True)
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    keep = ids == least[which]
    ids, digests, spots = ids[keep], digests[keep], spots[keep]
    order = np.lexsort((spots["first"], ids, digests, spots["hash"]))
    ids, digests, spots = ids[order], digests[order], spots[order]
    # repeated rows (same id and text) count once
    h, f = spots["hash"], spots["first"]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (digests[1:] != digests[:-1]) | (f[1:] != f[:-1]) | (ids[1:] != ids[:-1]))
        ids, digests, spots = ids[new], digests[new], spots[new]
    _, which, often = np.unique(spots["hash"], return_inverse=True, return_counts=True)
    spots["hot"] = often[which] > HOT
    again = often[which] > 1
    ids, digests, spots = ids[again], digests[again], spots[again]
    order = np.lexsort((spots["first"], digests, ids))
    ids, digests, spots = ids[order], digests[order], spots[order]
    if not len(ids):
        return pa.Table.from_batches([_batch(FOUND, [])])
    begin = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (digests[1:] != digests[:-1])))
    end = np.append(begin[1:], len(ids))
    return pa.Table.from_batches([_batch(FOUND, [(int(ids[b]), int(digests[b]), spots[b:e].tobytes()) for b, e in zip(begin, end)])])


SNIPPETS = "bucket int, batch long, ids binary, digests binary, hashes binary, firsts binary, runs binary, skips binary, bytes binary"


def _contents(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the size bytes of raw from each begin; about chunk bytes are looked at at once."""
    one, two = np.empty(len(size), np.uint64), np.empty(len(size), np.uint64)
    upto, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + chunk, "right")))
        own = np.cumsum(size[i:j]) - size[i:j]
        spread = np.arange(int(size[i:j].sum())) - np.repeat(own, size[i:j])
        value = mix64((_cut_out(raw, begin[i:j], size[i:j]).astype(np.uint64) + np.uint64(1)) * _M[0] + spread.astype(np.uint64) * _M[1])
        one[i:j] = np.add.reduceat(value, own)
        two[i:j] = np.add.reduceat(mix64(value ^ _M[2]), own)
        i = j
    return one, two


def _cut_out(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return raw[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def _split(spot: np.ndarray, row: np.ndarray, raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spots, rows, keys to deal by): hot spots in parts of SPAN distances from the anchor, each with the hash of the bytes that all windows of its part cover. begin: where rows begin in raw."""
    key = spot["hash"].copy()
    hot = np.flatnonzero(spot["hot"])
    if not len(hot):
        return spot, row, key
    shared = LENGTH - SPAN + 1
    skip, run = spot["skip"][hot].astype(np.int64), spot["run"][hot].astype(np.int64)
    parts, rows, keys = [spot[spot["hot"] == 0]], [row[spot["hot"] == 0]], [key[spot["hot"] == 0]]
    for low in range(0, REACH + 1, SPAN):
        least, most = np.maximum(low, skip - run), np.minimum(low + SPAN - 1, skip)
        some = np.flatnonzero(least <= most)
        part = spot[hot[some]]
        part["first"] += (skip - most)[some].astype(np.uint32)
        part["run"], part["skip"] = (most - least)[some], most[some]
        anchor = begin[row[hot[some]]] + spot["first"][hot[some]] + skip[some]
        parts.append(part)
        rows.append(row[hot[some]])
        around = _contents(raw, anchor - low, np.full(len(some), shared))[0]
        keys.append(mix64(around + np.uint64(low + 1)))
    return np.concatenate(parts), np.concatenate(rows), np.concatenate(keys)


def snippets(found: DataFrame, buckets: int) -> DataFrame:
    """The windows of (doc_id, digest, found, text), cut out and dealt by anchor hash.

    Of equal snippets of a hot anchor in a piece of text only the first goes to its bucket; the others are repeated whatever else there is. They come without bytes, in buckets from ``buckets`` on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, digests = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = arrow_bytes(batch.column(3))
            spots = [np.concatenate([np.frombuffer(x, _SPOT) for x in v.as_py()]) for v in batch.column(2)]
            for a, b in row_ranges(offsets, 8 << 20):
                row = np.repeat(np.arange(b - a), [len(s) for s in spots[a:b]])
                if not len(row):
                    continue
                text, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                spot, row, key = _split(np.concatenate(spots[a:b]), row, text, at)
                size = spot["run"].astype(np.int64) + LENGTH
                begin = at[row] + spot["first"]
                who, digest = ids[a:b][row], digests[a:b][row]
                hot = np.flatnonzero(spot["hot"])
                one, two = _contents(text, begin[hot], size[hot])
                names = (key[hot], one, two, spot["run"][hot])
                by = np.lexsort((spot["first"][hot], digest[hot], who[hot], *names[::-1]))
                same = np.append(False, np.logical_and.reduce([x[by][1:] == x[by][:-1] for x in names])) if len(by) else np.empty(0, bool)
                by = hot[by]
                first = by[~same][np.cumsum(~same) - 1]  # of each group of equal snippets
                copy = same & ((who[by] != who[first]) | (digest[by] != digest[first]) | (spot["first"][by] != spot["first"][first]))
                later, kept = np.sort(by[copy]), np.sort(np.append(np.flatnonzero(spot["hot"] == 0), by[~same]))
                rows = []
                for k, take in _deal(((key[kept] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)):
                    t = kept[take]
                    s = spot[t]
                    rows.append((k, number, who[t], digest[t], key[t], s["first"].copy(), s["run"].copy(), s["skip"].copy(), _cut_out(text, begin[t], size[t])))
                if len(later):
                    s = spot[later]
                    rows.append((buckets + number % buckets, number, who[later], digest[later], key[later], s["first"].copy(), s["run"].copy(), s["skip"].copy(), b""))
                yield _batch(SNIPPETS, rows)
                number += 1

    return found.mapInArrow(run, SNIPPETS)


RANGES = "doc_id long, digest long, ranges binary"


def repeated_starts(size: np.ndarray, raw: np.ndarray, order: np.ndarray, shard: np.ndarray, hashes: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(snippet, start) of all windows of the snippets that an earlier one equals. order: the snippets' places in the order of the corpus.

    Equal windows have the same anchor at the same distance, so windows are taken by these, some at a time.
    """
    begin = np.cumsum(size) - size
    windows = size - LENGTH + 1
    symbol = piece_hashes(raw, SYMBOL).view(np.int64)
    snippet = np.repeat(np.arange(len(size), dtype=np.int32), windows)
    start = (np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
    _, kind = np.unique(hashes, return_inverse=True)
    group = kind[snippet] * (REACH + 1) + (skip[snippet] - start)
    by = np.argsort(group, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, group[by][1:] != group[by][:-1])), len(by))
    del group
    found, i = [], 0
    while i < len(cuts) - 1:
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + AT_ONCE, "right")) - 1)
        some = by[cuts[i] : cuts[j]]
        found.append(some[_later(begin[snippet[some]] + start[some], order[snippet[some]], start[some], shard[snippet[some]], symbol)])
        i = j
    again = np.concatenate(found) if found else np.empty(0, np.int64)
    return snippet[again].astype(np.int64), start[again].astype(np.int64)


def _later(place: np.ndarray, order: np.ndarray, start: np.ndarray, shard: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Which windows (by where they begin in the bytes of symbol) equal one that is earlier in the corpus."""
    depth = LENGTH // SYMBOL
    parts = []
    for s in range(SHARDS):
        mine = np.flatnonzero(shard == s)
        strings = np.full((len(mine), depth + 1), END)
        for d in range(depth):
            strings[:, d] = symbol[place[mine] + d * SYMBOL]
        names = np.full(strings.shape, -1)
        names[:, 0] = mine  # suffixes that are not whole windows are not reported
        parts.append(transform(strings.ravel(), names.ravel(), depth))
    merged, block = merge_all(parts, depth)
    real = merged.place >= 0
    window, block = merged.place[real], block[real]
    by = np.lexsort((start[window], order[window], block))
    first = np.append(True, block[by][1:] != block[by][:-1]) if len(by) else np.empty(0, bool)
    return window[by[~first]]


def _removed(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
    ids, digests, hashes = (_cat(rows, n, k) for n, k in (("ids", np.int64), ("digests", np.int64), ("hashes", np.uint64)))
    first, run, raw = _cat(rows, "firsts", np.uint32).astype(np.int64), _cat(rows, "runs", np.uint8).astype(np.int64), _cat(rows, "bytes", np.uint8)
    skip = _cat(rows, "skips", np.uint8).astype(np.int64)
    if not len(raw):  # snippets that equal one before
        who = np.repeat(np.arange(len(ids)), run + 1)
        at = np.repeat(first, run + 1) + np.arange(int((run + 1).sum())) - np.repeat(np.cumsum(run + 1) - run - 1, run + 1)
        return _as_ranges(ids[who], digests[who], at)
    shard = np.repeat(np.arange(len(rows)) * SHARDS // max(1, len(rows)), [len(r["ids"]) // 8 for r in rows])
    size = run + LENGTH
    begin = np.cumsum(size) - size
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((first, digests, ids))] = np.arange(len(ids))
    # equal snippets: the first stands for all, the others are repeated as a whole
    one, two = _contents(raw, begin, size)
    by = np.lexsort((rank, run, two, one, hashes))
    new = np.ones(len(by), bool)
    new[1:] = (hashes[by][1:] != hashes[by][:-1]) | (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1]) | (run[by][1:] != run[by][:-1])
    same = np.zeros(len(by), bool)  # cut from a repeated row: the very snippet before, which repeats nothing
    same[1:] = (ids[by][1:] == ids[by][:-1]) & (digests[by][1:] == digests[by][:-1]) & (first[by][1:] == first[by][:-1])
    whole, some = by[~new & ~same], np.sort(by[new])
    owner, start = repeated_starts(size[some], _cut_out(raw, begin[some], size[some]), rank[some], shard[some], hashes[some], skip[some])
    who = np.concatenate([some[owner], np.repeat(whole, run[whole] + 1)])
    at = np.concatenate([first[some[owner]] + start, np.repeat(first[whole], run[whole] + 1) + (np.arange(int((run[whole] + 1).sum())) - np.repeat(np.cumsum(run[whole] + 1) - run[whole] - 1, run[whole] + 1))])
    return _as_ranges(ids[who], digests[who], at)


def _as_ranges(doc: np.ndarray, digest: np.ndarray, at: np.ndarray) -> pa.Table:
    """Repeated starts as ranges, by document."""
    by = np.lexsort((at, digest, doc))
    doc, digest, at = doc[by], digest[by], at[by]
    if not len(doc):
        return pa.Table.from_batches([_batch(RANGES, [])])
    change = (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])
    begins = np.flatnonzero(np.append(True, change | (at[1:] > at[:-1] + 1)))
    pairs = np.stack([at[begins], np.append(at[begins[1:] - 1], at[-1])], axis=1).astype(np.uint32)
    heads = np.flatnonzero(np.append(True, (doc[begins][1:] != doc[begins][:-1]) | (digest[begins][1:] != digest[begins][:-1])))
    out = [(int(doc[begins[b]]), int(digest[begins[b]]), pairs[b:e].tobytes()) for b, e in zip(heads, np.append(heads[1:], len(begins)))]
    return pa.Table.from_batches([_batch(RANGES, out)])


RESULT = "doc_id long, digest long, n_removed long, n_spans long, kept_sha256 string"


def _cut(ranges: list[bytes], size: int) -> tuple[np.ndarray, int]:
    """Which bytes stay, and the number of runs removed."""
    pairs = np.concatenate([np.frombuffer(x, np.uint32) for x in ranges]).reshape(-1, 2).astype(np.int64)
    delta = np.zeros(size + 1, np.int64)
    np.add.at(delta, pairs[:, 0], 1)
    np.add.at(delta, pairs[:, 1] + LENGTH, -1)
    gone = np.cumsum(delta[:-1]) > 0
    return ~gone, int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row for each row of docs."""
    spark = docs.sparkSession
    folder = work_dir(spark)
    least_id = F.lit(-(1 << 63)).cast("bigint")
    docs = docs.select(F.coalesce(column(key).cast("bigint"), least_id).alias("doc_id"), F.xxhash64(F.coalesce(column(text), F.lit(""))).alias("digest"), F.coalesce(column(text), F.lit("")).alias("text"))
    heads = docs.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    heads = written(heads.groupBy("doc_id", "digest", "sha", "n_bytes").agg(F.count("*").alias("rows")), "heads", folder)
    size = heads.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(64, -(-size // bucket_bytes))
    twins = written(positions(docs, buckets).groupBy("bucket").applyInArrow(_twins, FOUND), "spots", folder)
    spots = twins.groupBy("doc_id", "digest").agg(F.collect_list("found").alias("found"))
    cut = snippets(spots.join(docs, ["doc_id", "digest"]).select("doc_id", "digest", "found", "text"), buckets * SNIPPET_BUCKETS)
    ranges = written(cut.groupBy("bucket").applyInArrow(_removed, RANGES), "ranges", folder)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = arrow_bytes(batch.column(3))
            rows = []
            for i in range(batch.num_rows):
                part = raw[offsets[i] : offsets[i + 1]]
                stays, spans = _cut(batch.column(2)[i].as_py(), len(part))
                kept = part[stays].tobytes()
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(part) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            yield _batch(RESULT, rows)

    touched = ranges.groupBy("doc_id", "digest").agg(F.collect_list("ranges").alias("ranges")).join(docs, ["doc_id", "digest"]).select("doc_id", "digest", "ranges", "text")
    done = written(touched.mapInArrow(finish, RESULT), "done", folder).dropDuplicates(["doc_id", "digest"])
    firsts = heads.groupBy("sha").agg(F.min("doc_id").alias("first"))
    every = heads.join(firsts, "sha").join(done, ["doc_id", "digest"], "left").withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    copy = (F.col("doc_id") != F.col("first")) & (F.col("n_bytes") >= LENGTH)
    return every.select(
        F.nullif("doc_id", least_id).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document is removed as repeated."""
    return remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
