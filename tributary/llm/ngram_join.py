"""N-gram Jaccard join with signature trees.

The link is exact: Jaccard similarity of the sets of word 5-grams of at least 75 %. Equal sets are one class and are compared once.

1. Each set's least hashes (a quarter of it and a share of LEAST more) are dealt into hash buckets. Sets that link share at least a known number of those, so a
   class with fewer shared ones is alone. Most of a corpus ends here, without its text or its other n-grams ever moving.
2. The others' whole sets are counted in buckets the same way. A class needs three quarters of its n-grams in other sets. What is left orders its n-grams by
   how many sets hold them, rarest first, and linked sets share one of the first quarter. Passages that many documents share come last in that order (above 65535 holders by hash alone), so they
   join nothing. Classes that share such an n-gram form a block, and blocks hold whole components.
3. In a block a signature tree is built: a leaf is one set's bitmap and size, a node the OR of its children's bitmaps, their range of sizes and
   most collisions. A dual traversal drops a pair of nodes whose greatest possible overlap or sizes rule out a link, or which are wholly of one component already,
   so a group of copies costs its size and not its square; leaf pairs that remain are intersected exactly.

Blocks beyond ``block_tokens`` are dealt into chunks and each pair of chunks is traversed by one task, so no task holds more than two chunks. That is
exact for a block of any size; the links of the tasks are joined to components afterwards. Buckets follow the size of the input. Nothing but counts and sizes reaches the driver.

Cases: a null text and a text without words have an empty set and are their own component (a null id: null); fewer than five words are one n-gram; equal texts link; a
repeated id is one component with all its rows; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_bytes, documents, mix64, numbered, perhaps, row_ranges, word_hashes, work_dir, written
from .components import components

K = 5
NUMERATOR, DENOMINATOR = 75, 100
#: Share of a set that must be common to two prefixes.
LEAST = 0.1
PRIME = np.uint64(0x9E3779B97F4A7C15)


def overlap_needed(n):
    """Least size of the overlap that a set of n elements needs for a link."""
    return -(-n * NUMERATOR // DENOMINATOR)


def spare(n):
    return np.maximum(1, (n * LEAST).astype(np.int64) if isinstance(n, np.ndarray) else int(n * LEAST))


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int = K) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    words, at = word_hashes(raw, offsets)
    rolled = words[: max(0, len(words) - k + 1)].copy()
    for i in range(1, k):
        rolled *= PRIME
        rolled += words[i : i + len(rolled)]
        rolled = mix64(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for i in range(a, b):
                h = mix64(h * PRIME + words[i : i + 1])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(s):
        return 0, 0
    a = np.bitwise_xor.reduce(mix64(s + np.uint64(1)))
    b = np.add.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return int(mix64(np.array([a + np.uint64(len(s))]))[0].view(np.int64)), int(b.view(np.int64))


def dealt(tokens: np.ndarray, buckets: int, *others: np.ndarray) -> Iterator[tuple]:
    """(bucket, tokens, others...) for each bucket that has tokens."""
    bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for b, a, e in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        take = order[a:e]
        yield (b, tokens[take], *(x[take] for x in others))


def _rows(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "n": pa.int64(), "doc_id": pa.int64(), "digest": pa.int64(), "c": pa.int64(), "d": pa.int64(), "shared": pa.int64(), "a": pa.int64(), "b": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] if not isinstance(r[i], np.ndarray) else r[i].tobytes() for r in rows], kinds.get(x, pa.binary())) for i, x in enumerate(names)], names=names)


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in table[name]), kind)


def sets_of(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows with bucket null: (doc_id, digest, n, class c and d) of each document (doc_id, text, digest); others: tokens of prefixes in a bucket and the class of each."""
    names = ["bucket", "doc_id", "digest", "n", "c", "d", "tokens", "classes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = arrow_bytes(batch.column(1))
            ids, digests, rows, tokens, classes = batch.column(0).to_pylist(), batch.column(2).to_pylist(), [], [], []
            seen = set()
            for a, b in row_ranges(offsets):
                for r, s in enumerate(shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), a):
                    c, d = class_of(s)
                    n = len(s)
                    rows.append((None, ids[r], digests[r], n, c, d, None, None))
                    if n and (c, d) not in seen:
                        seen.add((c, d))
                        tokens.append(s[: min(n, n - overlap_needed(n) + int(spare(n)))])
                        classes.append(np.full(len(tokens[-1]), c, np.int64))
            if tokens:
                for b, t, c in dealt(np.concatenate(tokens), buckets, np.concatenate(classes)):
                    every, which = np.unique(c, return_inverse=True)
                    rows.append((b, None, None, None, None, None, t, _pack(every, which)))
            yield _rows(names, rows)

    return docs.mapInArrow(run, "bucket int, doc_id long, digest long, n long, c long, d long, tokens binary, classes binary")


def _pack(every: np.ndarray, which: np.ndarray) -> bytes:
    wide = len(every) > 1 << 16
    return np.array([len(every), wide], np.int64).tobytes() + every.tobytes() + which.astype(np.uint32 if wide else np.uint16).tobytes()


def _packed(values: np.ndarray, *others: np.ndarray) -> tuple:
    """values packed with their distinct ones once, and others at those."""
    every, first, which = np.unique(values, return_index=True, return_inverse=True)
    return (_pack(every, which), *(x[first].astype(np.uint32) for x in others))


def _unpacked(table: pa.Table, name: str, *others: str) -> tuple[np.ndarray, ...]:
    """The reverse of _packed, over all rows of a table."""
    columns = [table[x].to_pylist() for x in (name, *others)]
    out: list[list[np.ndarray]] = [[] for _ in columns]
    for data, *rest in zip(*columns):
        n, wide = np.frombuffer(data, np.int64, 2)
        which = np.frombuffer(data, np.uint32 if wide else np.uint16, -1, 16 + 8 * n)
        out[0].append(np.frombuffer(data, np.int64, n, 16)[which])
        for o, x in zip(out[1:], rest):
            o.append(np.frombuffer(x, np.uint32)[which].astype(np.int64))
    return tuple(np.concatenate(o) for o in out)


def _unpack(data: bytes) -> np.ndarray:
    n, wide = np.frombuffer(data, np.int64, 2)
    every = np.frombuffer(data, np.int64, n, 16)
    return every[np.frombuffer(data, np.uint32 if wide else np.uint16, -1, 16 + 8 * n)]


def _shared(table: pa.Table) -> pa.Table:
    """For each class, how many tokens of the bucket it has in common with another class."""
    tokens = _joined(table, "tokens", np.uint64)
    classes = np.concatenate([_unpack(v.as_py()) for v in table["classes"]])
    token, cls, count = _counted(tokens, classes)
    found, n = np.unique(cls[count > 1], return_counts=True)
    return pa.table({"c": pa.array(found, pa.int64()), "shared": pa.array(n, pa.int64())})


def _counted(tokens: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, class), and in how many classes the token is."""
    order = np.lexsort((classes, tokens))
    token, cls = tokens[order], classes[order]
    if len(token):
        new = np.append(True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))
        token, cls = token[new], cls[new]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(token)))
    return token, cls, np.repeat(size, size)


def whole_sets(texts: DataFrame) -> DataFrame:
    """(c, d, n, tokens) of (text, c, d): texts whose class is the one wanted. A repeated text can come more than once, which later steps allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = arrow_bytes(batch.column(0))
            wanted = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            for a, b in row_ranges(offsets):
                sets = {class_of(s): s for s in shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])}
                yield _rows(["c", "d", "n", "tokens"], [(*k, len(sets[k]), sets[k]) for k in dict.fromkeys(wanted[a:b]) if k in sets])

    return texts.mapInArrow(run, "c long, d long, n long, tokens binary")


def candidate_edges(sets: DataFrame, buckets: int) -> DataFrame:
    """Edges (a, b) between classes such that linked classes are connected."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(v.as_py(), np.uint64) for v in batch.column(2)]
            n = np.array([len(t) for t in tokens])
            if n.sum():
                c = np.repeat(batch.column(0).to_numpy(), n)
                rows = [(b, t, *_packed(k, size)) for b, t, k, size in dealt(np.concatenate(tokens), buckets, c, np.repeat(n, n))]
                yield _rows(["bucket", "tokens", "classes", "sizes"], rows)

    def replies(table: pa.Table) -> pa.Table:
        tokens, (classes, sizes) = _joined(table, "tokens", np.uint64), _unpacked(table, "classes", "sizes")
        every, at = np.unique(classes, return_index=True)
        size_of = sizes[at]
        token, cls, count = _counted(tokens, classes)
        keep = count > 1
        token, cls, count = token[keep], cls[keep], count[keep]
        rows = list(dealt(mix64(cls.view(np.uint64)), buckets, cls, token, count, size_of[np.searchsorted(every, cls)]))
        return pa.Table.from_batches([_rows(["bucket", "classes", "tokens", "counts", "sizes"], [(b, p, t, np.minimum(n, 0xFFFF).astype(np.uint16), z) for b, _, k, t, n, size in rows for p, z in [_packed(k, size)]])])

    def rarest(table: pa.Table) -> pa.Table:
        (cls, size), token, count = _unpacked(table, "classes", "sizes"), _joined(table, "tokens", np.uint64), _joined(table, "counts", np.uint16)
        order = np.lexsort((token, count, cls))
        cls, token, size = cls[order], token[order], size[order]
        first = np.flatnonzero(np.append(True, cls[1:] != cls[:-1])) if len(cls) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(cls)))
        rank = np.arange(len(cls)) - np.repeat(first, n) + size - np.repeat(n, n)  # those that no other set has come first
        keep = (np.repeat(n, n) >= overlap_needed(size)) & (rank < size - overlap_needed(size) + 1)
        return pa.Table.from_batches([_rows(["bucket", "tokens", "classes"], [(b, t, *_packed(k)) for b, t, k in dealt(token[keep], buckets, cls[keep])])])

    def stars(table: pa.Table) -> pa.Table:
        token, cls, count = _counted(_joined(table, "tokens", np.uint64), *_unpacked(table, "classes"))
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.empty(0, np.int64)
        least = np.repeat(cls[first], np.diff(np.append(first, len(token))))
        pairs = np.unique(np.stack([cls[count > 1], least[count > 1]], axis=1), axis=0) if len(token) else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    first = sets.select("c", "n", "tokens").mapInArrow(scatter, "bucket int, tokens binary, classes binary, sizes binary")
    second = first.groupBy("bucket").applyInArrow(replies, "bucket int, classes binary, tokens binary, counts binary, sizes binary")
    third = second.groupBy("bucket").applyInArrow(rarest, "bucket int, tokens binary, classes binary")
    return third.groupBy("bucket").applyInArrow(stars, "a long, b long").distinct()


class SignatureTree:
    """Sets in the order of their sizes below nodes of FANOUT children: OR of bitmaps, sizes, and most tokens that share a bit with another of their set."""

    FANOUT = 8

    def __init__(self, sets: list[np.ndarray], most: int):
        """most: the largest size of a set in any tree that this one meets, since their bitmaps need one width."""
        self.sets = sets
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = 1 << int(np.clip(np.ceil(np.log2(4 * most)), 9, 14))
        marks = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            bit = s & np.uint64(bits - 1)
            np.bitwise_or.at(marks[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        slack = sizes - np.bitwise_count(marks).sum(axis=1, dtype=np.int64)
        self.levels = [(marks, sizes, sizes, slack)]
        while len(self.levels[-1][0]) > 1:
            m, low, high, sl = self.levels[-1]
            at = np.arange(0, len(m), self.FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(sl, at)))

    def possible(self, level: int, a: int, others: np.ndarray, other_tree: SignatureTree) -> np.ndarray:
        """Which nodes others of other_tree, at the same level, may hold a link of node a."""
        m, low, high, slack = self.levels[level]
        m2, low2, high2, slack2 = (x[others] for x in other_tree.levels[level])
        most = np.bitwise_count(m2 & m[a]).sum(axis=1, dtype=np.int64) + np.minimum(slack[a], slack2)
        most = np.minimum(most, np.minimum(high[a], high2))
        needed = NUMERATOR * (low[a] + low2)  # 100 o >= 75 (x + y - o)
        near = (DENOMINATOR * high[a] >= NUMERATOR * low2) & (DENOMINATOR * high2 >= NUMERATOR * low[a])
        return near & ((DENOMINATOR + NUMERATOR) * most >= needed)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    overlap = int(np.count_nonzero(both[1:] == both[:-1]))
    return DENOMINATOR * overlap >= NUMERATOR * (len(x) + len(y) - overlap)


def tree_join(sets: list[np.ndarray], split: int | None = None) -> np.ndarray:
    """The component (least member) of each set, by links within sets, or only between the first split sets and the others, and within neither."""
    n = len(sets)
    parts = [np.arange(n)] if split is None else [np.arange(split), np.arange(split, n)]
    orders = [p[np.lexsort(([sets[i][0] for i in p], [len(sets[i]) for i in p]))] for p in parts if len(p)]
    label = np.arange(n)
    if len(orders) < len(parts) or not n:
        return label
    most = max(len(s) for s in sets)
    trees = [SignatureTree([sets[i] for i in o], most) for o in orders]
    order, tree = (orders[0], orders[-1]), (trees[0], trees[-1])
    fan, same = SignatureTree.FANOUT, split is None

    def members(side: int, level: int, node: int) -> np.ndarray:
        return order[side][node * fan**level : (node + 1) * fan**level]

    def settled(level: int, a: int, b: int) -> bool:
        x, y = label[members(0, level, a)], label[members(1, level, b)]
        return bool((x == x[0]).all() and (y == x[0]).all())

    depth = min(len(t.levels) for t in tree) - 1
    stack = [(depth, a, b) for a in range(len(tree[0].levels[depth][0])) for b in range(len(tree[1].levels[depth][0])) if not same or a <= b]
    while stack:
        level, a, b = stack.pop()
        if (level or not same or a != b) and settled(level, a, b):
            continue
        if level == 0:
            if same and a == b:
                continue
            x, y = order[0][a], order[1][b]
            if linked(sets[x], sets[y]):
                low, high = sorted((label[x], label[y]))
                label[label == high] = low
            continue
        level -= 1
        left = range(a * fan, min((a + 1) * fan, len(tree[0].levels[level][0])))
        right = np.arange(b * fan, min((b + 1) * fan, len(tree[1].levels[level][0])))
        inner, outer = [], []
        for x in left:
            others = right[right >= x] if same and a == b else right
            if len(others):
                for y in others[tree[0].possible(level, x, others, tree[1])].tolist():
                    (inner if same and x == y else outer).append((level, x, y))
        stack += outer + inner  # a node with itself comes first: its own copies settle before others are compared
    return label


def block_links(sets: DataFrame, blocks: DataFrame, block_tokens: int) -> DataFrame:
    """(a, b): classes and the least class of their component, as far as one task sees it."""
    tokens = sets.agg(F.sum(F.col("n") + F.lit(200))).first()[0] or 0
    tasks = max(256, -(-2 * tokens // block_tokens))  # small blocks share a task, half a large block's tokens in each
    sized = sets.select("c", "n").join(blocks.selectExpr("node AS c", "root AS block"), "c")
    chunks = sized.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("n") + F.lit(200)) / F.lit(block_tokens))).cast("int").alias("chunks"))
    homes = blocks.selectExpr("node AS c", "root AS block").join(chunks, "block")  # without the sets, which move once to meet it
    rows = sets.join(homes.hint("merge"), "c").withColumn("chunk", F.pmod(F.xxhash64("c", "d"), F.col("chunks")).cast("int"))
    # a chunk meets each other chunk once; a block of one chunk meets itself
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.struct(F.least("chunk", i).alias("i"), F.greatest("chunk", i).alias("j")))
    many = rows.withColumn("pair", F.explode(pairs)).withColumn("task", F.when(F.col("chunks") == 1, F.pmod("block", F.lit(tasks))).otherwise(F.xxhash64("block", "pair.i", "pair.j")))

    def solve(table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values(["block", "i", "j", "chunk", "c"], kind="stable")
        out = []
        for (_, i, j), part in frame.groupby(["block", "i", "j"], sort=False):
            part = part.drop_duplicates("c")
            sets_here = [np.frombuffer(t, np.uint64) for t in part["tokens"]]
            split = None if i == j else int((part["chunk"] == i).sum())
            label = tree_join(sets_here, split)
            names = part["c"].to_numpy()
            least = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(least, label, names)
            out.append(np.stack([names, least[label]], axis=1))
        got = np.concatenate(out)
        got = got[got[:, 0] != got[:, 1]]
        return pa.table({"a": pa.array(got[:, 0], pa.int64()), "b": pa.array(got[:, 1], pa.int64())})

    dealt_out = many.select("task", "block", "pair.i", "pair.j", "chunk", "c", "tokens")
    return dealt_out.groupBy("task").applyInArrow(solve, "a long, b long")


def join_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = 8 << 20, block_tokens: int = 3_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs."""
    out = _grouped(docs, key, text, bucket_bytes, block_tokens)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = 8 << 20, block_tokens: int = 3_000_000) -> DataFrame:
    """(doc_id, digest of the text, n, root, component_id): one row for each row of docs; rows with n-grams are of one component if they have one root."""
    spark = docs.sparkSession
    folder = work_dir(spark)
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), _digest(text).alias("digest"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, -(-size // bucket_bytes))
    found = written(sets_of(docs, buckets), "sets", folder)
    rows = found.where("bucket IS NULL").select("doc_id", "digest", "n", "c", "d")
    classes = rows.where("n > 0").groupBy("c", "d", "n").agg(F.min("doc_id").alias("least"))
    shared = found.where("bucket IS NOT NULL").select("bucket", "tokens", "classes").groupBy("bucket").applyInArrow(_shared, "c long, shared long").groupBy("c").agg(F.sum("shared").alias("shared"))
    needed = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) * LEAST))
    maybe = classes.join(shared, "c").where(F.col("shared") >= needed)
    maybe = written(maybe.select("c", "d", "least"), "maybe", folder)
    texts = perhaps(docs, "doc_id", maybe.select("least")).alias("x").join(maybe.hint("merge").alias("m"), F.col("x.doc_id").eqNullSafe(F.col("m.least"))).select("x.text", "m.c", "m.d")
    sets = written(whole_sets(texts), "whole", folder)
    edges = written(candidate_edges(sets, buckets), "candidates", folder)
    blocks = components(edges)
    links = written(block_links(sets, blocks, block_tokens), "links", folder)
    roots = components(links).selectExpr("node AS c", "root")
    least = classes.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(ids, "root").select("c", "d", "root", "component_id")
    return rows.join(named, ["c", "d"], "left").select("doc_id", "digest", "n", "root", "component_id")


def _digest(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document."""
    return join_groups(documents(spark, sf_dir, "doc_id", "text"))


def ngram_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of every document's set of shingles."""
    return op2_ngram_join(spark, sf_dir).select("doc_id", "n_shingles")


def keep_one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that with the least id (an id before none), of several texts with that id the one with the least digest. Texts without words are not copies of others."""
    names, carried = docs.columns, numbered(docs)
    key, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    rows = _grouped(docs.select("doc_id", "text"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best")
    kept = rows.where("n > 0").groupBy("root").agg(best).select("best.doc_id", "best.digest")
    kept = kept.unionByName(rows.where("n = 0").select("doc_id", "digest")).distinct().selectExpr("doc_id AS kept_id", "digest AS kept_digest")
    found = carried.join(kept, F.col(key).eqNullSafe(F.col("kept_id")) & (_digest(text) == F.col("kept_digest")), "left_semi").dropDuplicates([key, text])
    return found.toDF(*names)
