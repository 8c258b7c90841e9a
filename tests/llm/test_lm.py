import math
import random
import zlib
from collections import Counter

import numpy as np

from tributary.llm import pitman_yor as P

from .conftest import ODD, make, prose


def base(rows):
    toks = [((d, t), (t or "").encode().lower().split() + [None]) for d, t, *_ in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for (d, _), _ in toks]
    c = Counter(w for (_, ws), h in zip(toks, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ((d, _), ws), h in zip(toks, held)]


def check(df, rows):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect()), key=repr)
    assert got == sorted(((*b[:5], round(b[5], 6)) for b in base(rows)), key=repr)


def test_base_columns_on_odd_rows(spark, odd):
    df = P.score_documents(odd).cache()
    check(df, ODD)
    assert all(r["score"] < 0 for r in df.collect())


def test_empty_table(spark, empty):
    assert P.score_documents(empty).count() == 0


def test_better_than_base_on_held_out_text(spark, sf):
    rows = [r for r in P.op1_lm_scoring(spark, sf).collect() if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def lists(rows):
    """(word, context, row) of every token, by the tokenizer of the operator."""
    raw = [(t or "").encode() for _, t, *_ in rows]
    return P.tokens_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def chain(rows, samples, seed=1):
    """The sampler on plain arrays that hold the whole corpus: yields probabilities of all tokens of rows, sample by sample."""
    word, context, row = lists(rows)
    train = np.array([zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1 for d, *_ in rows])[row]
    words, w = np.unique(word, return_inverse=True)
    contexts, c = np.unique(context, return_inverse=True)
    dishes, dish = np.unique(c * len(words) + w, return_inverse=True)
    n = np.bincount(dish, train, len(dishes)).astype(np.int64)
    dc, dw = np.divmod(dishes, len(words))
    discount = lambda x: float(np.clip((x == 1).sum() / ((x == 1).sum() + 2 * (x == 2).sum()), 0.05, 0.95))
    v = int((np.bincount(w, train) > 0).sum())
    s = P.Settings(discount(n), 0.5, v, int(train.sum()), seed)
    t, tables = np.minimum(n, 1), v
    for sweep in range(1, max(samples) + 2):
        customers = np.bincount(dw, t, len(words)).astype(np.int64)
        own = P.word_tables(words, customers, P.parent_x(tables, s, sweep), s, sweep)
        tables = int(own.sum())
        if sweep - 1 in samples:
            now = P.Totals(int(customers.sum()), tables, 0, 0)
            p = P.expected(customers, own, now, s)[dw]
            yield P.prediction(n, t, np.bincount(dc, n)[dc], np.bincount(dc, t)[dc], p, s)[dish]
        shares = P.shares_of(words, customers, own, s, sweep)
        now = P.Totals(int(customers.sum()), tables, float(shares.sum()), P.base_share(tables, s, sweep))
        if sweep == 1:
            s.parent_discount = discount(customers)
        x = P.x_of(contexts, np.bincount(dc, t).astype(np.int64), s, sweep)
        more = n > 1
        t = t.copy()
        t[more] = P.dish_tables(contexts[dc], words[dw], n, x[dc], P.drawn(shares, now, s)[dw], s, sweep)[more]


def seated(rows, sweeps, burn, discount, parent_discount):
    """The same model seated one customer at a time, with every table remembered: mean probabilities of all tokens of rows."""
    rng = random.Random(4)
    word, context, row = (x.tolist() for x in lists(rows))
    train = [zlib.crc32(str(rows[r][0]).encode()) % 5 != 1 for r in row]
    v = len({w for w, h in zip(word, train) if h})
    parent, eaters, below = {}, Counter(), {}  # tables of words; customers by context; tables of dishes

    def p_parent(w):
        own = parent.get(w, [])
        tables, customers = sum(map(len, parent.values())), sum(map(sum, parent.values()))
        return (sum(own) - parent_discount * len(own) + (P.PARENT_STRENGTH + parent_discount * tables) / (v + 1)) / (P.PARENT_STRENGTH + customers)

    def p_dish(c, w):
        own, tables = below.get((c, w), []), by_context[c]
        return (sum(own) - discount * len(own) + (P.STRENGTH + discount * tables) * p_parent(w)) / (P.STRENGTH + eaters[c])

    by_context = Counter()

    def sit(own, mass, d):
        """Adds a customer to a list of tables; whether it opened one."""
        at = rng.random() * (sum(own) - d * len(own) + mass)
        for i, size in enumerate(own):
            at -= size - d
            if at < 0:
                own[i] += 1
                return False
        own.append(1)
        return True

    def rise(own):
        """Takes one customer away; whether its table closed."""
        i = rng.choices(range(len(own)), own)[0]
        own[i] -= 1
        if own[i]:
            return False
        del own[i]
        return True

    def add(c, w):
        if sit(below.setdefault((c, w), []), (P.STRENGTH + discount * by_context[c]) * p_parent(w), discount):
            by_context[c] += 1
            tables = sum(map(len, parent.values()))
            sit(parent.setdefault(w, []), (P.PARENT_STRENGTH + parent_discount * tables) / (v + 1), parent_discount)
        eaters[c] += 1

    def remove(c, w):
        eaters[c] -= 1
        if rise(below[c, w]):
            by_context[c] -= 1
            rise(parent[w])

    customers = [(c, w) for c, w, h in zip(context, word, train) if h]
    for c, w in customers:
        add(c, w)
    kinds = list(zip(context, word))
    sums = dict.fromkeys(kinds, 0.0)
    for sweep in range(sweeps):
        for c, w in customers:
            remove(c, w)
            add(c, w)
        if sweep >= burn:
            for k in sums:
                sums[k] += p_dish(*k) / (sweeps - burn)
    return np.array([sums[k] for k in kinds])


def small_corpus():
    r = random.Random(3)
    return [(i, " ".join(r.choices("abcdef", (12, 6, 3, 2, 1, 1), k=12)), "en", "a") for i in range(12)]


def test_agrees_with_seating_one_customer_at_a_time():
    rows = small_corpus()
    word, context, row = lists(rows)
    train = np.array([zlib.crc32(str(d).encode()) % 5 != 1 for d, *_ in rows])[row]
    n = np.array(list(Counter((c, w) for c, w, h in zip(context.tolist(), word.tolist(), train) if h).values()))
    k = Counter(w for _, w in {(c, w) for c, w, h in zip(context.tolist(), word.tolist(), train) if h})
    discount = lambda x: float(np.clip(sum(i == 1 for i in x) / max(1, sum(i == 1 for i in x) + 2 * sum(i == 2 for i in x)), 0.05, 0.95)) if sum(i == 1 for i in x) else 0.5
    plain = seated(rows, 700, 100, discount(n), discount(list(k.values())))
    drawn = np.mean(list(chain(rows, set(range(50, 2000)))), axis=0)
    assert np.abs(np.log10(drawn / plain)).max() < 0.03
    assert abs(np.log10(drawn).sum() / np.log10(plain).sum() - 1) < 0.01  # the base share of a drawn parent is spread at its mean: with 7 words that shows


def test_operator_equals_the_chain_on_plain_arrays(spark):
    rng = np.random.default_rng(12)
    share = 1 / np.arange(1, 900.0)
    rows = [(i, " ".join(f"w{k}" for k in rng.choice(len(share), 100, p=share / share.sum())), "en", "a") for i in range(120)]
    mean = np.mean(list(chain(rows, {P.BURN + i * P.BETWEEN for i in range(P.SAMPLES)})), axis=0)
    want = np.bincount(lists(rows)[2], np.log10(mean))
    got = {r["doc_id"]: r for r in P.score_documents(make(spark, rows), bucket_bytes=3000).collect()}
    assert all(abs(got[i]["score"] - want[i]) < 1e-8 for i in range(len(rows)))
    assert all(abs(math.log10(r["perplexity"]) + r["score"] / r["n_tokens"]) < 1e-9 for r in got.values())


def test_predictions_sum_to_one():
    rows = small_corpus()
    rows += [(1000 + i, f"{a} {b}", "en", "a") for i, (a, b) in enumerate((a, b) for a in "abcdef" for b in [*"abcdef", "unseen"])]
    rows = [r for r in rows if r[0] < 1000 or zlib.crc32(str(r[0]).encode()) % 5 == 1] + [(i, "a " + w, "en", "a") for i, w in zip((i for i in range(5000, 9000) if zlib.crc32(str(i).encode()) % 5 == 1), [*"abcdef", "unseen", ""])]
    word, context, row = lists(rows)
    of = [(r[0], i) for i, r in enumerate(rows) if r[0] >= 5000]
    for p in chain(rows, {3, 5}):
        after_a = [p[np.flatnonzero(row == i)[1]] for _, i in of]  # a, then each word, an unknown one or the end
        assert abs(sum(after_a) - 1) < 1e-9


def exact_tables(n, log_xp, d):
    """Mean and deviation of the table count, by the recursion of the coefficients."""
    row = np.full(n + 1, -np.inf)
    row[0] = 0
    t = np.arange(1, n + 1)
    for k in range(n):
        rest = np.maximum(k - d * t, 0)
        with np.errstate(divide="ignore"):
            row[1:], row[0] = np.logaddexp(math.log(d) + row[:-1], np.log(rest) + row[1:]), -np.inf
    w = row[1:] + t * log_xp
    w = np.exp(w - w.max())
    mean = (w * t).sum() / w.sum()
    return mean, math.sqrt((w * t * t).sum() / w.sum() - mean * mean)


def test_table_counts_are_exact():
    rng = np.random.default_rng(8)
    for n, xp, d in ((2, 0.9, 0.5), (9, 3.0, 0.6), (1000, 5 / 0.7, 0.7), (1500, 7.0, 0.7), (3000, 15.0, 0.5), (2000, 1.0, 0.9), (1100, 3e-4, 0.2), (5000, 1000.0, 0.7), (1200, 1e5, 0.6)):
        mean, deviation = exact_tables(n, math.log(xp), d)
        m = 4000
        got = P.table_counts(np.full(m, n), np.full(m, math.log(xp)), d, rng.random(m), rng.random(m))
        assert abs(got.mean() - mean) < 5 * deviation / math.sqrt(m) + 1e-3 * mean / 100
        assert abs(got.std() - deviation) < 0.08 * deviation + 0.02


def test_gamma_variables_have_their_moments():
    for shape in (0.2, 0.9, 1.0, 3.5, 400.0):
        x = P.gamma(np.full(60_000, shape), np.arange(60_000, dtype=np.uint64), 7, 1)
        assert abs(x.mean() - shape) < 5 * math.sqrt(shape / 60_000)
        assert abs(x.var() / shape - 1) < 0.06 + 0.1 * (shape < 1)


def test_scores_depend_neither_on_buckets_nor_on_partitions(spark):
    rng = np.random.default_rng(12)
    share = 1 / np.arange(1, 1500.0)
    rows = [(i, " ".join(f"w{k}" for k in rng.choice(len(share), 120, p=share / share.sum())), "en", "a") for i in range(250)]
    docs = make(spark, rows)
    one, *others = ({r["doc_id"]: r["score"] for r in P.score_documents(d, bucket_bytes=n).collect()} for d, n in ((docs.coalesce(1), 2 << 20), (docs.repartition(7), 2 << 20), (docs.repartition(3), 4000)))
    assert all(abs(one[i] - other[i]) < 1e-8 for other in others for i in one)


def test_large_contexts_are_exact(spark):
    rows = [(i, "a b a c a d" + " e" * (i % 3), "en", "a") for i in range(100)]
    docs = make(spark, rows)
    word, context, _ = lists(rows)
    n = Counter(context.tolist())
    for parts in (1, 9):
        large, pieces = P.large_contexts(docs.repartition(parts), 8, P.work_dir(spark))
        least = (len(word) - 100) // 32 + 3  # the end of a text opens no context
        assert dict(zip(large.tolist(), pieces.tolist())) == {c: -(-k // least) for c, k in n.items() if k > least}


def test_every_previous_word_is_a_context():
    text = " ".join(f"word{i}" for i in range(20_000)).encode()
    _, context, _ = P.tokens_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(np.unique(context)) == 20_001 and context[0] == P.START


def test_places_of_a_piece_keep_word_context_and_row(spark):
    rows = [(i, prose(i, 50), "en", "a") for i in range(40)] + [(41, prose(41, 20_000), "en", "a")]
    docs = make(spark, rows).selectExpr("text", "doc_id <> 3 AS train", "doc_id").coalesce(1)
    got, want = Counter(), Counter()
    none = np.empty(0, np.int64)
    for r in P.deal(docs, none.astype(np.uint64), none, 4).where("bucket < 4").collect():
        contexts = np.repeat(P.unpacked_ids(r["contexts"]), P.unpacked(r["runs"], np.uint32))
        words = P.unpacked_ids(r["words"])[P.unpacked(r["which"], np.uint32)]
        for w, c, n, k in zip(words.tolist(), contexts.tolist(), P.unpacked(r["counts"], np.uint16).tolist(), P.unpacked(r["rows"], np.uint16).tolist()):
            got[w, c, k] += n
    for k, (_, t, *_) in enumerate(rows):
        raw = np.frombuffer(t.encode(), np.uint8)
        word, context, _ = P.tokens_of(raw, np.array([0, len(raw)]))
        want.update((w, c, k) for w, c in zip(word.tolist(), context.tolist()))
    assert got == want


def test_extra_columns_of_any_name_are_ignored(spark, clash):
    assert sorted(r["doc_id"] for r in P.score_documents(clash).collect()) == sorted(r[0] for r in ODD[5:11])
