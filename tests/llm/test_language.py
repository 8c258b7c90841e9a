import zlib

import numpy as np
from pyspark.sql import functions as F

from tributary.llm import language as L

from .conftest import ODD, make, prose

GERMAN = ("der", "und", "nicht", "schön", "größe", "straße", "zwischen", "können", "mädchen", "licht", "ich", "auch")


def corpus(n=60):
    rows = []
    for i in range(n):
        rows.append((i, prose(i, 60), "en", "a") if i % 2 else (i, prose(i, 60, GERMAN), "de", "a"))
    return rows


def test_held_out_accuracy(spark, sf):
    got = L.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 30 and right >= 0.97 * n


def test_spans_of_mixed_text(spark):
    model = L.fit(make(spark, corpus()))
    mixed = make(spark, [(1, prose(500, 40) + " " + prose(501, 25, GERMAN) + " " + prose(502, 30), None, None)])
    row = L.identify(mixed, model).first()
    assert row["lang_pred"] == "en" and [s["lang"] for s in row["spans"]] == ["en", "de", "en"] and row["n_spans"] == 3
    assert row["spans"][0]["first_word"] == 0 and all(b["first_word"] == a["last_word"] + 1 for a, b in zip(row["spans"], row["spans"][1:]))
    assert 0.5 < row["score"] < 1


def test_odd_rows(spark, odd):
    model = L.fit(make(spark, corpus()))
    rows = L.identify(odd, model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0) and 0 <= r["score"] <= 1


def plain_labels(scores, switch):
    """Viterbi over one text, by the recursion."""
    best, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(best)), key=lambda i: (best[i], -i))
        came = [i if best[i] >= best[top] - switch else top for i in range(len(best))]
        best = [max(best[i], best[top] - switch) + row[i] for i in range(len(best))]
        back.append(came)
    state = max(range(len(best)), key=lambda i: (best[i], -i))
    out = [state]
    for came in reversed(back):
        state = came[state]
        out.append(state)
    return out[::-1]


def test_viterbi_equals_the_plain_recursion():
    rng = np.random.default_rng(6)
    for _ in range(30):
        n = rng.integers(0, 25, rng.integers(1, 9))
        offsets = np.concatenate([[0], np.cumsum(n)])
        scores = rng.normal(0, 6, (int(offsets[-1]), 3)).astype(np.float32)
        got = L.viterbi(scores, offsets, 7.0, most=int(rng.integers(5, 60)))
        for a, b in zip(offsets, offsets[1:]):
            if b > a:
                assert got[a:b].tolist() == plain_labels(scores[a:b].astype(float).tolist(), 7.0)


def plain_predictions(model, text):
    """Language and score of a text, word by word."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    low = "".join(" " if ord(c) < 128 and not c.isalpha() or any(a <= ord(c) <= b for a, b in L.SEPARATORS) else c for c in low)
    words = [w.encode() for w in low.split(" ") if w]
    if not words or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw, place, rows = low.encode(), 0, []
    for w in words:
        place = raw.index(w, place)
        around = b"  " + raw
        score = [0.0] * len(model.languages)
        used = 0
        for i in range(place, place + len(w)):
            code = around[i + 2] | around[i + 1] << 8 | around[i] << 16
            code = (code * 2654435761 & 0xFFFFFFFF) >> (32 - L.BITS)
            score = [s + float(x) for s, x in zip(score, model.scores[code])]
            for a, b, name in L.SCRIPTS:
                if a <= raw[i] <= b:
                    used |= 1 << L.SCRIPT_NAMES.index(name)
        rows.append([s if used & int(m) or not used else s + L.FOREIGN for s, m in zip(score, model.scripts)])
        place += len(w)
    share = [0] * len(model.languages)
    for w, k in zip(words, plain_labels(rows, L.SWITCH)):
        share[k] += len(w)
    best = max(range(len(share)), key=lambda i: (share[i], -i))
    return model.languages[best], share[best] / sum(share)


def test_predictions_equal_a_plain_version(spark):
    model = L.fit(make(spark, corpus()))
    texts = [prose(500, 20) + " — “" + prose(501, 20, GERMAN) + "”…" + prose(3, 9), "größe\u00a0the\u2014river", "Привет мир stone", "ÄÖ über\x01nicht", "🙂", "ª", "1 – 2", "α β γ the"] + [prose(600 + i, 12, GERMAN + ("the", "river")) for i in range(20)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    for r in L.identify(make(spark, rows), model).collect():
        lang, score = plain_predictions(model, r["text"])
        assert (r["lang_pred"], round(r["score"], 5)) == (lang, round(score, 5)), r["text"]


def test_separators():
    for text in ("a–b", "“a” “b”", "a\u00a0b", "a×b", "a、b", "a🙂b", "a！b", "a→b"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert b"ab" == bytes(L.lowered(raw)).replace(b" ", b"") or text == "a→b"
    assert bytes(L.lowered(np.frombuffer("éªß々ﬁ".encode(), np.uint8))).decode() == "éªß々ﬁ"


def test_no_labels_and_empty(spark, empty, odd):
    model = L.fit(empty)
    assert model.languages == [] and {r["lang_pred"] for r in L.identify(odd, model).collect()} == {"und"}
    assert L.identify(empty, L.fit(make(spark, corpus()))).count() == 0
    assert L.keep_identified(spark, empty).count() == 0


def test_sample_is_bounded(spark):
    rows = corpus(80)
    small = L.fit(make(spark, rows), per_language=5)
    assert small.languages == ["de", "en"] and small.scores.shape == (1 << L.BITS, 2)
    again = L.fit(make(spark, rows[::-1]).repartition(3), per_language=5)
    assert (small.scores == again.scores).all()


def test_clashing_columns(spark, clash):
    model = L.fit(make(spark, corpus()))
    out = L.identify(clash, model)
    assert out.columns.count("score") == 1 and out.columns.count("spans") == 1 and out.where("score >= 0").count() == clash.count()


def test_rejects_only_what_has_no_language(spark):
    rows = corpus() + [(900, None, "en", "a"), (901, "1 2 3 !!!", "en", "a")]
    kept = {r["doc_id"] for r in L.keep_identified(spark, make(spark, rows)).collect()}
    assert kept == {r[0] for r in corpus()}


def test_extra_columns_of_any_name_stay(spark):
    names = ("score", "spans", "lang_pred", "n_spans", "row", "label", "level", "x`y", "a.b")
    df = make(spark, corpus(), names)
    out = L.keep_identified(spark, df)
    assert out.columns == df.columns and out.count() == len(corpus()) and all(r[n] == "mine" for r in out.collect() for n in names)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = corpus()
    flipped = [(d, t, ("de" if l == "en" else "en") if zlib.crc32(str(d).encode()) % 3 == 1 else l, s) for d, t, l, s in rows]
    assert (L.learned(make(spark, rows)).scores == L.learned(make(spark, flipped)).scores).all()
