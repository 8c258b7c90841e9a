"""Language identification of mixed-language text.

Each word gets a score in each language (log likelihood of its letter trigrams). The scripts of its letters narrow the languages that may
claim it. A Viterbi pass over the words, with a penalty for each switch, labels spans. The language of a text is the one that labels most of its
letters; the score is its share of them.

The model is fitted on a bounded sample of labelled rows (``per_language`` whole texts of each language, those with the least id hashes), as counts
of hashed byte trigrams: ``1 << BITS`` numbers a language at most, which is what the executors get. Prediction reads each whole
text once in Arrow batches without a shuffle.

Cases: a text that is null or has no letter is ``und`` with score 0; a text whose scripts no learned language uses gets the best language at a low score;
rows without a label are not learned from; with no labelled row at all everything is ``und``; ties go to the first language by name; a very long text is read whole, alone;
repeated rows and extra columns are kept, columns named as an output are replaced; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import arrow_bytes, documents, fold_of, numbered, row_ranges

BITS = 15
LEVELS = 16
#: Bytes of text that are labelled at once. Rows advance together word by word, so more of them cost fewer steps.
AT_ONCE = 12 << 20
SWITCH = 12.0
FOREIGN = -60.0
#: Classes of lead bytes of UTF-8 letters: first byte, last byte, script.
SCRIPTS = (
    (0x41, 0x5A, "latin"),
    (0x61, 0x7A, "latin"),
    (0xC3, 0xC9, "latin"),
    (0xCD, 0xCF, "greek"),
    (0xD0, 0xD3, "cyrillic"),
    (0xD4, 0xD5, "armenian"),
    (0xD6, 0xD7, "hebrew"),
    (0xD8, 0xDB, "arabic"),
    (0xE0, 0xE1, "indic and south-east asian"),
    (0xE3, 0xE3, "kana"),
    (0xE4, 0xE9, "han"),
    (0xEA, 0xED, "hangul"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, _, name in SCRIPTS))
_CLASS = np.zeros(256, np.uint16)
for _a, _b, _name in SCRIPTS:
    _CLASS[_a : _b + 1] = 1 << SCRIPT_NAMES.index(_name)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_LOWER[:32], _LOWER[33:65], _LOWER[91:97], _LOWER[123:128] = 32, 32, 32, 32  # control characters, digits and punctuation separate words
#: Characters beyond ASCII that separate words: first and last code point.
SEPARATORS = (
    (0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x21C0, 0x23FF), (0x2500, 0x2BFF),
    (0x3000, 0x3004), (0x3008, 0x3020), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0x1F000, 0x1FFFF),
)
_LEADS = np.zeros(256, np.uint8)  # bytes of a character that may be a separator, by its first byte
for _a, _b in SEPARATORS:
    for _c in range(_a, _b + 1, 64):
        _LEADS[chr(_c).encode()[0]] = len(chr(_c).encode())
    _LEADS[chr(_b).encode()[0]] = len(chr(_b).encode())
_BOUNDS = np.array([x for a, b in SEPARATORS for x in (a, b + 1)])


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with ASCII letters in lower case and every byte of a separator as a space."""
    low = _LOWER[raw]
    maybe = np.flatnonzero(_LEADS[raw])
    for size in (2, 3, 4):
        at = maybe[_LEADS[raw[maybe]] == size]
        at = at[at + size <= len(raw)]
        code = (raw[at] & (0x7F >> size)).astype(np.int64)
        for i in range(1, size):
            code = (code << 6) | (raw[at + i] & 0x3F)
        at = at[np.searchsorted(_BOUNDS, code, "right") % 2 == 1]
        for i in range(size):
            low[at + i] = 32
    return low


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (1 << BITS, languages): log likelihoods of trigrams
    scripts: np.ndarray  # (languages,): bits of SCRIPT_NAMES


def _trigrams(raw: np.ndarray) -> np.ndarray:
    """For each byte, the hashed code of the trigram that ends there."""
    code = raw.astype(np.uint32)
    code[1:] |= raw[:-1].astype(np.uint32) << 8
    code[2:] |= raw[:-2].astype(np.uint32) << 16
    code *= np.uint32(2654435761)
    return code >> np.uint32(32 - BITS)


def fit(train: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = 500) -> Model:
    """Learns from at most per_language rows of each label."""
    rows = train.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("id_hash")).where("label IS NOT NULL AND text IS NOT NULL")
    # ids are chosen without their texts, so that only the sample's texts move; a repeated id could bring more rows, hence the second limit
    # in two levels, so that one label's rows are dealt to LEVELS tasks and the last one gets at most LEVELS times per_language
    least = lambda df, *by: df.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("id_hash"))).where(F.col("n") <= per_language).drop("n")
    chosen = least(least(rows.select("label", "id_hash", F.pmod("id_hash", F.lit(LEVELS)).alias("level")), "label", "level"), "label")
    texts = rows.join(F.broadcast(chosen.select("label", "id_hash").distinct()), ["label", "id_hash"])  # at most per_language rows a label
    again = W.partitionBy("label").orderBy("id_hash", F.xxhash64("text"))
    sample = texts.withColumn("n", F.row_number().over(again)).where(F.col("n") <= per_language).select("label", "text")

    def count(table: pa.Table) -> pa.Table:
        sums, scripts = np.zeros(1 << BITS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)
        for value in table["text"]:
            raw = lowered(np.frombuffer(b" " + value.as_py().encode() + b" ", np.uint8))
            codes = _trigrams(raw)[raw > 32]
            sums += np.bincount(codes, minlength=1 << BITS)
            found = _CLASS[raw]
            scripts += [np.count_nonzero(found & (1 << i)) for i in range(len(SCRIPT_NAMES))]
        return pa.table({"label": [table["label"][0].as_py()], "counts": [sums.tobytes()], "scripts": [scripts.tobytes()]})

    got = sample.groupBy("label").applyInArrow(count, "label string, counts binary, scripts binary").orderBy("label").collect()  # one bounded row a language
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in got]).reshape(len(got), 1 << BITS)
    uses = np.array([np.frombuffer(r["scripts"], np.int64) for r in got]).reshape(len(got), len(SCRIPT_NAMES))
    scores = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * (1 << BITS)))
    bits = ((uses >= 0.01 * uses.sum(axis=1, keepdims=True)) & (uses > 0)) @ (1 << np.arange(len(SCRIPT_NAMES)))
    return Model([r["label"] for r in got], np.ascontiguousarray(scores.T, np.float32), bits.astype(np.uint16))


def word_scores(model: Model, raw: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores (words, languages), letters of each word, and the n + 1 offsets of the rows' words. A word is a run of letters."""
    width = len(model.languages)
    low = lowered(raw)
    letter = low != 32
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    first[begins] = letter[begins]
    starts = np.flatnonzero(first)
    counts = np.searchsorted(starts, offsets)
    scores = np.empty((len(starts), width), np.float32)
    letters = np.empty(len(starts), np.float32)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, a + chunk)))
        b = int(starts[j]) if j < len(starts) else len(raw)
        part, rel = low[a:b], starts[i:j] - a
        codes = _trigrams(np.concatenate([np.array([32, 32], np.uint8), part]))[2:]
        ends = letter[a:b]
        values = model.scores[codes]
        values[~ends] = 0
        scores[i:j] = np.add.reduceat(values, rel, axis=0)
        letters[i:j] = np.add.reduceat(ends, rel, dtype=np.float32)
        used = np.bitwise_or.reduceat(_CLASS[part], rel)
        for k in range(width):
            scores[i:j, k] += np.where((used & model.scripts[k]) | (used == 0), 0, FOREIGN).astype(np.float32)
        i = j
    return scores, letters, counts


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH, most: int = 1 << 20) -> np.ndarray:
    """The best label of every word, row by row; rows of like length advance together."""
    lengths = np.diff(offsets)
    labels = np.zeros(len(scores), np.int8 if scores.shape[1] < 128 else np.int16)
    order = np.argsort(-lengths, kind="stable")[: np.count_nonzero(lengths)]
    i = 0
    while i < len(order):
        size = np.cumsum(lengths[order[i:]])
        j = i + max(1, int(np.searchsorted(size, most, "right")))
        rows, i = order[i:j], j
        at, n = offsets[rows], lengths[rows]
        active = np.searchsorted(-n, -np.arange(n[0]), "left")  # rows that are longer than step t
        best = scores[at].astype(np.float64)
        stays = np.ones((len(scores) if len(rows) == len(lengths) else int(n.sum()), scores.shape[1]), bool)
        froms = np.zeros(len(stays), labels.dtype)
        place = np.concatenate([[0], np.cumsum(n)])[:-1]
        for t in range(1, n[0]):
            m = active[t]
            part = best[:m]
            top = part.argmax(axis=1)
            peak = part[np.arange(m), top] - switch
            where = place[:m] + t
            keep = part >= peak[:, None]
            stays[where], froms[where] = keep, top
            best[:m] = np.where(keep, part, peak[:, None]) + scores[at[:m] + t]
        state = best.argmax(axis=1)
        for t in range(n[0] - 1, -1, -1):
            m = active[t]
            labels[at[:m] + t] = state[:m]
            where = place[:m] + t
            kept = stays[where, state[:m]]
            if t:
                state[:m] = np.where(kept, state[:m], froms[where])
    return labels


OUT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]))),
    ]
)


def identify(df: DataFrame, model: Model, text: str = "text", switch: float = SWITCH, keep_text: bool = True) -> DataFrame:
    """df and lang_pred, score, n_spans, spans (runs of letters, counted from 0)."""
    names = {f.name for f in OUT.fields} | (set() if keep_text else {text})
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *OUT.fields])
    span = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
    width = len(model.languages)

    def labelled(raw: np.ndarray, offsets: np.ndarray) -> tuple[list, np.ndarray, list]:
        rows = len(offsets) - 1
        lang, score, spans = ["und"] * rows, np.zeros(rows), [[] for _ in range(rows)]
        if width and len(raw):
            scores, letters, at = word_scores(model, raw, offsets)
            labels = viterbi(scores, at, switch)
            row = np.repeat(np.arange(rows), np.diff(at))
            weight = np.bincount(row * width + labels, letters, rows * width).reshape(rows, width)
            change = np.ones(len(labels), bool)
            change[1:] = (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(change)
            end = np.append(begin[1:], len(labels))
            for b, e in zip(begin, end):
                r = row[b]
                spans[r].append({"lang": model.languages[labels[b]], "first_word": int(b - at[r]), "last_word": int(e - 1 - at[r])})
            total = weight.sum(axis=1)
            plain = np.add.reduceat(np.append((_CLASS[raw] & 1) & (raw < 128), 0), offsets[:-1]) * (np.diff(offsets) > 0)
            for r in np.flatnonzero(total):
                if plain[r] or any(c.isalpha() for c in bytes(raw[offsets[r] : offsets[r + 1]]).decode()):
                    best = int(weight[r].argmax())
                    lang[r], score[r] = model.languages[best], min(1.0, weight[r, best] / total[r])
                else:
                    spans[r] = []
        return lang, score, spans

    def predict(texts) -> list[pa.Array]:
        raw, offsets = arrow_bytes(texts)
        parts = [labelled(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_ranges(offsets, AT_ONCE)]
        spans = [s for p in parts for s in p[2]]
        return [pa.array([x for p in parts for x in p[0]], pa.string()), pa.array(np.concatenate([np.empty(0), *(p[1] for p in parts)])), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), *found], names=schema.names)

    return df.mapInArrow(run, schema)


def learned(df: DataFrame, fold: int = 1, folds: int = 3, **options) -> Model:
    """The model of the rows whose id's crc32, modulo folds, is not fold."""
    return fit(df.where(fold_of(F.col("doc_id"), folds) != fold), **options)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = learned(docs)
    held = docs.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return identify(held, model, keep_text=False).drop("spans")


def keep_identified(spark: SparkSession, docs: DataFrame, least: float = 0.3) -> DataFrame:
    """docs without those whose language can't be told: no letters, or no language that labels a share of least."""
    model = learned(docs)
    carried = numbered(docs)
    kept = identify(carried, model, text=f"c{docs.columns.index('text')}").where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*carried.columns).toDF(*docs.columns)
