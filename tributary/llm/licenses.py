"""License scans by diagonal voting, all native.

Every rolling word k-gram of every text is joined by hash to the places of the templates' grams. A joined gram votes for the diagonal (its
place in the text less its place in the template). Votes are added up by diagonal; neighbouring diagonals of one template that follow each other in the text
are merged, so inserted or missing words do not break a match. A merged span is a candidate if its votes are for enough different places of the template, and is then
verified: its words are compared with the template's by their edit distance, word for word. The join compares the words themselves besides the hash.
Templates are a small fixed table, which is what gets broadcast; any other list of (text, label) can be given, also of whole licenses.

One scan finds the candidates and shuffles joined grams only, added up first; each text adds one closing row that carries its number of words, so texts without a match
stay in the result. A second scan splits only the texts that have a candidate; a small bitmap keeps the others from being moved.

Cases: a null or empty text has no words and no labels; repeated rows are one row of the result each; a null id
is an id; matches cross neither rows nor the end of a text; overlapping spans all count, so there are no ties to break; a very long text is one row for each of its words, none of which holds
more than k words; empty tables stay empty; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import column, documents, lower_ascii, perhaps, written

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose every place counts, and their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: Well-known sentences of licenses, as words, and their labels.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


#: Characters that stand for the distinct words of a template when words are compared; the first stands for every other word.
SIGNS = "".join(chr(c) for c in (*range(33, 127), *range(0x4E00, 0x9FA0)))


def templates_table(spark: SparkSession, base=BASE, templates=TEMPLATES, k: int = 3) -> DataFrame:
    """One row for each template: template, label, is_base, words, size (of its grams), total (its grams)."""
    rows = [F.struct(F.lit(i).alias("template"), F.split(F.lit(phrase), " ").alias("words"), F.lit(label).alias("label"), F.lit(i < len(base)).alias("is_base")) for i, (phrase, label) in enumerate([*base, *templates])]
    table = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*").withColumn("size", F.least(F.lit(k), F.size("words")))
    return table.withColumn("total", F.size("words") - F.col("size") + 1)


def grams(spark: SparkSession, base=BASE, templates=TEMPLATES, k: int = 3) -> DataFrame:
    """One row for each gram of each template: template, label, is_base, total (its grams), size, hash, gram (words), tpos."""
    table = templates_table(spark, base, templates, k).withColumn("tpos", F.explode(F.sequence(F.lit(0), F.col("total") - 1)))
    return table.withColumn("gram", F.slice("words", F.col("tpos") + 1, F.col("size"))).withColumn("hash", F.xxhash64("gram")).drop("words")


def _split(df: DataFrame, key: str, text: str) -> DataFrame:
    lowered = lower_ascii(F.coalesce(column(text), F.lit("")))
    return df.select(column(key).alias("key"), F.xxhash64(column(text)).alias("text_hash"), F.regexp_extract_all(lowered, F.lit(LICENSE_WORD), F.lit(0)).alias("words"))


def _likeness(span: Column, words: Column) -> Column:
    """1 less the edits, in words, that make a span of the template, by the template's length: words become signs, whose edit distance is native."""
    known = F.array_distinct(words)
    signs = lambda of: F.array_join(F.transform(of, lambda w: F.substr(F.lit(SIGNS), F.array_position(known, w).cast("int") + 1, F.lit(1))), "")
    return F.greatest(F.lit(0.0), 1 - F.levenshtein(signs(span), signs(words)) / F.size(words))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", base=BASE, templates=TEMPLATES, k: int = 3, slack: int = 3, gap: int = 6, coverage: float = 0.6, likeness: float = 0.6) -> DataFrame:
    """One row for each verified span (template set) and one for each distinct row of df (template null, first is its number of words, rows how often it is there).

    Columns: key, text_hash, template, label, is_base, first and last (words), score (likeness of the span's words to the template's), rows.
    """
    known = grams(df.sparkSession, base, templates, k)
    hashes: dict[int, list[int]] = {}
    for r in known.select("size", "hash").distinct().orderBy("size", "hash").collect():  # of the given templates
        hashes.setdefault(r["size"], []).append(r["hash"])
    sizes = list(hashes)
    names = [f"w{i}" for i in range(max(sizes))]
    # each place carries only its own k words, never the whole text
    ahead = _split(df, key, text).select("key", "text_hash", *[F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))).alias(n) for i, n in enumerate(names)])
    closing = F.array(F.struct(*[F.lit(None).cast("string").alias(n) for n in names]))
    rows = ahead.select("key", "text_hash", F.posexplode(F.concat(F.arrays_zip(*names), closing)).alias("pos", "g")).select("key", "text_hash", "pos", "g.*")
    word_hashes = {n: F.when(F.col(names[n - 1]).isNotNull(), F.xxhash64(F.array(*names[:n]))) for n in sizes}
    kept = rows.where(_any([F.col("w0").isNull(), *[word_hashes[n].isin(hashes[n]) for n in sizes]]))
    candidates = F.array_compact(F.array(*[F.when(word_hashes[n].isin(hashes[n]), F.struct(F.lit(n).alias("size"), F.array(*names[:n]).alias("gram"))) for n in sizes]))
    found = kept.select("key", "text_hash", "pos", F.explode_outer(F.when(F.col("w0").isNotNull(), candidates)).alias("c"))
    found = found.select("key", "text_hash", "pos", F.col("c.size").alias("size"), F.col("c.gram").alias("gram"), F.xxhash64("c.gram").alias("hash"))
    table = known.select("template", "is_base", "total", F.col("size").alias("n"), F.col("hash").alias("h"), F.col("gram").alias("g"), "tpos")
    joined = found.join(F.broadcast(table), (F.col("hash") == F.col("h")) & (F.col("size") == F.col("n")) & (F.col("gram") == F.col("g")), "left")
    votes = joined.where("template IS NOT NULL OR size IS NULL").groupBy("key", "text_hash", "template", "is_base", "total", "size", "tpos", "pos").agg(F.count("*").alias("rows"))
    votes = written(votes.withColumn("diagonal", F.col("pos") - F.col("tpos")), "votes")  # read by the branches below; added up, so that repeated rows are one
    texts = votes.where("template IS NULL").select("key", "text_hash", F.col("pos").alias("first"), "rows")
    line = ["key", "text_hash", "template"]
    ends = [F.min("pos").alias("first"), (F.max("pos") + F.first("size") - 1).alias("last")]
    whole = votes.where("is_base").groupBy(*line, "diagonal", "total").agg(F.count("*").alias("votes"), *ends).where("votes = total").select(*line, "first", "last", F.lit(1.0).alias("score"))
    by_diagonal = votes.where("NOT is_base").groupBy(*line, "total", "diagonal").agg(F.collect_set("tpos").alias("places"), *ends)
    order = W.partitionBy(*line).orderBy("first", "diagonal")
    apart = (F.col("first") - F.lag("last").over(order) > gap) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > slack)
    runs = by_diagonal.withColumn("run", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    merged = runs.groupBy(*line, "total", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    likely = merged.where(F.col("votes") >= F.lit(coverage) * F.col("total")).select(*line, "first", "last")
    wanted = likely.join(F.broadcast(templates_table(df.sparkSession, base, templates, k).select("template", F.col("words").alias("wanted"))), "template")
    again = df.select(column(key).alias("k"), F.xxhash64(column(text)).alias("h"), column(text).alias("t"))
    held = perhaps(again, "h", likely.select("text_hash")).join(wanted, F.col("k").eqNullSafe(F.col("key")) & (F.col("h") == F.col("text_hash"))).dropDuplicates([*line, "first", "last"])
    own = F.slice(F.regexp_extract_all(lower_ascii(F.col("t")), F.lit(LICENSE_WORD), F.lit(0)), F.col("first") + 1, F.col("last") - F.col("first") + 1)
    verified = held.select(*line, "first", "last", _likeness(own, F.col("wanted")).alias("score")).where(F.col("score") >= likeness)
    labelled = whole.unionByName(verified).join(F.broadcast(templates_table(df.sparkSession, base, templates, k).select("template", "label", "is_base")), "template")
    nothing = {"template": "int", "label": "string", "is_base": "boolean", "last": "int", "score": "double"}
    closed = texts.select("key", "text_hash", "first", "rows", *[F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()])
    return labelled.withColumn("rows", F.lit(None).cast("bigint")).unionByName(closed)


def _any(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of words, base places and labels of every document."""
    spans = scan(documents(spark, sf_dir, "doc_id", "text"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    is_base = F.col("is_base")
    return spans.groupBy(F.col("key").alias("doc_id"), "text_hash").agg(
        F.max(F.when(F.col("template").isNull(), F.col("first"))).cast("bigint").alias("n_words"),
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("bigint").alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        F.max("rows").alias("rows"),
    ).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("text_hash", "rows", "row")
