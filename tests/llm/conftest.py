import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, extra=()):
    """A documents table of (doc_id, text, lang, source); extra: names of columns that clash with outputs."""
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    for name in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("mine"))
    return df


def prose(seed, n, words=("the", "of", "stone", "river", "blue", "winter", "paper", "lamp", "green", "hollow", "quiet", "seven")):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(("", "s", "ing", "er", str(r.randint(0, 99)))) for _ in range(n))


ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "   \n\t ", None, None),
    (4, "12 34 !!", "en", None),
    (5, prose(5, 30_000), "en", "b"),  # very long
    (6, prose(6, 40), "en", "a"),
    (7, prose(6, 40), "de", "b"),  # the same text
    (8, prose(6, 40), None, "a"),
    (9, "ein", "de", "c"),
    (10, prose(10, 120), "en", "a"),
    (11, prose(10, 120) + " one more", "en", "a"),  # a near copy
    (None, prose(12, 30), "fr", "a"),
    (13, "é ß 你好 мир", "de", "a"),
    (14, prose(14, 50), "en", "a"),
    (14, prose(14, 50), "en", "a"),  # a repeated row
]


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def clash(spark):
    """Extra columns with the names of outputs."""
    names = ("score", "spans", "size", "shard", "slot", "media", "error", "tie", "copies", "bucket", "place", "label", "n", "hash", "pos", "first", "c", "d", "key")
    return make(spark, ODD[5:11], names)
