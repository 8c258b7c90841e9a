"""The corpus pipeline: five stages of tributary.llm on the documents table, each written and reread.

Order: language ID (documents without a language go), n-gram Jaccard join (one document of each group stays), benchmark decontamination
(documents that hold a benchmark item go), mixing to target weights (a document comes as often as it is taken), sharding (adds shard and slot).
Every stage but the last returns the columns of documents, whatever further columns there are and whatever their names; sharding replaces columns named shard and slot.

Cases: documents with a null or empty text, or one without letters, go in the first stage (no language); null ids and sources are values; equal and near equal texts leave one row, that with the least id (an id before none; of several texts
with that id the one with the least digest), so repeated rows and ties have one outcome; a very long text is one document in every stage; empty inputs pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm.common import work_dir, written
from tributary.llm.decontamination import clean
from tributary.llm.language import keep_identified
from tributary.llm.mixing import mix
from tributary.llm.ngram_join import keep_one_of_each
from tributary.llm.sharding import shuffle_to_shards

SHARDS = 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(spark, docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(spark, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shuffle_to_shards(docs, SHARDS)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: Language ID and the join are not expressible in SQL; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    folder = work_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name, folder)
    return docs
