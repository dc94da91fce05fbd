"""A training corpus from raw documents, in five stages; each one's rows are written and read by the next.

1. language      texts whose language cannot be told go
2. near_copies   one document of each group of near copies stays (five words, Jaccard 0.8 or more)
3. benchmark     benchmark passages are cut out; a document of nothing else goes
4. mixing        sources are taken to their target weights, document by document
5. sharding      every row gets its place: region, rack, shard and slot
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import session
from rankloom.llm import common, decontaminate, language, mixing, ngram_join, shard_tree


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows that are not held out; a text without a letter, or too uncertain, goes."""
    return language.recognised(docs, common.held_out(F.col("doc_id"), 4, 2))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.removed(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, whole=True)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_tree.assigned(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_copies", keep_one_of_near_copies),
    ("benchmark", cut_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: Naive Bayes, connected components and hypergeometric draws have no SQL counterpart; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is a table in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    root = f"{session.stage_root(spark)}/corpus/{uuid.uuid4().hex}"
    for nth, (name, stage) in enumerate(STAGES):
        path = f"{root}/{nth}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
