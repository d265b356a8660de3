"""A training corpus from raw documents, stage by stage.

Each stage takes what its predecessor kept, written as Parquet and read again, and calls one operator of ``skeinrisk.llm``.
All but the last return the columns of ``documents``.

Every stage takes nulls in any column, empty and very long texts (whole), repeated rows, empty tables (it returns none) and further
columns of any name, which pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinrisk.llm import decontaminate, mixing, quality, sharding, simhash
from skeinrisk.llm.common import table, written

SHARDS = 40


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Null and empty texts get the score of no evidence; rows that repeat get equal scores and stay or go together; without labels
    of both kinds nothing is learnt and every row gets the labels' share of good ones (0.5 without any).
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies: SimHash finds candidates by pigeonring, an exact join
    decides and completes them (five-word shingles, similarity 0.8 or more).

    Null and empty texts are copies of each other; rows without an id stay; rows that repeat an id and text stay or go together;
    rows of one id and different texts are judged each by its own.
    """
    return simhash.drop_near_duplicates(docs)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage.

    Null and empty texts hold none and stay; null and empty passages are held by none; rows that repeat stay or go together.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document's row stands as often as the mix takes it, 0, 1 or 2 times.

    Null sources form one source; null and empty texts weigh nothing and are taken with their source's share; of rows that repeat
    an id and text each is taken on its own.
    """
    return mixing.mix(docs)


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed rows with shard and slot, which depend on what the rows hold only.

    Rows that are equal in all columns each have a slot; null ids and texts are shards' rows like any other; columns named
    ``shard`` or ``slot`` are replaced, others of any type pass through.
    """
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("quality classifier", good_documents),
    ("near-duplicates", distinct_documents),
    ("decontamination", uncontaminated_documents),
    ("mixing", mixed_documents),
    ("sharding", sharded_documents),
]

#: No stage can be told in SQL: tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
