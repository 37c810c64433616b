"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Any stage takes rows with nulls, empty and repeated texts, and further columns, which all but the last pass on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concordia.llm import bpe, neardup
from concordia.llm.common import keep, table
from concordia.llm.decontaminate import decontaminate
from concordia.llm.pii import mask
from concordia.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that a classifier fitted on the labelled ones rejects."""
    return remove_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: sets of five-word shingles, similarity 0.8 or more."""
    return neardup.one_of_each(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold benchmark items."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data masked."""
    return mask(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of each text."""
    return bpe.encode(docs, bpe.vocabulary()).selectExpr("doc_id", "cast(size(ids) as bigint) AS n_tokens", "ids")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("encoding", encoding)]
#: The stages learn, link and merge, which SQL doesn't express. A test compares all rows of run() on a small corpus with
#: what plain versions of the five stages, one after the other, leave of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs)
    return docs
