"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents, whatever other columns there are and however
they are named; null texts count as empty, null ids are ids like others, and
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliograph.llm import bpe, exact_dedup, mixing, near_dup, toxicity
from foliograph.llm.common import cut, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; null and empty texts stay, repeated rows are judged each for itself."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of equal texts stays, that with the largest doc_id; null and empty texts are one group."""
    return exact_dedup.keep_one(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near duplicates stays, that with the smallest doc_id; null, empty and blank texts all stay."""
    return near_dup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix of sources takes it, null sources being one source; rows without words only if whole copies are taken."""
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix: doc_id, n_tokens, two digests and ids; null and empty texts have none."""
    return bpe.encode(docs, with_ids=True)


STAGES = [
    ("toxicity", toxic_out),
    ("exact dedup", copies_out),
    ("n-gram Jaccard join", near_copies_out),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE", encoded),
]

#: Toxicity, the Jaccard join and BPE cannot be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
