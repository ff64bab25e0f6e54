"""A corpus pipeline: each stage takes what its predecessor kept, written as Parquet and read again.

Rows of any kind go through all stages. A null text counts as empty: it is civil, near copies of it are the other empty and blank texts, it holds no benchmark
passage and no secret, and has no tokens. A row with a null id is never a copy of another and stays, as its id can't tell it from others.
Repeated rows, equal in id and text, become one; of rows of one id with other texts each is judged by its own text. Ties, as near copies of the same
smallest id, are settled by the texts' hashes. A very long text is judged whole in every stage. An empty table gives an empty result. Columns beside those of
`documents` go along untouched, whatever their names, until the last stage, which returns ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelight.llm import bpe, decontam, secrets, simhash, toxicity
from pagelight.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_civil(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word similarity of 0.8 or more stays, that of the smallest id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digests(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("bpe", encode)]

#: Boosted trees and near-duplicate links aren't SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
