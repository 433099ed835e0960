"""A corpus from raw documents: quality, near-duplicates, benchmark leaks, personal data, mixture.

Each stage works on all that the one before kept; its result is written as
Parquet and read again. Stages run on plain documents, so they can be used
alone or in another order.

Null and empty texts are texts without words: the classifier scores them like any
other, of those that it keeps one stays as near-duplicates of each other, they
hold no benchmark passage and no personal data, and the mix takes nothing of
them; a null text stays null. Texts of any length are read whole. Of near
duplicates the smallest doc_id stays, null only where none has one; rows equal in doc_id
and text are one row to near-duplicates and to decontamination. Columns besides
doc_id, text and source pass through the first four stages under their names,
whatever these are. An empty table of documents gives an empty result, an empty
benchmark removes nothing, and without labels the classifier is constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import decontam, mixing, pii, quality, simhash
from quillmark.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    net = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, net)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id."""
    return simhash.near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document, with the words themselves; ``mixing.corpus`` writes them by shard."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Neither a trained network nor drawn blocks can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
