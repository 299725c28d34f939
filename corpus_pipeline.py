"""A corpus from raw documents to shards, in stages that each read what the one before wrote.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their own columns; the last
adds `shard` and `slot`, by which a shard's repeated readings of a document lie apart.  Nulls, empty texts, repeated rows and empty tables have the results that the
operators state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from provena.llm import decontaminate, mixing, neardup, shard, toxicity
from provena.session import discard, run_folder, scratch, stored, table

SHARDS = 40
#: Likeness in percent from which documents are near copies; `op8_neardup` has its own.
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labels of this input, does not reject."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return neardup.clean(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not repeat benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture reads them; each at least once."""
    return mixing.apply(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it."""
    return shard.assign(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Trained weights and permutations by hash are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next.

    What a stage stores for itself goes when its output is written, its input when the next output is;
    what the last stage stores stays until the application ends.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{run_folder(spark)}/stage-{k}-{uuid.uuid4().hex[:12]}"
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), outside=path)
        discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
