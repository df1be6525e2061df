"""Training-data pipeline over ``documents``: five stages, each on all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the
shared checkpoint folder and read again as the next stage's ``docs``.  All but the last return the
columns of ``docs``; the last returns the shard manifest of the corpus.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ashgrid.llm.common import load
from ashgrid.llm.decontam import drop_contaminated
from ashgrid.llm.jaccard import drop_near_duplicates
from ashgrid.llm.mixing import sample_documents
from ashgrid.llm.quality import keep_good
from ashgrid.llm.sharding import shard_documents
from ashgrid.session import checkpoint_root


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3."""
    return keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the raked weights of their source, language and topic."""
    return sample_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document on the bounded-load ring."""
    return shard_documents(docs, shards=24)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

#: The iterative stages (fit, components, raking, overflow rounds) have no plain SQL; the tests hold
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    folder = f"{checkpoint_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
