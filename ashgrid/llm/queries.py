"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ashgrid.llm import oracles
from ashgrid.llm.common import load
from ashgrid.llm.conversations import conversation_trie
from ashgrid.llm.credentials import scan_documents
from ashgrid.llm.decontam import decontaminate
from ashgrid.llm.html import extract_pages
from ashgrid.llm.jaccard import near_duplicates
from ashgrid.llm.mixing import mix_documents
from ashgrid.llm.pii import replace_pii
from ashgrid.llm.quality import score_documents
from ashgrid.llm.repeats import remove_repeats
from ashgrid.llm.runs import run_digest, with_planted_period
from ashgrid.llm.sharding import shard_documents
from ashgrid.llm.topk import top_k
from ashgrid.llm.urls import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@query("op3_bounded_ring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 24 shards of a consistent-hash ring with bounded loads."""
    return shard_documents(load(spark, sf_dir, "documents"), shards=24)


@query("op9_rff_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality score of every document."""
    return score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query("op10_raked_mixture")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, sampling probability and draw of every document."""
    return mix_documents(load(spark, sf_dir, "documents"))


@query("op1_pii_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by keyed surrogates."""
    return replace_pii(load(spark, sf_dir, "documents"), key="ashgrid-surrogates")


@query("op2_segment_topk", oracles.TOP_K)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector against all other vectors."""
    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op4_linked_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, weak ones only next to a complementary part."""
    return scan_documents(load(spark, sf_dir, "documents"))


@query("op5_winnowed_overlap", oracles.DECONTAMINATION)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op6_prefix_tree_join", oracles.NEAR_DUPLICATES)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(load(spark, sf_dir, "documents"))


@query("op8_text_ratio")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(load(spark, sf_dir, "pages"))


@query("op7_rlbwt_repeats")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 100-byte repeats of earlier text cover."""
    return remove_repeats(load(spark, sf_dir, "documents"))


@query("op11_prefix_trie", oracles.PREFIX_TRIE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie(load(spark, sf_dir, "conversations"))


@query("op12_lyndon_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of them with a planted period."""
    docs = load(spark, sf_dir, "documents")
    return run_digest(docs.select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text")))


@query("op13_url_ratio", oracles.URL_FILTER)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by rules and by the ratio of two character models."""
    return filter_urls(load(spark, sf_dir, "pages"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality filter, near-duplicate removal, decontamination, mixing and sharding of all documents."""
    return corpus_pipeline.run(spark, sf_dir)
