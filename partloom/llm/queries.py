"""The corpus operators as named queries, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from partloom.llm import align, bpe, chat, decontaminate, flatgraph, langid, lmscore, neardup, secrets, tokenbin, topk, toxicity, trie
from partloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


@query
def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.digest(table(spark, sf_dir, "documents"))


@query
def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(table(spark, sf_dir, "conversations"))


ORACLES["op4_chat_format"] = chat.ORACLE


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(table(spark, sf_dir, "documents"))


ORACLES["op5_near_duplicates"] = neardup.ORACLE


@query
def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.digest(table(spark, sf_dir, "embeddings"))


ORACLES["op6_exact_topk"] = topk.ORACLE


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op7_decontamination"] = decontaminate.ORACLE


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.digest(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digest(table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digest(table(spark, sf_dir, "conversations"))


ORACLES["op12_prefix_trie"] = trie.ORACLE


@query
def op13_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.digest(table(spark, sf_dir, "embeddings"))


ORACLES["op13_flat_graph"] = flatgraph.ORACLE


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
