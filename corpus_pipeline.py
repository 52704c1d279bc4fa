"""The corpus pipeline: language ID, near-dedup, decontamination, secret scan, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns
of docs; rows that a stage has nothing against pass unchanged.

Defined cases, in every stage: an empty table gives an empty one; texts of any length are worked on whole; columns that are
called like a stage's own pass unchanged; a null id is an id like any other. What a stage does with null texts, ties and
repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partloom.llm import bpe, decontaminate, langid, neardup, secrets
from partloom.llm.common import bound_batches, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and those without a letter. Missing labels are filled in, ties going to the
    language with more labelled rows; repeated rows all stay. Where no row has a label, labels stay null."""
    bound_batches(spark)
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity of 0.8 or more): that with the
    smallest id, nulls last, then by a hash of the text, then any of equal rows. Null texts and those without words all stay."""
    bound_batches(spark)
    return neardup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a span with the benchmark go. Their texts alone decide, so repeated rows share their fate and rows of
    one id need not; null texts stay, and items without words meet nothing."""
    bound_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by marks, overlapping ones by the mark of the first; null texts stay null, and n_chars
    is that of the new text. Repeated rows are treated alike."""
    bound_batches(spark)
    return secrets.redacted(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; restored tells whether they decode to the text. A null text has no ids; each row gets its row."""
    bound_batches(spark)
    return bpe.encoded(docs)


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("decontamination", decontamination), ("secret scan", secret_scan), ("BPE encoding", bpe_encoding)]

#: SQL can express neither the parse of stage 1 nor the merges of stage 5; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
