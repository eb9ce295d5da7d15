"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE. Every stage reads what the last one wrote.

Defined cases, beside those of the operators: a null text, or one without letters, has no language and goes in the first
stage; a null doc_id comes after all others where documents are in order; rows that repeat id and text are one document to
line dedup and one stays in near-dedup; an id of several texts names several documents; an empty table passes through every
stage; columns beyond those of documents are carried along, whatever their names, but for ``ids``, ``n_tokens``, ``exact`` and
``decoded``, which the last stage makes; a very long text is one row's work throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, common, decontaminate, langid, line_dedup, simhash
from marlstone.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't rejected."""
    return langid.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; those of which nothing is left go."""
    return line_dedup.remove(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, a similarity of 0.8 or more."""
    return simhash.representatives(docs, words=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows; those of which nothing is left go."""
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with its size in tokens and whether they decode to its text, beside its columns but the text."""
    keep = tuple(c for c in docs.columns if c not in ("ids", "n_tokens", "exact", "decoded"))
    rows = bpe.roundtrip(docs, tokenizer_path(), keep=keep)
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select(*(c for c in keep if c != "text"), "ids", F.size("ids").cast("long").alias("n_tokens"), exact.alias("exact"))


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near), ("benchmark decontamination", benchmark), ("BPE encoding and decoding", tokens)]

#: The first stage applies a trained model, so SQL can't express the rows; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, f"stage{k}")
    return docs
