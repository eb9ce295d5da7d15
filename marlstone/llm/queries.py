"""The queries of this subpackage, by the name under which ``__spark_entry__`` registers them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, html_text, langid, line_dedup, lm_scoring, media, simhash, warc
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies; it is a parameter of the operators and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each document loses to earlier ones, with the kept text's digest."""
    rows = line_dedup.report(table(spark, sf_dir, "documents"))
    return rows.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document under a network trained on all of them."""
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in every document."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles, linked at 4 differing bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written, read back and merged into an ordered index."""
    rows = warc.captures(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured_at", "offset", "length")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy groups among pictures drawn from the embeddings, the only table of fixed-size numeric content."""
    pictures = media.render_vectors(table(spark, sf_dir, "embeddings"), "embedding", ("vec_id",))
    return media.copies(pictures, F.col("media"), "vec_id")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose id's crc32 isn't divisible by 5."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document's text, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side."""
    return chat.rotate(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_html": op3_html,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash": op5_simhash,
    "op6_warc": op6_warc,
    "op7_media": op7_media,
    "op8_langid": op8_langid,
    "op9_bpe": op9_bpe,
    "op10_chat": op10_chat,
}

#: DuckDB SQL of the operators that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op10_chat": chat.ORACLE,
}
