"""The registered query of each corpus operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text for every document."""
    from .bpe import encode_digest

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return encode_digest(table(spark, sf_dir, "documents"), path, keep=["doc_id"])


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict for every page's url."""
    from .urlfilter import PATTERNS, filter_urls, host_rule

    rules = [host_rule(v, r) for v, r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]
    return filter_urls(table(spark, sf_dir, "pages"), rules + PATTERNS, keep=["page_id"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document and what is left when repeated passages of lines are removed."""
    from .linededup import dedup_digest

    return dedup_digest(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    from .decontam import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of equal row counts."""
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), 40)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 4-word shingle sets at a similarity of 0.8 or more."""
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80).drop("key")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and score of every document."""
    from .langid import held_out, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, keep=["doc_id", held_out(F.col("doc_id")).alias("held_out")])


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every 20th vector with all others."""
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page into archives and returns what reading them back gives."""
    from .common import materialize
    from .warc import read_archives, write_archives

    archives = materialize(write_archives(table(spark, sf_dir, "pages")), "warc")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when windows of 50 words that start in an earlier document are removed."""
    from .substring import dedup_digest

    return dedup_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_url_filter": op2_url_filter,
        "op3_line_dedup": op3_line_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_sharding": op5_sharding,
        "op6_near_dedup": op6_near_dedup,
        "op7_language_id": op7_language_id,
        "op8_top_k": op8_top_k,
        "op9_warc": op9_warc,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
