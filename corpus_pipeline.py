"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage but the last returns the columns it was given, whatever their names; columns of a stage's own have names that are free. What
a stage does with nulls, empty, very long and repeated texts, ties and empty tables stands with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, langid, linededup, neardup
from tidemark.llm.common import free_name, materialize


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` brought up to date with the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told: neither without letters nor ambiguous between two languages.

    Null texts and those without letters, empty ones too, go; so does everything if no document has a label. Long texts are read whole.
    Repeated rows are judged alike and all stay or go. A language that is as close as the best one (a tie) makes a text ambiguous. An
    empty table gives an empty one.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    model = langid.learn(langid.learned_rows(docs))
    found = langid.predict(docs.toDF(*names), model, text=names[docs.columns.index("text")], keep=names)
    return found.where("lang_pred <> 'und' and not ambiguous").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of lines out of the texts; documents of which nothing is left go.

    Null texts stay null and empty texts empty; long texts are cut whole. The first occurrence by doc_id (null ids last), then by place,
    stays, so a tie is none; rows equal in id and text share their result, so neither loses to its twin. An empty table gives an empty
    one.
    """
    return with_length(linededup.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one with the smallest id (and one of its repeated rows).

    Shingles have five words, the width for near-duplicate stages without a contract of their own; ``op6_near_dedup`` has four by its
    contract. Null, empty and wordless texts are linked with nothing and stay, one row for each id and text. Long texts count whole. Of
    rows with a null id one of each text stays unless another document of its component has an id. An empty table gives an empty one.
    """
    key, kept_id, kept_key = (free_name(docs, x) for x in ("text_key", "kept_id", "kept_key"))
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(kept_id), F.col("key").alias(kept_key)).distinct()
    rows = docs.withColumn(key, F.xxhash64("text"))
    found = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    return found.dropDuplicates(["doc_id", key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of ten words of a benchmark item.

    Null, empty and wordless texts hold none and stay; long texts are searched whole; repeated rows stay or go together; there are no
    ties. Null items match nothing; items without an id count like others. An empty table of documents gives an empty one, an empty
    benchmark drops nothing.
    """
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source``, token counts and digests of the ids and of the decoded text.

    A null text counts as an empty one, which has no tokens and the digest of nothing. Long texts are encoded whole, repeated rows
    alike. Further columns are left out. An empty table gives an empty result.
    """
    import public_tokenizers

    return bpe.encode_digest(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", tokenize),
]

#: Language ID has no SQL form, so the pipeline has none; it is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "".join(c if c.isalnum() else "-" for c in name))
    return STAGES[-1][1](spark, docs, sf_dir)
