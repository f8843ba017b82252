"""From reads to a normalized matrix: fractional starts, significant windows, counts per experiment, equal column totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import scan_pvalue
from tidemark.operators import counting as ct
from tidemark.operators import intervals as ops
from tidemark.operators import matrix as mx
from tidemark.sources.scratch import written_table


def significant_windows(reads: DataFrame, lengths: DataFrame, size: int, step: int, alpha: float) -> DataFrame:
    """``chr, window_start, n, p`` of the windows whose count of read starts has a scan p-value below ``alpha``.

    The rate is the reference's reads over its length, so one small row a reference is joined.
    """
    starts = reads.select("chr", F.col("start").alias("pos"))
    counts = ops.window_counts(starts, size, step, ("chr",), F.lit(1.0)).select("chr", "window_start", "n")
    rates = reads.groupBy("chr").agg(F.count("*").alias("reads")).join(lengths.select("chr", "length"), "chr").select("chr", "length", (F.col("reads") / F.col("length")).alias("rate"))
    p = scan_pvalue(F.col("n"), F.col("rate"), F.lit(size), F.col("length"))
    return counts.join(rates, "chr").withColumn("p", p).where(F.col("p") < alpha).select("chr", "window_start", "n", "p")


def significant_genes(genes: DataFrame, windows: DataFrame, size: int, width: int) -> DataFrame:
    """The genes that overlap a significant window."""
    spans = windows.select("chr", F.col("window_start").alias("start"), (F.col("window_start") + size).alias("end"))
    return ops.overlap_join(genes, spans, width, how="left_semi")


def count_matrix(reads: DataFrame, genes: DataFrame, exons: DataFrame, width: int, normalize: bool = True) -> DataFrame:
    """Long matrix ``row`` (gene), ``col`` (experiment), ``value`` (fractional reads over exons), scaled to equal column totals."""
    counts = ct.count_exonic(reads, genes, exons, width)
    m = counts.select(F.col("name").cast("string").alias("row"), F.col("exp").alias("col"), F.col("weight").alias("value"))
    m = written_table(m, "counts") if normalize else m  # its totals and its rows are read
    return mx.scale_columns(m, mx.normalization_factors(m)) if normalize else m
