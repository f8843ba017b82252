"""Gene models: parts, transcript windows, compatibility, isoforms, peaks, aggregate profiles, simulated reads, conservation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import intervals as iv
from tidemark.operators import cells
from tidemark.operators import intervals as ops
from tidemark.operators.stats import seeded
from tidemark.sources.scratch import written_table

LONG_BLOCKS = "array<struct<start:bigint,end:bigint>>"


def parts(genes: DataFrame, promoter: int = 1_000) -> DataFrame:
    """Genes (name, chr, start, end, strand, blocks, cds_start, cds_end) with ``introns, cds, utr5, utr3, promoter, junctions``; no CDS means no CDS and no UTR."""
    coding = F.col("cds_start").isNotNull() & (F.col("cds_start") < F.col("cds_end"))
    none = F.array().cast(LONG_BLOCKS)
    left = F.when(coding, iv.clip_blocks(F.col("blocks"), F.col("start"), F.col("cds_start"))).otherwise(none)
    right = F.when(coding, iv.clip_blocks(F.col("blocks"), F.col("cds_end"), F.col("end"))).otherwise(none)
    back = F.col("strand") == "-"
    front = F.when(back, F.struct(F.col("end").alias("start"), (F.col("end") + promoter).alias("end"))).otherwise(F.struct(F.greatest(F.col("start") - promoter, F.lit(0)).alias("start"), F.col("start").alias("end")))
    introns = iv.introns(F.col("blocks"))
    return genes.select(
        "*", introns.alias("introns"), F.when(coding, iv.clip_blocks(F.col("blocks"), F.col("cds_start"), F.col("cds_end"))).otherwise(none).alias("cds"), F.when(back, right).otherwise(left).alias("utr5"),
        F.when(back, left).otherwise(right).alias("utr3"), front.alias("promoter"), F.transform(introns, lambda b: F.concat_ws("-", b["start"].cast("string"), b["end"].cast("string"))).alias("junctions"),
    )


def open_reading_frames(seq: Column, least_codons: int = 1) -> Column:
    """Open reading frames of the given strand, from each ATG to the first stop in frame that is not inside an earlier match."""
    return F.regexp_extract_all(F.upper(seq), F.lit(f"ATG(?:(?!TAA|TAG|TGA)[ACGTN]{{3}}){{{max(0, least_codons - 1)},}}(?:TAA|TAG|TGA)"), F.lit(0))


def transcript_windows(genes: DataFrame, size: int, step: int) -> DataFrame:
    """``name, chr, strand, at, blocks``: windows of ``size`` spliced positions at every ``step``, the last ones clipped at the gene's end, as blocks on the reference."""
    total = iv.blocks_length(F.col("blocks"))
    each = genes.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(step).cast("long"))))
    low = F.when(F.col("strand") == "-", F.greatest(F.lit(0).cast("long"), total - F.col("at") - size)).otherwise(F.col("at"))
    high = F.when(F.col("strand") == "-", total - F.col("at")).otherwise(F.least(total, F.col("at") + size))
    cut = F.aggregate(
        F.col("blocks"), F.struct(F.lit(0).cast("long").alias("p"), F.array().cast(LONG_BLOCKS).alias("out")),
        lambda s, b: F.struct((s["p"] + b["end"] - b["start"]).alias("p"), F.concat(s["out"], F.array(F.struct((b["start"] + F.greatest(F.lit(0).cast("long"), low - s["p"])).alias("start"), F.least(b["end"], b["start"] + high - s["p"]).alias("end")))).alias("out")),
        lambda s: F.filter(s["out"], lambda b: b["start"] < b["end"]),
    )
    return each.select("name", "chr", "strand", "at", cut.alias("blocks"))


def exon_overlaps(a: DataFrame, b: DataFrame, width: int, stranded: bool = True, compatible: bool = True) -> DataFrame:
    """Pairs of genes (name, chr, strand, blocks; a row a name) with ``exons`` that overlap, the ``shared`` bases and their share of a's, and ``compatible``
    (it may be left out): whether the introns of both agree where the genes overlap."""
    return cells.exon_pairs(a, b, width, ("chr", "strand") if stranded else ("chr",), compatible)


def loci(genes: DataFrame) -> DataFrame:
    """Genes that overlap on a strand as one locus: ``chr, strand, start, end, n, union_length`` with the union of their exons."""
    marked = ops.islands(genes.select("name", "chr", "strand", "start", "end"), ("chr", "strand")).select("name", "chr", "strand", F.col("island").alias("locus"))
    keys = ("chr", "strand", "locus")
    placed = written_table(genes.join(marked, ["name", "chr", "strand"]), "loci")  # read several times below
    span = placed.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    exons = placed.select(*keys, F.explode("blocks").alias("x")).select(*keys, F.col("x.start").alias("start"), F.col("x.end").alias("end"))
    union = ops.merge(exons, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("union_length"))
    return span.join(union, list(keys)).drop("locus")


def longest_isoform(isoforms: DataFrame) -> DataFrame:
    """For each gene the isoform (gene, name, blocks) with most introns, then most bases, then the least name."""
    best = isoforms.groupBy("gene").agg(F.max(F.struct(F.size("blocks").alias("n"), iv.blocks_length(F.col("blocks")).alias("l"))).alias("m"))
    hit = isoforms.join(best, "gene").where((F.size("blocks") == F.col("m.n")) & (iv.blocks_length(F.col("blocks")) == F.col("m.l")))
    return hit.groupBy("gene").agg(F.min("name").alias("name"))


def peaks(windows: DataFrame, size: int, alpha: float, keys: tuple[str, ...] = ("chr",)) -> DataFrame:
    """Significant windows (window_start, n, p) joined where they overlap: ``keys, start, end, windows, best_p, summit`` (the first window of the most counts)."""
    hits = windows.where(F.col("p") < alpha).select(*keys, F.col("window_start").alias("start"), (F.col("window_start") + size).alias("end"), "n", "p")
    return ops.islands(hits, keys).groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("windows"), F.min("p").alias("best_p"), (-F.max(F.struct("n", (-F.col("start")).alias("s")))["s"]).alias("summit"),
    ).drop("island")


def aggregate_profile(reads: DataFrame, regions: DataFrame, bins: int, width: int) -> DataFrame:
    """``bin, n``: reads by where their start lies within the regions they overlap, each region stretched to ``bins`` bins in reading direction."""
    pairs = ops.overlap_join(regions.select("name", "chr", "start", "end", "strand"), reads.select("chr", "start", "end"), width)
    at = F.greatest("start", F.least(F.col("start_r"), F.col("end") - 1)) - F.col("start")
    forward = F.floor(at * bins / (F.col("end") - F.col("start"))).cast("int")
    return pairs.groupBy(F.when(F.col("strand") == "-", bins - 1 - forward).otherwise(forward).alias("bin")).agg(F.count("*").alias("n"))


def simulated_reads(genes: DataFrame, per_gene: int, length: int, seed: int) -> DataFrame:
    """``name, read, chr, strand, start, end``: seeded reads at uniform places of genes long enough, the same on every run."""
    room = F.col("end") - F.col("start") - length + 1
    each = genes.where(room > 0).withColumn("read", F.explode(F.sequence(F.lit(0), F.lit(per_gene - 1))))
    at = F.col("start") + F.pmod(seeded([F.col("name"), F.col("read")], seed), room)
    return each.select("name", "read", "chr", "strand", at.alias("start"), (at + length).alias("end"))


def alignment_columns(alignment: DataFrame) -> DataFrame:
    """Rows (block, species, seq) of a multiple alignment by column: ``block, at, species, base``."""
    return alignment.select("block", "species", F.posexplode(F.split("seq", "")).alias("at", "base")).where("base <> ''")


def column_identity(alignment: DataFrame) -> DataFrame:
    """``block, at, n, identity``: the share of the most frequent base among the species without a gap at each column."""
    c = alignment_columns(alignment).where("base not in ('-', '.')").groupBy("block", "at", F.upper("base").alias("base")).agg(F.count("*").alias("k"))
    return c.groupBy("block", "at").agg(F.sum("k").alias("n"), (F.max("k") / F.sum("k")).alias("identity"))


def site_likelihoods(alignment: DataFrame, parents: dict[str, tuple[str, float]], rate: float = 1.0) -> DataFrame:
    """``block, at, log_likelihood`` of each alignment column on a tree by pruning, with equal base frequencies and equal substitution rates.

    ``parents``: child to (parent, branch length); the leaves are species. Gaps and missing species stand for any base. A column is a
    group of as many rows as there are species; equal columns of a batch are computed once.
    """
    children: dict[str, list[tuple[str, float]]] = {}
    for child, (parent, branch) in parents.items():
        children.setdefault(parent, []).append((child, branch))
    root = next(p for p in children if p not in parents)

    def move(branch: float) -> np.ndarray:
        stay = 0.25 + 0.75 * np.exp(-4 / 3 * branch * rate)
        return np.full((4, 4), (1 - stay) / 3) + np.eye(4) * (stay - (1 - stay) / 3)

    def like(node: str, bases: dict[str, str]) -> np.ndarray:
        if node not in children:
            i = "ACGT".find(bases.get(node, "-"))
            return np.ones(4) if i < 0 else np.eye(4)[i]
        out = np.ones(4)
        for child, branch in children[node]:
            out = out * (move(branch) @ like(child, bases))
        return out

    known: dict[str, float] = {}

    def score(columns: pd.Series) -> pd.Series:
        for key in set(columns):
            if key not in known:
                known[key] = float(np.log(like(root, dict(p.split("=") for p in key.split(";") if p)).mean()))
        return columns.map(known).astype(float)

    from pyspark.sql.types import DoubleType

    cols = alignment_columns(alignment).groupBy("block", "at").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "species", F.upper("base")))), ";").alias("key"))
    return cols.select("block", "at", F.pandas_udf(score, DoubleType())("key").alias("log_likelihood"))


def neighbours(genes: DataFrame, width: int = 1 << 16) -> DataFrame:
    """``name, before, after``: the genes next to each by start, end and name on its reference."""
    placed = ops.two_level(genes.select("name", "chr", "start", "end"), ("chr",), ["start", "end", "name"], "start", F.lit(1), "sum", width, "place").select("chr", "place", "name")
    # each gene tells its place's neighbours its name
    told = placed.select("chr", F.explode(F.array(F.struct((F.col("place") - 1).alias("p"), F.lit("after").alias("side")), F.struct((F.col("place") + 1).alias("p"), F.lit("before").alias("side")))).alias("x"), F.col("name").alias("other"))
    sides = told.groupBy("chr", F.col("x.p").alias("place")).agg(*[F.max(F.when(F.col("x.side") == s, F.col("other"))).alias(s) for s in ("before", "after")])
    return placed.join(sides, ["chr", "place"], "left").select("name", "before", "after")
