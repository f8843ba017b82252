"""Writers of line-based formats: each gives a DataFrame with one ``value`` column, which ``write_text`` puts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_text(rows: DataFrame, path: str, one_file: bool = False) -> None:
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").text(path)


def _text(c: str) -> Column:
    """Whole numbers without a fraction."""
    return F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\.0$", ""), F.lit("."))


def bed(df: DataFrame) -> DataFrame:
    """BED12 lines of annotations with blocks."""
    sizes = F.concat_ws(",", F.transform("blocks", lambda b: (b["end"] - b["start"]).cast("string")))
    starts = F.concat_ws(",", F.transform("blocks", lambda b: (b["start"] - F.col("start")).cast("string")))
    return df.select(F.concat_ws("\t", "chr", "start", "end", F.coalesce(F.col("name").cast("string"), F.lit(".")), F.regexp_replace(F.coalesce(F.col("score"), F.lit(0)).cast("string"), r"\.0$", ""), "strand", F.coalesce("cds_start", "start"), F.coalesce("cds_end", "end"), F.lit("0"), F.size("blocks"), sizes, starts).alias("value"))


def short_bed(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", "chr", "start", "end", "name").alias("value"))


def bedgraph(df: DataFrame, score: str = "score") -> DataFrame:
    return df.select(F.concat_ws("\t", "chr", "start", "end", _text(score)).alias("value"))


def wig(df: DataFrame, pos: str, value: str) -> DataFrame:
    """Variable-step WIG, a track a reference: positions count from 1."""
    head = df.select("chr").distinct().select("chr", F.lit(-1).cast("long").alias("p"), F.concat(F.lit("variableStep chrom="), "chr").alias("value"))
    body = df.select("chr", F.col(pos).cast("long").alias("p"), F.concat_ws(" ", (F.col(pos) + 1).cast("string"), _text(value)).alias("value"))
    return head.unionByName(body).sort("chr", "p").select("value")


def ucsc(df: DataFrame) -> DataFrame:
    return df.select(F.concat("chr", F.lit(":"), "start", F.lit("-"), "end").alias("value"))


def gtf(df: DataFrame, source: str = "tidemark", feature: str = "exon") -> DataFrame:
    """One line a block; positions count from 1, ends included."""
    each = df.select("*", F.explode("blocks").alias("b"))
    name = F.col("name").cast("string")
    attrs = F.concat(F.lit('gene_id "'), name, F.lit('"; transcript_id "'), name, F.lit('";'))
    return each.select(F.concat_ws("\t", "chr", F.lit(source), F.lit(feature), (F.col("b.start") + 1).cast("string"), F.col("b.end").cast("string"), _text("score"), "strand", F.lit("."), attrs).alias("value"))


def ref_seq(df: DataFrame) -> DataFrame:
    """Gene prediction lines: name, chr, strand, ends, CDS, exon count, exon starts and ends."""
    starts = F.concat(F.concat_ws(",", F.transform("blocks", lambda b: b["start"].cast("string"))), F.lit(","))
    ends = F.concat(F.concat_ws(",", F.transform("blocks", lambda b: b["end"].cast("string"))), F.lit(","))
    return df.select(F.concat_ws("\t", F.col("name").cast("string"), "chr", "strand", "start", "end", F.coalesce("cds_start", "end"), F.coalesce("cds_end", "end"), F.size("blocks"), starts, ends).alias("value"))


def cigar(blocks: Column) -> Column:
    """M for each block and N for each gap between two."""
    parts = F.transform(blocks, lambda b, i: F.concat(F.when(i > 0, F.concat((b["start"] - F.get(blocks, i - 1)["end"]).cast("string"), F.lit("N"))).otherwise(F.lit("")), (b["end"] - b["start"]).cast("string"), F.lit("M")))
    return F.array_join(parts, "")


def sam(df: DataFrame) -> DataFrame:
    """SAM lines of annotations or PSL alignments with blocks: name, strand flag, place and CIGAR."""
    return df.select(F.concat_ws("\t", F.col("name").cast("string"), F.when(F.col("strand") == "-", "16").otherwise("0"), "chr", (F.col("start") + 1).cast("string"), F.lit("255"), cigar(F.col("blocks")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*")).alias("value"))


def fasta(df: DataFrame, numbered: bool = False, width: int = 0) -> DataFrame:
    """FASTA records of ``id, seq`` (``numbered``: ids count from 1 by the order of ``file, i``); lines of ``width`` letters if above 0."""
    if numbered:  # within each file in two levels, then over one row a file
        from tidemark.operators.intervals import two_level

        df = two_level(df, ("file",), ["i"], "i", F.lit(1), "sum", 1 << 16, "__k")
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        files = df.groupBy("file").agg(F.count("*").alias("__n")).select("file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
        df = df.join(files, "file")
    ids = (F.col("__k") + F.col("__before")).cast("string") if numbered else F.col("id")
    seq = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n") if width else F.col("seq")
    return df.select(F.concat(F.lit(">"), ids, F.lit("\n"), seq).alias("value"))


def gmt(sets: DataFrame) -> DataFrame:
    """Name, name again, and the sorted genes of each set."""
    g = sets.groupBy("set_name").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    return g.select(F.concat_ws("\t", "set_name", "set_name", F.col("genes")).alias("value"))


def gct(m: DataFrame) -> DataFrame:
    """GCT lines of a long matrix; columns in alphabetical order. Column names come to the driver: they are samples."""
    columns = [r["col"] for r in m.select("col").distinct().orderBy("col").collect()]
    wide = m.groupBy("row").pivot("col", columns).agg(F.first("value"))
    body = wide.select(F.lit(3).alias("o"), F.col("row"), F.concat_ws("\t", "row", "row", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]).alias("value"))
    n = m.select("row").distinct().count()
    head = m.sparkSession.createDataFrame([(0, "", "#1.2"), (1, "", f"{n}\t{len(columns)}"), (2, "", "\t".join(["Name", "Description", *columns]))], "o int, row string, value string")
    return head.unionByName(body).sort("o", "row").select("value")


def cls(labels: list[str]) -> str:
    """A CLS file: counts, the classes in order of appearance, and each sample's label."""
    classes = list(dict.fromkeys(labels))
    return f"{len(labels)} {len(classes)} 1\n# {' '.join(classes)}\n{' '.join(labels)}\n"


def barcode_report(distances: DataFrame) -> str:
    """Least, greatest and a histogram of stars over the distances up to the greatest (``distance, n``; as many rows as a barcode has letters)."""
    rows = {r["distance"]: r["n"] for r in distances.collect()}
    if not rows:
        return "no pairs\n"
    lines = [f"min\t{min(rows)}", f"max\t{max(rows)}"] + [f"{d:>3}\t{rows.get(d, 0):>8}\t{'*' * min(60, rows.get(d, 0))}" for d in range(max(rows) + 1)]
    return "\n".join(lines) + "\n"
