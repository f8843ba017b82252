"""Readers of line-based formats. Every reader gives a DataFrame with an explicit schema and decodes with column expressions.

Lines are numbered across the splits of a file, so records of several lines (FASTQ) are put together by number and large files are read
in parallel. Formats whose records begin with a sign of their own (FASTA, MAF) are split at it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCKS = "array<struct<start:bigint,end:bigint>>"


def lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """``file, no, value``: the lines of each file, or what ``sep`` parts, with their numbers from 0.

    Rows are numbered within the split that they are read from; what earlier splits hold is one row a split.
    """
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"))
    splits = rows.groupBy("file", "__at").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "__at", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(splits, ["file", "__at"]).select("file", (F.col("__id") - F.col("__first") + F.col("__before")).alias("no"), "value")


def fields(names: dict[str, str], column: str = "value", sep: str = "\t") -> list[Column]:
    """The parts of a separated line as columns of the given types; null where a part is missing or malformed."""
    parts = F.split(F.col(column), sep)
    return [F.get(parts, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(names.items())]


def tabbed(spark: SparkSession, path: str, schema: dict[str, str], where: Column | None = None, skip_rows: int = 0) -> DataFrame:
    """Tab-separated lines as the columns of ``schema`` (name to type), without the first ``skip_rows`` of each file."""
    rows = lines(spark, path).where(F.col("no") >= skip_rows) if skip_rows else spark.read.text(path)
    out = rows.select(*fields(schema))
    return out.where(where) if where is not None else out


def annotation_table(spark: SparkSession, path: str, schema: dict[str, str], where: Column | None = None) -> DataFrame:
    """As ``tabbed`` without blank and ``#`` lines; a ``track`` line is an error."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    rows = rows.withColumn("value", F.when(F.col("value").startswith("track"), F.raise_error(F.concat(F.lit("track line in an annotation table: "), "value"))).otherwise(F.col("value")))
    out = rows.select(*fields(schema))
    return out.where(where) if where is not None else out


def _plain(spark: SparkSession, path: str) -> DataFrame:
    skipped = F.col("value").rlike("^(#|track|browser)") | (F.trim("value") == "")
    return spark.read.text(path).where(~skipped)


BED = {"chr": "string", "start": "bigint", "end": "bigint", "name": "string", "score": "double", "strand": "string", "thick_start": "bigint", "thick_end": "bigint", "rgb": "string", "block_count": "int", "block_sizes": "string", "block_starts": "string"}


def _longs(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("bigint"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of a BED file of 3 to 12 columns, equal lines once: ``chr, start, end, name, score, strand, blocks, cds_start, cds_end``."""
    rows = _plain(spark, path).select(*fields(BED, sep="\t|  *")).distinct()
    starts, sizes = _longs(F.col("block_starts")), _longs(F.col("block_sizes"))
    some = F.zip_with(starts, sizes, lambda s, n: F.struct((F.col("start") + s).alias("start"), (F.col("start") + s + n).alias("end")))
    one = F.array(F.struct(F.col("start").alias("start"), F.col("end").alias("end")))
    return rows.select("chr", "start", "end", "name", "score", F.coalesce("strand", F.lit("*")).alias("strand"), F.coalesce(some, one).cast(BLOCKS).alias("blocks"), F.col("thick_start").alias("cds_start"), F.col("thick_end").alias("cds_end"))


def short_bed(spark: SparkSession, path: str) -> DataFrame:
    return _plain(spark, path).select(*fields(dict(list(BED.items())[:4])))


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return _plain(spark, path).select(*fields({"chr": "string", "start": "bigint", "end": "bigint", "score": "double"}, sep="\t|  *"))


def chromosome_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``chr, length``: up to the first blank line; of repeated names the last counts."""
    rows = lines(spark, path)
    stop = rows.where(F.trim("value") == "").groupBy("file").agg(F.min("no").alias("stop"))
    kept = rows.join(stop, "file", "left").where(F.col("stop").isNull() | (F.col("no") < F.col("stop")))
    parsed = kept.select("file", "no", *fields({"chr": "string", "length": "bigint"}, sep="\t| +"))
    return parsed.groupBy("chr").agg(F.max(F.struct("file", "no", "length")).alias("m")).select("chr", F.col("m.length").alias("length"))


PSL = {
    "matches": "int", "mismatches": "int", "rep_matches": "int", "n_count": "int", "q_gaps": "int", "q_gap_bases": "int", "t_gaps": "int", "t_gap_bases": "int", "strand": "string", "name": "string",
    "q_size": "int", "q_start": "int", "q_end": "int", "chr": "string", "t_size": "bigint", "start": "bigint", "end": "bigint", "block_count": "int", "sizes": "string", "q_starts": "string", "t_starts": "string",
}


def psl(spark: SparkSession, path: str) -> DataFrame:
    """BLAT alignments with ``blocks`` and ``identity`` (matches over aligned bases). Lines with fewer than 21 fields, block lists that
    disagree, or a last block that doesn't end at the stated end are errors."""
    rows = spark.read.text(path).where(F.col("value").rlike("^[0-9]"))
    rows = rows.withColumn("value", F.when(F.size(F.split("value", "\t")) < 21, F.raise_error(F.concat(F.lit("too few fields: "), "value"))).otherwise(F.col("value")))
    p = rows.select(*fields(PSL))
    sizes, starts, q = _longs(F.col("sizes")), _longs(F.col("t_starts")), _longs(F.col("q_starts"))
    p = p.withColumn("blocks", F.zip_with(starts, sizes, lambda s, n: F.struct(s.alias("start"), (s + n).alias("end"))))
    bad = (F.size(sizes) != F.col("block_count")) | (F.size(starts) != F.col("block_count")) | (F.size(q) != F.col("block_count")) | (F.element_at("blocks", -1)["end"] != F.col("end"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("blocks disagree in "), "name"))).otherwise(F.col("blocks"))
    aligned = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return p.select("name", "chr", "start", "end", "strand", "matches", "mismatches", checked.alias("blocks"), (F.col("matches") / aligned).alias("identity"))


def mapping_table(spark: SparkSession, path: str, wanted: list[str], sep: str = "\t") -> DataFrame:
    """The named columns of a table with a header, in the order asked for; a missing one is an error."""
    table = spark.read.csv(path, header=True, sep=sep)
    if missing := [c for c in wanted if c not in table.columns]:
        raise ValueError(f"the header lacks {missing}")
    return table.select(*[F.col(f"`{c}`") for c in wanted])


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """``file, i, id, seq, qual``: records of four lines, whatever the quality line begins with."""
    rows = lines(spark, path).withColumn("i", F.call_function("div", F.col("no"), F.lit(4)).cast("bigint")).withColumn("k", F.col("no") % 4)
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    out = rows.groupBy("file", "i").agg(part(0).alias("id"), part(1).alias("seq"), part(3).alias("qual"))
    return out.where("qual is not null").select("file", "i", F.regexp_replace("id", "^@", "").alias("id"), "seq", "qual")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``id, description, seq``: comments from ``#`` on dropped, white space within sequences removed."""
    records = _marked(spark, path).select(F.trim(F.regexp_replace("r", "#[^\n]*", "")).alias("r")).where(~F.col("r").rlike(r"^\s*$"))
    head = F.regexp_extract("r", "^[^\n]*", 0)
    return records.select(F.regexp_extract(head, r"^\S*", 0).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), F.regexp_replace(F.regexp_replace("r", "^[^\n]*", ""), r"\s", "").alias("seq"))


def _marked(spark: SparkSession, path: str) -> DataFrame:
    """``r``: what follows each ``>`` at a line's start, up to the next one; what stands before a file's first one is left out."""
    rows = lines(spark, path, "\n>").withColumn("value", F.regexp_replace("value", "\r", ""))
    # the first piece of a file begins with its mark, or lies before any record
    kept = rows.where((F.col("no") > 0) | F.col("value").startswith(">"))
    return kept.select(F.when(F.col("no") == 0, F.substring("value", 2, 2_147_483_647)).otherwise(F.col("value")).alias("r"))


def fasta_quality(spark: SparkSession, path: str) -> DataFrame:
    """``id, quality`` (array of ints)."""
    numbers = F.filter(F.split(F.regexp_replace("r", "^[^\n]*", ""), r"\s+"), lambda x: x != "")
    return _marked(spark, path).select(F.regexp_extract("r", r"^\S*", 0).alias("id"), F.transform(numbers, lambda x: x.cast("int")).alias("quality"))


def fastq_count(spark: SparkSession, path: str) -> DataFrame:
    """``n``: lines that begin with ``@``; quality lines that do so count, too, as the format's counters have it."""
    return spark.read.text(path).agg(F.count_if(F.col("value").startswith("@")).alias("n"))


def gmt(spark: SparkSession, path: str, more_than: int = 0) -> DataFrame:
    """``set_name, gene`` (upper-cased) of the sets with more than ``more_than`` genes; genes start at the third field; a blank line ends a file."""
    rows = lines(spark, path)
    stop = rows.where(F.trim("value") == "").groupBy("file").agg(F.min("no").alias("stop"))
    rows = rows.join(stop, "file", "left").where(F.col("stop").isNull() | (F.col("no") < F.col("stop")))
    parts = F.split("value", "\t")
    genes = F.array_distinct(F.filter(F.transform(F.slice(parts, 3, 1_000_000), F.upper), lambda g: g != ""))
    sets = rows.select(F.get(parts, F.lit(0)).alias("set_name"), genes.alias("genes")).where(F.size("genes") > more_than)
    return sets.select("set_name", F.explode("genes").alias("gene"))


def gmx(spark: SparkSession, path: str, more_than: int = 0) -> DataFrame:
    """``set_name, gene``: one set a column, names in the first line, the second ignored; genes as they are."""
    rows = lines(spark, path).select("file", "no", F.posexplode(F.split("value", "\t")).alias("col", "gene"))
    names = rows.where("no = 0").select("file", "col", F.col("gene").alias("set_name"))
    genes = rows.where((F.col("no") > 1) & (F.col("gene") != "")).join(names, ["file", "col"]).select("set_name", "gene").distinct()
    big = genes.groupBy("set_name").agg(F.count("*").alias("n")).where(F.col("n") > more_than).select("set_name")
    return genes.join(big, "set_name", "left_semi")


def gene_sets(spark: SparkSession, path: str, more_than: int = 0) -> DataFrame:
    return gmt(spark, path, more_than) if path.lower().endswith(".gmt") else gmx(spark, path, more_than)


def chip(spark: SparkSession, path: str) -> DataFrame:
    """``probe, gene`` (upper-cased); of repeated probes the last line counts."""
    rows = lines(spark, path).select("file", "no", *fields({"probe": "string", "gene": "string"}))
    last = rows.groupBy("probe").agg(F.max(F.struct("file", "no", "gene")).alias("m"))
    return last.select("probe", F.upper("m.gene").alias("gene"))


def probes_by_gene(probes: DataFrame) -> DataFrame:
    return probes.groupBy("gene").agg(F.array_sort(F.collect_set("probe")).alias("probes"))


EXPERIMENT = ("barcode", "experiment", "plate", "plate_pos", "hyb_date", "qc_flag_no", "sample_type", "time_point", "unused", "batch")


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """Experiment records; ``qc_flag_no`` is true where the file says "no"; ``is_control`` where the sample type says so."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(*fields(dict.fromkeys(EXPERIMENT, "string")))
    return rows.select("barcode", "experiment", "plate", "plate_pos", "hyb_date", (F.lower(F.trim("qc_flag_no")) == "no").alias("qc_flag_no"), "sample_type", F.col("time_point").try_cast("int").alias("time_point"), "batch", F.lower("sample_type").contains("control").alias("is_control"))


def barcode_map(spark: SparkSession, path: str) -> DataFrame:
    """``barcode, sample``: of repeated barcodes the last line counts."""
    rows = lines(spark, path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    rows = rows.select("file", "no", F.get(parts, F.lit(0)).alias("barcode"), F.get(parts, F.lit(1)).alias("sample"))
    return rows.groupBy("barcode").agg(F.max(F.struct("file", "no", "sample")).alias("m")).select("barcode", F.col("m.sample").alias("sample"))


SAM = {"read_name": "string", "flag": "int", "chr": "string", "pos": "bigint", "mapq": "int", "cigar": "string", "rnext": "string", "pnext": "bigint", "tlen": "bigint", "seq": "string", "qual": "string"}


def sam(spark: SparkSession, path: str, keep_unmapped: bool = False) -> DataFrame:
    """Reads of a SAM text file: half-open 0-based ``start, end`` and ``blocks`` from the CIGAR, flags as columns, ``nh`` from its tag (1 without)."""
    return decode_sam(spark.read.text(path), keep_unmapped)


def decode_sam(lines_: DataFrame, keep_unmapped: bool = False) -> DataFrame:
    """The reads of SAM lines (value); header lines are left out."""
    rows = lines_.where(~F.col("value").startswith("@") & (F.trim("value") != ""))
    r = rows.select(*fields(SAM), F.regexp_extract("value", r"\tNH:i:(\d+)", 1).try_cast("int").alias("nh"))
    flag = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    state = F.struct((F.col("pos") - 1).alias("at"), F.lit(False).alias("open"), F.array().cast(BLOCKS).alias("out"))

    def step(s: Column, op: Column) -> Column:
        n, kind = F.regexp_extract(op, r"^\d+", 0).cast("bigint"), F.right(op, F.lit(1))
        grown = F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(F.struct(F.element_at(s["out"], -1)["start"].alias("start"), (s["at"] + n).alias("end"))))
        fresh = F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), (s["at"] + n).alias("end"))))
        covers = kind.isin("M", "=", "X", "D")
        return F.struct(
            F.when(covers | (kind == "N"), s["at"] + n).otherwise(s["at"]).alias("at"), F.when(covers, True).when(kind == "N", False).otherwise(s["open"]).alias("open"),
            F.when(covers & s["open"], grown).when(covers, fresh).otherwise(s["out"]).alias("out"),
        )

    r = r.withColumn("blocks", F.when((F.col("cigar") != "*") & (F.size(ops) > 0), F.aggregate(ops, state, step, lambda s: s["out"])))
    out = r.select(
        "read_name", "chr", F.col("blocks")[0]["start"].alias("start"), F.element_at("blocks", -1)["end"].alias("end"), F.when(flag(16), "-").otherwise("+").alias("strand"), "mapq", F.coalesce("nh", F.lit(1)).alias("nh"),
        flag(1).alias("is_paired"), (~flag(128)).alias("is_first"), flag(1024).alias("is_duplicate"), flag(2).alias("is_proper"), (~flag(256)).alias("is_primary"), "cigar",
        F.when(F.col("rnext") == "=", F.col("chr")).otherwise(F.col("rnext")).alias("mate_chr"), (F.col("pnext") - 1).alias("mate_start"), F.when(flag(32), "-").otherwise("+").alias("mate_strand"), "blocks", "seq", "qual",
    )
    return out if keep_unmapped else out.where("blocks is not null")


def sam_references(spark: SparkSession, path: str) -> DataFrame:
    """``chr, length`` from the header."""
    head = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    return head.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chr"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("length"))


GFF = {"chr": "string", "source": "string", "feature": "string", "gff_start": "bigint", "gff_end": "bigint", "score": "string", "strand": "string", "frame": "string", "attributes": "string"}


def gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF and GTF features, 0-based half-open, attributes as a map."""
    rows = _plain(spark, path).select(*fields(GFF))
    pairs = F.filter(F.transform(F.split("attributes", ";"), lambda x: F.trim(x)), lambda x: x != "")
    key = lambda x: F.regexp_extract(x, r"^([^=\s]+)", 1)
    value = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[^=\s]+[=\s]\s*", ""), '^"|"$', "")
    attrs = F.map_from_entries(F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda s, x: F.when(F.exists(s, lambda e: e["key"] == key(x)), s).otherwise(F.concat(s, F.array(F.struct(key(x).alias("key"), value(x).alias("value")))))))
    return rows.select("chr", "source", "feature", (F.col("gff_start") - 1).alias("start"), F.col("gff_end").alias("end"), F.col("score").try_cast("double").alias("score"), "strand", "frame", attrs.alias("attributes"))


def repeat_masker(spark: SparkSession, path: str) -> DataFrame:
    """``chr, start, end, strand, name, family, score`` of a RepeatMasker table (fields by white space, three header lines)."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^[0-9]"))
    g = lambda i: F.get(parts, F.lit(i))
    return rows.select(g(4).alias("chr"), (g(5).cast("bigint") - 1).alias("start"), g(6).cast("bigint").alias("end"), F.when(g(8) == "C", "-").otherwise("+").alias("strand"), g(9).alias("name"), g(10).alias("family"), g(0).cast("double").alias("score"))


def gct(spark: SparkSession, path: str) -> DataFrame:
    """Long matrix ``row, description, col, value`` of a GCT file (``#1.2``, sizes, header) or of a plain table with a header."""
    rows = lines(spark, path)
    shape = rows.groupBy("file").agg(F.max(F.when((F.col("no") == 0) & F.col("value").startswith("#1.2"), 2).otherwise(0)).alias("head"))
    rows = rows.join(shape, "file").where(F.col("no") >= F.col("head")).select("file", (F.col("no") - F.col("head")).alias("no"), "head", F.split("value", "\t").alias("p"))
    first = F.when(F.col("head") == 2, 2).otherwise(1)
    names = rows.where("no = 0").select("file", F.posexplode(F.slice("p", first + 1, F.size("p"))).alias("i", "col"))
    values = rows.where("no > 0").select("file", F.get("p", F.lit(0)).alias("row"), F.when(F.col("head") == 2, F.get("p", F.lit(1))).alias("description"), F.posexplode(F.slice("p", first + 1, F.size("p"))).alias("i", "v"))
    return values.join(names, ["file", "i"]).select("row", "description", "col", F.col("v").try_cast("double").alias("value")).where("value is not null")


def cls(spark: SparkSession, path: str) -> DataFrame:
    """``i, label`` of a CLS file: the third line's label of each sample."""
    rows = lines(spark, path).where("no = 2")
    return rows.select(F.posexplode(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")).alias("i", "label"))


def maf(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, species, chr, start, size, strand, src_size, seq`` of a multiple alignment format file."""
    # an alignment begins with a line that starts with an "a"; what stands before a file's first is its header
    blocks = lines(spark, path, "\na").select("file", F.col("no").alias("block"), F.explode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("value"))
    first = F.col("value").rlike(r"^a(\s|$)").cast("long")
    heads = blocks.where("block = 0").groupBy("file").agg(F.max(first).alias("__head"))
    rows = blocks.where(F.col("value").rlike(r"^s\s")).join(heads, "file", "left").withColumn("block", F.col("block") + F.coalesce("__head", F.lit(0))).drop("__head")
    p = F.split("value", r"\s+")
    g = lambda i: F.get(p, F.lit(i))
    return rows.select("file", "block", F.regexp_extract(g(1), r"^[^.]*", 0).alias("species"), F.regexp_extract(g(1), r"\.(.*)$", 1).alias("chr"), g(2).cast("bigint").alias("start"), g(3).cast("bigint").alias("size"), g(4).alias("strand"), g(5).cast("bigint").alias("src_size"), g(6).alias("seq"))


def phylip(spark: SparkSession, path: str, interleaved: bool = False) -> DataFrame:
    """``species, seq`` of a PHYLIP alignment."""
    rows = lines(spark, path).where((F.col("no") > 0) & (F.trim("value") != ""))
    count = lines(spark, path).where("no = 0").select("file", F.regexp_extract(F.trim("value"), r"^(\d+)", 1).cast("int").alias("n"))
    rows = rows.join(count, "file").withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("no")) - 1)
    if interleaved:
        rows = rows.withColumn("g", F.col("k") % F.col("n")).withColumn("named", F.col("k") < F.col("n"))
    else:
        rows = rows.withColumn("named", F.col("value").rlike(r"^\S")).withColumn("g", F.sum(F.col("named").cast("int")).over(Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part = F.when(F.col("named"), F.regexp_replace("value", r"^\s*\S+", "")).otherwise(F.col("value"))
    joined = rows.groupBy("file", "g").agg(F.max(F.when(F.col("named"), F.regexp_extract("value", r"^\s*(\S+)", 1))).alias("species"), F.array_sort(F.collect_list(F.struct("no", F.regexp_replace(part, r"\s", "").alias("s")))).alias("p"))
    return joined.select("species", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"))


def motif_report(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """The motifs of a MEME text report: (``motif, width, sites, llr, evalue, pwm``) and (``motif, id, start, p, seq``). Reports are small and parsed on the driver."""
    motifs, sites, name, mode = [], [], None, ""
    for line in text.splitlines():
        if m := re.match(r"MOTIF\s+(\S+).*?width\s*=\s*(\d+)\s+sites\s*=\s*(\d+)\s+llr\s*=\s*(\S+)\s+E-value\s*=\s*(\S+)", line):
            name = m[1]
            motifs.append([name, int(m[2]), int(m[3]), float(m[4]), float(m[5]), []])
        elif re.search(r"sites sorted by position p-value", line):
            mode = "sites"
        elif line.startswith("letter-probability matrix"):
            mode = "matrix"
        elif mode == "sites" and (m := re.match(r"(\S+)\s+(?:[+-]\s+)?(\d+)\s+(\d\S*)\s+(?:\S+\s+)?([A-Za-z]+)(?:\s+\S+)?$", line)):
            sites.append((name, m[1], int(m[2]), float(m[3]), m[4]))
        elif mode == "matrix" and (m := re.match(r"\s*([\d.eE+-]+)\s+([\d.eE+-]+)\s+([\d.eE+-]+)\s+([\d.eE+-]+)\s*$", line)):
            motifs[-1][5].append([float(x) for x in m.groups()])
        elif mode == "matrix" and motifs and motifs[-1][5]:
            mode = ""
    return (
        spark.createDataFrame([tuple(m) for m in motifs], "motif string, width int, sites int, llr double, evalue double, pwm array<array<double>>"),
        spark.createDataFrame(sites, "motif string, id string, start int, p double, seq string"),
    )


def motif_enrichment(spark: SparkSession, path: str) -> DataFrame:
    """``motif, p, corrected_p`` of an enrichment report: lines that begin with a number and a dot."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^[0-9]+\."))
    p = F.split(F.trim("value"), r"\s+")
    return rows.select(F.get(p, F.lit(5)).alias("motif"), F.element_at(p, -4).cast("double").alias("p"), F.regexp_replace(F.element_at(p, -1), r"\)$", "").cast("double").alias("corrected_p"))


def annotation_files(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """``path, name`` of all files below a folder with one of the extensions; the name is the path below it, dotted, without the extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    pattern = r"\.(" + "|".join(map(re.escape, extensions)) + ")$"
    below = F.regexp_replace("path", "^.*?" + re.escape(folder.rstrip("/")) + "/", "")
    return files.where(F.col("path").rlike(pattern)).select("path", F.replace(F.regexp_replace(below, pattern, ""), F.lit("/"), F.lit(".")).alias("name"))


def assert_sorted(df: DataFrame, order: list[str], place: str) -> DataFrame:
    """The rows, with an error where one sorts before any row ahead of it by ``place``, a whole number."""
    from tidemark.operators.intervals import two_level

    met = two_level(df, (), [place], place, F.struct(*order), "max", 1 << 16, "__before", inclusive=False)
    fits = F.coalesce(F.col("__before") <= F.struct(*order), F.lit(True))
    return met.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("rows are not sorted")).cast("boolean"))).drop("__before")


def parse_fields(column: Column, sep: str = r"\s+") -> Column:
    """Fields of a string; ``typed`` takes one with a type."""
    return F.split(column, sep)


def typed(parts: Column, i: int, kind: str) -> Column:
    """Field i as a type; an error that names the field where it is missing or malformed."""
    raw = F.get(parts, F.lit(i))
    value = raw.try_cast(kind)
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"field {i} is no {kind}: "), F.coalesce(raw, F.lit("missing"))))).otherwise(value).cast(kind)


def index_of(parts: Column, value: str) -> Column:
    """First place (from 0) of a value among the fields; -1 if it is not there."""
    return F.array_position(parts, value) - 1
