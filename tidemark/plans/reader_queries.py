"""Registered round trips: the driver's tables put out as text files of each format and read again by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.plans.format_queries import models
from tidemark.plans.interval_queries import BLOCKS
from tidemark.plans.sequence_queries import DNA, dna
from tidemark.plans.views import EXONS, GENES, MATRIX, READS, genes, matrix, reads, references, table
from tidemark.sources import extra_formats as xf
from tidemark.sources import sinks, text
from tidemark.sources.scratch import written_text

W = f"WITH {READS}, {GENES}, {EXONS}, {BLOCKS}"


def put(df, *columns, label="read", sep="\t"):
    """Rows as separated lines in a folder of text files."""
    return written_text(df.select(F.concat_ws(sep, *[c if not isinstance(c, str) else F.col(c).cast("string") for c in columns]).alias("value")), label)


@query("read_tabbed", "SELECT s_suppkey AS id, s_name AS name, s_nationkey::INTEGER AS nation FROM supplier WHERE s_nationkey < 10")
def read_tabbed(spark, sf):
    p = put(table(spark, sf, "supplier"), "s_suppkey", "s_name", "s_nationkey")
    return text.tabbed(spark, p, {"id": "bigint", "name": "string", "nation": "int"}, F.col("nation") < 10)


@query("read_annotation_table", f"""WITH {GENES} SELECT name, chr, start FROM genes""")
def read_annotation_table(spark, sf):
    """Blank and comment lines between the rows are dropped."""
    g = genes(spark, sf).select(F.concat(F.lit("# gene\n\n"), F.concat_ws("\t", F.col("name").cast("string"), "chr", F.col("start").cast("string"))).alias("value"))
    return text.annotation_table(spark, written_text(g, "table"), {"name": "bigint", "chr": "string", "start": "bigint"})


@query("read_bed", f"""{W} SELECT b.name::VARCHAR AS name, g.chr, g.strand, blocks[1].s AS start, blocks[-1].e AS end_pos, len(blocks) AS n_blocks, list_sum(list_transform(blocks, lambda x: x.e - x.s))::BIGINT AS length FROM b JOIN (SELECT name, chr, strand FROM genes) g USING (name)""")
def read_bed(spark, sf):
    b = text.bed(spark, written_text(sinks.bed(models(spark, sf)), "bed"))
    total = F.aggregate("blocks", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return b.select("name", "chr", "strand", "start", F.col("end").alias("end_pos"), F.size("blocks").cast("long").alias("n_blocks"), total.alias("length"))


@query("read_short_bed", f"""WITH {READS} SELECT chr, start, "end" AS end_pos, name::VARCHAR AS name FROM reads""")
def read_short_bed(spark, sf):
    return text.short_bed(spark, put(reads(spark, sf), "chr", "start", "end", "name")).withColumnRenamed("end", "end_pos")


@query("read_bedgraph", f"""WITH {READS} SELECT chr, start, "end" AS end_pos, value AS score FROM reads WHERE value IS NOT NULL""")
def read_bedgraph(spark, sf):
    return text.bedgraph(spark, put(reads(spark, sf).where("value is not null"), "chr", "start", "end", "value")).withColumnRenamed("end", "end_pos")


@query("read_chromosome_sizes", "SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS chr, 2592000::BIGINT AS length")
def read_chromosome_sizes(spark, sf):
    return text.chromosome_sizes(spark, put(references(spark).coalesce(1), "chr", "length"))


@query("read_psl", f"""{W} SELECT b.name::VARCHAR AS name, g.chr, g.strand, blocks[1].s AS start, blocks[-1].e AS end_pos, len(blocks) AS n_blocks, 0.9::DOUBLE AS identity FROM b JOIN (SELECT name, chr, strand FROM genes) g USING (name)""")
def read_psl(spark, sf):
    p = text.psl(spark, written_text(xf.psl_lines(models(spark, sf), 0.9), "psl"))
    return p.select("name", "chr", "strand", "start", F.col("end").alias("end_pos"), F.size("blocks").cast("long").alias("n_blocks"), F.round("identity", 6).alias("identity"))


@query("psl_to_sam", f"""{W}, c AS (SELECT name, array_to_string(list_transform(blocks, lambda x, i: CASE WHEN i > 1 THEN (x.s - blocks[i - 1].e)::VARCHAR || 'N' ELSE '' END || (x.e - x.s)::VARCHAR || 'M'), '') AS cigar, blocks[1].s + 1 AS pos FROM b)
SELECT concat_ws(chr(9), name, CASE WHEN strand = '-' THEN '16' ELSE '0' END, chr, pos, '255', cigar, '*', '0', '0', '*', '*') AS value FROM c JOIN (SELECT name, chr, strand FROM genes) USING (name)""")
def psl_to_sam(spark, sf):
    return sinks.sam(text.psl(spark, written_text(xf.psl_lines(models(spark, sf), 0.9), "psl")))


@query("read_mapping_table", "SELECT p_brand AS brand, p_partkey::VARCHAR AS part FROM part")
def read_mapping_table(spark, sf):
    """The columns that are asked for, in that order, from files that each have the header."""
    p = put(table(spark, sf, "part"), "p_partkey", "p_name", "p_brand")
    head = put(table(spark, sf, "region").limit(1), F.lit("part"), F.lit("name"), F.lit("brand"))
    rows = spark.read.text(p).mapInPandas(lambda parts: parts, "value string")
    files = written_text(spark.read.text(head).unionByName(rows).coalesce(1), "mapping")
    return text.mapping_table(spark, files, ["brand", "part"])


def fastq_lines(spark, sf):
    d = dna(spark, sf)
    return d.select(F.concat_ws("\n", F.concat(F.lit("@r"), F.col("item_id").cast("string")), "seq", F.lit("+"), F.regexp_replace("seq", ".", "I")).alias("value"))


@query("read_fastq", f"WITH {DNA} SELECT 'r' || item_id AS id, seq, length(seq) AS n FROM dna")
def read_fastq(spark, sf):
    return text.fastq(spark, written_text(fastq_lines(spark, sf), "fastq")).select("id", "seq", F.length("qual").cast("long").alias("n"))


@query("fastq_count", f"WITH {DNA} SELECT count(*) AS n FROM dna")
def fastq_count(spark, sf):
    return text.fastq_count(spark, written_text(fastq_lines(spark, sf), "fastq"))


@query("read_fasta", f"WITH {DNA} SELECT item_id::VARCHAR AS id, 'of a text' AS description, seq FROM dna")
def read_fasta(spark, sf):
    records = dna(spark, sf).select(F.concat(F.lit(">"), F.col("item_id").cast("string"), F.lit(" of a text\n# a comment\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value"))
    return text.fasta(spark, written_text(records, "fasta"))


@query("read_fasta_quality", "SELECT item_id::VARCHAR AS id, length(text)::INTEGER AS first, 2::BIGINT AS n FROM benchmark WHERE text IS NOT NULL")
def read_fasta_quality(spark, sf):
    b = table(spark, sf, "benchmark").where("text is not null")
    q = text.fasta_quality(spark, written_text(b.select(F.concat(F.lit(">"), F.col("item_id").cast("string"), F.lit("\n"), F.length("text").cast("string"), F.lit("\n7")).alias("value")), "qual"))
    return q.select("id", F.col("quality")[0].alias("first"), F.size("quality").cast("long").alias("n"))


@query("read_gmt", "SELECT DISTINCT p_type AS set_name, upper(p_name) AS gene FROM part")
def read_gmt(spark, sf):
    return text.gmt(spark, written_text(sinks.gmt(table(spark, sf, "part").select(F.col("p_type").alias("set_name"), F.col("p_name").alias("gene"))), "gmt"))


@query("read_gmx", "SELECT DISTINCT n_name AS gene, 's' || n_regionkey AS set_name FROM nation")
def read_gmx(spark, sf):
    """Sets as columns: one row a rank within the region."""
    n = table(spark, sf, "nation")
    cells = [F.coalesce(F.when(F.col("n_regionkey") == i, F.col("n_name")), F.lit("")) for i in range(5)]
    head = spark.createDataFrame([("\t".join(f"s{i}" for i in range(5)) + "\n" + "\t".join(["na"] * 5),)], "value string")
    return text.gmx(spark, written_text(head.unionByName(n.select(F.concat_ws("\t", *cells).alias("value"))).coalesce(1), "gmx")).select("gene", "set_name")


@query("read_chip", "SELECT p_partkey::VARCHAR AS probe, upper(p_brand) AS gene FROM part")
def read_chip(spark, sf):
    return text.chip(spark, put(table(spark, sf, "part"), "p_partkey", "p_brand"))


@query("read_experiments", "SELECT s_suppkey::VARCHAR AS barcode, s_name AS experiment, s_nationkey % 2 = 0 AS qc_flag_no, s_nationkey::INTEGER AS time_point, s_nationkey = 3 AS is_control FROM supplier")
def read_experiments(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_nationkey")
    p = put(s, "s_suppkey", "s_name", F.lit("p"), F.lit("a1"), F.lit("day"), F.when(k % 2 == 0, "no").otherwise("yes"), F.when(k == 3, "a control").otherwise("sample"), "s_nationkey", F.lit("-"), F.lit("b"))
    return text.experiments(spark, p).select("barcode", "experiment", "qc_flag_no", "time_point", "is_control")


@query("read_barcode_map", "SELECT c_custkey::VARCHAR AS barcode, c_mktsegment AS sample FROM customer")
def read_barcode_map(spark, sf):
    return text.barcode_map(spark, put(table(spark, sf, "customer"), "c_custkey", "c_mktsegment", sep="  "))


@query("read_sam", f"""{W} SELECT b.name::VARCHAR AS read_name, g.chr, g.strand, blocks[1].s AS start, blocks[-1].e AS end_pos, len(blocks) AS n_blocks FROM b JOIN (SELECT name, chr, strand FROM genes) g USING (name)""")
def read_sam(spark, sf):
    r = text.sam(spark, written_text(sinks.sam(models(spark, sf)), "sam"))
    return r.select("read_name", "chr", "strand", "start", F.col("end").alias("end_pos"), F.size("blocks").cast("long").alias("n_blocks"))


@query("sam_region", f"""{W} SELECT b.name::VARCHAR AS read_name, blocks[1].s AS start FROM b JOIN (SELECT name, chr FROM genes) g USING (name) WHERE chr = 'view' AND blocks[1].s < 1000000 AND blocks[-1].e > 500000""")
def sam_region(spark, sf):
    """Reads of one region, from files laid out by reference and bin so that others aren't opened."""
    r = text.sam(spark, written_text(sinks.sam(models(spark, sf)), "sam"))
    return xf.region_reads(xf.indexed_reads(r, 1 << 18), "view", 500_000, 1_000_000, 1 << 18).select("read_name", "start")


@query("read_gtf", f"""WITH {GENES}, {EXONS} SELECT chr, feature, start, "end" AS end_pos, strand, name::VARCHAR AS gene FROM (SELECT *, 'exon' AS feature FROM exons)""")
def read_gtf(spark, sf):
    g = text.gff(spark, written_text(sinks.gtf(models(spark, sf)), "gtf"))
    return g.select("chr", "feature", "start", F.col("end").alias("end_pos"), "strand", F.col("attributes")["gene_id"].alias("gene"))


@query("read_repeat_masker", f"""WITH {GENES} SELECT chr, start, "end" AS end_pos, strand, name::VARCHAR AS name, score FROM genes""")
def read_repeat_masker(spark, sf):
    g = genes(spark, sf)
    p = put(g, "score", F.lit("0.1"), F.lit("0"), F.lit("0"), "chr", (F.col("start") + 1).cast("string"), "end", F.lit("(0)"), F.when(F.col("strand") == "-", "C").otherwise("+"), "name", F.lit("SINE"), sep="  ")
    return text.repeat_masker(spark, p).select("chr", "start", F.col("end").alias("end_pos"), "strand", "name", "score")


@query("read_gct", f"WITH {MATRIX} SELECT row, row AS description, col, value::DOUBLE AS value FROM matrix")
def read_gct(spark, sf):
    return text.gct(spark, written_text(sinks.gct(matrix(spark, sf)).coalesce(1), "gct"))


@query("read_igv_matrix", f"WITH {MATRIX} SELECT row, col, value::DOUBLE AS value FROM matrix")
def read_igv_matrix(spark, sf):
    """A matrix whose rows start with a place on a reference."""
    lines = sinks.gct(matrix(spark, sf)).coalesce(1).where("not value like '#%' and value like '%/%' or value like 'Name%'")
    placed = lines.select(F.when(F.col("value").startswith("Name"), F.regexp_replace("value", "^Name\tDescription", "Chromosome\tStart\tEnd\tFeature")).otherwise(F.concat(F.lit("chr1\t0\t10\t"), F.regexp_replace("value", "^([^\t]*)\t[^\t]*", "$1"))).alias("value"))
    return xf.igv_matrix(spark, written_text(placed, "igv")).select("row", "col", "value")


@query("read_nanostring", "SELECT p_name AS gene, 'Endogenous' AS code_class, 's' || p_size % 3 AS sample, p_partkey::DOUBLE AS count FROM part")
def read_nanostring(spark, sf):
    """One file a sample, each with the sections of the format."""
    p = table(spark, sf, "part")
    head = "<Header>\nFileVersion,1.7\n</Header>\n<Sample_Attributes>\nID,{0}\n</Sample_Attributes>\n<Code_Summary>\nCodeClass,Name,Accession,Count\n"
    found = None
    for i in range(3):
        own = p.where(F.col("p_size") % 3 == i).select(F.concat_ws(",", F.lit("Endogenous"), "p_name", F.lit("x"), F.col("p_partkey").cast("string")).alias("value"))
        first = spark.createDataFrame([(head.format(f"s{i}"),)], "value string")
        one = xf.nanostring(spark, written_text(first.unionByName(own).unionByName(spark.createDataFrame([("</Code_Summary>",)], "value string")).coalesce(1), "rcc"))
        found = one if found is None else found.unionByName(one)
    return found.select("gene", "code_class", "sample", "count")


@query("read_cls", "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INTEGER AS i, 'r' || n_regionkey AS label FROM nation")
def read_cls(spark, sf):
    labels = [r[0] for r in table(spark, sf, "nation").orderBy("n_nationkey").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).collect()]  # samples are few
    return text.cls(spark, written_text(spark.createDataFrame([(sinks.cls(labels).rstrip("\n"),)], "value string"), "cls"))


@query("read_maf", f"WITH {DNA} SELECT 'sp' || k AS species, 'c' || item_id AS chr, item_id AS start, length(seq) AS size, seq FROM dna, range(2) AS t(k) WHERE length(seq) > 0")
def read_maf(spark, sf):
    d = dna(spark, sf).where(F.length("seq") > 0)
    row = lambda k: F.concat_ws(" ", F.lit("s"), F.concat(F.lit(f"sp{k}.c"), F.col("item_id").cast("string")), F.col("item_id").cast("string"), F.length("seq").cast("string"), F.lit("+"), F.lit("1000"), "seq")
    m = text.maf(spark, written_text(d.select(F.concat_ws("\n", F.lit("a score=1"), row(0), row(1), F.lit("")).alias("value")), "maf"))
    return m.select("species", "chr", "start", "size", "seq")


@query("read_multi_fasta", f"WITH {DNA} SELECT item_id::VARCHAR AS species, rpad(left(seq, 30), 30, '-') AS seq FROM dna")
def read_multi_fasta(spark, sf):
    records = dna(spark, sf).select(F.concat(F.lit(">"), F.col("item_id").cast("string"), F.lit("\n"), F.rpad(F.left("seq", F.lit(30)), 30, "-")).alias("value"))
    return xf.multi_fasta(spark, written_text(records, "afa"))


@query("read_phylip", "SELECT n_name AS species, 'ACGTACGTAC' AS seq FROM nation")
def read_phylip(spark, sf):
    n = table(spark, sf, "nation")
    rows = n.select(F.concat("n_name", F.lit("  ACGTA CGTAC")).alias("value"))
    head = spark.createDataFrame([("25 10",)], "value string")
    return text.phylip(spark, written_text(head.unionByName(rows).coalesce(1), "phylip"))


@query("read_motif_enrichment", "SELECT p_partkey::VARCHAR AS motif, 0.5::DOUBLE AS p, 0.75::DOUBLE AS corrected_p FROM part")
def read_motif_enrichment(spark, sf):
    line = F.concat(F.lit("1. a b c d "), F.col("p_partkey").cast("string"), F.lit(" p-value: 0.5 (corrected p-value: 0.75)"))
    return text.motif_enrichment(spark, written_text(table(spark, sf, "part").select(line.alias("value")), "ame"))


@query("read_conserved_elements", f"""WITH {GENES} SELECT chr, start, "end" AS end_pos, (name % 1000)::DOUBLE AS log_odds, score FROM genes""")
def read_conserved_elements(spark, sf):
    g = genes(spark, sf)
    p = put(g, "chr", "start", "end", F.concat(F.lit("lod="), (F.col("name") % 1000).cast("string")), "score")
    return xf.conserved_elements(spark, p).select("chr", "start", F.col("end").alias("end_pos"), "log_odds", "score")


@query("read_rate_windows", f"""WITH {GENES} SELECT chr, start, "end" AS end_pos, 0.5::DOUBLE AS omega, score AS log_odds, 0.01::DOUBLE AS p FROM genes""")
def read_rate_windows(spark, sf):
    return xf.rate_windows(spark, put(genes(spark, sf), "chr", "start", "end", F.lit("0.5"), "score", F.lit("0.01"))).withColumnRenamed("end", "end_pos")


@query("read_array_features", "SELECT p_name AS probe, p_brand AS gene, p_retailprice AS signal, p_size > 40 AS saturated, p_size % 5 <> 0 AS above_background FROM part")
def read_array_features(spark, sf):
    p = table(spark, sf, "part")
    return xf.array_features(spark, xf.array_file(p, "p_name", "p_brand", "p_retailprice", F.col("p_size") > 40, F.col("p_size") % 5 != 0)).select("probe", "gene", "signal", "saturated", "above_background")


@query("array_stats", "SELECT count(*) AS features, count(*) FILTER (WHERE p_size > 40) AS saturated, round(quantile_cont(p_retailprice, 0.99), 6) AS signal_99, round(avg(p_retailprice), 6) AS mean_signal FROM part")
def array_stats(spark, sf):
    p = table(spark, sf, "part")
    a = xf.array_features(spark, xf.array_file(p, "p_name", "p_brand", "p_retailprice", F.col("p_size") > 40, F.col("p_size") % 5 != 0))
    return xf.array_stats(a).withColumns({"signal_99": F.round("signal_99", 6), "mean_signal": F.round("mean_signal", 6)})


@query("array_matrix", "SELECT p_brand AS row, 'a1' AS col, round(avg(p_retailprice), 6) AS value FROM part WHERE p_size <= 40 GROUP BY p_brand")
def array_matrix(spark, sf):
    """Mean signal of a gene's unflagged features."""
    p = table(spark, sf, "part")
    a = xf.array_features(spark, xf.array_file(p, "p_name", "p_brand", "p_retailprice", F.col("p_size") > 40, F.col("p_size") % 5 != 0))
    return xf.array_matrix(a, "a1").withColumn("value", F.round("value", 6))


@query("paired_lines", f"""WITH {READS} SELECT concat_ws(chr(9), a.name, a.chr, a.start + 1, a."end", b.start + 1, b."end", 1) AS value FROM reads a JOIN reads b ON b.name = a.name + 1 AND a.name % 2 = 0 AND a.chr = b.chr""")
def paired_lines(spark, sf):
    """Neighbouring reads of one reference as the mates of a pair, one line a pair."""
    r = reads(spark, sf)
    k = F.col("name")
    mates = r.select(F.call_function("div", k, F.lit(2)).alias("pair"), (k % 2 == 0).alias("is_first"), "name", "chr", "start", "end", F.lit(1).alias("nh"))
    return xf.paired_lines(mates)


@query("mapped_fragments", f"""WITH {READS}, p AS (SELECT a.chr, least(a.start, b.start) AS s, greatest(a."end", b."end") AS e FROM reads a JOIN reads b ON b.name = a.name + 1 AND a.name % 2 = 0 AND a.chr = b.chr) SELECT chr, s AS start, e AS end_pos, count(*) AS n FROM p WHERE e - s <= 86400 GROUP BY ALL""")
def mapped_fragments(spark, sf):
    """Pairs of at most a day's insert, read back from their lines."""
    r = reads(spark, sf)
    k = F.col("name")
    mates = r.select(F.call_function("div", k, F.lit(2)).alias("pair"), (k % 2 == 0).alias("is_first"), "name", "chr", "start", "end", F.lit(1).alias("nh"))
    f = xf.paired_reads(spark, written_text(xf.paired_lines(mates), "pairs"), 86_400)
    return f.groupBy("chr", "start", F.col("end").alias("end_pos")).agg(F.count("*").alias("n"))
