"""Registered queries that render lines of text formats, and the whole way from reads to a normalized matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.plans import endseq
from tidemark.plans.interval_queries import BLOCKS, OVER, WIDTH
from tidemark.plans.stats_queries import CDF, PMF
from tidemark.plans.views import AXIS, EXONS, GENES, READS, exons, genes, reads, references, table
from tidemark.sources import sinks

W = f"WITH {READS}, {GENES}, {EXONS}, {BLOCKS}"


def models(spark, sf):
    e = exons(spark, sf).groupBy("name", "chr", "strand").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("blocks"))
    return e.select("name", "chr", "strand", "blocks", F.col("blocks")[0]["start"].alias("start"), F.element_at("blocks", -1)["end"].alias("end"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("cds_start"), F.lit(None).cast("long").alias("cds_end"))


@query("bed_lines", f"""{W} SELECT concat_ws(chr(9), g.chr, blocks[1].s, blocks[-1].e, name, '0', g.strand, blocks[1].s, blocks[-1].e, '0', len(blocks), array_to_string(list_transform(blocks, lambda x: x.e - x.s), ','), array_to_string(list_transform(blocks, lambda x: x.s - blocks[1].s), ',')) AS value FROM b JOIN (SELECT name, chr, strand FROM genes) g USING (name)""")
def bed_lines(spark, sf):
    return sinks.bed(models(spark, sf))


@query("gtf_lines", f"""{W} SELECT concat_ws(chr(9), chr, 'tidemark', 'exon', start + 1, "end", '.', strand, '.', 'gene_id "' || name || '"; transcript_id "' || name || '";') AS value FROM exons""")
def gtf_lines(spark, sf):
    return sinks.gtf(models(spark, sf))


@query("sam_lines", f"""{W}, c AS (SELECT name, array_to_string(list_transform(blocks, lambda x, i: CASE WHEN i > 1 THEN (x.s - blocks[i - 1].e)::VARCHAR || 'N' ELSE '' END || (x.e - x.s)::VARCHAR || 'M'), '') AS cigar, blocks[1].s + 1 AS pos FROM b)
SELECT concat_ws(chr(9), name, CASE WHEN strand = '-' THEN '16' ELSE '0' END, chr, pos, '255', cigar, '*', '0', '0', '*', '*') AS value FROM c JOIN (SELECT name, chr, strand FROM genes) USING (name)""")
def sam_lines(spark, sf):
    return sinks.sam(models(spark, sf))


@query("refseq_lines", f"""{W} SELECT concat_ws(chr(9), name, chr, g.strand, blocks[1].s, blocks[-1].e, blocks[-1].e, blocks[-1].e, len(blocks), array_to_string(list_transform(blocks, lambda x: x.s), ',') || ',', array_to_string(list_transform(blocks, lambda x: x.e), ',') || ',') AS value FROM b JOIN (SELECT name, chr, strand FROM genes) g USING (name)""")
def refseq_lines(spark, sf):
    return sinks.ref_seq(models(spark, sf))


@query("bedgraph_lines", f"""{W}, s AS (SELECT chr, start AS pos, 1 AS w FROM reads UNION ALL SELECT chr, "end", -1 FROM reads), t AS (SELECT chr, pos, sum(w) AS w FROM s GROUP BY ALL), u AS (SELECT chr, pos AS a, lead(pos) OVER (PARTITION BY chr ORDER BY pos) AS z, (sum(w) OVER (PARTITION BY chr ORDER BY pos))::BIGINT AS d FROM t)
SELECT concat_ws(chr(9), chr, a, z, d) AS value FROM u WHERE z IS NOT NULL AND d > 0""")
def bedgraph_lines(spark, sf):
    from tidemark.operators.intervals import coverage

    return sinks.bedgraph(coverage(reads(spark, sf)).where("depth > 0"), "depth")


@query("gmt_lines", "WITH g AS (SELECT DISTINCT p_type AS s, p_name AS g FROM part) SELECT s || chr(9) || s || chr(9) || string_agg(g, chr(9) ORDER BY g) AS value FROM g GROUP BY s")
def gmt_lines(spark, sf):
    return sinks.gmt(table(spark, sf, "part").select(F.col("p_type").alias("set_name"), F.col("p_name").alias("gene")))


@query("fasta_lines", "SELECT '>' || item_id || chr(10) || text AS value FROM benchmark")
def fasta_lines(spark, sf):
    return sinks.fasta(table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("seq")))


_SIG = f"""l AS (SELECT chr, count(*) / {AXIS}.0::DOUBLE AS lam FROM reads GROUP BY chr), c AS (SELECT chr, (start // 3600) * 3600 AS ws, count(*) AS n FROM reads GROUP BY ALL), s AS (SELECT c.*, lam, lam * 3600 AS m FROM c JOIN l USING (chr)),
a AS (SELECT *, ((n - m) / n) * (lam * ({AXIS} - 3600) * {PMF.format(k='(n - 1)', m='m')}) AS a FROM s), w AS (SELECT chr, ws, n, CASE WHEN n <= 2 THEN 1 ELSE least(1, abs(1 - {CDF.format(k='n - 1', m='m')} * exp(-a))) END AS p FROM a)"""


@query("significant_windows", f"WITH {READS}, {_SIG} SELECT chr, ws AS window_start, n, round(p, 8) AS p FROM w WHERE p < 1.5")
def significant_windows(spark, sf):
    return endseq.significant_windows(reads(spark, sf), references(spark), 3_600, 3_600, 1.5).withColumn("p", F.round("p", 8))


@query("gene_count_matrix", f"""{W}, k AS (SELECT g.name, count(*) AS k FROM genes g JOIN exons e ON g.name = e.name AND g.start < e."end" AND e.start < g."end" GROUP BY g.name),
h AS (SELECT DISTINCT g.name, r.name AS read, r.exp, r.nh FROM genes g LEFT JOIN k USING (name) JOIN reads r ON {OVER}
  WHERE coalesce(k, 0) <= 1 OR EXISTS (SELECT 1 FROM exons e WHERE e.name = g.name AND e.start < g."end" AND g.start < e."end" AND greatest(e.start, g.start) < r."end" AND r.start < least(e."end", g."end"))),
m AS (SELECT name::VARCHAR AS row, exp AS col, sum(1.0 / nh) AS value FROM h GROUP BY ALL), t AS (SELECT col, sum(value) AS t FROM m GROUP BY col)
SELECT row, m.col, round(value * (SELECT avg(t) FROM t) / t, 6) AS value FROM m JOIN t ON m.col = t.col""")
def gene_count_matrix(spark, sf):
    e = exons(spark, sf).select("name", "chr", "start", "end", F.concat_ws(".", "name", "i").alias("exon"))
    m = endseq.count_matrix(reads(spark, sf).select("name", "chr", "start", "end", "nh", "exp"), genes(spark, sf), e, WIDTH)
    return m.withColumn("value", F.round("value", 6))
