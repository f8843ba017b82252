"""Registered queries on window scores against surroundings and permutations, relations of regions, chunked sequences and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import intervals as ops
from tidemark.operators import regions as rg
from tidemark.plans.interval_queries import BLOCKS, WIDTH
from tidemark.plans.sequence_queries import DNA, dna
from tidemark.plans.stats_queries import CDF, PMF
from tidemark.plans.views import AXIS, EXONS, GENES, READS, REFERENCES, exons, genes, reads, references, table

DAY = 86_400
W = f"WITH {READS}, {GENES}, {EXONS}, {REFERENCES}"
DAYS = f"days AS (SELECT chr, d * {DAY} AS start, (d + 1) * {DAY} AS \"end\", CASE WHEN d % 7 < 2 THEN 'rest' ELSE 'work' END AS set_name FROM refs, range({AXIS // DAY}) AS t(d))"


def days(spark):
    d = references(spark).withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(AXIS // DAY - 1).cast("long"))))
    return d.select("chr", (F.col("d") * DAY).alias("start"), ((F.col("d") + 1) * DAY).alias("end"), F.when(F.col("d") % 7 < 2, "rest").otherwise("work").alias("set_name"))


def points(spark, sf):
    return reads(spark, sf).select("name", "chr", F.col("start").alias("pos"))


@query("gene_windows", f"""{W}, w AS (SELECT chr, k * 14400 AS start, k * 14400 + 28800 AS "end" FROM refs, unnest(range((length + 14399) // 14400)) AS t(k))
SELECT w.chr, w.start, w."end" AS end_pos, count(g.name) AS n, coalesce(string_agg(g.name::VARCHAR, ',' ORDER BY g.name), '') AS names FROM w LEFT JOIN genes g ON g.chr = w.chr AND w.start <= g.start AND g."end" <= w."end" GROUP BY ALL""")
def gene_windows(spark, sf):
    """Windows with the genes that they contain, which belong to what they are compared by."""
    w = rg.windows_with_genes(ops.fixed_windows(references(spark), 28_800, 14_400), genes(spark, sf), 8_192)
    return w.select("chr", "start", F.col("end").alias("end_pos"), F.size("genes").cast("long").alias("n"), F.concat_ws(",", F.transform("genes", lambda x: x.cast("string"))).alias("names"))


@query("subject_pairs", f"""{W} SELECT g.name AS a, count(*) FILTER (WHERE g.strand = r.strand) AS direct, count(*) FILTER (WHERE g.strand <> r.strand) AS opposite, sum(least(g."end", r."end") - greatest(g.start, r.start))::BIGINT AS shared
FROM genes g JOIN reads r ON g.chr = r.chr AND g.start < r."end" AND r.start < g."end" GROUP BY g.name""")
def subject_pairs(spark, sf):
    p = rg.subject_pairs(genes(spark, sf), reads(spark, sf), WIDTH)
    return p.groupBy("a").agg(F.count_if("direct").alias("direct"), F.count_if(~F.col("direct")).alias("opposite"), F.sum(F.col("end") - F.col("start")).alias("shared"))


HOURS = """h AS (SELECT chr, start // 3600 * 3600 AS ws, count(*) AS n FROM reads GROUP BY ALL)"""


def hours(spark, sf):
    return ops.window_counts(points(spark, sf), 3_600, 3_600, ("chr",), F.lit(1)).select("chr", F.col("window_start").alias("start"), (F.col("window_start") + 3_600).alias("end"), "n")


@query("transcript_counts", f"""{W}, {HOURS}, w AS (SELECT g.name, count(*) AS k, max(h.n) AS best FROM genes g JOIN h ON g.chr = h.chr AND g.start < h.ws + 3600 AND h.ws < g."end" AND h.n >= 4 GROUP BY g.name), e AS (SELECT name, count(*) AS k, sum("end" - start) AS l FROM exons GROUP BY name)
SELECT g.name, g.strand, coalesce(w.k, 0) AS windows, coalesce(best, 0) AS best, coalesce(e.k, 0) AS exons, coalesce(l, 0)::BIGINT AS exon_length FROM genes g LEFT JOIN w USING (name) LEFT JOIN e USING (name)""")
def transcript_counts(spark, sf):
    """A gene's well-filled hours and its exons; exons of one gene lie apart."""
    return rg.transcript_counts(genes(spark, sf), hours(spark, sf).where("n >= 4"), exons(spark, sf), WIDTH)


_LOCAL = "(l / {0}.0::DOUBLE * 3600)"


@query("local_scan", f"""{W}, {HOURS}, x AS (SELECT a.chr, a.ws, a.n, sum(b.n) AS l, any_value(t.rate) AS rate FROM h a JOIN h b ON a.chr = b.chr AND b.ws BETWEEN a.ws - 43200 AND a.ws + 43200 JOIN (SELECT chr, sum(n) / {AXIS}.0::DOUBLE AS rate FROM h GROUP BY chr) t ON t.chr = a.chr GROUP BY a.chr, a.ws, a.n),
y AS (SELECT *, rate * 3600 AS m, l / 90000.0::DOUBLE * 3600 AS lm FROM x), z AS (SELECT *, ((n - m) / n) * (rate * ({AXIS} - 3600) * {PMF.format(k='(n - 1)', m='m')}) AS ea, ((n - lm) / n) * (lm / 3600 * (90000 - 3600) * {PMF.format(k='(n - 1)', m='lm')}) AS el FROM y)
SELECT chr, ws AS window_start, n, round(n / lm, 6) AS enrichment, round(CASE WHEN n <= 2 THEN 1 ELSE least(1, abs(1 - {CDF.format(k='n - 1', m='m')} * exp(-ea))) END, 8) AS p, round(CASE WHEN n <= 2 THEN 1 ELSE least(1, abs(1 - {CDF.format(k='n - 1', m='lm')} * exp(-el))) END, 8) AS local_p FROM z""")
def local_scan(spark, sf):
    s = rg.local_scan(points(spark, sf), 3_600, 12, AXIS)
    return s.select("chr", "window_start", "n", F.round("enrichment", 6).alias("enrichment"), F.round("p", 8).alias("p"), F.round("local_p", 8).alias("local_p"))


@query("previous_scores", f"""{W}, {HOURS} SELECT chr, ws AS start, n, lag(n) OVER (PARTITION BY chr ORDER BY ws) AS previous FROM h""")
def previous_scores(spark, sf):
    return rg.with_previous(hours(spark, sf).select("chr", "start", "n"), ("chr",), "start", "n", DAY)


_FIRST = "CASE WHEN i = 0 THEN exp = 'e0' ELSE (strpos('0123456789abcdef', substr(md5(name || '|' || i || '|5'), 15, 1)) - 1) % 2 = 0 END"
NULLS = f"""u AS (SELECT i AS permutation, chr, start // 7200 * 7200 AS ws, count(*) FILTER (WHERE {_FIRST}) AS a, count(*) FILTER (WHERE NOT ({_FIRST})) AS b FROM reads, range(4) AS t(i) GROUP BY ALL), v AS (SELECT *, (a + 1) / (b + 1) AS ratio FROM u)"""


def nulls(spark, sf):
    r = reads(spark, sf).select("name", "chr", F.col("start").alias("pos"), "exp")
    return rg.ratio_null(r, "exp", "e0", 7_200, 3, 5)


@query("ratio_null_distribution", f"{W}, {NULLS} SELECT permutation::INTEGER AS permutation, round(ratio, 9) AS ratio, count(*) AS n FROM v GROUP BY ALL")
def ratio_null_distribution(spark, sf):
    return nulls(spark, sf).groupBy("permutation", F.round("ratio", 9).alias("ratio")).agg(F.count("*").alias("n"))


@query("ratio_peaks", f"""{W}, {NULLS}, d AS (SELECT ratio, count(*) AS e FROM v WHERE permutation > 0 GROUP BY ratio), k AS (SELECT DISTINCT o.ratio FROM v o WHERE permutation = 0 AND coalesce((SELECT sum(e) FROM d WHERE d.ratio > o.ratio), 0) <= 0.05 * (SELECT sum(e) FROM d)),
s AS (SELECT chr, ws, ratio FROM v WHERE permutation = 0 AND ratio IN (SELECT ratio FROM k)), f AS (SELECT *, CASE WHEN lag(ws) OVER w = ws - 7200 THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY chr ORDER BY ws)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY ws) AS i FROM f)
SELECT chr, min(ws) AS start, max(ws) + 7200 AS end_pos, count(*) AS windows, round(max(ratio), 6) AS best FROM i GROUP BY chr, i""")
def ratio_peaks(spark, sf):
    return rg.ratio_peaks(nulls(spark, sf), 7_200, 0.05).select("chr", "start", F.col("end").alias("end_pos"), "windows", F.round("best", 6).alias("best"))


METRICS = f"""p AS (SELECT g.name, g.chr, "end" - start AS size, i, CASE WHEN i = 0 THEN start ELSE ('0x' || substr(md5(g.name || '|' || i || '|3'), 1, 15))::BIGINT % (length - ("end" - start) + 1) END AS s FROM genes g JOIN refs USING (chr), range(4) AS t(i) WHERE "end" - start <= length),
c AS (SELECT set_name, i, count(DISTINCT p.name) AS n FROM p JOIN days d ON p.chr = d.chr AND p.s < d."end" AND d.start < p.s + p.size GROUP BY ALL),
m AS (SELECT o.set_name AS name, 'overlap' AS statistic_name, 'shuffled' AS method, any_value(o.n) / avg(c.n) AS statistic, (count(*) FILTER (WHERE c.n >= o.n) + 1) / 4 AS p_value, (SELECT count(*) FROM genes) AS total_count, any_value(o.n) AS region_count FROM c o JOIN c ON o.set_name = c.set_name AND o.i = 0 AND c.i > 0 GROUP BY o.set_name)"""


@query("annotation_enrichment", f"""{W}, {DAYS}, {METRICS} SELECT name, name || '.' || statistic_name || '.' || method AS id, statistic_name AS get_method, method AS get_submethod, round(statistic, 6) AS statistic, p_value, total_count, region_count FROM m""")
def annotation_enrichment(spark, sf):
    """Genes over working and resting days against genes moved at random; one record a set of days."""
    m = rg.annotation_enrichment(genes(spark, sf).select("name", "chr", "start", "end"), days(spark), references(spark), 3, 3, 16_384)
    return rg.metric_columns(m).select("name", "id", "get_method", "get_submethod", F.round("statistic", 6).alias("statistic"), "p_value", "total_count", "region_count")


@query("gap_compressed", f"""{W}, {DAYS}, g AS (SELECT chr, start, "end" FROM days WHERE set_name = 'rest') SELECT r.name, CASE WHEN bool_or(g.start <= r.start AND r.start < g."end") THEN NULL ELSE any_value(r.start) - coalesce(sum(g."end" - g.start) FILTER (WHERE g."end" <= r.start), 0)::BIGINT END AS relative FROM reads r LEFT JOIN g ON g.chr = r.chr GROUP BY r.name""")
def gap_compressed(spark, sf):
    """Read starts on an axis without resting days."""
    return rg.without_gaps(points(spark, sf), days(spark).where("set_name = 'rest'")).select("name", "relative")


@query("end_distances", f"""{W} SELECT g.name AS gene, count(*) AS n, min(d)::BIGINT AS nearest, round(avg(d), 6) AS mean FROM (SELECT g.name, CASE WHEN g.strand = '-' THEN r."end" - 1 - g.start ELSE g."end" - 1 - r.start END AS d FROM genes g JOIN reads r ON g.chr = r.chr AND g.strand = r.strand
AND CASE WHEN r.strand = '-' THEN r."end" - 1 ELSE r.start END BETWEEN g.start AND g."end" - 1) g GROUP BY g.name""")
def end_distances(spark, sf):
    d = rg.end_distances(reads(spark, sf), genes(spark, sf), WIDTH)
    return d.groupBy("gene").agg(F.count("*").alias("n"), F.min("distance").alias("nearest"), F.round(F.avg("distance"), 6).alias("mean"))


@query("transcript_orientation", f"""{W} SELECT r.name, CASE WHEN min(g.strand) IS NULL THEN 'none' WHEN min(g.strand) <> max(g.strand) THEN 'both' ELSE min(g.strand) END AS orientation FROM reads r LEFT JOIN genes g ON g.chr = r.chr AND g.start <= r.start AND r.start < g."end" GROUP BY r.name""")
def transcript_orientation(spark, sf):
    return rg.transcript_orientation(points(spark, sf), genes(spark, sf), WIDTH).select("name", "orientation")


@query("scaled_windows", f"""{W} SELECT g.name, ((r.start - g.start) * 10 // (g."end" - g.start))::INTEGER AS part, count(*) AS n FROM genes g JOIN reads r ON g.chr = r.chr AND g.start <= r.start AND r.start < g."end" GROUP BY ALL""")
def scaled_windows(spark, sf):
    return rg.scaled_windows(genes(spark, sf), points(spark, sf), 10, WIDTH)


@query("read_classes", f"""{W}, t AS (SELECT r.name, r.exp, EXISTS (SELECT 1 FROM exons e WHERE e.chr = r.chr AND e.start < r."end" AND r.start < e."end") AS e, EXISTS (SELECT 1 FROM genes g WHERE g.chr = r.chr AND g.start < r."end" AND r.start < g."end") AS g FROM reads r)
SELECT exp, count(*) FILTER (WHERE e) AS exonic, count(*) FILTER (WHERE NOT e AND g) AS intronic, count(*) FILTER (WHERE NOT e AND NOT g) AS intergenic FROM t GROUP BY exp""")
def read_classes(spark, sf):
    return rg.read_classes(reads(spark, sf), exons(spark, sf), genes(spark, sf), WIDTH)


TERMS = "t AS (SELECT DISTINCT p_partkey AS gene, unnest(string_split(p_type, ' ')) AS term FROM part), s AS (SELECT p_partkey AS gene FROM part WHERE p_size <= 10)"


@query("term_enrichment", f"""WITH {TERMS}, u AS (SELECT count(DISTINCT gene) AS u FROM t), k AS (SELECT count(DISTINCT gene) AS k FROM t WHERE gene IN (FROM s)), n AS (SELECT term, count(*) AS annotated, count(*) FILTER (WHERE gene IN (FROM s)) AS hits FROM t GROUP BY term)
SELECT term, hits, k AS study, annotated, u AS universe, round(least(1, list_sum(list_transform(range(greatest(hits, k + annotated - u, 0), least(k, annotated) + 1), lambda i: exp(lgamma(annotated + 1) - lgamma(i + 1) - lgamma(annotated - i + 1) + lgamma(u - annotated + 1) - lgamma(k - i + 1) - lgamma(u - annotated - k + i + 1) - (lgamma(u + 1) - lgamma(k + 1) - lgamma(u - k + 1)))))), 6) AS p FROM n, u, k WHERE hits > 0""")
def term_enrichment(spark, sf):
    p = table(spark, sf, "part")
    found = rg.term_enrichment(p.where("p_size <= 10").select(F.col("p_partkey").alias("gene")), p.select(F.col("p_partkey").alias("gene"), F.explode(F.split("p_type", " ")).alias("term")))
    return found.withColumn("p", F.round("p", 6))


@query("binned_null", f"""{W}, b AS (SELECT name, ("end" - start) // 500 AS bin FROM genes), k AS (SELECT bin, count(*) AS k FROM b WHERE name IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY bin),
r AS (SELECT i AS permutation, name, k, row_number() OVER (PARTITION BY i, bin ORDER BY substr(md5(name || '|' || i || '|9'), 1, 15), name) AS place FROM b JOIN k USING (bin), range(1, 4) AS t(i)) SELECT permutation::INTEGER AS permutation, name FROM r WHERE place <= k""")
def binned_null(spark, sf):
    """Genes of the same lengths as the urgent ones, three times over."""
    g = genes(spark, sf).select("name", (F.col("end") - F.col("start")).alias("length"))
    return rg.binned_null(g, table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("name")), 3, 9, 500)


@query("chunked_regions", f"""WITH {DNA}, n AS (SELECT item_id, length(seq) AS n, seq FROM dna WHERE length(seq) >= 30), r AS (SELECT item_id || ':' || i AS name, seq, n, ('0x' || substr(md5(item_id || '|' || i || '|4'), 1, 15))::BIGINT AS h FROM n, range(3) AS t(i)),
s AS (SELECT name, h % (n - 29) AS start, h % 2 = 1 AS back, substr(seq, (h % (n - 29))::BIGINT + 1, 30) AS w FROM r) SELECT name, start, CASE WHEN back THEN reverse(translate(w, 'ACGT', 'TGCA')) ELSE w END AS seq FROM s""")
def chunked_regions(spark, sf):
    """Seeded random regions of an assembly that is kept in chunks of 64 bases."""
    chunks = rg.chunked(dna(spark, sf).select(F.col("item_id").alias("id"), "seq"), 64)
    wanted = rg.random_regions(rg.assembly_sizes(chunks), 3, 30, 4)
    return rg.chunk_regions(chunks, wanted, 64).select("name", "start", "seq")


@query("assembly_sizes", f"WITH {DNA} SELECT item_id AS id, length(seq) AS size, length(regexp_replace(seq, '[Nn]', '', 'g')) AS ungapped FROM dna")
def assembly_sizes(spark, sf):
    return rg.assembly_sizes(rg.chunked(dna(spark, sf).select(F.col("item_id").alias("id"), "seq"), 64))


@query("shared_kmers", f"""WITH {DNA}, k AS (SELECT DISTINCT item_id, substr(seq, i, 10) AS kmer FROM dna, unnest(range(1, greatest(length(seq) - 8, 1))) AS t(i)), n AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer) SELECT item_id, count(*) AS kmers, count(*) FILTER (WHERE n > 1) AS shared FROM k JOIN n USING (kmer) GROUP BY item_id""")
def shared_kmers(spark, sf):
    return rg.shared_kmers(dna(spark, sf), "item_id", "seq", 10)


@query("splice_support", f"""{W}, {BLOCKS}, i AS (SELECT g.chr, g.strand, b.blocks[k].e AS start, b.blocks[k + 1].s AS stop FROM b JOIN genes g USING (name), unnest(range(1, len(b.blocks))) AS t(k)) SELECT chr, strand, start, stop AS end_pos, count(*) AS n FROM i WHERE stop - start BETWEEN 150 AND 450 GROUP BY ALL""")
def splice_support(spark, sf):
    """Introns between neighbouring exons of 150 to 450 bases."""
    from tidemark.functions import intervals as iv
    from tidemark.plans.format_queries import models

    i = models(spark, sf).select("chr", "strand", F.explode(iv.introns(F.col("blocks"))).alias("i")).select("chr", "strand", F.col("i.start").alias("start"), F.col("i.end").alias("end"))
    return rg.splice_support(i, 150, 450, 1).select("chr", "strand", "start", F.col("end").alias("end_pos"), "n")


@query("full_length_matches", f"""WITH {DNA}, p AS (SELECT item_id, seq, substr(seq, 11, 8) AS a FROM dna WHERE length(seq) > 20) SELECT item_id, strpos(seq, a) - 1 AS at FROM p""")
def full_length_matches(spark, sf):
    d = dna(spark, sf).where(F.length("seq") > 20).withColumn("a", F.substring("seq", 11, 8))
    return rg.full_length_matches(d, "a", "seq").select("item_id", F.col("at").cast("long").alias("at"))
