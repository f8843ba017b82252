"""Registered queries on intervals and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import intervals as iv
from tidemark.operators import counting as ct
from tidemark.operators import intervals as ops
from tidemark.plans.views import EXONS, GENES, READS, REFERENCES, exons, genes, reads, references

W = f"WITH {READS}, {GENES}, {EXONS}, {REFERENCES}"
#: About the length of a gene.
WIDTH = 2_048


@query("count_scan_windows", f"""{W}, p AS (SELECT chr, exp, start AS pos, 1.0 / nh AS w FROM reads)
SELECT chr, exp, k * 3600 AS window_start, count(*) AS n, round(sum(w), 6) AS total
FROM p, unnest(range(greatest(pos // 3600 - 1, 0), pos // 3600 + 1)) AS t(k) GROUP BY ALL""")
def count_scan_windows(spark, sf):
    points = reads(spark, sf).select("chr", "exp", F.col("start").alias("pos"), "nh")
    return ops.window_counts(points, 7_200, 3_600, ("chr", "exp"), 1 / F.col("nh")).select("chr", "exp", "window_start", "n", F.round("total", 6).alias("total"))


@query("read_start_counts", f"""{W} SELECT chr, strand, CASE WHEN strand = '-' THEN "end" - 1 ELSE start END AS pos, round(sum(1.0 / nh), 6) AS weight FROM reads GROUP BY ALL""")
def read_start_counts(spark, sf):
    return ct.start_counts(reads(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("read_left_counts", f"""{W} SELECT chr, strand, start AS pos, round(sum(1.0 / nh), 6) AS weight FROM reads GROUP BY ALL""")
def read_left_counts(spark, sf):
    return ct.start_counts(reads(spark, sf), ends_on_reverse=False).withColumn("weight", F.round("weight", 6))


@query("read_unstranded_counts", f"""{W} SELECT chr, '+' AS strand, start AS pos, round(sum(1.0 / nh), 6) AS weight FROM reads GROUP BY ALL""")
def read_unstranded_counts(spark, sf):
    return ct.start_counts(reads(spark, sf), stranded=False).withColumn("weight", F.round("weight", 6))


OVER = 'g.chr = r.chr AND g.start < r."end" AND r.start < g."end"'


@query("overlap_join", f"""{W} SELECT g.name AS gene, r.name AS read, least(g."end", r."end") - greatest(g.start, r.start) AS shared FROM genes g JOIN reads r ON {OVER}""")
def overlap_join(spark, sf):
    g, r = genes(spark, sf).select(F.col("name").alias("gene"), "chr", "start", "end"), reads(spark, sf).select(F.col("name").alias("read"), "chr", "start", "end")
    return ops.overlap_join(g, r, WIDTH).select("gene", "read", iv.overlap_length(F.col("start"), F.col("end"), F.col("start_r"), F.col("end_r")).alias("shared"))


@query("containment_join", f"""{W} SELECT g.name AS gene, r.name AS read FROM genes g JOIN reads r ON g.chr = r.chr AND g.start <= r.start AND r."end" <= g."end" """)
def containment_join(spark, sf):
    g, r = genes(spark, sf).select(F.col("name").alias("gene"), "chr", "start", "end"), reads(spark, sf).select(F.col("name").alias("read"), "chr", "start", "end")
    return ops.overlap_join(g, r, WIDTH, contained=True).select("gene", "read")


@query("overlap_semi", f"""{W} SELECT r.name FROM reads r WHERE EXISTS (SELECT 1 FROM genes g WHERE {OVER})""")
def overlap_semi(spark, sf):
    return ops.overlap_join(reads(spark, sf).select("name", "chr", "start", "end"), genes(spark, sf).select("chr", "start", "end"), WIDTH, how="left_semi").select("name")


@query("overlap_anti", f"""{W} SELECT r.name FROM reads r WHERE NOT EXISTS (SELECT 1 FROM genes g WHERE {OVER})""")
def overlap_anti(spark, sf):
    return ops.overlap_join(reads(spark, sf).select("name", "chr", "start", "end"), genes(spark, sf).select("chr", "start", "end"), WIDTH, how="left_anti").select("name")


@query("contained_semi", f"""{W} SELECT g.name FROM genes g WHERE EXISTS (SELECT 1 FROM reads r WHERE g.chr = r.chr AND g.start <= r.start AND r."end" <= g."end")""")
def contained_semi(spark, sf):
    return ops.overlap_join(genes(spark, sf).select("name", "chr", "start", "end"), reads(spark, sf).select("chr", "start", "end"), WIDTH, how="left_semi", contained=True).select("name")


@query("same_orientation_counts", f"""{W} SELECT g.name, count(*) AS n FROM genes g JOIN reads r ON {OVER} AND g.strand = r.strand GROUP BY ALL""")
def same_orientation_counts(spark, sf):
    g, r = genes(spark, sf).select("name", "chr", "strand", "start", "end"), reads(spark, sf).select("chr", "strand", "start", "end")
    return ops.overlap_join(g, r, WIDTH, keys=("chr", "strand")).groupBy("name").agg(F.count("*").alias("n"))


@query("region_counts", f"""{W} SELECT g.name, count(*) AS n, round(sum(1.0 / r.nh), 6) AS weight, sum(least(g."end", r."end") - greatest(g.start, r.start))::BIGINT AS covered,
  round(sum(least(g."end", r."end") - greatest(g.start, r.start)) / any_value(g."end" - g.start), 6) AS average_coverage FROM genes g JOIN reads r ON {OVER} GROUP BY g.name""")
def region_counts(spark, sf):
    g = genes(spark, sf)
    out = ct.count_regions(reads(spark, sf), g, WIDTH).join(g.select("name", (F.col("end") - F.col("start")).alias("length")), "name")
    return out.select("name", "n", F.round("weight", 6).alias("weight"), "covered", F.round(F.col("covered") / F.col("length"), 6).alias("average_coverage"))


@query("merged_genes", f"""{W}, o AS (SELECT chr, start, "end", max("end") OVER (PARTITION BY chr ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM genes),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT chr, min(start) AS start, max("end") AS end_pos, count(*) AS n FROM i GROUP BY chr, island""")
def merged_genes(spark, sf):
    return ops.merge(genes(spark, sf)).withColumnRenamed("end", "end_pos")


@query("overlap_clusters", f"""{W}, o AS (SELECT *, max("end") OVER (PARTITION BY chr, strand ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM genes),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY chr, strand ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT name, chr, strand, (island - 1)::BIGINT AS island FROM i""")
def overlap_clusters(spark, sf):
    return ops.islands(genes(spark, sf).select("name", "chr", "strand", "start", "end"), ("chr", "strand")).select("name", "chr", "strand", "island")


COVERAGE = """s AS (SELECT chr, start AS pos, 1 AS w FROM {0} UNION ALL SELECT chr, "end", -1 FROM {0}), t AS (SELECT chr, pos, sum(w) AS w FROM s GROUP BY ALL),
u AS (SELECT chr, pos AS start, lead(pos) OVER (PARTITION BY chr ORDER BY pos) AS "end", (sum(w) OVER (PARTITION BY chr ORDER BY pos))::BIGINT AS depth FROM t)"""


@query("coverage_depth", f"""{W}, {COVERAGE.format('reads')} SELECT chr, start, "end" AS end_pos, depth FROM u WHERE "end" IS NOT NULL""")
def coverage_depth(spark, sf):
    return ops.coverage(reads(spark, sf)).withColumnRenamed("end", "end_pos")


@query("coverage_peak", f"""{W}, {COVERAGE.format('reads')} SELECT chr, max(depth) AS depth, min(start) AS start FROM u WHERE "end" IS NOT NULL AND depth = (SELECT max(depth) FROM u v WHERE v.chr = u.chr AND v."end" IS NOT NULL) GROUP BY chr""")
def coverage_peak(spark, sf):
    best = ops.coverage(reads(spark, sf)).groupBy("chr").agg(F.max(F.struct("depth", (-F.col("start")).alias("s"))).alias("m"))
    return best.select("chr", F.col("m.depth").alias("depth"), (-F.col("m.s")).alias("start"))


@query("bases_covered", f"""{W}, {COVERAGE.format('reads')} SELECT chr, sum(CASE WHEN depth > 0 THEN "end" - start ELSE 0 END)::BIGINT AS covered FROM u WHERE "end" IS NOT NULL GROUP BY chr""")
def bases_covered(spark, sf):
    return ops.merge(reads(spark, sf)).groupBy("chr").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


@query("uncovered_gaps", f"""{W}, c AS (SELECT chr, start, "end" FROM genes UNION ALL SELECT chr, 0, 0 FROM refs UNION ALL SELECT chr, length, length FROM refs),
m AS (SELECT chr, start, max("end") OVER (PARTITION BY chr ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT chr, before AS start, start AS end_pos FROM m WHERE before < start""")
def uncovered_gaps(spark, sf):
    return ops.complement(genes(spark, sf), references(spark)).withColumnRenamed("end", "end_pos")


@query("interval_minus", f"""{W}, s AS (SELECT chr, start AS pos, 1 AS a, 0 AS b FROM genes UNION ALL SELECT chr, "end", -1, 0 FROM genes UNION ALL SELECT chr, start, 0, 1 FROM reads UNION ALL SELECT chr, "end", 0, -1 FROM reads),
t AS (SELECT chr, pos, sum(a) AS a, sum(b) AS b FROM s GROUP BY ALL),
u AS (SELECT chr, pos AS start, lead(pos) OVER w AS "end", sum(a) OVER w AS a, sum(b) OVER w AS b FROM t WINDOW w AS (PARTITION BY chr ORDER BY pos)),
k AS (SELECT *, CASE WHEN lag("end") OVER (PARTITION BY chr ORDER BY start) = start THEN 0 ELSE 1 END AS fresh FROM u WHERE a > 0 AND b = 0 AND "end" IS NOT NULL),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY start) AS i FROM k)
SELECT chr, min(start) AS start, max("end") AS end_pos FROM g GROUP BY chr, i""")
def interval_minus(spark, sf):
    return ops.minus(genes(spark, sf), reads(spark, sf), WIDTH).withColumnRenamed("end", "end_pos")


@query("nearest_gene", f"""{W}, d AS (SELECT r.name, r.chr, g.name AS near, greatest(0, g.start - r."end", r.start - g."end") AS distance FROM reads r JOIN genes g ON r.chr = g.chr),
m AS (SELECT name, min(distance) AS distance FROM d GROUP BY name)
SELECT d.chr, d.name, min(d.near) AS near, any_value(d.distance)::BIGINT AS distance FROM d JOIN m ON d.name = m.name AND d.distance = m.distance GROUP BY d.chr, d.name""")
def nearest_gene(spark, sf):
    return ops.nearest(reads(spark, sf), genes(spark, sf))


@query("largest_parent", f"""{W}, p AS (SELECT c.name, g.name AS parent, row_number() OVER (PARTITION BY c.name ORDER BY g."end" - g.start DESC, g.name) AS k
FROM genes g JOIN genes c ON g.chr = c.chr AND g.name <> c.name AND g.start <= c.start AND c."end" <= g."end") SELECT name, parent FROM p WHERE k = 1""")
def largest_parent(spark, sf):
    return ops.largest_parents(genes(spark, sf).select("name", "chr", "start", "end"), WIDTH)


@query("tiling_windows", f"""{W} SELECT chr, s AS start, s + 7000 AS end_pos FROM refs, unnest(range(0, length, 5000)) AS t(s)""")
def tiling_windows(spark, sf):
    return ops.fixed_windows(references(spark), 7_000, 5_000).withColumnRenamed("end", "end_pos")


@query("sequence_windows", f"""{W} SELECT name, s AS start, s + 400 AS end_pos FROM genes, unnest(range(start, "end" - 400, 300)) AS t(s)""")
def sequence_windows(spark, sf):
    return ops.sliding_windows(genes(spark, sf).select("name", "start", "end"), 400, 100).select("name", "start", "end").withColumnRenamed("end", "end_pos")


@query("scan_overlapping_reads", f"""{W} SELECT w.chr, w.s AS start, count(*) AS n, round(sum(1.0 / nh), 6) AS weight FROM (SELECT chr, s FROM refs, unnest(range(0, length, 1800)) AS t(s)) w JOIN reads r ON w.chr = r.chr AND w.s < r."end" AND r.start < w.s + 3600 GROUP BY ALL""")
def scan_overlapping_reads(spark, sf):
    found = ops.overlap_join(ops.fixed_windows(references(spark), 3_600, 1_800), reads(spark, sf).select("chr", "start", "end", "nh"), 3_600)
    return found.groupBy("chr", "start").agg(F.count("*").alias("n"), F.round(F.sum(1 / F.col("nh")), 6).alias("weight"))


@query("start_in_window_counts", f"""{W}, p AS (SELECT chr, CASE WHEN strand = '-' THEN "end" - 1 ELSE start END AS s, CASE WHEN strand = '-' THEN start ELSE "end" - 1 END AS e FROM reads)
SELECT g.name, count(*) FILTER (WHERE g.start < s AND s < g."end") AS starts, count(*) FILTER (WHERE g.start < e AND e < g."end") AS ends
FROM genes g JOIN p ON g.chr = p.chr AND ((g.start < s AND s < g."end") OR (g.start < e AND e < g."end")) GROUP BY g.name""")
def start_in_window_counts(spark, sf):
    r = reads(spark, sf).select("chr", "strand", F.col("start"), "end")
    found = ops.overlap_join(genes(spark, sf).select("name", "chr", "start", "end"), r, WIDTH)
    s, e = (f(F.col("start_r"), F.col("end_r"), F.col("strand")) for f in (iv.oriented_start, iv.oriented_end))
    inside = lambda x: (F.col("start") < x) & (x < F.col("end"))
    return found.where(inside(s) | inside(e)).groupBy("name").agg(F.count_if(inside(s)).alias("starts"), F.count_if(inside(e)).alias("ends"))


@query("interval_scalars", """WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS a, l_partkey % 50 + 1 + l_suppkey % 20 AS b, l_suppkey % 50 AS c, l_suppkey % 50 + 1 + l_partkey % 20 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, (CASE WHEN a < c THEN 1 ELSE 0 END + CASE WHEN a < d AND c < b THEN 2 ELSE 0 END + CASE WHEN b > d THEN 4 ELSE 0 END)::INTEGER AS relation, a < d AND c < b AS overlapping,
  a <= c AND d <= b AS holds, a = d OR b = c AS touching, greatest(0, c - b, a - d) AS distance, least(a, c) AS span_start, greatest(b, d) AS span_end, CASE WHEN a < d AND c < b THEN greatest(a, c) END AS common_start, CASE WHEN a < d AND c < b THEN least(b, d) END AS common_end, (a + b) // 2 AS middle FROM i""")
def interval_scalars(spark, sf):
    from tidemark.plans.views import table

    li = table(spark, sf, "lineitem")
    a, c = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    x = (a, a + 1 + F.col("l_suppkey") % 20, c, c + 1 + F.col("l_partkey") % 20)
    return li.select(
        "l_orderkey", "l_linenumber", iv.relationship(*x).alias("relation"), iv.overlaps(*x).alias("overlapping"), iv.contains(*x).alias("holds"), iv.adjacent(*x).alias("touching"), iv.distance(*x).alias("distance"),
        iv.span(*x)["start"].alias("span_start"), iv.span(*x)["end"].alias("span_end"), iv.intersection(*x)["start"].alias("common_start"), iv.intersection(*x)["end"].alias("common_end"), iv.midpoint(x[0], x[1]).alias("middle"),
    )


@query("exonic_window_counts", f"""{W}, k AS (SELECT g.name, count(*) AS k FROM genes g JOIN exons e ON g.name = e.name AND g.start < e."end" AND e.start < g."end" GROUP BY g.name),
h AS (SELECT DISTINCT g.name, r.name AS read, r.exp, r.nh FROM genes g LEFT JOIN k USING (name) JOIN reads r ON {OVER}
  WHERE coalesce(k, 0) <= 1 OR EXISTS (SELECT 1 FROM exons e WHERE e.name = g.name AND e.start < g."end" AND g.start < e."end" AND greatest(e.start, g.start) < r."end" AND r.start < least(e."end", g."end")))
SELECT name, exp, count(*) AS n, round(sum(1.0 / nh), 6) AS weight FROM h GROUP BY ALL""")
def exonic_window_counts(spark, sf):
    e = exons(spark, sf).select("name", "chr", "start", "end", F.concat_ws(".", "name", "i").alias("exon"))
    out = ct.count_exonic(reads(spark, sf).select("name", "chr", "start", "end", "nh", "exp"), genes(spark, sf), e, WIDTH)
    return out.withColumn("weight", F.round("weight", 6))


BLOCKS = """b AS (SELECT name, any_value(strand) AS strand, list({'s': start, 'e': "end"} ORDER BY start) AS blocks FROM exons GROUP BY name)"""


@query("spliced_lengths", f"""{W}, {BLOCKS} SELECT name, list_sum(list_transform(blocks, lambda x: x.e - x.s))::BIGINT AS length, len(blocks) AS n_exons, (blocks[-1].e - blocks[1].s - list_sum(list_transform(blocks, lambda x: x.e - x.s)))::BIGINT AS intronic FROM b""")
def spliced_lengths(spark, sf):
    b = exons(spark, sf).groupBy("name").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("blocks"))
    return b.select("name", iv.blocks_length(F.col("blocks")).alias("length"), F.size("blocks").cast("long").alias("n_exons"), iv.blocks_length(iv.introns(F.col("blocks"))).alias("intronic"))


@query("spliced_positions", f"""{W}, {BLOCKS}, l AS (SELECT *, len(blocks) * 100 AS total FROM b), q AS (SELECT *, 50 + name % 100 AS off FROM l),
p AS (SELECT name, strand, off, total, CASE WHEN strand = '-' THEN total - 1 - off ELSE off END AS fwd, blocks FROM q)
SELECT name, off AS off, CASE WHEN fwd >= 0 AND fwd < total THEN blocks[(fwd // 100 + 1)::INTEGER].s + fwd % 100 END AS place FROM p""")
def spliced_positions(spark, sf):
    b = exons(spark, sf).groupBy("name").agg(F.first("strand").alias("strand"), F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("blocks"))
    b = b.withColumn("offset", 50 + F.col("name") % 100).withColumn("at", iv.to_reference(F.col("blocks"), F.col("offset"), F.col("strand")))
    back = iv.to_spliced(F.col("blocks"), F.col("at"), F.col("strand"))
    return b.select("name", F.col("offset").alias("off"), F.when(F.col("at").isNull() | (back == F.col("offset")), F.col("at")).alias("place"))


@query("first_and_last_bases", f"""{W}, {BLOCKS}, t AS (SELECT name, strand, s + k AS p, row_number() OVER (PARTITION BY name ORDER BY s + k) - 1 AS off FROM b, unnest(list_transform(blocks, lambda x: x.s)) AS u(s), unnest(range(100)) AS v(k)),
n AS (SELECT name, strand, p, CASE WHEN strand = '-' THEN count(*) OVER (PARTITION BY name) - 1 - off ELSE off END AS o, count(*) OVER (PARTITION BY name) AS total FROM t)
SELECT name, min(p) FILTER (WHERE o < 150) AS first_start, max(p) FILTER (WHERE o < 150) + 1 AS first_end, min(p) FILTER (WHERE o >= total - 150) AS last_start, max(p) FILTER (WHERE o >= total - 150) + 1 AS last_end FROM n GROUP BY name""")
def first_and_last_bases(spark, sf):
    b = exons(spark, sf).groupBy("name").agg(F.first("strand").alias("strand"), F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("blocks"))
    first, last = iv.first_bases(F.col("blocks"), 150, F.col("strand")), iv.last_bases(F.col("blocks"), 150, F.col("strand"))
    b = b.select("name", first.alias("f"), last.alias("l"))
    return b.select("name", F.col("f")[0]["start"].alias("first_start"), F.element_at("f", -1)["end"].alias("first_end"), F.col("l")[0]["start"].alias("last_start"), F.element_at("l", -1)["end"].alias("last_end"))


@query("global_read_stats", f"""{W} SELECT r.chr, count(*) AS n, round(sum(1.0 / nh), 6) AS weight, round(count(*) / any_value(length), 12) AS rate, median("end" - start) AS median_length FROM reads r JOIN refs USING (chr) GROUP BY r.chr""")
def global_read_stats(spark, sf):
    r = reads(spark, sf).join(F.broadcast(references(spark)), "chr")  # a row a reference
    return r.groupBy("chr").agg(F.count("*").alias("n"), F.round(F.sum(1 / F.col("nh")), 6).alias("weight"), F.round(F.count("*") / F.first("length"), 12).alias("rate"), F.expr("percentile(end - start, 0.5)").alias("median_length"))


@query("rpkm", f"""{W}, c AS (SELECT g.name, count(*) AS n, any_value(g."end" - g.start) AS length FROM genes g JOIN reads r ON {OVER} GROUP BY g.name)
SELECT name, round(n * 1e9 / (length * (SELECT count(*) FROM reads)), 6) AS rpkm, round(n * 1e3 / length, 6) AS rpk FROM c""")
def rpkm(spark, sf):
    r, g = reads(spark, sf), genes(spark, sf)
    total = r.count()
    c = ct.count_regions(r, g, WIDTH).select("name", "n").join(g.select("name", (F.col("end") - F.col("start")).alias("length")), "name")
    return c.select("name", F.round(F.col("n") * 1e9 / (F.col("length") * total), 6).alias("rpkm"), F.round(F.col("n") * 1e3 / F.col("length"), 6).alias("rpk"))


@query("read_filters", f"""{W} SELECT name, mapq >= CASE WHEN is_paired THEN 10 ELSE 30 END AS quality, NOT is_duplicate AS fresh, nh = 1 AS one_place, "end" - start <= 200 AS short,
  CASE WHEN strand = '-' THEN "end" - 1 ELSE start END > 86400 AND CASE WHEN strand = '-' THEN "end" - 1 ELSE start END < 864000 AS begins_in, CASE WHEN strand = '-' THEN start ELSE "end" - 1 END > 86400 AND CASE WHEN strand = '-' THEN start ELSE "end" - 1 END < 864000 AS ends_in
  FROM reads WHERE (mapq >= CASE WHEN is_paired THEN 10 ELSE 30 END AND NOT is_duplicate) OR NOT (strand = '+')""")
def read_filters(spark, sf):
    kept = reads(spark, sf).where(ct.any_of(ct.all_of(ct.mapping_quality(30, 10), ct.not_duplicate()), ~ct.same_orientation("+")))
    return kept.select("name", ct.mapping_quality(30, 10).alias("quality"), ct.not_duplicate().alias("fresh"), ct.uniquely_mapped().alias("one_place"), ct.span_at_most(200).alias("short"), ct.starts_in(86_400, 864_000).alias("begins_in"), ct.ends_in(86_400, 864_000).alias("ends_in"))


@query("experiment_index", f"""{W} SELECT exp, row_number() OVER (ORDER BY exp) - 1 AS idx FROM (SELECT DISTINCT exp FROM reads)""")
def experiment_index(spark, sf):
    return ct.experiment_index(reads(spark, sf))


MATES = """mates AS (SELECT l_orderkey AS read_name, l_linenumber % 2 = 1 AS is_first, l_returnflag AS chr, l_partkey AS start, l_partkey + 50 AS "end", CASE WHEN l_linenumber % 2 = 1 THEN '+' ELSE '-' END AS strand,
  (SELECT 1) AS one, l_linestatus = 'O' AS is_primary, l_linenumber, (1 + l_suppkey % 2)::INTEGER AS nh FROM lineitem),
pairs AS (SELECT a.*, lead(start) OVER w AS mate_next, lag(start) OVER w AS mate_prev, lead(chr) OVER w AS chr_next, lag(chr) OVER w AS chr_prev FROM mates a WINDOW w AS (PARTITION BY read_name ORDER BY l_linenumber, start, "end", chr, nh))"""


def mates(spark, sf):
    from pyspark.sql import Window

    from tidemark.plans.views import table

    li = table(spark, sf, "lineitem")
    first = F.col("l_linenumber") % 2 == 1
    m = li.select(F.col("l_orderkey").alias("read_name"), first.alias("is_first"), F.col("l_returnflag").alias("chr"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 50).alias("end"), F.when(first, "+").otherwise("-").alias("strand"), (F.col("l_linestatus") == "O").alias("is_primary"), "l_linenumber", (1 + F.col("l_suppkey") % 2).cast("int").alias("nh"))
    w = Window.partitionBy("read_name").orderBy("l_linenumber", "start", "end", "chr", "nh")
    side = lambda c: F.when(F.col("is_first"), F.lead(c).over(w)).otherwise(F.lag(c).over(w))
    return m.select("*", side("start").alias("mate_start"), side("chr").alias("mate_chr"), F.when(F.col("is_first"), "-").otherwise("+").alias("mate_strand"))


@query("mate_pairs", f"""WITH {MATES}, m AS (SELECT *, CASE WHEN is_first THEN mate_next ELSE mate_prev END AS mate_start, CASE WHEN is_first THEN chr_next ELSE chr_prev END AS mate_chr FROM pairs)
SELECT a.read_name, a.chr, least(a.start, b.start) AS start, greatest(a."end", b."end") AS end_pos, greatest(a."end", b."end") - least(a.start, b.start) AS fragment_length, greatest(0, b.start - a."end", a.start - b."end") AS gap, a.is_primary OR b.is_primary AS is_primary, a.chr <> b.chr AS chimeric
FROM m a JOIN m b ON a.read_name = b.read_name AND a.is_first AND NOT b.is_first AND a.mate_chr = b.chr AND b.mate_chr = a.chr AND a.mate_start = b.start AND b.mate_start = a.start""")
def mate_pairs(spark, sf):
    return ct.mate_pairs(mates(spark, sf)).withColumnRenamed("primary", "is_primary").withColumnRenamed("end", "end_pos")


@query("pair_completeness", f"""WITH {MATES}, h AS (SELECT read_name, count(*) FILTER (WHERE is_first) AS hits_1, count(*) FILTER (WHERE NOT is_first) AS hits_2, max(nh) FILTER (WHERE is_first) AS n1, max(nh) FILTER (WHERE NOT is_first) AS n2 FROM mates GROUP BY read_name)
SELECT read_name, hits_1, hits_2, hits_1 = CASE WHEN coalesce(n1, 1) <= 1 THEN 1 ELSE hits_1 END AND hits_2 = CASE WHEN coalesce(n2, 1) <= 1 THEN 1 ELSE hits_2 END AS complete FROM h""")
def pair_completeness(spark, sf):
    return ct.pair_completeness(mates(spark, sf))


@query("barcode_distances", """WITH b AS (SELECT s_suppkey AS i, lpad(lower(to_hex(s_suppkey * 2654435761 % 4294967296)), 8, '0') AS b FROM supplier),
d AS (SELECT list_sum(list_transform(range(1, 9), lambda k: (x.b[k] <> y.b[k])::INTEGER))::INTEGER AS distance FROM b x JOIN b y ON x.i < y.i)
SELECT distance, count(*) AS n FROM d GROUP BY distance""")
def barcode_distances(spark, sf):
    from tidemark.plans.views import table

    code = F.lpad(F.lower(F.hex(F.col("s_suppkey") * 2_654_435_761 % 4_294_967_296)), 8, "0")
    return ct.barcode_distances(table(spark, sf, "supplier").select(code.alias("barcode")))


@query("demultiplex", """WITH s AS (SELECT c_custkey, c_custkey % 200 AS k FROM customer), r AS (SELECT c_custkey, lpad((k * 37 % 1000)::VARCHAR, 4, '0') AS idx FROM s),
b AS (SELECT lpad((n_nationkey * 41 % 1000)::VARCHAR, 4, '0') AS barcode, n_name AS sample FROM nation),
p AS (SELECT c_custkey, sample, idx <> barcode AS off FROM r JOIN b ON list_sum(list_transform(range(1, 5), lambda k: (idx[k] <> barcode[k])::INTEGER)) <= 1),
m AS (SELECT c_custkey, arg_min(sample, (off, sample)) AS sample FROM p GROUP BY c_custkey)
SELECT sample, count(*) AS n FROM r LEFT JOIN m USING (c_custkey) GROUP BY sample""")
def demultiplex(spark, sf):
    from tidemark.plans.views import table

    r = table(spark, sf, "customer").select("c_custkey", F.lpad((F.col("c_custkey") % 200 * 37 % 1_000).cast("string"), 4, "0").alias("index"))
    b = table(spark, sf, "nation").select(F.lpad((F.col("n_nationkey") * 41 % 1_000).cast("string"), 4, "0").alias("barcode"), F.col("n_name").alias("sample"))
    return ct.demultiplex(r, b, 1).groupBy("sample").agg(F.count("*").alias("n"))



