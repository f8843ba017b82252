"""Registered queries on ordered lookups, distributions and expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import extra as ex
from tidemark.plans.sequence_queries import DNA, dna
from tidemark.plans.views import GENES, MATRIX, READS, genes, matrix, reads, table


@query("interval_index", f"""WITH {GENES} SELECT name, row_number() OVER w - 1 AS place, row_number() OVER w = 1 AS is_first, row_number() OVER w = count(*) OVER (PARTITION BY chr, strand) AS is_last FROM genes WINDOW w AS (PARTITION BY chr, strand ORDER BY start, "end" DESC)""")
def interval_index(spark, sf):
    return ex.interval_index(genes(spark, sf), ("chr", "strand"), ties=("name",)).select("name", F.col("place").cast("long").alias("place"), "is_first", "is_last")


@query("floor_lookup", f"""WITH {READS}, {GENES} SELECT r.name, max(g.start) FILTER (WHERE g.start <= r.start) AS floor_start, min(g.start) FILTER (WHERE g.start > r.start) AS above FROM reads r LEFT JOIN genes g ON r.chr = g.chr GROUP BY r.name""")
def floor_lookup(spark, sf):
    r = reads(spark, sf).select("name", "chr", F.col("start").alias("pos"))
    found = ex.floor_lookup(r.select("chr", "pos").distinct(), genes(spark, sf))
    return r.join(found, ["chr", "pos"]).select("name", F.col("floor").alias("floor_start"), "above")


@query("distribution_distance", """WITH h AS (SELECT least(greatest(floor(value / 10)::INTEGER, 0), 9) AS bin, count(*) FILTER (WHERE event_type = 'click') AS x, count(*) FILTER (WHERE event_type = 'view') AS y FROM events GROUP BY 1), b AS (SELECT b AS bin, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM range(10) AS r(b) LEFT JOIN h ON h.bin = b),
t AS (SELECT sum(x) AS sx, sum(y) AS sy FROM b), c AS (SELECT (x + 1) / (sx + 10) AS p, (y + 1) / (sy + 10) AS q, abs(sum(x) OVER (ORDER BY bin) / sx - sum(y) OVER (ORDER BY bin) / sy) AS d FROM b, t) SELECT round(sum(p * ln(p / q)), 9) AS kl, round(max(d), 9) AS ks FROM c""")
def distribution_distance(spark, sf):
    return ex.compare_distributions(table(spark, sf, "events"), "event_type", "click", "view", "value", 0.0, 100.0, 10).select(F.round("kl", 9).alias("kl"), F.round("ks", 9).alias("ks"))


@query("differential_expression", f"""WITH {MATRIX}, j AS (SELECT row, value, (ends_with(col, 'O'))::INTEGER AS flag FROM matrix), m AS (SELECT row, count(*) FILTER (WHERE flag = 0) AS n0, count(*) FILTER (WHERE flag = 1) AS n1, avg(value) FILTER (WHERE flag = 1) AS m1, avg(value) FILTER (WHERE flag = 0) AS m0, var_samp(value) FILTER (WHERE flag = 1) AS v1, var_samp(value) FILTER (WHERE flag = 0) AS v0 FROM j GROUP BY row)
SELECT row, n0, n1, round(m1 - m0, 6) AS difference, round((m1 - m0) / (sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) + 1), 6) AS t, round(m1 / m0, 6) AS fold FROM m""")
def differential_expression(spark, sf):
    m = matrix(spark, sf)
    labels = m.select("col").distinct().withColumn("flag", F.col("col").endswith("O").cast("int"))
    return ex.differential_expression(m, labels, 1.0).select("row", "n0", "n1", *[F.round(c, 6).alias(c) for c in ("difference", "t", "fold")])


@query("batch_centered", f"""WITH {MATRIX}, j AS (SELECT row, col, left(col, 1) AS batch, value FROM matrix), b AS (SELECT row, batch, avg(value) AS b FROM j GROUP BY ALL), a AS (SELECT row, avg(value) AS a FROM matrix GROUP BY row) SELECT row, col, round(value - b + a, 6) AS value FROM j JOIN b USING (row, batch) JOIN a USING (row)""")
def batch_centered(spark, sf):
    m = matrix(spark, sf)
    return ex.batch_center(m, m.select("col", F.left("col", F.lit(1)).alias("batch")).distinct()).withColumn("value", F.round("value", 6))


@query("restriction_sites", f"WITH {DNA} SELECT item_id::VARCHAR AS id, enzyme, (SELECT count(*) FROM unnest(range(1, greatest(length(seq) - 2, 1))) AS t(i) WHERE substr(seq, i, 4) = site)::INTEGER AS n FROM dna, (VALUES ('DpnI', 'GATC'), ('TaqI', 'TCGA')) AS e(enzyme, site)")
def restriction_sites(spark, sf):
    return ex.restriction_sites(dna(spark, sf).select(F.col("item_id").cast("string").alias("id"), "seq"), {"DpnI": "GATC", "TaqI": "TCGA"})


_WINDOWS = "unnest(range(0, CASE WHEN length(seq) = 0 THEN 0 ELSE greatest(length(seq) - {0}, 0) + 1 END)) AS t(i)"
_GC = "length(regexp_replace(w, '[^GC]', '', 'g'))"


@query("melting_points", f"""WITH {DNA}, p AS (SELECT item_id, i, substr(seq, i + 1, 20) AS w FROM dna, {_WINDOWS.format(20)}), s AS (SELECT item_id, i, substr(seq, i + 1, 8) AS w FROM dna, {_WINDOWS.format(8)}),
a AS (SELECT item_id, 20 AS size, i, CASE WHEN length(w) < 14 THEN 2.0 * (length(w) - {_GC}) + 4.0 * {_GC} ELSE 64.9 + 41 * ({_GC} - 16.4) / length(w) END AS tm FROM p UNION ALL SELECT item_id, 8, i, 2.0 * (length(w) - {_GC}) + 4.0 * {_GC} FROM s)
SELECT item_id, size, i::INTEGER AS start, round(tm, 6)::DOUBLE AS tm FROM a""")
def melting_points(spark, sf):
    """Every window of 20 bases (primers) and of 8 (seeds) of every sequence."""
    d = dna(spark, sf)
    parts = [ex.primer_scores(d, ["item_id"], "seq", n).select("item_id", F.lit(n).alias("size"), "start", F.round("tm", 6).alias("tm")) for n in (20, 8)]
    return parts[0].unionByName(parts[1])


@query("library_stats", f"WITH {DNA} SELECT count(*) AS reads, sum(length(seq))::BIGINT AS bases, min(length(seq))::INTEGER AS least, max(length(seq))::INTEGER AS most, round(avg(length(seq)), 6) AS mean_length, round(sum(length(regexp_replace(seq, '[^GC]', '', 'g'))) / sum(length(seq)), 9) AS gc, count(DISTINCT seq) AS distinct_reads FROM dna")
def library_stats(spark, sf):
    return ex.library_stats(dna(spark, sf)).withColumns({"mean_length": F.round("mean_length", 6), "gc": F.round("gc", 9)})
