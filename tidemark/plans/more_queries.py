"""Registered queries on gene parts, per-position counts, two-sample scores, peaks and region extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import intervals as iv
from tidemark.functions import stats as st
from tidemark.operators import counting as ct
from tidemark.operators import further as fu
from tidemark.operators import genes as ge
from tidemark.operators import intervals as ops
from tidemark.operators import sequences as so
from tidemark.plans.format_queries import models
from tidemark.plans.interval_queries import BLOCKS, OVER, WIDTH
from tidemark.plans.sequence_queries import DNA, dna
from tidemark.plans.stats_queries import CDF, PMF, SCAN, scanned
from tidemark.plans.views import AXIS, EXONS, GENES, READS, genes, reads
from tidemark.sources.scratch import written_table

W = f"WITH {READS}, {GENES}, {EXONS}, {BLOCKS}"


@query("position_counts", f"""{W}, p AS (SELECT g.name, r.start AS pos, count(*) AS n FROM genes g JOIN reads r ON g.chr = r.chr AND g.start <= r.start AND r.start < g."end" GROUP BY ALL)
SELECT name, count(*) AS positions, max(n) AS most, sum(n)::BIGINT AS total, round(sum(n) / any_value(g."end" - g.start), 9) AS average FROM p JOIN genes g USING (name) GROUP BY name""")
def position_counts(spark, sf):
    per = fu.position_counts(reads(spark, sf).select("chr", F.col("start").alias("pos")), genes(spark, sf), WIDTH)
    return per.select("name", "positions", "most", "total", F.round("average", 9).alias("average"))


@query("intron_counts", f"""{W}, i AS (SELECT name, chr, strand, "end" AS s, lead(start) OVER (PARTITION BY name ORDER BY start) AS e FROM exons), h AS (SELECT DISTINCT i.name, r.name AS read FROM i JOIN reads r ON i.chr = r.chr AND i.s < r."end" AND r.start < i.e AND i.e IS NOT NULL)
SELECT name, count(*) AS n FROM h WHERE NOT EXISTS (SELECT 1 FROM exons e JOIN reads r ON r.name = h.read WHERE e.name = h.name AND e.chr = r.chr AND e.start < r."end" AND r.start < e."end") GROUP BY name""")
def intron_counts(spark, sf):
    m = written_table(models(spark, sf).select("name", "chr", "blocks"), "models")  # looked at twice
    return ct.count_intronic(reads(spark, sf), m, 256)


@query("two_sample_scores", f"""WITH {READS}, {SCAN}, w AS (SELECT window_start, coalesce(max(CASE WHEN chr = 'click' THEN n END), 0)::BIGINT AS a, coalesce(max(CASE WHEN chr = 'view' THEN n END), 0)::BIGINT AS b, (SELECT lam * 3600 FROM l WHERE chr = 'click') AS ma, (SELECT lam * 3600 FROM l WHERE chr = 'view') AS mb FROM s WHERE chr IN ('click', 'view') GROUP BY window_start),
x AS (SELECT *, ((a - ma) / nullif(a, 0)) * (ma / 3600 * ({AXIS} - 3600) * {PMF.format(k='(a - 1)', m='ma')}) AS ea, ((b - mb) / nullif(b, 0)) * (mb / 3600 * ({AXIS} - 3600) * {PMF.format(k='(b - 1)', m='mb')}) AS eb FROM w)
SELECT window_start, a, b, round(a / ma / nullif(b / mb, 0), 6) AS ratio, round(log2(nullif(a, 0) / ma / nullif(b / mb, 0)), 6) AS log_ratio, round(CASE WHEN a <= 2 THEN 1 ELSE least(1, abs(1 - {CDF.format(k='a - 1', m='ma')} * exp(-ea))) END, 8) AS p_a, round(CASE WHEN b <= 2 THEN 1 ELSE least(1, abs(1 - {CDF.format(k='b - 1', m='mb')} * exp(-eb))) END, 8) AS p_b FROM x""")
def two_sample_scores(spark, sf):
    """Windows that either sample has reads in; without reads in the second there is no ratio, without any in either no logarithm of it."""
    s = scanned(spark, sf).where("chr in ('click', 'view')")
    rates = s.agg(*[F.max(F.when(F.col("chr") == c, F.col("lam"))).alias(n) for c, n in (("click", "la"), ("view", "lb"))])
    side = lambda chr_: F.coalesce(F.max(F.when(F.col("chr") == chr_, F.col("n"))), F.lit(0).cast("long"))
    w = s.groupBy("window_start").agg(side("click").alias("a"), side("view").alias("b")).crossJoin(F.broadcast(rates))  # one row
    ratio = F.try_divide(F.col("a") / (F.col("la") * 3600), F.col("b") / (F.col("lb") * 3600))
    p = lambda n, lam: F.round(st.scan_pvalue(F.col(n), F.col(lam), F.lit(3600), F.lit(AXIS)), 8)
    return w.select("window_start", "a", "b", F.round(ratio, 6).alias("ratio"), F.round(F.log2(F.nullif(ratio, F.lit(0.0))), 6).alias("log_ratio"), p("a", "la").alias("p_a"), p("b", "lb").alias("p_b"))


@query("peak_calls", f"""WITH {READS}, c AS (SELECT chr, k * 1800 AS ws, count(*) AS n FROM reads, unnest(range(greatest(start // 1800 - 1, 0), start // 1800 + 1)) AS t(k) GROUP BY ALL), h AS (SELECT * FROM c WHERE n >= 6),
f AS (SELECT *, CASE WHEN lag(ws) OVER w IS NULL OR ws >= lag(ws) OVER w + 3600 THEN 1 ELSE 0 END AS fresh FROM h WINDOW w AS (PARTITION BY chr ORDER BY ws)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY ws) AS i FROM f)
SELECT chr, min(ws) AS start, max(ws) + 3600 AS end_pos, count(*) AS windows, max(n) AS most, arg_max(ws, (n, -ws)) AS summit FROM i GROUP BY chr, i""")
def peak_calls(spark, sf):
    points = reads(spark, sf).select("chr", F.col("start").alias("pos"))
    w = ops.window_counts(points, 3_600, 1_800, ("chr",), F.lit(1.0)).select("chr", "window_start", "n", (-F.col("n")).cast("double").alias("p"))
    found = ge.peaks(w, 3_600, -5.5)
    return found.select("chr", "start", F.col("end").alias("end_pos"), "windows", (-F.col("best_p")).cast("long").alias("most"), "summit")


@query("region_sequences", f"""WITH {DNA}, r AS (SELECT item_id, s, CASE WHEN s % 2 = 0 THEN '+' ELSE '-' END AS strand, substr(seq, s + 1, 25) AS part FROM dna, unnest(range(0, greatest(length(seq) - 25, 0), 13)) AS t(s))
SELECT item_id || ':' || s AS name, CASE WHEN strand = '-' THEN reverse(translate(part, 'ACGT', 'TGCA')) ELSE part END AS seq FROM r""")
def region_sequences(spark, sf):
    d = dna(spark, sf).select(F.col("item_id").cast("string").alias("id"), "seq")
    n = F.length("seq") - 25
    at = d.where(n > 0).select(F.col("id").alias("chr"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(13))).alias("start"))
    wanted = at.select(F.concat_ws(":", "chr", "start").alias("name"), "chr", "start", (F.col("start") + 25).alias("end"), F.when(F.col("start") % 2 == 0, "+").otherwise("-").alias("strand"))
    return so.regions(d, wanted).select("name", "seq")


@query("transcript_windows", f"""{W} SELECT name, w.o AS off, least(100 * len(blocks) - w.o, 250) AS bases FROM b, unnest(range(0, 100 * len(blocks), 150)) AS w(o)""")
def transcript_windows(spark, sf):
    w = ge.transcript_windows(models(spark, sf), 250, 150)
    return w.select("name", F.col("at").alias("off"), iv.blocks_length(F.col("blocks")).alias("bases"))


@query("aggregate_profile", f"""WITH {READS}, {GENES}, p AS (SELECT g.strand, least(greatest(r.start, g.start), g."end" - 1) - g.start AS o, g."end" - g.start AS len FROM genes g JOIN reads r ON {OVER})
SELECT (CASE WHEN strand = '-' THEN 19 - o * 20 // len ELSE o * 20 // len END)::INTEGER AS bin, count(*) AS n FROM p GROUP BY ALL""")
def aggregate_profile(spark, sf):
    return ge.aggregate_profile(reads(spark, sf), genes(spark, sf), 20, WIDTH)



