"""Registered queries on sequences, graphs and permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import sequences as sq
from tidemark.operators import sequences as so
from tidemark.plans.views import GENES, REFERENCES, genes, references, table

#: Letters of a text as bases: a to e A, f to l C, m to r G, s to z T, others N.
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "AAAAACCCCCCCGGGGGGTTTTTTTT"
DNA = f"dna AS (SELECT item_id, regexp_replace(translate(lower(text), '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS seq FROM benchmark)"


def dna(spark, sf, name="benchmark", key="item_id"):
    t = F.translate(F.lower("text"), LETTERS, BASES)
    return table(spark, sf, name).select(key, F.regexp_replace(t, "[^ACGT]", "").alias("seq"))


@query("kmer_counts", f"WITH {DNA} SELECT substr(seq, i, 5) AS kmer, count(*) AS n FROM dna, unnest(range(1, greatest(length(seq) - 3, 1))) AS t(i) GROUP BY ALL")
def kmer_counts(spark, sf):
    return so.kmer_counts(dna(spark, sf), "seq", 5)


@query("word_gram_counts", "SELECT lang, substr(text, i, 3) AS kmer, count(*) AS n FROM documents, unnest(range(1, greatest(length(text) - 1, 1))) AS t(i) GROUP BY ALL")
def word_gram_counts(spark, sf):
    return so.kmer_counts(table(spark, sf, "documents"), "text", 3, ["lang"])


@query("sequence_functions", f"""WITH {DNA} SELECT item_id, length(seq) AS n, round(length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq), 9) AS gc, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp,
  regexp_replace(regexp_replace(seq, 'A{{2,}}$', ''), '^T{{2,}}', '') AS trimmed, CASE WHEN strpos(seq, 'GATC') > 0 THEN substr(seq, 1, strpos(seq, 'GATC') - 1) ELSE seq END AS unlinked, regexp_matches(seq, '(A{{2,}}$)|(^T{{2,}})') AS poly_a FROM dna""")
def sequence_functions(spark, sf):
    s = F.col("seq")
    return dna(spark, sf).select("item_id", F.length(s).cast("long").alias("n"), F.round(sq.gc_content(s), 9).alias("gc"), sq.reverse_complement(s).alias("revcomp"), sq.trim_poly_a(s, 2).alias("trimmed"), sq.trim_linker(s, "GATC").alias("unlinked"), sq.has_poly_a(s, 2).alias("poly_a"))


@query("gc_windows", f"WITH {DNA} SELECT item_id, i::INTEGER AS start, round(length(regexp_replace(substr(seq, i + 1, 40), '[^GC]', '', 'g')) / 40.0::DOUBLE, 9) AS gc FROM dna, unnest(range(0, greatest(length(seq) - 40, 0), 20)) AS t(i)")
def gc_windows(spark, sf):
    w = dna(spark, sf).select("item_id", F.explode(sq.windows(F.col("seq"), 40, 20)).alias("w"))
    return w.select("item_id", F.col("w.start").alias("start"), F.round(sq.gc_content(F.col("w.seq")), 9).alias("gc"))


@query("motif_matches", "SELECT doc_id, len(regexp_extract_all(upper(text), 'T[AEIO]N'))::BIGINT AS n, regexp_extract_all(upper(text), 'T[AEIO]N')[1] AS first FROM documents")
def motif_matches(spark, sf):
    m = table(spark, sf, "documents").select("doc_id", sq.motif_matches(F.col("text"), "T[AEIO]N").alias("m"))
    return m.select("doc_id", F.size("m").cast("long").alias("n"), F.get("m", F.lit(0)).alias("first"))


_LOOSE, _STRICT = sq.cluster_pattern(["CA", "TG"], 3, 2)


@query("motif_clusters", f"WITH {DNA}, m AS (SELECT item_id, list_filter(regexp_extract_all(seq, '{_LOOSE}'), lambda x: regexp_matches(x, '{_STRICT}')) AS m FROM dna) SELECT item_id, len(m)::BIGINT AS n, coalesce(list_max(list_transform(m, lambda x: length(x))), 0)::BIGINT AS longest FROM m")
def motif_clusters(spark, sf):
    m = dna(spark, sf).select("item_id", sq.motif_clusters(F.col("seq"), ["CA", "TG"], 3, 2).alias("m"))
    return m.select("item_id", F.size("m").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("m", F.length)), F.lit(0)).cast("long").alias("longest"))


PWM = [[0.7, 0.1, 0.1, 0.1], [0.1, 0.6, 0.2, 0.1], [0.1, 0.1, 0.7, 0.1], [0.2, 0.2, 0.2, 0.4], [0.05, 0.85, 0.05, 0.05]]
_SCORE = " + ".join("CASE substr(seq, i + %d, 1) %s ELSE 0 END" % (k, " ".join(f"WHEN '{b}' THEN ln(({p} + 0.01) / 1.04 / 0.25) / ln(2)" for b, p in zip("ACGT", c, strict=True))) for k, c in enumerate(PWM))


@query("pwm_hits", f"WITH {DNA}, s AS (SELECT item_id, (i - 1)::INTEGER AS place, round({_SCORE}, 6) AS score FROM dna, unnest(range(1, greatest(length(seq) - 3, 1))) AS t(i)) SELECT item_id, place, score FROM s WHERE score >= 2")
def pwm_hits(spark, sf):
    return so.pwm_hits(dna(spark, sf), "seq", PWM, -1e9, ["item_id"]).withColumnRenamed("at", "place").withColumn("score", F.round("score", 6)).where("score >= 2")


_GAIN = "CASE WHEN substr(a, {i}, 1) = substr(b, {j}, 1) OR upper(substr(a, {i}, 1)) = 'N' OR upper(substr(b, {j}, 1)) = 'N' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
_GO = "(i > 0 OR j > 0) AND NOT (state = 'd' AND hs[i + 1][j + 1] = 0)"
_DIAGONAL = f"i > 0 AND j > 0 AND abs(hs[i + 1][j + 1] - (hs[i][j] + {_GAIN.format(i='i', j='j')})) < 1e-6"


@query("local_alignments", f"""WITH RECURSIVE o AS (SELECT p_brand, min(p_name) AS b FROM part GROUP BY p_brand), q AS (SELECT DISTINCT p_name AS a, b FROM part JOIN o USING (p_brand)),
d AS (SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0.0::DOUBLE) AS h, list_transform(range(length(b) + 1), lambda x: -1e18::DOUBLE) AS f, [list_transform(range(length(b) + 1), lambda x: 0.0::DOUBLE)] AS hs, [list_transform(range(length(b) + 1), lambda x: -1e18::DOUBLE)] AS es, [list_transform(range(length(b) + 1), lambda x: -1e18::DOUBLE)] AS fs FROM q
UNION ALL SELECT a, b, i + 1, h2, f2, list_append(hs, h2), list_append(es, e2), list_append(fs, f2) FROM (SELECT *, list_transform(range(1, length(b) + 2), lambda j: greatest(best[j], e2[j])) AS h2 FROM (
  SELECT *, list_transform(range(1, length(b) + 2), lambda j: CASE WHEN j = 1 THEN -1e18::DOUBLE ELSE list_max(list_transform(range(1, j), lambda k: best[k] + (k - 1) * 0.5::DOUBLE)) - (j - 2) * 0.5::DOUBLE - 2 END) AS e2 FROM (
    SELECT *, list_transform(range(1, length(b) + 2), lambda j: CASE WHEN j = 1 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, h[j - 1] + {_GAIN.format(i='i + 1', j='(j - 1)::BIGINT')}, f2[j]) END) AS best FROM (
      SELECT *, list_transform(range(1, length(b) + 2), lambda j: CASE WHEN j = 1 THEN -1e18::DOUBLE ELSE greatest(h[j] - 2, f[j] - 0.5::DOUBLE) END) AS f2 FROM d WHERE i < length(a)))))),
m AS (SELECT a, b, hs, es, fs, list_transform(hs, lambda r: list_max(r)) AS tops FROM d WHERE i = length(a)), n AS (SELECT *, list_max(tops) AS score, list_position(tops, list_max(tops)) AS top FROM m),
t AS (SELECT a, b, hs, es, fs, score, (top - 1)::BIGINT AS i, (list_position(hs[top], score) - 1)::BIGINT AS j, 'd' AS state, 0 AS identical, 0 AS gaps FROM n
UNION ALL SELECT a, b, hs, es, fs, score, CASE WHEN state = 'u' OR (state = 'd' AND {_DIAGONAL}) THEN i - 1 ELSE i END, CASE WHEN state = 'l' OR (state = 'd' AND {_DIAGONAL}) THEN j - 1 ELSE j END,
  CASE WHEN state = 'd' THEN CASE WHEN {_DIAGONAL} THEN 'd' WHEN abs(hs[i + 1][j + 1] - es[i + 1][j + 1]) < 1e-6 THEN 'l' ELSE 'u' END WHEN state = 'l' THEN CASE WHEN abs(es[i + 1][j + 1] - (hs[i + 1][j] - 2)) < 1e-6 OR j = 1 THEN 'd' ELSE 'l' END ELSE CASE WHEN abs(fs[i + 1][j + 1] - (hs[i][j + 1] - 2)) < 1e-6 OR i = 1 THEN 'd' ELSE 'u' END END,
  identical + CASE WHEN state = 'd' AND {_DIAGONAL} AND substr(a, i, 1) = substr(b, j, 1) THEN 1 ELSE 0 END, gaps + CASE WHEN state <> 'd' THEN 1 ELSE 0 END FROM t WHERE {_GO})
SELECT p_partkey, score, identical, gaps FROM part JOIN o USING (p_brand) JOIN (SELECT * FROM t WHERE NOT ({_GO})) t ON t.a = p_name AND t.b = o.b""")
def local_alignments(spark, sf):
    """Local alignments of every part's name with its brand's alphabetically first name; tested against brute force, too."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    pairs = p.join(p.groupBy("p_brand").agg(F.min("p_name").alias("other")), "p_brand")
    distinct = pairs.select("p_name", "other").distinct().withColumn("x", sq.aligner()("p_name", "other"))
    return pairs.join(distinct, ["p_name", "other"]).select("p_partkey", "x.score", "x.identical", "x.gaps")


@query("combinations", "SELECT a.n_nationkey AS c1, b.n_nationkey AS c2, c.n_nationkey AS c3 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey JOIN nation c ON b.n_nationkey < c.n_nationkey")
def combinations(spark, sf):
    return so.combinations(table(spark, sf, "nation"), "n_nationkey", 3)


@query("permuted_genes", f"""WITH {GENES}, {REFERENCES}, t AS (SELECT name, chr, "end" - start AS size, i, greatest(length - ("end" - start) + 1, 1) AS room, md5(name || '|' || i || '|11') AS h, length FROM genes JOIN refs USING (chr), range(10) AS r(i)),
d AS (SELECT name, chr, size, i, ('0x' || substr(h, 1, 15))::BIGINT % room AS start FROM t WHERE size <= length), b AS (SELECT name, min(i) AS i FROM d WHERE start >= 86400 GROUP BY name)
SELECT name, chr, start, start + size AS "end" FROM d JOIN b USING (name, i)""")
def permuted_genes(spark, sf):
    """Genes moved to seeded random places outside the first day of each reference."""
    mask = references(spark).select("chr", F.lit(0).cast("long").alias("start"), F.lit(86_400).cast("long").alias("end"))
    return so.permute_annotations(genes(spark, sf).select("name", "chr", "start", "end"), references(spark), mask, 11, width=86_400)


@query("unmasked_lengths", f"""WITH {GENES}, {REFERENCES}, o AS (SELECT chr, start, "end", max("end") OVER (PARTITION BY chr ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM genes),
m AS (SELECT chr, sum(greatest(0, "end" - greatest(start, coalesce(before, start))))::BIGINT AS masked FROM o GROUP BY chr) SELECT chr, length, coalesce(masked, 0)::BIGINT AS masked, length - coalesce(masked, 0)::BIGINT AS free FROM refs LEFT JOIN m USING (chr)""")
def unmasked_lengths(spark, sf):
    return so.unmasked_lengths(references(spark), genes(spark, sf))


@query("tree_levels", """WITH RECURSIVE e AS (SELECT (c_custkey - 1) // 3 AS parent, c_custkey AS child FROM customer WHERE c_custkey > 0), t AS (SELECT 0::BIGINT AS node, 0 AS level UNION ALL SELECT e.child, t.level + 1 FROM t JOIN e ON e.parent = t.node) SELECT node, level FROM t""")
def tree_levels(spark, sf):
    c = table(spark, sf, "customer").where("c_custkey > 0")
    return so.tree_levels(c.select(F.call_function("div", F.col("c_custkey") - 1, F.lit(3)).alias("parent"), F.col("c_custkey").alias("child")), 0)


@query("all_paths", """WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS src, n_nationkey + 1 + n_regionkey AS dst FROM nation WHERE n_nationkey + 1 + n_regionkey < 25 UNION SELECT n_nationkey, n_nationkey + 5 FROM nation WHERE n_nationkey + 5 < 25),
p AS (SELECT [src] AS path, src AS v FROM (SELECT DISTINCT src FROM e WHERE src NOT IN (SELECT dst FROM e)) UNION ALL SELECT list_append(p.path, e.dst), e.dst FROM p JOIN e ON e.src = p.v) SELECT array_to_string(path, '>') AS path FROM p WHERE v NOT IN (SELECT src FROM e)""")
def all_paths(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    e = n.select(k.alias("src"), (k + 1 + F.col("n_regionkey")).alias("dst")).unionByName(n.select(k.alias("src"), (k + 5).alias("dst"))).where("dst < 25").distinct()
    return so.all_paths(e, 30).select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"))


@query("chromosome_order", """WITH c AS (SELECT DISTINCT 'chr' || CASE WHEN p_size % 7 = 0 THEN chr(65 + p_size % 24) ELSE p_size::VARCHAR END AS chr FROM part), k AS (SELECT chr, substr(chr, 4) AS s FROM c)
SELECT chr, row_number() OVER (ORDER BY NOT regexp_matches(s, '^[0-9]{1,2}$'), try_cast(s AS INTEGER), s) AS place FROM k""")
def chromosome_order(spark, sf):
    from pyspark.sql import Window

    size = F.col("p_size")
    c = table(spark, sf, "part").select(F.concat(F.lit("chr"), F.when(size % 7 == 0, F.char((65 + size % 24).cast("long"))).otherwise(size.cast("string"))).alias("chr")).distinct()
    return c.withColumn("place", F.row_number().over(Window.orderBy(*so.chromosome_key())).cast("long"))
