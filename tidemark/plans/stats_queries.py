"""Registered queries on statistics, matrices and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import stats as st
from tidemark.operators import intervals as ops
from tidemark.operators import matrix as mx
from tidemark.operators import stats as so
from tidemark.plans.views import AXIS, MATRIX, READS, matrix, reads, table

#: Poisson mass and distribution function as SQL.
PMF = "exp({k} * ln({m}) - {m} - lgamma({k} + 1))"
CDF = "list_sum(list_transform(range(0, ({k}) + 1), lambda i: exp(i * ln({m}) - {m} - lgamma(i + 1))))"
NORMAL = """(0.5 + list_reduce(list_prepend({{'t': {z}, 's': {z}}}, list_transform(range(1, 121), lambda i: {{'t': i::DOUBLE, 's': 0.0::DOUBLE}})), lambda a, x: {{'t': a.t * {z} * {z} / (2 * x.t + 1), 's': a.s + a.t * {z} * {z} / (2 * x.t + 1)}}).s * exp(-{z} * {z} / 2) / sqrt(2 * pi()))"""


@query("summary_statistics", """WITH m AS (SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, sum(l_quantity) AS total, avg(l_quantity) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, median(l_quantity) AS median,
  var_samp(l_quantity) AS variance, stddev_samp(l_quantity) AS deviation, exp(avg(ln(l_quantity))) AS geometric_mean FROM lineitem GROUP BY ALL),
d AS (SELECT l_returnflag, l_linestatus, median(abs(l_quantity - median)) AS mad FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY ALL)
SELECT l_returnflag, l_linestatus, n, total, round(mean, 6) AS mean, least, most, median, round(variance, 6) AS variance, round(deviation, 6) AS deviation, round(geometric_mean, 6) AS geometric_mean, mad FROM m JOIN d USING (l_returnflag, l_linestatus)""")
def summary_statistics(spark, sf):
    s = so.summary(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"])
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "variance", "deviation", "geometric_mean")})


@query("average_ranks", """WITH c AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM c)
SELECT event_id, event_type, rank FROM events JOIN r USING (event_type, value)""")
def average_ranks(spark, sf):
    return so.average_rank(table(spark, sf, "events").select("event_id", "event_type", "value"), "value", ["event_type"]).select("event_id", "event_type", "rank")


@query("anova", """WITH g AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, avg(c_acctbal) AS m, sum(c_acctbal) AS s FROM customer GROUP BY ALL),
t AS (SELECT c_mktsegment, sum(n)::BIGINT AS n, count(*) AS groups, sum(s) / sum(n) AS gm FROM g GROUP BY c_mktsegment),
b AS (SELECT c_mktsegment, sum(g.n * (g.m - t.gm) * (g.m - t.gm)) AS between FROM g JOIN t USING (c_mktsegment) GROUP BY c_mktsegment),
w AS (SELECT c_mktsegment, sum((c_acctbal - m) * (c_acctbal - m)) AS within FROM customer JOIN g USING (c_mktsegment, c_nationkey) GROUP BY c_mktsegment)
SELECT c_mktsegment, n, groups, round(between, 2) AS between_ss, round(within, 2) AS within_ss, round(between / (groups - 1) / (within / (n - groups)), 6) AS f FROM t JOIN b USING (c_mktsegment) JOIN w USING (c_mktsegment)""")
def anova(spark, sf):
    a = so.anova(table(spark, sf, "customer"), "c_nationkey", "c_acctbal", ["c_mktsegment"])
    return a.select("c_mktsegment", "n", "groups", F.round("between", 2).alias("between_ss"), F.round("within", 2).alias("within_ss"), F.round("f", 6).alias("f"))


LABELLED = "l AS (SELECT d.lang, l.quality, d.n_chars::DOUBLE AS v FROM documents d JOIN labels l USING (doc_id))"


def labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("v")).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("t_statistic", f"""WITH {LABELLED}, m AS (SELECT lang, count(v) FILTER (WHERE quality = 0) AS n0, count(v) FILTER (WHERE quality = 1) AS n1, avg(v) FILTER (WHERE quality = 1) - avg(v) FILTER (WHERE quality = 0) AS d, var_samp(v) FILTER (WHERE quality = 0) AS v0, var_samp(v) FILTER (WHERE quality = 1) AS v1 FROM l GROUP BY lang)
SELECT lang, n0, n1, round(d, 4) AS difference, round(d / (sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) + 10), 6) AS t FROM m""")
def t_statistic(spark, sf):
    t = so.t_statistic(labelled(spark, sf), "quality", "v", ["lang"], fudge=10.0)
    return t.select("lang", "n0", "n1", F.round("difference", 4).alias("difference"), F.round("t", 6).alias("t"))


@query("rank_sum_test", f"""WITH {LABELLED}, c AS (SELECT lang, v, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rk FROM c),
m AS (SELECT lang, count(*) FILTER (WHERE quality = 1) AS n1, count(*) FILTER (WHERE quality = 0) AS n0, sum(rk) FILTER (WHERE quality = 1) AS s FROM l JOIN r USING (lang, v) GROUP BY lang),
z AS (SELECT *, s - n1 * (n1 + 1) / 2 AS u FROM m WHERE n1 > 0 AND n0 > 0), q AS (SELECT *, (u - n1 * n0 / 2) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12) AS z FROM z), p AS (SELECT *, CASE WHEN z < -6 THEN 0 WHEN z > 6 THEN 1 ELSE {NORMAL.format(z='z')} END AS cdf FROM q)
SELECT lang, n1, n0, u, round(z, 6) AS z, round(least(1, 2 * least(cdf, 1 - cdf)), 8) AS p FROM p""")
def rank_sum_test(spark, sf):
    r = so.rank_sum(labelled(spark, sf), "quality", "v", ["lang"])
    return r.select("lang", "n1", "n0", "u", F.round("z", 6).alias("z"), F.round("p", 8).alias("p"))


@query("signed_rank_test", f"""WITH l AS (SELECT l_shipdate::DATE - DATE '1995-01-01' AS day, l_returnflag AS k, l_quantity AS a, l_discount * 500 AS b FROM lineitem), d AS (SELECT k, round(a - b, 9) AS d FROM l), c AS (SELECT k, abs(d) AS v, count(*) AS n FROM d GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rk FROM c), m AS (SELECT d.k, count(*) AS n, sum(CASE WHEN d <= 0 THEN rk END) AS u FROM d JOIN r ON d.k = r.k AND abs(d.d) = r.v GROUP BY d.k)
SELECT k, n, u, round((u - n * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM m""")
def signed_rank_test(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.round(F.col("l_quantity") - F.col("l_discount") * 500, 9).alias("a"), F.lit(0.0).alias("b"))
    return so.signed_rank(li, "a", "b", ["k"]).select("k", "n", "u", F.round("z", 6).alias("z"))


@query("fisher_combined", """WITH p AS (SELECT event_type, (1 + event_id % 97) / 98.0::DOUBLE AS p FROM events), m AS (SELECT event_type, count(*) AS n, sum(-2 * ln(p)) AS x FROM p GROUP BY ALL)
SELECT event_type, n, round(x, 6) AS x2, round(list_sum(list_transform(range(0, n), lambda i: exp(i * ln(x / 2) - x / 2 - lgamma(i + 1)))), 8) AS p FROM m""")
def fisher_combined(spark, sf):
    p = table(spark, sf, "events").select("event_type", ((1 + F.col("event_id") % 97) / F.lit(98.0)).alias("p"))
    return so.fisher_combined(p, "p", ["event_type"]).select("event_type", "n", F.round("x2", 6).alias("x2"), F.round("p", 8).alias("p"))


@query("bh_adjusted", """WITH p AS (SELECT event_id, round((1 + event_id * 7919 % 9973) / 10000.0::DOUBLE * (value + 1) / (value + 20), 6) AS p FROM events), r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p),
x AS (SELECT p, max(r) AS r, any_value(m) AS m FROM r GROUP BY p), q AS (SELECT p, least(1, min(p * m / r) OVER (ORDER BY p DESC)) AS q FROM x) SELECT event_id, p, round(q, 9) AS q FROM p JOIN q USING (p)""")
def bh_adjusted(spark, sf):
    p = table(spark, sf, "events").select("event_id", F.round((1 + F.col("event_id") * 7919 % 9973) / F.lit(10000.0) * (F.col("value") + 1) / (F.col("value") + 20), 6).alias("p"))
    return so.benjamini_hochberg(p, "p").select("event_id", "p", F.round("q", 9).alias("q"))


PERM = """v AS (SELECT round(value * 100)::BIGINT - 2500 AS v FROM events), o AS (SELECT v * 10 AS s FROM v), e AS (SELECT i AS permutation, v * (4 + i) AS s FROM v, unnest(range(5)) AS t(i))"""


def permuted(spark, sf):
    v = table(spark, sf, "events").select((F.round(F.col("value") * 100).cast("long") - 2500).alias("v"))
    return v.select((F.col("v") * 10).alias("s")), v.select("v", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("permutation")).select("permutation", (F.col("v") * (4 + F.col("permutation"))).alias("s"))


@query("permutation_fdr", f"""WITH {PERM}, oc AS (SELECT abs(s) AS s, count(*) AS n FROM o GROUP BY ALL), ec AS (SELECT abs(s) AS s, count(*) AS n FROM e GROUP BY ALL),
a AS (SELECT s, (SELECT sum(n) FROM oc y WHERE y.s >= x.s) AS r, coalesce((SELECT sum(n) FROM ec y WHERE y.s > x.s), 0) / 5 AS ev FROM oc x)
SELECT s AS score, r::BIGINT AS observed, ev AS expected, round(least(1, ev / r), 9) AS fdr FROM a""")
def permutation_fdr(spark, sf):
    o, e = permuted(spark, sf)
    return so.permutation_fdr(o, e, "s", "permutation").withColumn("fdr", F.round("fdr", 9))


@query("family_wise_rate", f"""WITH {PERM}, m AS (SELECT permutation, max(abs(s)) AS s FROM e GROUP BY permutation) SELECT s AS score, (SELECT count(*) FROM m WHERE m.s >= x.s) / 5 AS fwer FROM (SELECT DISTINCT abs(s) AS s FROM o) x""")
def family_wise_rate(spark, sf):
    return so.family_wise(*permuted(spark, sf), "s", "permutation")


RANKED = """r AS (SELECT p_partkey AS gene, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, round(p_retailprice - 1000, 2) AS score FROM part), g AS (SELECT p_type || '/' || p_brand AS set_name, p_partkey AS gene FROM part)"""


@query("enrichment_score", f"""WITH {RANKED}, n AS (SELECT count(*) AS n FROM r), t AS (SELECT set_name, sum(abs(score)) AS total, count(*) AS k FROM g JOIN r USING (gene) GROUP BY set_name),
s AS (SELECT t.set_name, r.rank, r.score, sum(CASE WHEN g.gene IS NOT NULL THEN abs(r.score) / t.total ELSE -1.0::DOUBLE / (n - k) END) OVER (PARTITION BY t.set_name ORDER BY r.rank) AS es FROM t CROSS JOIN r CROSS JOIN n LEFT JOIN g ON g.gene = r.gene AND g.set_name = t.set_name),
b AS (SELECT *, row_number() OVER (PARTITION BY set_name ORDER BY round(abs(es), 9) DESC, rank) AS k FROM s) SELECT set_name, round(es, 6) AS es, rank AS at_rank, score AS at_score FROM b WHERE k = 1""")
def enrichment_score(spark, sf):
    p = table(spark, sf, "part")
    ranked = so.ordered_rank(p.select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", down=True).select(F.col("p_partkey").alias("gene"), "rank", F.round(F.col("p_retailprice") - 1000, 2).alias("score"))
    sets = p.select(F.concat_ws("/", "p_type", "p_brand").alias("set_name"), F.col("p_partkey").alias("gene"))
    return so.enrichment_score(ranked, sets).withColumn("es", F.round("es", 6))


@query("max_segment", """WITH v AS (SELECT user_id, event_id, round(value - 25, 2) AS v FROM events), p AS (SELECT *, sum(v) OVER w AS p, row_number() OVER w AS i FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT a.user_id, max(round(b.p - (a.p - a.v), 4)) AS best FROM p a JOIN p b ON a.user_id = b.user_id AND a.i <= b.i GROUP BY a.user_id) SELECT user_id, best FROM d""")
def max_segment(spark, sf):
    v = table(spark, sf, "events").select("user_id", "event_id", F.round(F.col("value") - 25, 2).alias("v"))
    return so.max_segment(v, ["user_id"], ["event_id"], "v").select("user_id", F.round("best", 4).alias("best"))


@query("empirical_distribution", """WITH h AS (SELECT event_type, least(greatest(floor(value / 2.5)::INTEGER, 0), 39)::INTEGER AS bin, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, bin, n, round(n / sum(n) OVER (PARTITION BY event_type), 9) AS density, round(sum(n) OVER (PARTITION BY event_type ORDER BY bin) / sum(n) OVER (PARTITION BY event_type), 9) AS cumulative FROM h""")
def empirical_distribution(spark, sf):
    h = so.empirical(table(spark, sf, "events"), "value", 0.0, 100.0, 40, ["event_type"])
    return h.withColumns({c: F.round(c, 9) for c in ("density", "cumulative")})


SCAN = f"""c AS (SELECT chr, k * 3600 AS window_start, count(*) AS n FROM (SELECT chr, start AS pos FROM reads), unnest(range(pos // 3600, pos // 3600 + 1)) AS t(k) GROUP BY ALL),
l AS (SELECT chr, count(*) / {AXIS}.0::DOUBLE AS lam FROM reads GROUP BY chr), s AS (SELECT c.*, lam, lam * 3600 AS m FROM c JOIN l USING (chr))"""


def scanned(spark, sf):
    r = reads(spark, sf)
    counts = ops.window_counts(r.select("chr", F.col("start").alias("pos")), 3_600, 3_600, ("chr",), F.lit(1.0)).select("chr", "window_start", "n")
    return counts.join(F.broadcast(r.groupBy("chr").agg((F.count("*") / F.lit(float(AXIS))).alias("lam"))), "chr")  # a row a reference


@query("scan_pvalues", f"""WITH {READS}, {SCAN}, a AS (SELECT *, ((n - m) / n) * (lam * ({AXIS} - 3600) * {PMF.format(k='(n - 1)', m='m')}) AS a FROM s)
SELECT chr, window_start, n, round(n / m, 6) AS enrichment, round(CASE WHEN n <= 2 THEN 1 ELSE least(1, abs(1 - {CDF.format(k='n - 1', m='m')} * exp(-a))) END, 8) AS p FROM a""")
def scan_pvalues(spark, sf):
    p = st.scan_pvalue(F.col("n"), F.col("lam"), F.lit(3600), F.lit(AXIS))
    return scanned(spark, sf).select("chr", "window_start", "n", F.round(F.col("n") / (F.col("lam") * 3600), 6).alias("enrichment"), F.round(p, 8).alias("p"))


@query("poisson_enrichment", f"""WITH {READS}, {SCAN}, w AS (SELECT window_start, max(CASE WHEN chr = 'click' THEN n END) AS a, max(CASE WHEN chr = 'view' THEN n END) AS b, (SELECT lam * 3600 FROM l WHERE chr = 'view') AS m FROM s GROUP BY window_start),
x AS (SELECT window_start, coalesce(a, 0)::BIGINT AS a, coalesce(b, 0)::BIGINT AS b, greatest(coalesce(b, 0), m) AS rate FROM w WHERE a IS NOT NULL OR b IS NOT NULL)
SELECT window_start, a, b, round(log2((a + 1) / (b + 1)), 6) AS log_ratio, round(1 - coalesce({CDF.format(k='a - 1', m='rate')}, 0), 8) AS p, round(list_sum(list_transform(range(a, a + b + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + i * ln(1.0::DOUBLE / 3) + (a + b - i) * ln(2.0::DOUBLE / 3)))), 8) AS p_binomial FROM x""")
def poisson_enrichment(spark, sf):
    s = scanned(spark, sf)
    m = s.where("chr = 'view'").agg(F.max("lam")).first()[0] * 3600
    w = s.where("chr in ('click', 'view')").groupBy("window_start").agg(F.coalesce(F.max(F.when(F.col("chr") == "click", F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.max(F.when(F.col("chr") == "view", F.col("n"))), F.lit(0)).alias("b"))
    rate = F.greatest(F.col("b").cast("double"), F.lit(m))
    n = F.col("a") + F.col("b")
    return w.select("window_start", "a", "b", F.round(F.log2((F.col("a") + 1) / (F.col("b") + 1)), 6).alias("log_ratio"), F.round(1 - st.poisson_cdf(F.col("a") - 1, rate), 8).alias("p"), F.round(st.binomial_tail(F.col("a"), n, F.lit(1 / 3)), 8).alias("p_binomial"))


@query("skellam_pvalues", f"""WITH {READS}, {SCAN}, w AS (SELECT window_start, (coalesce(max(CASE WHEN chr = 'click' THEN n END), 0) - coalesce(max(CASE WHEN chr = 'view' THEN n END), 0))::BIGINT AS k FROM s WHERE chr IN ('click', 'view') GROUP BY window_start),
r AS (SELECT max(CASE WHEN chr = 'click' THEN m END) AS ma, max(CASE WHEN chr = 'view' THEN m END) AS mb FROM s), i AS (SELECT unnest(range(0, (ma + mb + 40 * sqrt(ma + mb) + 100)::BIGINT)) AS i, ma, mb FROM r),
x AS (SELECT i, sum(exp(i * ln(ma) - ma - lgamma(i + 1))) OVER (ORDER BY i) AS c FROM i), y AS (SELECT i, exp(i * ln(mb) - mb - lgamma(i + 1)) AS p FROM i), u AS (SELECT k FROM w UNION SELECT k - 1 FROM w),
d AS (SELECT u.k, sum(y.p * coalesce(x.c, CASE WHEN u.k + y.i < 0 THEN 0 ELSE 1 END)) AS c FROM u CROSS JOIN y LEFT JOIN x ON x.i = u.k + y.i GROUP BY u.k)
SELECT window_start, w.k, round(least(a.c, 1 - b.c), 10) AS p FROM w JOIN d a ON a.k = w.k JOIN d b ON b.k = w.k - 1""")
def skellam_pvalues(spark, sf):
    """P-values of the difference of two samples' window counts; the SQL convolves the two Poisson masses."""
    s = scanned(spark, sf)
    rates = {r["chr"]: r["lam"] * 3600 for r in s.groupBy("chr").agg(F.max("lam").alias("lam")).collect()}  # a row a reference
    w = s.where("chr in ('click', 'view')").groupBy("window_start").agg((F.coalesce(F.max(F.when(F.col("chr") == "click", F.col("n"))), F.lit(0)) - F.coalesce(F.max(F.when(F.col("chr") == "view", F.col("n"))), F.lit(0))).alias("k"))
    distinct = w.select("k").distinct().withColumn("p", st.skellam_pvalue("k", F.lit(rates["click"]), F.lit(rates["view"])))
    return w.join(distinct, "k").select("window_start", "k", F.round("p", 10).alias("p"))


MX = f"WITH {MATRIX}"


def cells(m):
    return m.select("row", "col", F.round("value", 8).alias("value"))


def _axis_query(name, f, expr, axis):
    query(name, f"{MX} SELECT row, col, round({expr.format(a=axis)}, 8) AS value FROM matrix")(lambda spark, sf: cells(f(matrix(spark, sf), axis)))


for _axis in ("row", "col"):
    _axis_query(f"median_center_{_axis}s", mx.median_center, "value - median(value) OVER (PARTITION BY {a})", _axis)
    _axis_query(f"mean_normalize_{_axis}s", mx.mean_normalize, "value / avg(value) OVER (PARTITION BY {a})", _axis)
    _axis_query(f"density_normalize_{_axis}s", mx.density_normalize, "value / sum(value) OVER (PARTITION BY {a})", _axis)
    _axis_query(f"z_normalize_{_axis}s", mx.z_normalize, "(value - avg(value) OVER (PARTITION BY {a})) / stddev_samp(value) OVER (PARTITION BY {a})", _axis)


@query("z_normalize_log_cols", f"{MX}, l AS (SELECT row, col, log2(value) AS value FROM matrix) SELECT row, col, round((value - avg(value) OVER (PARTITION BY col)) / stddev_samp(value) OVER (PARTITION BY col), 8) AS value FROM l")
def z_normalize_log_cols(spark, sf):
    return cells(mx.z_normalize(matrix(spark, sf), "col", log=True))


@query("quantile_normalize", f"{MX}, k AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY value, row) AS k FROM matrix), q AS (SELECT k, avg(value) AS q FROM k GROUP BY k) SELECT row, col, round(q, 8) AS value FROM k JOIN q USING (k)")
def quantile_normalize(spark, sf):
    return cells(mx.quantile_normalize(matrix(spark, sf)))


@query("normalized_matrix", f"{MX}, t AS (SELECT col, sum(value) AS t FROM matrix GROUP BY col), f AS (SELECT col, (SELECT avg(t) FROM t) / t AS factor FROM t) SELECT row, col, round(value * factor, 6) AS value FROM matrix JOIN f USING (col)")
def normalized_matrix(spark, sf):
    m = matrix(spark, sf)
    return mx.scale_columns(m, mx.normalization_factors(m)).withColumn("value", F.round("value", 6))


@query("matrix_product", f"{MX} SELECT a.col AS row, b.col AS col, round(sum(a.value * b.value), 4) AS value FROM matrix a JOIN matrix b USING (row) GROUP BY ALL")
def matrix_product(spark, sf):
    m = matrix(spark, sf)
    return mx.multiply(mx.transpose(m), m).withColumn("value", F.round("value", 4))


@query("matrix_arithmetic", f"{MX} SELECT a.row, a.col, (a.value + greatest(b.value, 100)) - a.value * b.value AS value FROM matrix a JOIN matrix b ON a.row = b.row AND a.col = b.col")
def matrix_arithmetic(spark, sf):
    m = matrix(spark, sf)
    return mx.combine(mx.combine(m, mx.floor_at(m, 100.0), "plus"), mx.combine(m, m, "times"), "minus")


@query("varying_rows", f"{MX}, k AS (SELECT row FROM matrix GROUP BY row HAVING max(value) >= min(value) * 2 AND count(*) FILTER (WHERE value >= 150) >= 2) SELECT row, col, value FROM matrix WHERE row IN (SELECT row FROM k) AND col IN ('AF', 'NO', 'RF')")
def varying_rows(spark, sf):
    m = matrix(spark, sf)
    return mx.submatrix(mx.keep_reaching(mx.keep_varying(m, 2.0), 150.0, 2), columns=["AF", "NO", "RF"])


@query("column_correlation", f"{MX} SELECT x.col AS a, y.col AS b, count(*) AS n, round(corr(x.value, y.value), 8) AS r FROM matrix x JOIN matrix y ON x.row = y.row AND x.col < y.col GROUP BY ALL")
def column_correlation(spark, sf):
    return mx.column_correlation(matrix(spark, sf)).withColumn("r", F.round("r", 8))


@query("column_rank_correlation", f"""{MX}, c AS (SELECT col, value, count(*) AS n FROM matrix GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY col ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS k FROM c), m AS (SELECT row, col, k FROM matrix JOIN r USING (col, value))
SELECT x.col AS a, y.col AS b, count(*) AS n, round(corr(x.k, y.k), 8) AS r FROM m x JOIN m y ON x.row = y.row AND x.col < y.col GROUP BY ALL""")
def column_rank_correlation(spark, sf):
    return mx.column_correlation(matrix(spark, sf), ranks=True).withColumn("r", F.round("r", 8))


@query("column_distances", f"{MX} SELECT x.col AS a, y.col AS b, round(sqrt(sum((x.value - y.value) * (x.value - y.value))), 6) AS distance FROM matrix x JOIN matrix y ON x.row = y.row AND x.col < y.col GROUP BY ALL")
def column_distances(spark, sf):
    return mx.column_distance(matrix(spark, sf)).withColumn("distance", F.round("distance", 6))


def _merge_steps(most: int) -> str:
    """SQL of an average-linkage clustering in at most ``most`` steps: the closest two, ties by name, give one cluster with the mean distance of all their columns."""
    parts = ["d0 AS (SELECT a, b, 1 AS na, 1 AS nb, round(sqrt(sum((x - y) * (x - y))), 9) AS d FROM p GROUP BY a, b)"]
    for k in range(most):
        parts.append(f"m{k} AS (SELECT *, '(' || a || ',' || b || ')' AS c FROM d{k} ORDER BY d, a, b LIMIT 1)")
        parts.append(
            f"e{k} AS (SELECT m.c, m.na + m.nb AS nc, CASE WHEN e.a IN (m.a, m.b) THEN e.b ELSE e.a END AS z, CASE WHEN e.a IN (m.a, m.b) THEN e.nb ELSE e.na END AS nz, CASE WHEN m.a IN (e.a, e.b) THEN m.na ELSE m.nb END AS w, e.d "
            f"FROM d{k} e, m{k} m WHERE (e.a IN (m.a, m.b)) <> (e.b IN (m.a, m.b)))"
        )
        parts.append(
            f"d{k + 1} AS (SELECT e.a, e.b, e.na, e.nb, e.d FROM d{k} e, m{k} m WHERE e.a NOT IN (m.a, m.b) AND e.b NOT IN (m.a, m.b) UNION ALL "
            f"SELECT least(c, z), greatest(c, z), CASE WHEN c < z THEN nc ELSE nz END, CASE WHEN c < z THEN nz ELSE nc END, sum(w * d) / sum(w) FROM e{k} GROUP BY c, nc, z, nz)"
        )
    return ", ".join(parts) + " " + " UNION ALL ".join(f'SELECT {k}::BIGINT AS step, a AS "left", b AS "right", round(d, 6) AS height, (na + nb)::BIGINT AS size FROM m{k}' for k in range(most))


@query("column_clusters", f"WITH {MATRIX}, p AS (SELECT x.col AS a, y.col AS b, x.value AS x, y.value AS y FROM matrix x JOIN matrix y ON x.row = y.row AND x.col < y.col), {_merge_steps(6)}")
def column_clusters(spark, sf):
    """Average-linkage clustering of the columns."""
    d = mx.column_distance(matrix(spark, sf)).withColumn("distance", F.round("distance", 9))
    return mx.cluster_columns(d).withColumn("height", F.round("height", 6))


@query("best_probe", "SELECT p_brand AS gene, min(p_retailprice) AS p, arg_min(p_partkey, (p_retailprice, p_partkey)) AS probe FROM part GROUP BY p_brand")
def best_probe(spark, sf):
    return mx.best_probe(table(spark, sf, "part").select(F.col("p_brand").alias("gene"), F.col("p_retailprice").alias("p"), F.col("p_partkey").alias("probe")), "gene", "p")


@query("collapsed_rows", f"{MX} SELECT split_part(row, '/', 1) AS row, col, round(avg(value), 8) AS value FROM matrix GROUP BY ALL")
def collapsed_rows(spark, sf):
    m = matrix(spark, sf)
    return cells(mx.collapse_rows(m, m.select("row").distinct().withColumn("description", F.split_part("row", F.lit("/"), F.lit(1)))))


SETS = "g AS (SELECT DISTINCT s_nationkey AS set_name, l_partkey AS gene FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), n AS (SELECT set_name, count(*) AS n FROM g GROUP BY ALL), u AS (SELECT count(*) AS u FROM part)"


@query("gene_set_overlaps", f"""WITH {SETS}, s AS (SELECT x.set_name AS a, y.set_name AS b, count(*) AS shared FROM g x JOIN g y ON x.gene = y.gene AND x.set_name < y.set_name GROUP BY ALL), t AS (SELECT s.*, p.n AS size_a, q.n AS size_b, u FROM s JOIN n p ON p.set_name = a JOIN n q ON q.set_name = b, u)
SELECT a, b, shared, size_a, size_b, round(least(1, list_sum(list_transform(range(greatest(shared, size_a + size_b - u, 0), least(size_a, size_b) + 1), lambda i: exp(lgamma(size_b + 1) - lgamma(i + 1) - lgamma(size_b - i + 1) + lgamma(u - size_b + 1) - lgamma(size_a - i + 1) - lgamma(u - size_b - size_a + i + 1) - (lgamma(u + 1) - lgamma(size_a + 1) - lgamma(u - size_a + 1)))))), 6) AS p FROM t""")
def gene_set_overlaps(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    g = table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("set_name"), F.col("l_partkey").alias("gene"))
    return mx.gene_set_pairs(g, table(spark, sf, "part").count()).withColumn("p", F.round("p", 6))


@query("vector_distances", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), c AS (SELECT label, min(vec_id) AS first FROM e GROUP BY label), p AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM e a JOIN c USING (label) JOIN e b ON b.vec_id = c.first)
SELECT vec_id, round(list_distance(x, y), 8) AS euclidean, round(list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))), 8) AS manhattan,
  round(1 - list_inner_product(list_transform(x, lambda t: t - list_avg(x)), list_transform(y, lambda t: t - list_avg(y))) / sqrt(list_inner_product(list_transform(x, lambda t: t - list_avg(x)), list_transform(x, lambda t: t - list_avg(x))) * list_inner_product(list_transform(y, lambda t: t - list_avg(y)), list_transform(y, lambda t: t - list_avg(y)))), 8) AS pearson_distance FROM p""")
def vector_distances(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    first = e.groupBy("label").agg(F.min(F.struct("vec_id", F.col("x"))).alias("m")).select("label", F.col("m.x").alias("y"))
    x, y = F.col("x"), F.col("y")
    return e.join(first, "label").select("vec_id", F.round(st.euclidean(x, y), 8).alias("euclidean"), F.round(st.manhattan(x, y), 8).alias("manhattan"), F.round(st.pearson_distance(x, y), 8).alias("pearson_distance"))


@query("scalar_functions", """SELECT p_partkey, round(log2(p_retailprice), 9) AS log2_price, abs(p_retailprice / 1000 - 1) < 1e-8 AS near_one, factorial((p_size % 21)::INTEGER)::BIGINT AS fact, (factorial((p_size % 21)::INTEGER) / factorial((p_size % 21 // 2)::INTEGER) / factorial((p_size % 21 - p_size % 21 // 2)::INTEGER))::BIGINT AS choose, round(p_retailprice / p_size, 9) AS fold, round(greatest(p_retailprice / p_size, p_size / p_retailprice), 9) AS abs_fold, round(sqrt(p_size::DOUBLE * p_size + p_retailprice * p_retailprice), 6) AS hypotenuse FROM part""")
def scalar_functions(spark, sf):
    n = F.col("p_size") % 21
    return table(spark, sf, "part").select("p_partkey", F.round(F.log2("p_retailprice"), 9).alias("log2_price"), st.close_to_1(F.col("p_retailprice") / 1000).alias("near_one"), F.factorial(n).alias("fact"), st.binomial_coefficient(n, F.call_function("div", n, F.lit(2)).cast("int")).alias("choose"), F.round(st.fold(F.col("p_retailprice"), F.col("p_size")), 9).alias("fold"), F.round(st.abs_fold(F.col("p_retailprice"), F.col("p_size")), 9).alias("abs_fold"), F.round(F.hypot("p_size", "p_retailprice"), 6).alias("hypotenuse"))


@query("swap_test", """WITH li AS (SELECT l_orderkey, round(sum(l_quantity)::DOUBLE, 2) - round(sum(l_discount)::DOUBLE, 2) * 500 AS d FROM lineitem GROUP BY l_orderkey), o AS (SELECT round(sum(d), 4) AS observed FROM li),
s AS (SELECT i, sum(CASE WHEN strpos('0123456789abcdef', substr(md5(l_orderkey || '|' || i || '|7'), 15, 1)) % 2 = 0 THEN -d ELSE d END) AS s FROM li, range(50) AS t(i) GROUP BY i)
SELECT observed, count(*) AS n, avg((round(abs(s), 4) >= abs(observed))::INTEGER) AS p FROM s, o GROUP BY observed""")
def swap_test(spark, sf):
    """Seeded paired permutation test; its null mean and spread are tested, too."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity").cast("double"), 2).alias("a"), (F.round(F.sum("l_discount").cast("double"), 2) * 500).alias("b"))
    return so.swap_test(li, "a", "b", 50, "l_orderkey", 7)


_K, _ROUNDS = 6, 4


def _lloyd_steps() -> str:
    """SQL of ``_ROUNDS`` rounds of Lloyd's algorithm from the first ``_K`` vectors, centers rounded to six decimals."""
    far = "round(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9)"
    parts = ["e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)", f"c0 AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS k, list_transform(v, lambda x: round(x, 6)) AS c FROM e ORDER BY vec_id LIMIT {_K})"]
    for r in range(_ROUNDS + 1):
        parts.append(f"a{r} AS (SELECT vec_id, v, arg_min(k, ({far}, k)) AS k FROM e, c{r} GROUP BY vec_id, v)")
        if r < _ROUNDS:
            parts.append(f"u{r} AS (SELECT k, i, round(avg(v[i]), 6) AS x FROM a{r}, unnest(range(1, len(v) + 1)) AS t(i) GROUP BY k, i)")
            parts.append(f"c{r + 1} AS (SELECT c{r}.k, coalesce(n.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT k, list(x ORDER BY i) AS c FROM u{r} GROUP BY k) n USING (k))")
    return "WITH " + ", ".join(parts) + f" SELECT vec_id, k AS cluster FROM a{_ROUNDS}"


@query("kmeans_clusters", _lloyd_steps())
def kmeans_clusters(spark, sf):
    """Lloyd's algorithm over all embeddings from the first vectors, so that the result is the same everywhere."""
    e = table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    starts = [r["v"] for r in e.orderBy("vec_id").limit(_K).collect()]
    return mx.lloyd(e, "v", starts, _ROUNDS).select("vec_id", "cluster")


_EMITS = {"calm": (0.3, 0.05, 0.2, 0.15, 0.3), "rough": (0.2, 0.5, 0.05, 0.05, 0.2)}
_EMIT_SQL = {s: "ln(CASE event_type " + " ".join(f"WHEN '{t}' THEN {p}::DOUBLE" for t, p in zip(("click", "error", "purchase", "signup", "view"), ps, strict=True)) + " END)" for s, ps in _EMITS.items()}
_STEP = "p.{0} + ln({1}::DOUBLE)"


@query("hidden_states", f"""WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, {_EMIT_SQL['calm']} AS ec, {_EMIT_SQL['rough']} AS er FROM events),
p AS (SELECT user_id, i, ln(0.6::DOUBLE) + ec AS c, ln(0.4::DOUBLE) + er AS r, ['calm'] AS pc, ['rough'] AS pr FROM o WHERE i = 1 UNION ALL
SELECT o.user_id, o.i, greatest({_STEP.format('c', 0.8)}, {_STEP.format('r', 0.3)}) + ec, greatest({_STEP.format('c', 0.2)}, {_STEP.format('r', 0.7)}) + er,
list_append(CASE WHEN {_STEP.format('c', 0.8)} >= {_STEP.format('r', 0.3)} THEN p.pc ELSE p.pr END, 'calm'), list_append(CASE WHEN {_STEP.format('c', 0.2)} >= {_STEP.format('r', 0.7)} THEN p.pc ELSE p.pr END, 'rough') FROM p JOIN o ON o.user_id = p.user_id AND o.i = p.i + 1),
f AS (SELECT p.user_id, CASE WHEN c >= r THEN pc ELSE pr END AS path, greatest(c, r) AS best FROM p JOIN (SELECT user_id, max(i) AS i FROM o GROUP BY user_id) USING (user_id, i))
SELECT user_id, event_id, path[i] AS state, round(best, 6) AS log_likelihood FROM o JOIN f USING (user_id)""")
def hidden_states(spark, sf):
    """Most likely hidden states of each user's event sequence; tested against enumeration, too."""
    types = ("click", "error", "purchase", "signup", "view")
    emits = {s: dict(zip(types, ps, strict=True)) for s, ps in _EMITS.items()}
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return mx.viterbi(e, ["user_id"], "event_id", "event_type", {"calm": 0.6, "rough": 0.4}, {"calm": {"calm": 0.8, "rough": 0.2}, "rough": {"calm": 0.3, "rough": 0.7}}, emits).withColumn("log_likelihood", F.round("log_likelihood", 6))



