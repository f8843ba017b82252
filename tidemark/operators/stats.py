"""Statistical operators on tables: ranks, tests, permutations, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats as st

#: Ranges of values that an ordered pass over one key is dealt into.
RANGES = 64


def with_ranges(df: DataFrame, value: str, keys: list[str], name: str = "__range") -> DataFrame:
    """The rows with the number of the range their value lies in, among ``RANGES`` that hold about as many rows of the key each.

    Bounds are approximate percentiles, at most ``RANGES`` numbers a key, from partial sketches. Equal values lie in one range; null is
    in the first.
    """
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    bounds = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), shares, F.lit(1000))).alias("__bounds"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    bounds = bounds.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    placed = df.join(bounds, same).drop(*[f"__k_{k}" for k in keys]) if keys else df.crossJoin(F.broadcast(bounds))  # one row without keys
    v = F.col(value).cast("double")
    return placed.withColumn(name, F.coalesce(F.size(F.filter("__bounds", lambda b: b < v)), F.lit(0))).drop("__bounds")


def running(df: DataFrame, value: str, keys: list[str], sums: dict[str, str], down: bool = False) -> DataFrame:
    """Running sums (new name to column) over rows in the order of distinct ``value`` within the keys, downwards with ``down``, the row itself included.

    In two levels: within ranges of the value, and over one row a range.
    """
    ranged = with_ranges(df, value, keys)
    order, outer = (F.desc(value), F.desc("__range")) if down else (F.asc(value), F.asc("__range"))
    totals = ranged.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(outer).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "__range", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in sums])
    within = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.select("*", *[F.sum(c).over(within).alias(f"__o_{n}") for n, c in sums.items()])
    same = F.col("a.__range") == F.col("b.__range")
    for k in keys:
        same &= F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    met = own.alias("a").join(carried.alias("b"), same)
    return met.select(*[F.col(f"a.`{c}`") for c in df.columns], *[(F.col(f"a.__o_{n}") + F.col(f"b.__c_{n}")).alias(n) for n in sums])


def summary(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Count, sum, mean, extremes, median, sample variance and deviation, geometric mean and median absolute deviation per key."""
    med = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.percentile(value, 0.5).alias("median"),
        F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("deviation"), F.exp(F.avg(F.when(F.col(value) > 0, F.log(value)))).alias("geometric_mean"),
    )
    near = df.select(*keys, value).join(med.select(*keys, "median"), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))
    return med.join(near, keys)


def ordered_rank(df: DataFrame, value: str, tie: str, down: bool = False, name: str = "rank") -> DataFrame:
    """Rows with their place from 1 by ``value`` (downwards with ``down``), equal values by ``tie``: values are counted and ranged, only rows of one value are ordered together."""
    counts = running(df.groupBy(value).agg(F.count("*").alias("__n")), value, [], {"__upto": "__n"}, down)
    within = F.row_number().over(Window.partitionBy(value).orderBy(tie))
    return df.withColumn("__k", within).join(counts, value).withColumn(name, (F.col("__upto") - F.col("__n") + F.col("__k")).cast("long")).drop("__k", "__n", "__upto")


def average_rank(df: DataFrame, value: Column | str, keys: list[str], name: str = "rank") -> DataFrame:
    """Ranks from 1 within the keys, ties sharing their mean. Equal values are counted first; the running sum is over distinct values."""
    v = F.col(value) if isinstance(value, str) else value
    marked = df.withColumn("__v", v)
    counts = marked.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    ranks = running(counts, "__v", keys, {"__s": "__n"}).withColumn(name, F.col("__s") - F.col("__n") + (F.col("__n") + 1) / 2).drop("__n", "__s")
    cond = F.col("a.__v").eqNullSafe(F.col("b.__v"))
    for k in keys:
        cond &= F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return marked.alias("a").join(ranks.alias("b"), cond).select("a.*", f"b.{name}").drop("__v")


def anova(df: DataFrame, group: str, value: str, keys: list[str]) -> DataFrame:
    """One-way analysis of variance per key: ``n, groups, between, within, f``, from one pass of moments."""
    g = df.groupBy(*keys, group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    t = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    t = t.withColumn("between", F.col("b") - F.col("s") * F.col("s") / F.col("n")).withColumn("within", F.col("q") - F.col("b"))
    f = F.try_divide(F.col("between") / (F.col("groups") - 1), F.col("within") / (F.col("n") - F.col("groups")))
    return t.select(*keys, "n", "groups", "between", "within", F.when((F.col("groups") > 1) & (F.col("n") > F.col("groups")), f).alias("f"))


def t_statistic(df: DataFrame, flag: str, value: str, keys: list[str], fudge: float = 0.0) -> DataFrame:
    """Difference of the means of two groups (flag 1 against 0) over its pooled standard error plus ``fudge``."""
    hit = lambda f: F.when(F.col(flag) == f, F.col(value))
    m = df.groupBy(*keys).agg(*[x for f in (0, 1) for x in (F.count(hit(f)).alias(f"n{f}"), F.avg(hit(f)).alias(f"m{f}"), F.var_samp(hit(f)).alias(f"v{f}"))])
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / F.nullif(F.col("n1") + F.col("n0") - 2, F.lit(0))
    return m.select(*keys, "n0", "n1", (F.col("m1") - F.col("m0")).alias("difference"), F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n0")))) + fudge).alias("t"))


def paired_t(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.groupBy(*keys).agg(F.count(d).alias("n"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d))).alias("t"))


def rank_sum(df: DataFrame, flag: str, value: str, keys: list[str]) -> DataFrame:
    """Mann-Whitney: ``u`` of the rows with flag 1, its z and the two-sided p by the normal approximation."""
    r = average_rank(df.select(*keys, flag, value), value, keys, "r")
    m = r.groupBy(*keys).agg(F.count_if(F.col(flag) == 1).alias("n1"), F.count_if(F.col(flag) == 0).alias("n0"), F.sum(F.when(F.col(flag) == 1, F.col("r"))).alias("s"))
    m = m.where("n1 > 0 and n0 > 0").withColumn("u", F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")  # their products go beyond a long
    z = (F.col("u") - n1 * n0 / 2) / F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12)
    cdf = st.normal_cdf(z)
    return m.select(*keys, "n1", "n0", "u", z.alias("z"), F.least(F.lit(1.0), 2 * F.least(cdf, 1 - cdf)).alias("p"))


def signed_rank(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Wilcoxon signed ranks: the rank sum of the differences <= 0, its z and two-sided p; infinite values are left out."""
    d = F.col(a) - F.col(b)
    rows = df.where((F.abs(F.col(a)) < float("inf")) & (F.abs(F.col(b)) < float("inf"))).select(*keys, d.alias("d"))
    r = average_rank(rows, F.abs(F.col("d")), keys, "r")
    m = r.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") <= 0, F.col("r"))), F.lit(0.0)).alias("u"))
    n = F.col("n").cast("double")  # its cube goes beyond a long
    z = (F.col("u") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    cdf = st.normal_cdf(z)
    return m.select(*keys, "n", "u", z.alias("z"), F.least(F.lit(1.0), 2 * F.least(cdf, 1 - cdf)).alias("p"))


def fisher_combined(df: DataFrame, p: str, keys: list[str], distinct: bool = False) -> DataFrame:
    """Fisher's combined p-value per key; 0 if any p is 0. ``distinct`` lets equal p-values count once."""
    rows = df.select(*keys, p).distinct() if distinct else df
    m = rows.groupBy(*keys).agg(F.count(p).alias("n"), F.min(p).alias("least"), F.sum(F.when(F.col(p) > 0, -2 * F.log(p))).alias("x"))
    x = F.when(F.col("least") > 0, F.col("x"))
    return m.select(*keys, "n", x.alias("x2"), F.when(F.col("least") <= 0, 0.0).otherwise(st.chi2_even_tail(F.col("x"), F.col("n"))).alias("p"))


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str] | None = None, name: str = "q") -> DataFrame:
    """Adjusted p-values. Distinct p-values are counted first; only they are ordered."""
    keys = keys or []
    counts = df.groupBy(*keys, p).agg(F.count("*").alias("__n"))
    ranked = running(counts, p, keys, {"__r": "__n"})
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__m"))
    ranked = ranked.join(totals, keys) if keys else ranked.crossJoin(F.broadcast(totals))
    ranked = with_ranges(ranked.withColumn("__q", F.col(p) * F.col("__m") / F.col("__r")), p, keys)
    # the least from this value upwards: within its range, and of the ranges above
    lows = ranked.groupBy(*keys, "__range").agg(F.min("__q").alias("__low"))
    above = Window.partitionBy(*keys).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    lows = lows.select(*keys, "__range", F.min("__low").over(above).alias("__above"))
    down = Window.partitionBy(*keys, "__range").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = ranked.withColumn("__own", F.min("__q").over(down)).join(lows, [*keys, "__range"])
    adjusted = adjusted.select(*keys, p, F.least(F.lit(1.0), "__own", "__above").alias(name))
    return df.join(adjusted, [*keys, p])


def permutation_fdr(observed: DataFrame, permuted: DataFrame, score: str, permutation: str, at_least: bool = True, none_is: float | None = 0.0, cap: bool = True) -> DataFrame:
    """For each distinct |score| observed: how many observed reach it (``>=``), how many permuted exceed it (``>``) on average over the
    permutations, and their ratio. Both counts come from one ordered pass over the distinct values. ``none_is``: the ratio where no
    observed value counts (None: the permuted mean)."""
    o = observed.select(F.abs(F.col(score)).alias("s"), F.lit(1).alias("o"), F.lit(0).alias("e"))
    e = permuted.select(F.abs(F.col(score)).alias("s"), F.lit(0).alias("o"), F.lit(1).alias("e"))
    n = permuted.select(permutation).distinct().count()
    totals = o.unionByName(e).groupBy("s").agg(F.sum("o").alias("o"), F.sum("e").alias("e"))
    met = running(totals, "s", [], {"ro": "o", "re": "e"}, down=True)
    r = F.col("ro") if at_least else F.col("ro") - F.col("o")
    out = met.select("s", "o", r.alias("r"), ((F.col("re") - F.col("e")) / n).alias("ev")).where("o > 0")
    ratio = F.when(F.coalesce("r", F.lit(0)) == 0, F.col("ev") if none_is is None else F.lit(none_is)).otherwise(F.col("ev") / F.col("r"))
    return out.select(F.col("s").alias("score"), F.coalesce("r", F.lit(0)).alias("observed"), F.col("ev").alias("expected"), (F.least(F.lit(1.0), ratio) if cap else ratio).alias("fdr"))


def family_wise(observed: DataFrame, permuted: DataFrame, score: str, permutation: str) -> DataFrame:
    """For each distinct observed score, the share of permutations whose greatest score reaches it."""
    most = permuted.groupBy(permutation).agg(F.max(F.abs(F.col(score))).alias("s"))
    n = most.count()
    both = observed.select(F.abs(F.col(score)).alias("s")).distinct().withColumn("w", F.lit(0)).unionByName(most.select("s", F.lit(1).alias("w")))
    totals = both.groupBy("s").agg(F.sum("w").alias("w"), F.max(1 - F.col("w")).alias("seen"))
    met = running(totals, "s", [], {"reached": "w"}, down=True)
    return met.where("seen = 1").select(F.col("s").alias("score"), (F.col("reached") / n).alias("fwer"))


def enrichment_score(ranked: DataFrame, sets: DataFrame, rank: str = "rank", gene: str = "gene", score: str = "score") -> DataFrame:
    """Weighted running-sum enrichment of each set over a ranked list: ``set_name, es, at_rank, at_score`` at the first largest deviation.

    Members step up by |score| over their total, others down by 1/(N - members); NaN and infinite scores weigh 0.01. Between members
    the sum falls linearly, so its extremes lie at or just before members and at the end: only the members are ordered.
    """
    n = ranked.count()
    weight = F.when(F.isnan(score) | (F.abs(F.col(score)) == float("inf")), 0.01).otherwise(F.abs(F.col(score)))
    hits = sets.select("set_name", F.col("gene").alias("__g")).distinct().join(ranked.select(F.col(gene).alias("__g"), F.col(rank).alias("r"), F.col(score).alias("s"), weight.alias("w")), "__g")
    totals = hits.groupBy("set_name").agg(F.sum("w").alias("total"), F.count("*").alias("k"))
    w = Window.partitionBy("set_name").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hits.join(totals, "set_name").withColumn("up", F.sum("w").over(w) / F.col("total")).withColumn("i", F.row_number().over(Window.partitionBy("set_name").orderBy("r")))
    h = h.withColumn("miss", F.try_divide(F.lit(1.0), F.lit(n) - F.col("k")))
    at = F.struct((F.col("up") - (F.col("r") - F.col("i")) * F.col("miss")).alias("es"), F.col("r").alias("rank"))
    before = F.when(F.col("r") > 1, F.struct((F.col("up") - F.col("w") / F.col("total") - (F.col("r") - F.col("i")) * F.col("miss")).alias("es"), (F.col("r") - 1).alias("rank")))
    points = h.select("set_name", F.explode(F.array_compact(F.array(at, before))).alias("p"))
    best = points.groupBy("set_name").agg(F.max(F.struct(F.round(F.abs(F.col("p.es")), 12).alias("a"), (-F.col("p.rank")).alias("nr"), F.col("p.es").alias("es"))).alias("m"))
    out = best.select("set_name", F.col("m.es").alias("es"), (-F.col("m.nr")).alias("at_rank"))
    return out.join(ranked.select(F.col(rank).alias("at_rank"), F.col(score).alias("at_score")), "at_rank").select("set_name", "es", "at_rank", "at_score")


def max_segment(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The contiguous run of rows with the largest sum per key: ``best`` and the ``order`` columns' place (row number) of its ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("__p", F.sum(value).over(upto)).withColumn("__i", F.row_number().over(w))
    rows = rows.withColumn("__b", F.struct((F.col("__p") - F.col(value)).alias("p"), F.col("__i").alias("i")))
    rows = rows.withColumn("__l", F.min("__b").over(upto)).withColumn("__d", F.col("__p") - F.col("__l.p"))
    best = rows.groupBy(*keys).agg(F.max(F.struct("__d", (-F.col("__i")).alias("e"), F.col("__l.i").alias("s"))).alias("m"))
    return best.select(*keys, F.col("m.__d").alias("best"), F.col("m.s").alias("first"), (-F.col("m.e")).alias("last"))


def empirical(df: DataFrame, value: str, low: float, high: float, bins: int, keys: list[str]) -> DataFrame:
    """Histogram of ``bins`` equal bins over [low, high) with density and cumulative share; values beyond fall into the end bins."""
    b = F.least(F.greatest(F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int"), F.lit(0)), F.lit(bins - 1))
    h = df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    per, run = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return h.select(*keys, "bin", "n", (F.col("n") / F.sum("n").over(per)).alias("density"), (F.sum("n").over(run) / F.sum("n").over(per)).alias("cumulative"))


def permuted_labels(df: DataFrame, permutations: int, unit: str, seed: int) -> DataFrame:
    """Every row once for each permutation with a seeded random ``coin`` (0 or 1) for its unit: the same on every run and machine."""
    each = df.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    return each.withColumn("coin", (seeded([F.col(unit), F.col("permutation")], seed) % 2).cast("int"))


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """The rows, with an error instead if there are more than ``most``: for what has to be in one place."""
    checked = df.agg(F.count("*").alias("__c")).select(F.when(F.col("__c") > most, F.raise_error(F.lit(f"more than {most} {what}")).cast("boolean")).otherwise(F.lit(True)).alias("__ok"))
    return df.crossJoin(F.broadcast(checked)).where("__ok").drop("__ok")  # one row


def seeded(columns: list[Column], seed: int) -> Column:
    """A number of 60 bits from the columns' text and the seed: the first 15 digits of an md5."""
    text = F.concat_ws("|", *[c.cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def swap_test(df: DataFrame, a: str, b: str, permutations: int, unit: str, seed: int) -> DataFrame:
    """Paired permutation test: ``observed`` sum of a - b and the share ``p`` of permutations, each pair swapped at random, that reach it."""
    d = F.col(a) - F.col(b)
    per = permuted_labels(df.select(unit, d.alias("d")), permutations, unit, seed).groupBy("permutation").agg(F.sum(F.when(F.col("coin") == 1, -F.col("d")).otherwise(F.col("d"))).alias("s"))
    seen = df.agg(F.sum(d).alias("observed"))
    return per.crossJoin(F.broadcast(seen)).groupBy("observed").agg(F.count("*").alias("n"), F.avg((F.abs("s") >= F.abs("observed")).cast("double")).alias("p"))
