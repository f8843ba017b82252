"""Ordered lookups, comparison of distributions, differential expression, amplicons and primers, library statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import sequences as sq
from tidemark.operators import stats as so
from tidemark.operators.intervals import two_level


def interval_index(df: DataFrame, keys: tuple[str, ...] = ("chr",), width: int = 1 << 16, ties: tuple[str, ...] = ()) -> DataFrame:
    """Every interval with its place (from 0) on its reference, by start and, of equal starts, the longer first, and whether it is the first or the last there.

    Equal intervals come in the order of the columns ``ties``, without which their order is open."""
    ends = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    out = two_level(df, keys, ["start", F.desc("end"), *ties], "start", F.lit(1), "sum", width, "__k").withColumn("place", F.col("__k") - 1).join(ends, list(keys))
    return out.withColumn("is_first", F.col("place") == 0).withColumn("is_last", F.col("place") == F.col("__n") - 1).drop("__n", "__k")


def floor_lookup(probes: DataFrame, df: DataFrame, keys: tuple[str, ...] = ("chr",), width: int = 1 << 16) -> DataFrame:
    """For each probe (keys, pos) the greatest start at or below it, and the least above it: an ordered pass each way over both."""
    both = probes.select(*keys, "pos", F.lit(1).alias("side"), F.lit(None).cast("long").alias("start")).unionByName(df.select(*keys, F.col("start").alias("pos"), F.lit(0).alias("side"), F.col("start").cast("long").alias("start")))
    up = two_level(both, keys, ["pos", "side"], "pos", F.col("start"), "max", width, "floor")
    # downwards, probes before the starts at their own place
    down = two_level(up, keys, [F.desc("pos"), F.desc("side")], -F.col("pos"), -F.col("start"), "max", width, "above")
    return down.where("side = 1").select(*keys, "pos", "floor", (-F.col("above")).alias("above"))


def compare_distributions(df: DataFrame, group: str, a: str, b: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Kullback-Leibler divergence (nats, with a pseudo-count of one a bin) and Kolmogorov-Smirnov distance of two groups' histograms."""
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    h = so.empirical(df.where(F.col(group).isin(a, b)), value, low, high, bins, [group])
    counts = every.join(h.groupBy("bin").agg(F.max(F.when(F.col(group) == a, F.col("n"))).alias("x"), F.max(F.when(F.col(group) == b, F.col("n"))).alias("y")), "bin", "left").fillna(0)
    totals = counts.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a bin
    c = counts.crossJoin(F.broadcast(totals)).withColumn("p", (F.col("x") + 1) / (F.col("sx") + bins)).withColumn("q", (F.col("y") + 1) / (F.col("sy") + bins))
    c = c.withColumn("d", F.abs(F.sum("x").over(run) / F.col("sx") - F.sum("y").over(run) / F.col("sy")))
    return c.agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"), F.max("d").alias("ks"))


def differential_expression(m: DataFrame, labels: DataFrame, fudge: float = 0.0) -> DataFrame:
    """Long matrix and ``col, flag`` (0 or 1): t statistic, difference and fold of the means per row."""
    joined = m.join(labels, "col")
    t = so.t_statistic(joined, "flag", "value", ["row"], fudge)
    fold = joined.groupBy("row").agg(F.try_divide(F.avg(F.when(F.col("flag") == 1, F.col("value"))), F.avg(F.when(F.col("flag") == 0, F.col("value")))).alias("fold"))
    return t.join(fold, "row")


def batch_center(m: DataFrame, batches: DataFrame) -> DataFrame:
    """Values less their row's mean within the batch of their column (``col, batch``), plus the row's mean over all."""
    joined = m.join(batches, "col")
    per = joined.groupBy("row", "batch").agg(F.avg("value").alias("b"))
    over = m.groupBy("row").agg(F.avg("value").alias("a"))
    return joined.join(per, ["row", "batch"]).join(over, "row").select("row", "col", (F.col("value") - F.col("b") + F.col("a")).alias("value"))


def discrete(m: DataFrame, low: float, high: float) -> DataFrame:
    """-1 at or below ``low``, 1 at or above ``high``, else 0."""
    return m.select("row", "col", F.when(F.col("value") <= low, -1).when(F.col("value") >= high, 1).otherwise(0).alias("value"))


def amplicons(sequences: DataFrame, forward: str, backward: str, least: int, most: int) -> DataFrame:
    """``id, amplicon``: stretches from the forward primer to the reverse complement of the backward one, ``least`` to ``most`` long, the shortest from each forward site that ends first."""
    back = backward.upper()[::-1].translate(str.maketrans("ACGT", "TGCA"))
    inner = len(forward) + len(back)
    pattern = f"{forward.upper()}.{{{max(0, least - inner)},{max(0, most - inner)}}}?{back}"
    return sequences.select("id", F.explode(F.regexp_extract_all(F.upper("seq"), F.lit(pattern), F.lit(0))).alias("amplicon"))


def melting_point(seq: Column) -> Column:
    """Degrees Celsius: 2 for each A or T and 4 for each G or C below 14 bases, else 64.9 + 41 (GC - 16.4) / n."""
    n, gc = F.length(seq), F.length(F.regexp_replace(seq, "[^GCgc]", ""))
    return F.when(n < 14, 2.0 * (n - gc) + 4.0 * gc).otherwise(64.9 + 41 * (gc - 16.4) / n)


def primer_scores(df: DataFrame, keys: list[str], seq: str, length: int) -> DataFrame:
    """``keys, start, tm`` of every window of ``length`` bases; a shorter sequence is one window, an empty one none."""
    n = F.length(seq)
    starts = F.when(n > length, F.sequence(F.lit(0), n - length)).when(n > 0, F.array(F.lit(0)))
    each = df.select(*keys, F.col(seq).alias("__s"), F.explode(starts).alias("start"))
    return each.select(*keys, "start", melting_point(F.substring("__s", F.col("start") + 1, F.lit(length))).alias("tm"))


def has_hairpin(seq: Column, stem: int, loop: int = 3) -> Column:
    """Whether some ``stem`` bases meet their reverse complement at least ``loop`` bases further on."""
    starts = F.sequence(F.lit(1), F.length(seq) - 2 * stem - loop + 1)
    hit = F.exists(starts, lambda i: F.contains(F.substring(seq, i + stem + loop, F.length(seq)), sq.reverse_complement(F.substring(seq, i, F.lit(stem)))))
    return F.when(F.length(seq) >= 2 * stem + loop, hit).otherwise(F.lit(False))


def restriction_sites(sequences: DataFrame, sites: dict[str, str]) -> DataFrame:
    """``id, enzyme, n``: how often each enzyme's site occurs, overlaps included."""
    rows = None
    for enzyme, site in sorted(sites.items()):
        n = F.size(F.filter(sq.kmers(F.upper("seq"), len(site)), lambda k: k == F.lit(site.upper())))  # noqa: B023
        part = sequences.select("id", F.lit(enzyme).alias("enzyme"), n.alias("n"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def library_stats(fastq: DataFrame) -> DataFrame:
    """``reads, bases, least, most, mean_length, gc, distinct_reads`` of FASTQ records."""
    return fastq.agg(
        F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"), F.min(F.length("seq")).alias("least"), F.max(F.length("seq")).alias("most"), F.avg(F.length("seq")).alias("mean_length"),
        (F.sum(F.length(F.regexp_replace("seq", "[^GCgc]", ""))) / F.sum(F.length("seq"))).alias("gc"), F.count_distinct("seq").alias("distinct_reads"),
    )
