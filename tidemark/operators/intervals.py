"""Relational operators on tables of half-open intervals: joins, islands, coverage, windows.

Sets are keyed by ``keys`` (as ``chr``, or ``chr`` and ``strand``). Overlap joins become equi-joins on fixed bins, so they shuffle by
(key, bin) and one crowded key is spread over its bins. Running sums and maxima are taken in two levels, within bins and over bins,
so that no task needs all rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import intervals as iv


def bins(start: Column, end: Column, width: int) -> Column:
    """All bins that [start, end) touches; an empty interval touches one."""
    div = lambda x: F.floor(x / F.lit(width)).cast("long")
    return F.sequence(div(start), div(F.greatest(start, end - 1)))


def _placed(df: DataFrame, start: str, end: str, width: int, long_from: int | None, mark: str) -> DataFrame:
    """The rows in each bin they touch: ``__level`` 0 with bins of ``width``; with ``long_from``, level 1 with bins of that, where long rows lie only and short ones, too."""
    s, e = F.col(start), F.col(end)
    cells = lambda w, level: F.transform(bins(s, e, w), lambda b: F.struct(F.lit(level).alias("l"), b.alias("b")))
    if long_from is None:
        return df.withColumns({f"__level{mark}": F.lit(0), f"__long{mark}": F.lit(False)}).withColumn(f"__bin{mark}", F.explode(bins(s, e, width)))
    is_long = e - s >= long_from
    # the fine bins of a long row are never made
    fine = F.when(is_long, F.array().cast("array<struct<l:int,b:bigint>>")).otherwise(cells(width, 0))
    out = df.withColumn(f"__long{mark}", is_long).withColumn(f"__cell{mark}", F.explode(F.concat(fine, cells(long_from, 1))))
    return out.withColumns({f"__level{mark}": F.col(f"__cell{mark}.l"), f"__bin{mark}": F.col(f"__cell{mark}.b")}).drop(f"__cell{mark}")


def overlap_join(left: DataFrame, right: DataFrame, width: int, keys: tuple[str, ...] = ("chr",), how: str = "inner", contained: bool = False, long_from: int | None = None) -> DataFrame:
    """Pairs of overlapping intervals (with ``contained``: the right one within the left); ``how``: inner, left_semi or left_anti.

    Columns of the right side that the left side has too get the suffix ``_r``. Each pair is met in the bin of the later start only.
    ``width`` should be about the usual length of the intervals: each is copied to every bin it touches. Where some are very much
    longer, ``long_from`` (a multiple of the width) puts those of at least this length into bins of this width; pairs with one of them
    are met there, all others in the fine bins.
    """
    b = F.col("__bin")
    r = right.withColumnsRenamed({c: f"{c}_r" for c in right.columns if c in left.columns})
    rn = lambda c: f"{c}_r" if c in left.columns else c
    lefts = _placed(left, "start", "end", width, long_from, "")
    rights = _placed(r, rn("start"), rn("end"), width, long_from, "_r")
    own = F.when(F.col("__level") == 0, F.lit(width)).otherwise(F.lit(long_from)) if long_from else F.lit(width)
    later = F.floor(F.greatest(F.col("start"), F.col(rn("start"))) / own).cast("long")
    cond = (b == F.col("__bin_r")) & iv.overlaps(F.col("start"), F.col("end"), F.col(rn("start")), F.col(rn("end")))
    if long_from:
        cond &= (F.col("__level") == F.col("__level_r")) & ((F.col("__level") == 0) | F.col("__long") | F.col("__long_r"))
    if contained:
        cond &= iv.contains(F.col("start"), F.col("end"), F.col(rn("start")), F.col(rn("end")))
    for k in keys:
        cond &= F.col(k) == F.col(rn(k))
    if how == "inner":
        return lefts.join(rights, cond & (b == later)).drop(*[f"__{c}{m}" for c in ("bin", "level", "long") for m in ("", "_r")])
    # membership depends on the key and the interval alone, so repeated rows and columns of any type are left as they are
    own = [*keys, "start", "end"]
    found = lefts.select(*own, "__bin", "__level", "__long").distinct().join(rights, cond, "left_semi").select(*[F.col(c).alias(f"__{c}") for c in own]).distinct()
    same = F.lit(True)
    for c in own:
        same &= F.col(c) == F.col(f"__{c}")
    return left.join(found, same, how)


def largest_parents(df: DataFrame, width: int, keys: tuple[str, ...] = ("chr",)) -> DataFrame:
    """``name, parent``: for each interval the longest other one that holds it, of equally long ones that of the least name; none without.

    Whatever holds a holder holds the interval, too, so only intervals that no longer one holds are met: those that end beyond all
    that start before them, each with its two least names.
    """
    place = F.dense_rank().over(Window.partitionBy(*keys, "start", "end").orderBy("name"))
    least = df.where(F.col("name").isNotNull()).select("name", *keys, "start", "end").withColumn("__k", place).where("__k <= 2")
    spans = least.groupBy(*keys, "start", "end").agg(F.min("name").alias("__first"), F.max("name").alias("__second"))
    longest = spans.groupBy(*keys, "start").agg(F.max(F.struct("end", "__first", "__second")).alias("m")).select(*keys, "start", "m.*")
    ahead = two_level(longest, keys, ["start"], "start", F.col("end"), "max", 1 << 16, "__before", inclusive=False)
    top = ahead.where(F.col("__before").isNull() | (F.col("end") > F.col("__before"))).drop("__before")
    found = overlap_join(df.select("name", *keys, "start", "end"), top, width, keys).where((F.col("start_r") <= F.col("start")) & (F.col("end") <= F.col("end_r")))
    other = F.when(F.col("__first") != F.col("name"), F.col("__first")).when(F.col("__second") != F.col("name"), F.col("__second"))
    best = found.groupBy("name").agg(F.max(F.struct((F.col("end_r") - F.col("start_r")).alias("size"), (-other).alias("p"))).alias("m"))
    return best.where("m.p IS NOT NULL").select("name", (-F.col("m.p")).alias("parent"))


def two_level(df: DataFrame, keys: tuple[str, ...], order: list, position: str | Column, value: Column, how: str, width: float, name: str, inclusive: bool = True) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` over rows ordered by ``order`` within ``keys`` as column ``name``.

    Rows are dealt by (keys, bin of the position, which must not fall along the order); what earlier bins add is one row a bin.
    """
    agg = F.sum if how == "sum" else F.max
    at = F.col(position) if isinstance(position, str) else position
    binned = df.withColumn("__bin", F.floor(at / F.lit(width)).cast("long")).withColumn("__v", value)
    totals = binned.groupBy(*keys, "__bin").agg(agg("__v").alias("__t"))
    over_bins = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "__bin", agg("__t").over(over_bins).alias("__c"))
    within = Window.partitionBy(*keys, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    own = agg("__v").over(within)
    out = binned.withColumn("__own", own).join(carried, [*keys, "__bin"])
    if how == "sum":
        total = F.coalesce("__own", F.lit(0)) + F.coalesce("__c", F.lit(0))
    else:
        total = F.greatest("__own", "__c")
    return out.withColumn(name, total).drop("__bin", "__v", "__own", "__c")


def islands(df: DataFrame, keys: tuple[str, ...] = ("chr",), width: int = 1 << 16, gap: int = 0) -> DataFrame:
    """Every row with the number ``island`` of the run of overlapping intervals it belongs to (from 0 in each key).

    Intervals that only touch are different islands; with ``gap`` those that lie up to that far apart are joined.
    """
    order = ["start", "end"]
    ahead = two_level(df, keys, order, "start", F.col("end"), "max", width, "__before", inclusive=False)
    fresh = F.when(F.col("__before").isNull() | (F.col("start") >= F.col("__before") + gap), 1).otherwise(0)
    return two_level(ahead.withColumn("__new", fresh), keys, [*order, F.desc("__new")], "start", F.col("__new"), "sum", width, "__n").withColumn("island", (F.col("__n") - 1).cast("long")).drop("__before", "__new", "__n")


def merge(df: DataFrame, keys: tuple[str, ...] = ("chr",), width: int = 1 << 16, gap: int = 0) -> DataFrame:
    """``keys, start, end, n`` of the islands."""
    marked = islands(df.select(*keys, "start", "end"), keys, width, gap)
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def edges(df: DataFrame, keys: tuple[str, ...], weight: Column) -> DataFrame:
    """``keys, pos, w``: what the weights of the intervals that begin and end at a place add up to there."""
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), weight.alias("w")), F.struct(F.col("end").alias("pos"), (-weight).alias("w"))))
    return df.select(*keys, ends.alias("e")).select(*keys, F.col("e.pos").alias("pos"), F.col("e.w").alias("w")).groupBy(*keys, "pos").agg(F.sum("w").alias("w"))


def stretches(steps: DataFrame, keys: tuple[str, ...], width: int) -> DataFrame:
    """``keys, start, end, w, depth`` between each place of ``steps`` (keys, pos, w) and the next one: its own weight and the sum up to it.

    In two levels: within bins, and over one row a bin, which holds the bin's sum and first place.
    """
    binned = steps.withColumn("__bin", F.floor(F.col("pos") / F.lit(width)).cast("long"))
    totals = binned.groupBy(*keys, "__bin").agg(F.sum("w").alias("__t"), F.min("pos").alias("__first"))
    over = Window.partitionBy(*keys).orderBy("__bin")
    carried = totals.select(*keys, "__bin", F.sum("__t").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__c"), F.lead("__first").over(over).alias("__next"))
    within = Window.partitionBy(*keys, "__bin").orderBy("pos")
    own = binned.withColumn("__own", F.sum("w").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__lead", F.lead("pos").over(within))
    out = own.join(carried, [*keys, "__bin"])
    return out.select(*keys, F.col("pos").alias("start"), F.coalesce("__lead", "__next").alias("end"), "w", (F.col("__own") + F.coalesce("__c", F.lit(0))).alias("depth")).where(F.col("end").isNotNull())


def touching(df: DataFrame, keys: tuple[str, ...] = ("chr",), width: int = 1 << 16) -> DataFrame:
    """``keys, start, end`` of the covered stretches, those that touch joined."""
    return joined_parts(coverage(df, keys, width).where("depth > 0"), keys, width)


def joined_parts(parts: DataFrame, keys: tuple[str, ...], width: int) -> DataFrame:
    """Disjoint intervals with those that touch joined: an end and a beginning at one place cancel each other out."""
    left = edges(parts, keys, F.lit(1)).where("w <> 0")
    return stretches(left, keys, width).where("w > 0").select(*keys, "start", "end")


def coverage(df: DataFrame, keys: tuple[str, ...] = ("chr",), width: int = 1 << 16, weight: str | None = None) -> DataFrame:
    """``keys, start, end, depth``: the stretches between consecutive interval ends and how many intervals (or what weight) lie over them."""
    return stretches(edges(df, keys, F.col(weight) if weight else F.lit(1).cast("long")), keys, width).drop("w")


def complement(df: DataFrame, lengths: DataFrame, keys: tuple[str, ...] = ("chr",), width: int = 1 << 16) -> DataFrame:
    """``keys, start, end`` of what the intervals leave uncovered of [0, length)."""
    ends = merge(df, keys, width).select(*keys, "start", "end").unionByName(lengths.select(*keys, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))).unionByName(lengths.select(*keys, F.col("length").alias("start"), F.col("length").alias("end")))
    gaps = two_level(ends, keys, ["start", "end"], "start", F.col("end"), "max", width, "__before", inclusive=False)
    return gaps.select(*keys, F.col("__before").alias("start"), F.col("start").alias("end")).where("start < end")


def minus(a: DataFrame, b: DataFrame, width: int, keys: tuple[str, ...] = ("chr",)) -> DataFrame:
    """The covered stretches of a that b doesn't cover: ``keys, start, end``."""
    both = a.select(*keys, "start", "end", F.lit(1).cast("long").alias("w")).unionByName(b.select(*keys, "start", "end", F.lit(1 << 32).cast("long").alias("w")))
    parts = coverage(both, keys, width, "w").where((F.col("depth") > 0) & (F.col("depth") < 1 << 32))
    return joined_parts(parts, keys, width)


def nearest(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("chr",), id_a: str = "name", id_b: str = "name", width: int = 1 << 16) -> DataFrame:
    """For each row of a, the distance to the nearest row of b and the smallest id among the nearest: ``keys, id_a, near, distance``.

    Candidates are the overlapping ones (distance 0), the b that ends last before a's start and the one that starts first after its
    end; both come from one ordered pass in two levels, not from pairs.
    """
    at = "struct<at:bigint,id:bigint>"

    def last_before(ours: Column, theirs: Column, names: list[str]) -> DataFrame:
        """For each of our places, the greatest of theirs at or before it and the smallest id there."""
        they = b.select(*keys, theirs.alias("pos"), F.lit(0).alias("side"), F.struct(theirs.alias("at"), (-F.col(id_b)).alias("id")).cast(at).alias("b"), F.lit(None).cast("long").alias("aid"))
        we = a.select(*keys, ours.alias("pos"), F.lit(1).alias("side"), F.lit(None).cast(at).alias("b"), F.col(id_a).alias("aid"))
        met = two_level(they.unionByName(we), keys, ["pos", "side"], "pos", F.col("b"), "max", width, "m").where("side = 1")
        return met.select(*keys, "aid", F.col("m.at").alias(names[0]), (-F.col("m.id")).alias(names[1]))

    left = last_before(F.col("start"), F.col("end"), ["l_at", "l_id"])
    # the other way round on the mirrored axis
    right = last_before(-F.col("end"), -F.col("start"), ["r_at", "r_id"]).withColumn("r_at", -F.col("r_at"))
    length = b.agg(F.percentile_approx(F.col("end") - F.col("start"), 0.9)).first()[0] or 1
    over = overlap_join(a.select(*keys, "start", "end", F.col(id_a).alias("aid")), b.select(*keys, "start", "end", F.col(id_b).alias("bid")), max(1, int(length)), keys).groupBy(*keys, "aid").agg(F.min("bid").alias("o_id"))
    out = a.select(*keys, F.col(id_a).alias("aid"), "start", "end").join(left, [*keys, "aid"], "left").join(right, [*keys, "aid"], "left").join(over, [*keys, "aid"], "left")
    l_d, r_d = F.col("start") - F.col("l_at"), F.col("r_at") - F.col("end")
    best = F.when(F.col("o_id").isNotNull(), F.lit(0).cast("long")).otherwise(F.least(l_d, r_d))
    choice = F.when(F.col("o_id").isNotNull() & F.lit(True), F.least("o_id", F.when(l_d == 0, F.col("l_id")), F.when(r_d == 0, F.col("r_id")))).otherwise(F.least(F.when(l_d == best, F.col("l_id")), F.when(r_d == best, F.col("r_id"))))
    return out.select(*keys, F.col("aid").alias(id_a), choice.alias("near"), best.alias("distance"))


def fixed_windows(references: DataFrame, size: int, step: int, keys: tuple[str, ...] = ("chr",)) -> DataFrame:
    """Windows of ``size`` at every ``step`` while the start lies below the length; the last ones overhang the end."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))
    rows = references.where("length > 0").select(*keys, F.explode(starts).alias("start"))
    return rows.select(*keys, "start", (F.col("start") + size).alias("end"))


def sliding_windows(regions: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` within each region at steps of size - overlap; one that would end exactly at the region's end is left out."""
    step = size - overlap
    starts = F.when(F.col("end") - F.col("start") > size, F.sequence(F.col("start"), F.col("end") - size - 1, F.lit(step).cast("long")))
    others = [c for c in regions.columns if c not in ("start", "end")]
    rows = regions.select(*others, F.explode(starts).alias("start"))
    return rows.select(*others, "start", (F.col("start") + size).alias("end"))


def window_counts(points: DataFrame, size: int, step: int, groups: tuple[str, ...], value: Column, pos: str = "pos") -> DataFrame:
    """Sum of ``value`` per group and window start for points, windows of ``size`` at every ``step``: each point goes to its windows directly, without a join."""
    first = F.floor((F.col(pos) - size) / F.lit(step)).cast("long") + 1
    last = F.floor(F.col(pos) / F.lit(step)).cast("long")
    rows = points.withColumn("__v", value).withColumn("window_start", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)))
    rows = rows.withColumn("window_start", F.col("window_start") * step)
    return rows.groupBy(*groups, "window_start").agg(F.sum("__v").alias("total"), F.count("*").alias("n"))
