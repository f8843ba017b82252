"""Column functions on half-open intervals [start, end) and on arrays of blocks ``struct<start, end>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of ``relationship``; fixed values.
LESSER, OVERLAP, GREATER = 1, 2, 4


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether a holds all of b."""
    return (a_start <= b_start) & (b_end <= a_end)


def adjacent(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start == b_end) | (a_end == b_start)


def relationship(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether a begins before b, overlaps it and ends after it, as bits."""
    bit = lambda cond, value: F.when(cond, F.lit(value)).otherwise(F.lit(0))
    return bit(a_start < b_start, LESSER) + bit(overlaps(a_start, a_end, b_start, b_end), OVERLAP) + bit(a_end > b_end, GREATER)


def distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Gap between the intervals, 0 if they overlap or touch."""
    return F.greatest(F.lit(0), b_start - a_end, a_start - b_end)


def span(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The union, gaps included."""
    return F.struct(F.least(a_start, b_start).alias("start"), F.greatest(a_end, b_end).alias("end"))


def intersection(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The common part; null if there is none."""
    return F.when(overlaps(a_start, a_end, b_start, b_end), F.struct(F.greatest(a_start, b_start).alias("start"), F.least(a_end, b_end).alias("end")))


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def oriented_start(start: Column, end: Column, strand: Column) -> Column:
    """First position in reading direction: the last base of the interval on the reverse strand."""
    return F.when(strand == "-", end - 1).otherwise(start)


def oriented_end(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "-", start).otherwise(end - 1)


def midpoint(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2).cast("long")


def expand(start: Column, end: Column, left: int, right: int) -> list[Column]:
    return [(start - left).alias("start"), (end + right).alias("end")]


def trim(start: Column, end: Column, strand: Column, first: int, last: int) -> list[Column]:
    """Without ``first`` positions at the oriented start and ``last`` at the oriented end."""
    back = strand == "-"
    return [F.when(back, start + last).otherwise(start + first).alias("start"), F.when(back, end - first).otherwise(end - last).alias("end")]


def blocks_length(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + (b["end"] - b["start"]))


def introns(blocks: Column) -> Column:
    """The gaps between sorted blocks."""
    return F.when(F.size(blocks) > 1, F.transform(F.sequence(F.lit(0), F.size(blocks) - 2), lambda i: F.struct(F.get(blocks, i)["end"].alias("start"), F.get(blocks, i + 1)["start"].alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def merge_blocks(blocks: Column) -> Column:
    """Sorted blocks with overlapping ones joined; those that only touch stay apart."""
    return F.aggregate(
        F.array_sort(blocks), F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda out, b: F.when(
            (F.size(out) > 0) & (b["start"] < F.get(out, F.size(out) - 1)["end"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.get(out, F.size(out) - 1)["start"].alias("start"), F.greatest(F.get(out, F.size(out) - 1)["end"], b["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(b))),
    )


def clip_blocks(blocks: Column, start: Column, end: Column) -> Column:
    """The parts of the blocks within [start, end)."""
    cut = F.transform(blocks, lambda b: F.struct(F.greatest(b["start"], start).alias("start"), F.least(b["end"], end).alias("end")))
    return F.filter(cut, lambda b: b["start"] < b["end"])


def minus_blocks(blocks: Column, start: Column, end: Column) -> Column:
    """The parts of the blocks outside [start, end)."""
    parts = F.flatten(F.transform(blocks, lambda b: F.array(F.struct(b["start"].alias("start"), F.least(b["end"], start).alias("end")), F.struct(F.greatest(b["start"], end).alias("start"), b["end"].alias("end")))))
    return F.filter(parts, lambda b: b["start"] < b["end"])


def to_spliced(blocks: Column, position: Column, strand: Column) -> Column:
    """Offset of a reference position within the sorted blocks, counted from the oriented start; null outside them."""
    before = F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + F.greatest(F.lit(0).cast("long"), F.least(b["end"], position) - b["start"]))
    inside = F.exists(blocks, lambda b: (b["start"] <= position) & (position < b["end"]))
    return F.when(inside, F.when(strand == "-", blocks_length(blocks) - 1 - before).otherwise(before))


def to_reference(blocks: Column, offset: Column, strand: Column) -> Column:
    """Reference position of an offset within the sorted blocks; null beyond them."""
    forward = F.when(strand == "-", blocks_length(blocks) - 1 - offset).otherwise(offset)
    found = F.aggregate(
        blocks, F.struct(forward.cast("long").alias("left"), F.lit(None).cast("long").alias("at")),
        lambda s, b: F.struct(
            (s["left"] - (b["end"] - b["start"])).alias("left"),
            F.when((s["left"] >= 0) & (s["left"] < b["end"] - b["start"]), b["start"] + s["left"]).otherwise(s["at"]).alias("at"),
        ),
        lambda s: s["at"],
    )
    return F.when(offset >= 0, found)


def first_bases(blocks: Column, n: int, strand: Column) -> Column:
    """Blocks of the first ``n`` spliced positions in reading direction."""
    return _part(blocks, n, strand, front=True)


def last_bases(blocks: Column, n: int, strand: Column) -> Column:
    """Blocks of the last ``n`` spliced positions in reading direction."""
    return _part(blocks, n, strand, front=False)


def _part(blocks: Column, n: int, strand: Column, *, front: bool) -> Column:
    total = blocks_length(blocks)
    low = F.when((strand == "-") == F.lit(front), F.greatest(F.lit(0).cast("long"), total - n)).otherwise(F.lit(0).cast("long"))
    high = F.least(total, low + n)
    kept = F.aggregate(
        blocks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out")),
        lambda s, b: F.struct((s["at"] + b["end"] - b["start"]).alias("at"), F.concat(s["out"], F.array(F.struct((b["start"] + F.greatest(F.lit(0).cast("long"), low - s["at"])).alias("start"), F.least(b["end"], b["start"] + (high - s["at"])).alias("end")))).alias("out")),
        lambda s: s["out"],
    )
    return F.filter(kept, lambda b: b["start"] < b["end"])
