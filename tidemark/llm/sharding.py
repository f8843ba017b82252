"""Sharding: a Feistel permutation with cycle walking over global row numbers. DataFrame functions only.

Rows get global numbers in the order of (doc_id, checksum, size). The permutation of [0, n) is keyed, so the shuffle can be made
again, and from a row number alone the shard and the slot follow: with p the permuted number, shard = p mod shards and slot =
p div shards. Shard sizes in rows differ by one at most. The Feistel halves live in Z_a and Z_b with a*b just above n; numbers that
land beyond n walk on. The longest walk is computed beforehand from the few numbers beyond n, so a fixed count of steps is exact.

Defined results: a null text has no bytes and checksum 0; null ids come first; rows equal in id, checksum and size are
interchangeable and each get a slot of their own; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PRIME = 2_147_483_647
FACTOR = 1_103_515_245
#: Keys of the rounds; each pair makes one double round.
KEYS = ((104_729, 1_299_709), (15_485_863, 32_452_843), (49_979_687, 67_867_967))
#: Equal rows are spread over this many ranges.
SALTS = 64


def halves(n: int) -> tuple[int, int]:
    """a and b with a*b >= n and a*b - n < a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def round_value(r, key: int):
    """The round function: two keyed squarings modulo a prime. For ints, arrays and Columns alike."""
    t = (r * FACTOR + key) % PRIME
    t = (t * t + key) % PRIME
    return (t * t + r) % PRIME


def permute(x, a: int, b: int):
    """One pass of the permutation of [0, a*b), for ints and int64 arrays."""
    left, right = x // b, x % b
    for first, second in KEYS:
        left = (left + round_value(right, first)) % a
        right = (right + round_value(left, second)) % b
    return left * b + right


def longest_walk(n: int) -> int:
    """Passes that the longest cycle walk from any number below n takes: it passes through numbers from n on only."""
    a, b = halves(n)
    beyond = np.arange(n, a * b, dtype=np.int64)
    steps, at = 1, beyond
    while len(at):
        steps += 1
        at = permute(at, a, b)
        at = at[at >= n]
        if steps > len(beyond) + 2:  # only a cycle within the numbers beyond n, which no walk enters, is left
            break
    return steps


def permuted(number: Column, n: int) -> Column:
    """The permuted row number as a Column."""
    a, b = halves(n)

    def bound(value: Column, use) -> Column:
        """``use(value)`` with the value computed once."""
        return F.transform(F.array(value), lambda v: use(v))[0]

    def one(x: Column) -> Column:
        pair = F.struct(F.call_function("div", x, F.lit(b)).alias("l"), (x % b).alias("r"))
        for first, second in KEYS:
            pair = bound(pair, lambda p: F.struct(((p["l"] + round_value(p["r"], first)) % a).alias("l"), p["r"].alias("r")))  # noqa: B023
            pair = bound(pair, lambda p: F.struct(p["l"].alias("l"), ((p["r"] + round_value(p["l"], second)) % b).alias("r")))  # noqa: B023
        return bound(pair, lambda p: p["l"] * b + p["r"])

    walks = F.sequence(F.lit(1), F.lit(longest_walk(n)))
    start = F.named_struct(F.lit("x"), number, F.lit("go"), F.lit(True))
    walked = F.aggregate(
        walks, start,
        lambda s, _: F.when(s["go"], bound(one(s["x"]), lambda y: F.named_struct(F.lit("x"), y, F.lit("go"), y >= n))).otherwise(s),
        lambda s: s["x"],
    )
    return walked


def numbered(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32`` and ``row_number`` (from 0, by doc_id, checksum and size) of every row."""
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 16).cast("long").alias("size"), F.crc32(whole).cast("long").alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt").select(*order, F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    placed = materialize(placed, "sharding")
    # one row a partition: small by its making
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return placed.join(F.broadcast(starts), "part").select(*order, (F.col("start") + F.col("at")).alias("row_number"))


def shard(df: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row; law ``rows``: counts are at most one apart."""
    rows = numbered(df, doc_id, text)
    n = df.select(F.lit(1)).count()
    place = rows.withColumn("place", permuted(F.col("row_number"), n))
    return place.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
