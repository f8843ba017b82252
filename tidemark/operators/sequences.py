"""Relational operators on sequences, permutations, coordinate spaces, trees and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import sequences as sq
from tidemark.operators.intervals import overlap_join
from tidemark.operators.stats import seeded
from tidemark.sources.scratch import written_table


def kmer_counts(df: DataFrame, seq: str, k: int, keys: list[str] | None = None) -> DataFrame:
    """``keys, kmer, n``."""
    keys = keys or []
    return df.select(*keys, F.explode(sq.kmers(F.col(seq), k)).alias("kmer")).groupBy(*keys, "kmer").agg(F.count("*").alias("n"))


def regions(sequences: DataFrame, wanted: DataFrame) -> DataFrame:
    """``name`` and ``seq`` of [start, end) of each reference; the reverse strand is read backwards."""
    part = F.substring(F.col("whole"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    joined = wanted.join(sequences.select(F.col("id").alias("chr"), F.col("seq").alias("whole")), "chr")
    return joined.select("name", "chr", "start", "end", F.when(F.col("strand") == "-", sq.reverse_complement(part)).otherwise(part).alias("seq"))


def pwm_hits(df: DataFrame, seq: str, pwm: list[list[float]], least: float, keys: list[str]) -> DataFrame:
    """Places (from 0) where the matrix scores at least ``least``: ``keys, at, score``."""
    found = df.select(*keys, F.posexplode(sq.pwm_scores(F.col(seq), pwm)).alias("at", "score"))
    return found.where(F.col("score") >= least)


def combinations(items: DataFrame, column: str, r: int) -> DataFrame:
    """All r-element combinations in lexicographic order of places, one row each; the items are few by intention."""
    base = items.select(F.col(column).alias("c1"))
    out = base
    for i in range(2, r + 1):
        out = out.join(items.select(F.col(column).alias(f"c{i}")), F.col(f"c{i - 1}") < F.col(f"c{i}"))
    return out


def shuffled(df: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """Rows with a seeded random ``place`` from 1 within the keys, the same on every run."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed)), *df.columns)
    return df.withColumn("place", F.row_number().over(order))


def permute_annotations(annotations: DataFrame, lengths: DataFrame, mask: DataFrame | None, seed: int, attempts: int = 10, width: int = 2_048) -> DataFrame:
    """Every annotation (name, chr, start, end) moved to a seeded random place of its reference that the mask (chr, start, end) leaves
    free, its length and, if it has ``blocks``, their layout kept. An annotation that finds none in ``attempts`` draws is an error."""
    size = F.col("end") - F.col("start")
    tries = annotations.join(F.broadcast(lengths.select("chr", "length")), "chr").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))  # a row a reference
    room = F.greatest(F.col("length") - size + 1, F.lit(1))
    at = F.pmod(seeded([F.col("name"), F.col("attempt")], seed), room)
    drawn = tries.select("name", "chr", "attempt", at.alias("start"), (at + size).alias("end"), (size <= F.col("length")).alias("fits")).where("fits").drop("fits")
    if mask is not None:
        drawn = overlap_join(drawn, mask.select("chr", "start", "end"), width, how="left_anti")
    best = drawn.groupBy("name").agg(F.min(F.struct("attempt", "chr", "start", "end")).alias("m"))
    out = annotations.select("name").join(best, "name", "left")
    checked = F.when(F.col("m").isNull(), F.raise_error(F.concat(F.lit(f"no place in {attempts} tries for "), F.col("name").cast("string")))).otherwise(F.col("m.start"))
    moved = out.select("name", F.col("m.chr").alias("chr"), checked.cast("long").alias("start"), F.col("m.end").alias("end"))
    if "blocks" not in annotations.columns:
        return moved
    laid = moved.join(annotations.select("name", F.col("start").alias("__from"), F.col("blocks").alias("__b")), "name")
    by = F.col("start") - F.col("__from")
    return laid.select("name", "chr", "start", "end", F.transform("__b", lambda b: F.struct((b["start"] + by).alias("start"), (b["end"] + by).alias("end"))).alias("blocks"))


def unmasked_lengths(lengths: DataFrame, mask: DataFrame) -> DataFrame:
    """``chr, length, masked, free`` of each reference, overlapping masks counted once."""
    from tidemark.operators.intervals import merge

    m = merge(mask.select("chr", "start", "end")).groupBy("chr").agg(F.sum(F.col("end") - F.col("start")).alias("masked"))
    return lengths.join(m, "chr", "left").select("chr", "length", F.coalesce("masked", F.lit(0)).alias("masked"), (F.col("length") - F.coalesce("masked", F.lit(0))).alias("free"))


def tree_levels(edges: DataFrame, root, depth: int = 64) -> DataFrame:
    """``node, level`` of a tree (parent, child) under ``root``: one join a level, each on the new nodes only, which are written so that no
    level is worked out again. More than ``depth`` levels are an error."""
    level = edges.sparkSession.createDataFrame([(root,)], "node " + dict(edges.dtypes)["child"])
    out = level.withColumn("level", F.lit(0))
    for k in range(1, depth + 2):
        level = written_table(edges.join(level, F.col("parent") == F.col("node")).select(F.col("child").alias("node")), "tree-level")
        if level.isEmpty():
            return out
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    raise ValueError(f"there are nodes below level {depth}")


def all_paths(edges: DataFrame, depth: int) -> DataFrame:
    """Every path (array of vertices) of an acyclic graph from a source to a sink, of at most ``depth`` edges. Longer paths are an error."""
    sources = edges.select(F.col("src").alias("v")).distinct().join(edges.select(F.col("dst").alias("v")).distinct(), "v", "left_anti")
    open_ = sources.select(F.array("v").alias("path"), F.col("v").alias("at"))
    done = None
    for _ in range(depth + 1):
        step = written_table(open_.join(edges, F.col("at") == F.col("src"), "left"), "paths")
        ended = step.where("dst is null").select("path")
        done = ended if done is None else done.unionByName(ended)
        open_ = step.where("dst is not null").select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        if open_.isEmpty():
            return done
    raise ValueError(f"there are paths of more than {depth} edges")


def compatible_isoforms(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of gene models (name, chr, strand, introns) that share their whole chain of introns."""
    chain = F.to_json("introns")
    x = a.select("chr", "strand", F.col("name").alias("a"), chain.alias("chain")).where(F.size("introns") > 0)
    y = b.select("chr", "strand", F.col("name").alias("b"), chain.alias("chain")).where(F.size("introns") > 0)
    return x.join(y, ["chr", "strand", "chain"]).where("a < b").select("a", "b")


def chromosome_key(column: str = "chr") -> list:
    """Sort key of reference names: ``chr`` taken off, one- and two-digit numbers by value and first, then the rest by text."""
    name = F.regexp_replace(F.col(column), "^chr", "")
    number = F.when(name.rlike("^[0-9]{1,2}$"), name.cast("int"))
    return [number.isNull(), number, name]


def suffix_number_key(column: str) -> list:
    """Sort key of ids: the letters before the number, case aside, then the number."""
    return [F.lower(F.regexp_extract(F.col(column), "^([A-Za-z]*)", 1)), F.expr(f"try_cast(regexp_extract(`{column}`, '([0-9]+)$', 1) as long)"), F.col(column)]
