"""Line dedup over content-defined chunks of lines, and over the seams that they leave.

A passage is a line that holds anything but white space and the next such line, with the blank lines between them. A rolling hash over
the hashes of two such lines makes a passage the first of a chunk where its value is a multiple of ``MEAN`` (or after ``MOST`` passages), so
boundaries depend on the lines around them and resist shifts. A chunk is the lines of its passages: it has two lines at least and
shares its last one with the chunk after it, so every passage lies in one chunk.

Chunks are counted by digest over all documents. A chunk that an earlier document has, too, goes whole, once its bytes are compared.
That alone misses the repeats that start or end within a chunk, so the passages of what is left, which is every chunk at its first
place, are counted likewise: the first occurrence of a passage lies in the first occurrence of some chunk. Those met more than once are
compared byte by byte, and every occurrence but the first (by doc_id, then by place) goes. So a repeated run of two or more lines goes
whole, wherever it starts and ends. Within one text an occurrence that overlaps the first one stays. Blank lines after a removed line
go with it, and those before it if nothing else is left; single lines are left alone. The first occurrence of a line never goes, so no
line vanishes from the corpus.

Defined results: a null text has no lines and stays null; an empty text is one empty line; long texts are processed whole; null ids
come last; rows equal in id and text share their result, so a repeated row loses nothing to its twin; an empty table gives an
empty result; for ``dedup_lines`` all columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, blobs, bound_batches, discard, free_name, materialize, spread_join

#: The mean number of passages in a chunk, and the most.
MEAN = 4
MOST = 64
ROLL = 0x9E3779B97F4A7C15
LAST = (1 << 63) - 1


def solid_lines(lines: list[bytes]) -> list[int]:
    """The lines that hold anything but white space."""
    return [i for i, line in enumerate(lines) if line.strip()]


def chunk_bounds(lines: list[bytes], solid: list[int]) -> list[tuple[int, int]]:
    """First passage and end (exclusive) of the chunks; passage t is the solid lines t and t + 1."""
    if len(solid) < 2:
        return []
    hashes = [xxhash.xxh3_64_intdigest(lines[i]) for i in solid]
    starts = [0]
    rolled = hashes[0]
    for t in range(len(solid) - 1):
        rolled = ((rolled - hashes[t - 1] * ROLL if t else rolled) * ROLL + hashes[t + 1]) & MASK64
        if t and ((rolled >> 17) % MEAN == 0 or t - starts[-1] >= MOST):
            starts.append(t)
    return list(zip(starts, [*starts[1:], len(solid) - 1], strict=True))


def chunks(raw: bytes | None) -> list[tuple[int, int, bytes]]:
    """First line, number of lines and bytes of each chunk."""
    lines = [] if raw is None else raw.split(b"\n")
    solid = solid_lines(lines)
    return [(solid[t], solid[u] - solid[t] + 1, b"\n".join(lines[solid[t] : solid[u] + 1])) for t, u in chunk_bounds(lines, solid)]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(F.col(text).cast("string")).alias("key"), F.col(text).cast("string").alias("text"))


SCAN = "ord long, key long, n_lines long, sha string, chunks array<struct<i:int,c:binary>>, passages array<struct<i:int,k:int,h:binary>>"
CHUNKS = pa.list_(pa.struct([("i", pa.int32()), ("c", pa.binary())]))
PASSAGES = pa.list_(pa.struct([("i", pa.int32()), ("k", pa.int32()), ("h", pa.binary())]))


def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's number of lines, digest, chunks and passages (``k``: the first line of the passage's chunk)."""
    for batch in parts:
        n_lines, shas, found, pairs = [], [], [], []
        for raw in blobs(batch.column("text")):
            lines = [] if raw is None else raw.split(b"\n")
            n_lines.append(len(lines))
            shas.append(hashlib.sha256(raw or b"").hexdigest())
            solid = solid_lines(lines)
            own, own_pairs = [], []
            for t, u in chunk_bounds(lines, solid):
                own.append({"i": solid[t], "c": xxhash.xxh3_128_digest(b"\n".join(lines[solid[t] : solid[u] + 1]))})
                own_pairs += [{"i": solid[x], "k": solid[t], "h": xxhash.xxh3_128_digest(b"\n".join(lines[solid[x] : solid[x + 1] + 1]))} for x in range(t, u)]
            found.append(own)
            pairs.append(own_pairs)
        yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("key"), pa.array(n_lines, pa.int64()), pa.array(shas, pa.string()), pa.array(found, CHUNKS), pa.array(pairs, PASSAGES)], names=["ord", "key", "n_lines", "sha", "chunks", "passages"])


def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks that start at the lines ``chunk_at`` and of the passages that start at ``at``, with their first line, number of lines and digest."""
    for batch in parts:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            out: list[list] = [[], [], [], [], [], [], []]
            for ord_, key, raw, chunk_at, at in zip(*[part.column(c).to_pylist() for c in ("ord", "key")], blobs(part.column("text")), *[part.column(c).to_pylist() for c in ("chunk_at", "at")], strict=True):
                lines = raw.split(b"\n")
                solid = solid_lines(lines)
                heads = set(chunk_at or ())
                spans = [(True, solid[t], solid[u] + 1) for t, u in chunk_bounds(lines, solid) if solid[t] in heads] if heads else []
                if at:
                    wanted = set(at)
                    spans += [(False, i, j + 1) for i, j in zip(solid, solid[1:], strict=False) if i in wanted]
                for whole, i, j in spans:
                    piece = b"\n".join(lines[i:j])
                    for held, x in zip(out, (whole, ord_, key, i, j - i, hashlib.sha256((b"c" if whole else b"p") + piece).digest(), piece), strict=True):
                        held.append(x)
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["whole", "ord", "key", "i", "n", "s", "piece"])


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: ``ord, key, n_lines, sha`` of every row (ord the id, key the text's hash); ``ord, key, gone`` with the stretches
    (first line ``i``, lines ``n``) to remove; and the texts ``ord, key, text`` of the rows that hold anything repeated."""
    bound_batches(docs)
    rows = _keyed(docs, doc_id, text)
    scanned = materialize(rows.mapInArrow(scan, SCAN), "lines-scan")
    place = F.struct("ord", "key", "i")
    # chunks that lie in several documents, and their first place
    each = scanned.select("ord", "key", F.explode("chunks").alias("x")).select("ord", "key", F.col("x.i").alias("i"), F.col("x.c").alias("c"))
    shared = each.groupBy("c").agg(F.min(place).alias("f"), F.count("*").alias("met"), F.max(F.struct("ord", "key")).alias("z"))
    shared = materialize(shared.where(F.struct("f.ord", "f.key") < F.col("z")).select("c", "f", "met"), "lines-chunks")
    n_shared = shared.agg(F.sum("met")).first()[0] or 0
    other = (F.col("ord") != F.col("f.ord")) | (F.col("key") != F.col("f.key"))
    placed = spread_join(each, shared, "c", "met", n_shared, ["ord", "key", "i"]).where(other | (place == F.col("f"))).withColumn("other", other)
    held = placed.groupBy("ord", "key").agg(F.collect_set("i").alias("chunk_at"), F.collect_set(F.when(F.col("other"), F.col("i"))).alias("copied"))
    held = materialize(held, "lines-held")
    # the passages of all chunks but the copies in later documents
    kept = scanned.select("ord", "key", "passages").join(held.select("ord", "key", "copied"), ["ord", "key"], "left")
    kept = kept.select("ord", "key", F.filter("passages", lambda p: ~F.coalesce(F.array_contains("copied", p["k"]), F.lit(False))).alias("passages")).where(F.size("passages") > 0)
    kept = materialize(kept, "lines-passages")
    pairs = kept.select("ord", "key", F.explode("passages").alias("x")).select("ord", "key", F.col("x.i").alias("i"), F.col("x.h").alias("h"))
    repeated = materialize(pairs.groupBy("h").agg(F.count("*").alias("met")).where("met > 1"), "lines-repeated")
    n_repeated = repeated.agg(F.sum("met")).first()[0] or 0
    wanted = spread_join(pairs, repeated, "h", "met", n_repeated, ["ord", "key", "i"]).groupBy("ord", "key").agg(F.collect_set("i").alias("at"))
    wanted = wanted.join(held.select("ord", "key", "chunk_at"), ["ord", "key"], "full")
    texts = materialize(rows.join(wanted, ["ord", "key"]).select("ord", "key", "text", "chunk_at", "at"), "lines-texts")
    discard(shared, kept, repeated)
    places = materialize(texts.mapInArrow(fetch, "whole boolean, ord long, key long, i int, n int, s binary, piece binary"), "lines-places")
    # grouping by the piece itself compares its bytes; a repeated row's pieces fall together
    first = places.groupBy("s", "piece").agg(F.min(place).alias("f"), F.count("*").alias("met")).where("met > 1").select("s", "f", "met")
    first = materialize(first, "lines-first")
    n_first = first.agg(F.sum("met")).first()[0] or 0
    later = spread_join(places.select("whole", "ord", "key", "i", "n", "s"), first, "s", "met", n_first, ["ord", "key", "i"]).where(place > F.col("f"))
    gone = later.where("not (ord = f.ord and key = f.key and (whole or i < f.i + n))")
    return scanned.drop("chunks", "passages"), gone.groupBy("ord", "key").agg(F.collect_set(F.struct("i", "n")).alias("gone")), texts.select("ord", "key", "text")


def cut(raw: bytes | None, gone: list[dict] | None) -> tuple[bytes | None, int]:
    """The text without the stretches ``gone`` (``i``, ``n``), and the number of lines removed."""
    if raw is None or not gone:
        return raw, 0
    lines = raw.split(b"\n")
    drop = {k for g in gone for k in range(g["i"], g["i"] + g["n"])}
    for i, line in enumerate(lines):
        if not line.strip() and i - 1 in drop:
            drop.add(i)
    left = [line for i, line in enumerate(lines) if i not in drop]
    if not any(line.strip() for line in left):
        left = []
    return b"\n".join(left), len(lines) - len(left)


def dedup_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` for every row: lines, lines removed and the digest of the text that is left."""
    scanned, gone, texts = repeated_lines(docs, doc_id, text)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            made = [cut(raw, g) for raw, g in zip(blobs(batch.column("text")), batch.column("gone").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("key"), pa.array([n for _, n in made], pa.int64()), pa.array([hashlib.sha256(t or b"").hexdigest() for t, _ in made], pa.string())], names=["ord", "key", "n_removed", "kept_sha"])

    hit = texts.join(gone, ["ord", "key"]).mapInArrow(task, "ord long, key long, n_removed long, kept_sha string").dropDuplicates(["ord", "key"])
    out = scanned.join(hit, ["ord", "key"], "left")
    return out.select(F.when(F.col("ord") != LAST, F.col("ord")).alias("doc_id"), "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_emptied: bool = True) -> DataFrame:
    """All rows and columns with the repeated passages cut out of the text; rows that lose every line go if ``drop_emptied``."""
    _, gone, _ = repeated_lines(docs, doc_id, text)
    a, b, g, at = (free_name(docs, x) for x in ("ord", "key", "gone", "cut"))
    rows = docs.withColumns({a: F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), b: F.xxhash64(F.col(text).cast("string"))})
    rows = rows.join(gone.withColumnsRenamed({"ord": a, "key": b, "gone": g}), [a, b], "left").drop(a, b)
    columns = docs.columns
    names = [*columns, g]
    place = columns.index(text)
    schema = ", ".join(f"`{f.name}` {'string' if f.name == text else f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{at}` boolean"

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            lists = batch.column(len(names) - 1).to_pylist()
            raws = blobs(batch.column(place))
            made = [cut(raw, x) for raw, x in zip(raws, lists, strict=True)]
            emptied = [n > 0 and n == len(raw.split(b"\n")) for raw, (_, n) in zip(raws, made, strict=True)]
            cols = list(batch.columns[:-1])
            cols[place] = pa.array([t for t, _ in made], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(emptied, pa.bool_())], names=[*columns, at])

    out = rows.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(task, schema)
    return (out.where(~F.col(at)) if drop_emptied else out).drop(at)
