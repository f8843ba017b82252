"""Substring dedup with super-k-mer partitioning.

A window is ``k`` consecutive words. Its minimiser is the least hash of the ``m``-word grams in it; consecutive windows that share a
minimiser, ``LONGEST`` at most, form a super-k-mer. Windows that are equal have equal minimisers, so a minimiser met in one document
only is settled. The super-k-mers of the others travel as packed strings to their minimiser's bucket, equal strings as one row with
their smallest doc_id; there the windows are sorted and the smallest doc_id of each is found by comparing them whole. A bucket of more
than ``HOT`` strings is dealt on by the windows themselves: equal ones fall together before they travel, and they are grouped by their
words, so no task holds such a bucket.

A word is removed if a window that covers it also starts in a document with a smaller doc_id.

Defined results: null and empty texts have no words and nothing is removed; long texts are processed whole; rows with equal ids are
not compared with each other (none has the smaller id), so repeated rows share their result; rows with a null id neither remove
nor lose words; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, blobs, bound_batches, materialize, power_hashes, release_memory, signed, spread_join

#: Words of the grams that minimisers are chosen from.
GRAM = 14
#: Windows of a super-k-mer at most: a periodic text has one minimiser throughout.
LONGEST = 64
#: Distinct strings that one minimiser's bucket may hold in memory; none is longer than ``LONGEST`` windows.
HOT = 1_000


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < width:
        count = len(values) - width + 1
        out = np.minimum(out[:count], out[width - size : width - size + count])
    return out


def super_kmers(words: list[bytes], hashes: WordHashes, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer."""
    if len(words) < k:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = sliding_min(power_hashes(hashes.of(words), m, 3), k - m + 1)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    size = np.diff(np.append(first, len(least)))
    if size.max() > LONGEST:  # cut in steps from the run's own start, so that equal runs are cut alike
        parts = -(-size // LONGEST)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + step * LONGEST
    return signed(least[first]), first, np.diff(np.append(first, len(least)))


def least_by_window(rows: list[tuple[bytes, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each (packed string, smallest id) of a bucket, the ranges of windows that also start in a smaller id's string. Sorts all windows."""
    windows = []
    for i, (packed, first) in enumerate(rows):
        ends = [p for p, c in enumerate(packed) if c == 32] + [len(packed)]
        starts = [0, *[e + 1 for e in ends[:-1]]]
        windows += [(packed[starts[j] : ends[j + k - 1]], first, i, j) for j in range(len(starts) - k + 1)]
    windows.sort()
    found: list[list[int]] = [[] for _ in rows]
    last, least = None, 0
    for window, first, i, j in windows:
        if window != last:
            last, least = window, first
        elif first > least:
            found[i].append(j)
    return [_ranges(sorted(x)) for x in found]


def _ranges(numbers: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for j in numbers:
        if out and out[-1][1] == j - 1:
            out[-1] = (out[-1][0], j)
        else:
            out.append((j, j))
    return out


def removed_mask(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Mask of the words in the spans (first and last word)."""
    marks = np.zeros(n + 1, np.int64)
    for a, b in spans:
        marks[a] += 1
        marks[b + 1] -= 1
    return np.cumsum(marks[:-1]) > 0


def repeated_spans(docs: DataFrame, k: int = 50, m: int = GRAM, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: every document's ``doc_id, key, n_words, sha`` (digest of all its words); the spans ``doc_id, key, a, b`` of words
    to remove; and the texts ``doc_id, key, text`` of the documents that can have any. ``key`` tells apart rows with equal ids."""
    bound_batches(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        hashes = WordHashes()
        for batch in parts:
            n_words, shas, mins = [], [], []
            for raw in blobs(batch.column("text")):
                words = (raw or b"").split()
                n_words.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                mins.append(np.unique(super_kmers(words, hashes, k, m)[0]))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in mins])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(mins) if mins else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n_words, pa.int64()), pa.array(shas), lists], names=["doc_id", "key", "n_words", "sha", "mins"])

    scanned = materialize(rows.select("doc_id", "key", "text").mapInArrow(scan, "doc_id long, key long, n_words long, sha string, mins array<long>"), "substring-scan")
    single = scanned.where("doc_id is not null").select("doc_id", "key", F.explode("mins").alias("mh"))
    shared = single.groupBy("mh").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("met")).where("a < b").select("mh", "met")
    shared = materialize(shared, "substring-shared")
    n_single = shared.agg(F.sum("met")).first()[0] or 0
    wanted = spread_join(single, shared, "mh", "met", n_single, ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.collect_set("mh").alias("mins"))
    texts = materialize(rows.join(wanted, ["doc_id", "key"]).select("doc_id", "key", "text", "mins"), "substring-texts")

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        hashes = WordHashes()
        for batch in parts:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], [], [], [], []]
                for id_, key, raw, mins in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), blobs(part.column("text")), part.column("mins").to_pylist(), strict=True):
                    words = raw.split()
                    minimisers, first, count = super_kmers(words, hashes, k, m)
                    for i in np.flatnonzero(np.isin(minimisers, mins)):
                        start, size = int(first[i]), int(count[i])
                        packed = b" ".join(words[start : start + size + k - 1])
                        for held, x in zip(out, (int(minimisers[i]), xxhash.xxh3_128_digest(packed), id_, key, start, size, packed), strict=True):
                            held.append(x)
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["mh", "sid", "doc_id", "key", "start", "size", "packed"])

    packed = materialize(texts.mapInArrow(pack, "mh long, sid binary, doc_id long, key long, start long, size long, packed binary"), "substring-packed")
    strings = materialize(packed.groupBy("mh", "sid", "size", "packed").agg(F.min("doc_id").alias("first"), F.count("*").alias("met")), "substring-strings")
    sizes = materialize(strings.groupBy("mh").agg(F.count("*").alias("n")).where("n > 1"), "substring-sizes")
    n_strings = sizes.agg(F.sum("n")).first()[0] or 0
    split = F.broadcast if n_strings // max(1, hot) < 1 << 20 else (lambda df: df)  # so few buckets can be crowded
    crowded = strings.join(split(sizes.where(f"n > {hot}").select("mh")), "mh", "left_semi")
    cold = strings.join(sizes.where(f"n <= {hot}").select("mh"), "mh", "left_semi")

    def settle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        out: list[tuple] = []

        def close() -> None:
            for (sid, first, _), ranges in zip(held, least_by_window([(p, f) for _, f, p in held], k), strict=True):
                out.extend((sid, first, lo, hi) for lo, hi in ranges)

        def batch_of() -> pa.RecordBatch:
            cols = [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["sid", "first", "lo", "hi"])

        for batch in parts:
            for mh, sid, first, string in zip(*[batch.column(c).to_pylist() for c in ("mh", "sid", "first", "packed")], strict=True):
                if mh != bucket:
                    close()
                    bucket, held = mh, []
                    if len(out) > 10_000:
                        yield batch_of()
                held.append((sid, first, string))
        close()
        yield batch_of()

    inner = cold.repartition("mh").sortWithinPartitions("mh").mapInArrow(settle, "sid binary, first long, lo long, hi long")

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, batch.num_rows, 64):  # a string has LONGEST windows at most
                part = batch.slice(at, 64)
                out: list[list] = [[], [], [], []]
                for sid, first, string in zip(*[part.column(c).to_pylist() for c in ("sid", "first", "packed")], strict=True):
                    ends = [p for p, c in enumerate(string) if c == 32] + [len(string)]
                    starts = [0, *[e + 1 for e in ends[:-1]]]
                    n = len(starts) - k + 1
                    out[0] += [string[starts[j] : ends[j + k - 1]] for j in range(n)]
                    out[1] += [sid] * n
                    out[2] += [first] * n
                    out[3] += range(n)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["window", "sid", "first", "lo"])

    each = crowded.select("sid", "first", "packed").mapInArrow(windows, "window binary, sid binary, first long, lo long")
    least = each.groupBy("window").agg(F.min("first").alias("least"), F.max("first").alias("most"), F.count("*").alias("met")).where("least < most")
    least = materialize(least.select("window", "least", "met"), "substring-windows")
    n_windows = least.agg(F.sum("met")).first()[0] or 0
    again = spread_join(each, least, "window", "met", n_windows, ["sid", "lo"])
    inner = inner.unionByName(again.where("least < first").select("sid", "first", "lo", F.col("lo").alias("hi")))
    places = packed.select("sid", "doc_id", "key", "start", "size")
    n_places = strings.agg(F.sum("met")).first()[0] or 0
    # a string of one place has no later one
    later = spread_join(places, strings.where("met > 1").select("sid", "first", "met"), "sid", "met", n_places, ["doc_id", "start"]).where("doc_id > first")
    later = later.select("doc_id", "key", F.col("start").alias("a"), (F.col("start") + F.col("size") + F.lit(k - 2)).alias("b"))
    # all places of a string in its first document, none of the others
    inner = inner.groupBy("sid", "first").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    within = places.join(inner, (F.col("doc_id") == F.col("first")) & (places["sid"] == inner["sid"])).select("doc_id", "key", "start", F.explode("ranges").alias("r"))
    within = within.select("doc_id", "key", (F.col("start") + F.col("r.lo")).alias("a"), (F.col("start") + F.col("r.hi") + F.lit(k - 1)).alias("b"))
    return scanned.drop("mins"), later.unionByName(within), texts.select("doc_id", "key", "text")


def dedup_digest(docs: DataFrame, k: int = 50, m: int = GRAM, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row: the digest of the kept words joined by one space."""
    return _removed(docs, k, m, doc_id, text, hot).select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def _removed(docs: DataFrame, k: int, m: int, doc_id: str, text: str, hot: int) -> DataFrame:
    scanned, spans, texts = repeated_spans(docs, k, m, doc_id, text, hot)
    per_doc = spans.distinct().groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            removed, shas = [], []
            for raw, spans_ in zip(blobs(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                words = raw.split()
                mask = removed_mask(len(words), [(s["a"], s["b"]) for s in spans_])
                removed.append(int(mask.sum()))
                shas.append(hashlib.sha256(b" ".join([w for w, gone in zip(words, mask.tolist(), strict=True) if not gone])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(removed, pa.int64()), pa.array(shas)], names=["doc_id", "key", "n_removed", "kept_sha"])

    hit = texts.join(per_doc, ["doc_id", "key"]).mapInArrow(cut, "doc_id long, key long, n_removed long, kept_sha string").dropDuplicates(["doc_id", "key"])
    return scanned.join(hit, ["doc_id", "key"], "left")
