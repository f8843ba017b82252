"""Near-duplicate detection with SetSketch registers.

Every document's set of word shingles gets a SetSketch: each shingle draws ascending values from exponentially spaced truncated
exponentials and deals them to registers; a register keeps its least value on a logarithmic scale. Sketches of parts merge by
register-wise maximum, and two sketches agree in a register with a probability close to the Jaccard similarity. Bands of registers
make buckets. Within a bucket no pairs are listed: members are held against one leader, and only where that leaves more than one
component are they compared, in blocks, across the components that are left. A pair's registers are judged jointly by their
likelihood given the set sizes; what that cannot rule out is verified on the full shingle sets.

With 32 bands of 4 of 128 registers, two sets at a similarity of exactly 0.8 share no bucket with a probability of 5e-8, and the
likelihood rules out a pair that is linked with one of 1e-11.

Defined results: null or wordless texts have empty sets and are linked with nothing; texts with fewer words than a shingle are one
shingle; equal sets are one node however many rows have them; repeated rows share their result; rows with a null id have the
smallest other id of their component, or null, and are not kept unless that is null; an empty table gives an empty result;
further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, blobs, bound_batches, discard, gram_hashes, materialize, mix64, release_memory, signed, spread_join

REGISTERS = 128
BANDS = 32
BASE = 1.02
#: Members of a bucket that are compared with as many others in one place.
BLOCK = 1024
#: Bytes of shingle hashes in such a block; two blocks are held at a time.
BLOCK_BYTES = 16 << 20
#: Similarity below which the likelihood rules a pair out is this much below the threshold (7 standard errors).
SLACK = 0.25

_EDGES = np.log1p(np.arange(REGISTERS) / np.maximum(REGISTERS - np.arange(REGISTERS), 1))
_SHARE = 1 - np.exp(-np.diff(np.append(_EDGES, np.inf)))


def shingles(words: list[bytes], hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; of all words together if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    own = hashes.of(words)
    return np.unique(gram_hashes(own, min(n, len(own)), seed=len(own) if len(own) < n else n))


def sketch(elements: np.ndarray) -> np.ndarray:
    """The registers (int16) of a set of hashes."""
    m = REGISTERS
    least = np.full(m, np.inf)
    start = (mix64(elements ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(20)).astype(np.int64)
    step = (mix64(elements ^ np.uint64(0x14057B7EF767814F)) >> np.uint64(20)).astype(np.int64) | 1
    width = 1 if len(elements) > 2 * m else m if len(elements) * m <= 1 << 15 else 8
    for j in range(0, m, width):
        if _EDGES[j] >= least.max():
            break
        each = np.arange(j, min(j + width, m))
        u = (mix64(elements[:, None] + each.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        values = _EDGES[each] - np.log1p(-u * _SHARE[each])
        np.minimum.at(least, ((start[:, None] + each * step[:, None]) % m).ravel(), values.ravel())
    return np.clip(np.floor(1 - np.log(np.maximum(least, 1e-300)) / np.log(BASE)), -32768, 32767).astype(np.int16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    rows = registers.reshape(BANDS, -1).astype(np.int64).astype(np.uint64)
    keys = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for c in range(rows.shape[1]):
        keys = mix64(keys ^ rows[:, c]) * np.uint64(0x9FB21C651E98DF25)
    return signed(keys)


def sketches(docs: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    """``uid, doc_id, key, n, fp, registers, bands`` of every row; ``fp`` identifies the set, ``key`` the text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        hashes = WordHashes()
        for batch in parts:
            n, fps, registers, bands = [], [], [], []
            for raw in blobs(batch.column("text")):
                own = shingles((raw or b"").lower().split(), hashes, shingle)
                n.append(len(own))
                fps.append(xxhash.xxh3_128_digest(own.tobytes()))
                registers.append(sketch(own) if len(own) else np.empty(0, np.int16))
                bands.append(band_keys(registers[-1]) if len(own) else np.empty(0, np.int64))
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in c])]).astype(np.int32)), pa.array(np.concatenate(c) if c else np.empty(0, t))) for c, t in ((registers, np.int16), (bands, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), *lists], names=["doc_id", "key", "n", "fp", "registers", "bands"])

    made = rows.mapInArrow(task, "doc_id long, key long, n long, fp binary, registers array<short>, bands array<long>")
    return materialize(made.withColumn("uid", F.monotonically_increasing_id()), "neardup-sketches")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    """``uid, n, grams`` of the nodes in ``wanted`` (uid, doc_id, key)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    found = rows.join(wanted.withColumnsRenamed({"doc_id": "w_id", "key": "w_key"}), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))).select("uid", "text")

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        hashes = WordHashes()
        for batch in parts:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own = [signed(shingles((raw or b"").lower().split(), hashes, shingle)) for raw in blobs(part.column("text"))]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)), pa.array(np.concatenate(own) if own else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("uid"), lists], names=["uid", "grams"])

    # rows that repeat id and text give their node more than once
    return materialize(found.mapInArrow(task, "uid long, grams array<long>"), "neardup-sets")


def plausible(a: Column, b: Column, threshold: float) -> Column:
    """Whether the likelihood of two nodes' registers, given their sizes, has its maximum at ``threshold - SLACK`` or above.

    The log-likelihood is concave in the similarity, so its slope there tells. ``a`` and ``b`` are structs with ``n`` and ``registers``.
    """
    j = threshold - SLACK
    u, v = a["n"] / (a["n"] + b["n"]), b["n"] / (a["n"] + b["n"])
    scale = (BASE - 1) / BASE
    more = F.greatest(u - v * j, F.lit(1e-9))
    less = F.greatest(v - u * j, F.lit(1e-9))
    p_more, p_less = -F.log1p(-more * scale) / float(np.log(BASE)), -F.log1p(-less * scale) / float(np.log(BASE))
    d_more, d_less = -v * scale / ((1 - more * scale) * float(np.log(BASE))), -u * scale / ((1 - less * scale) * float(np.log(BASE)))
    signs = F.zip_with(a["registers"], b["registers"], lambda x, y: F.when(x > y, 1).when(x < y, 1 << 16).otherwise(0))
    both = F.aggregate(signs, F.lit(0), lambda s, x: s + x)
    n_more, n_less = both.bitwiseAND(F.lit(65535)), F.shiftright(both, 16)
    same = F.greatest(1 - p_more - p_less, F.lit(1e-9))
    slope = n_more * d_more / p_more + n_less * d_less / p_less - (REGISTERS - n_more - n_less) * (d_more + d_less) / same
    sizes = F.least(a["n"], b["n"]) >= F.lit(threshold - 1e-9) * F.greatest(a["n"], b["n"])
    return sizes & F.when(sizes, slope >= 0).otherwise(F.lit(False))


def with_leader(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b) with the facts of ``a``, which may lead very many pairs. Facts of a node may be repeated."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("met"))
    counted = counts.join(facts.dropDuplicates(["a"]), "a")
    return spread_join(pairs, counted, "a", "met", pairs.count(), ["b"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    pairs = materialize(pairs, "neardup-plausible")
    found = with_leader(pairs, sets.select(F.col("uid").alias("a"), F.col("grams").alias("ga"))).join(sets.select(F.col("uid").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return found.where(100 * common >= percent * (F.size("ga") + F.size("gb") - common)).select("a", "b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``uid, root`` for every node of the edges (a, b), root the least uid reachable: alternating large-star and small-star steps."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("met")).select("u", F.least("u", "m").alias("m"), "met")
        large = spread_join(both, low, "u", "met", 2 * e.count(), ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("met"))
        small = spread_join(large, low, "u", "met", large.count(), ["v"])
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        before, e = e, materialize(small.distinct(), label)
        discard(before, large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("uid"), F.col("v").alias("root"))


def across(members: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components ``root`` within each bucket of ``members`` (bucket, uid, size, grams, root).

    A bucket is cut into blocks of about ``BLOCK`` members, or of ``BLOCK_BYTES`` in shingles if that is less, and every two blocks meet in one place, where pairs of different
    components are compared in memory: only links leave it, and none between what earlier links there have joined. A pair that
    shares several buckets is compared in that of its first common band.
    """
    facts = known.select("uid", "registers", "bands").join(sets.groupBy("uid").agg(F.first("grams").alias("grams")), "uid")
    parts = F.greatest(F.ceil(F.col("size") / F.lit(BLOCK)), F.least(F.col("size"), F.ceil(8 * F.col("grams") / F.lit(BLOCK_BYTES)))).cast("int")
    rows = members.select("bucket", "uid", "root", parts.alias("parts"), F.pmod(F.xxhash64("uid"), parts).cast("int").alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "uid", "root").join(facts, "uid")

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in parts:
            regs, bands, grams = (batch.column(c) for c in ("registers", "bands", "grams"))
            keys = zip(*[batch.column(c).to_pylist() for c in ("bucket", "i", "j", "own", "uid", "root")], strict=True)
            for n, (bucket, i, j, own, uid, root) in enumerate(keys):
                if place != (bucket, i, j):
                    if held:
                        yield _pairs_batch(compare_blocks(place, held, percent))
                    place, held = (bucket, i, j), []
                held.append((own, uid, root, regs[n].values.to_numpy(), bands[n].values.to_numpy(), grams[n].values.to_numpy()))
        if held:
            yield _pairs_batch(compare_blocks(place, held, percent))

    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.select("bucket", "i", "j", "own", "uid", "root", "registers", "bands", "grams").mapInArrow(task, "a long, b long").distinct()


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def compare_blocks(place: tuple[int, int, int], held: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between the members of block i and of block j of a bucket (of one block with itself if i = j) that join components."""
    bucket, i, j = place
    left, right = [h for h in held if h[0] == i], [h for h in held if h[0] == j]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    if not left or not right:
        return []
    right_regs, right_bands = np.array([r[3] for r in right]), np.array([r[4] for r in right])
    right_sizes, right_uids = np.array([len(r[5]) for r in right]), np.array([r[1] for r in right])
    right_roots = np.array([r[2] for r in right])
    out = []
    for _, uid, root, regs, bands, grams in left:
        n = len(grams)
        ok = (right_roots != root) & (100 * np.minimum(right_sizes, n) >= percent * np.maximum(right_sizes, n))
        if i == j:
            ok &= right_uids > uid
        index = np.flatnonzero(ok)
        if not len(index):
            continue
        index = index[right_bands[index, (right_bands[index] == bands).argmax(1)] == bucket]
        found = right_regs[index]
        index = index[likely(n, right_sizes[index], (regs > found).sum(1), (regs < found).sum(1), percent / 100)]
        for k in index.tolist():
            if find(root) != find(int(right_roots[k])):
                common = len(np.intersect1d(grams, right[k][5], assume_unique=True))
                if 100 * common >= percent * (n + int(right_sizes[k]) - common):
                    parent[find(root)] = find(int(right_roots[k]))
                    out.append((min(uid, right[k][1]), max(uid, right[k][1])))
    return out


def likely(n: int, sizes: np.ndarray, more: np.ndarray, less: np.ndarray, threshold: float) -> np.ndarray:
    """``plausible`` for one set against many, from the numbers of registers that are more and less."""
    j, scale, log_base = threshold - SLACK, (BASE - 1) / BASE, np.log(BASE)
    u, v = n / (n + sizes), sizes / (n + sizes)
    x, y = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9)
    p, q = -np.log1p(-x * scale) / log_base, -np.log1p(-y * scale) / log_base
    dp, dq = -v * scale / ((1 - x * scale) * log_base), -u * scale / ((1 - y * scale) * log_base)
    return more * dp / p + less * dq / q - (REGISTERS - more - less) * (dp + dq) / np.maximum(1 - p - q, 1e-9) >= 0


def link(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and ``fp, component_id``: for each set, the smallest doc_id reachable over links."""
    threshold = percent / 100
    bound_batches(docs)
    every = sketches(docs, shingle, doc_id, text)
    nodes = materialize(every.where("n > 0").groupBy("fp").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least_id")), "neardup-nodes")
    own = every.join(nodes.select("uid"), "uid", "left_semi")
    banded = own.select("uid", "n", F.explode("bands").alias("bucket"))
    led = banded.groupBy("bucket").agg(F.min("uid").alias("leader"), F.count("*").alias("size"), F.sum("n").alias("grams")).where("size > 1")
    led = materialize(led.withColumn("met", F.col("size")), "neardup-leaders")
    total = led.agg(F.sum("met")).first()[0] or 0
    members = materialize(spread_join(banded.drop("n"), led, "bucket", "met", total, ["uid"]).select("bucket", "uid", "leader", "size", "grams"), "neardup-members")
    known = own.join(members.select("uid").distinct(), "uid", "left_semi")
    known = materialize(known.select("uid", "doc_id", "key", "n", "registers", "bands"), "neardup-known")
    sets = shingle_sets(docs, known.select("uid", "doc_id", "key"), shingle, doc_id, text)
    facts = known.select("uid", F.struct("n", "registers").alias("s"))

    def judged(pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that the likelihood leaves, verified."""
        left = with_leader(pairs, facts.select(F.col("uid").alias("a"), F.col("s").alias("sa"))).join(facts.select(F.col("uid").alias("b"), F.col("s").alias("sb")), "b")
        return verify(left.where(plausible(F.col("sa"), F.col("sb"), threshold)).select("a", "b"), sets, percent)

    links = materialize(judged(materialize(members.where("uid <> leader").select(F.col("leader").alias("a"), F.col("uid").alias("b")).distinct(), "neardup-led")), "neardup-links")
    roots = components(links)
    others = members.where("size > 2 and uid <> leader").select("bucket", "uid", "size", "grams")
    placed = others.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    unsettled = materialize(placed.join(split, "bucket", "left_semi"), "neardup-unsettled")
    if not unsettled.isEmpty():
        links = materialize(links.unionByName(across(unsettled, known, sets, percent)), "neardup-links")
        roots = components(links)
    placed = nodes.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return every, placed.join(named, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, n_shingles, component_id, kept`` for every row; ``key`` is the 64-bit hash of the text."""
    every, classes = link(docs, shingle, percent, doc_id, text)
    out = every.select("doc_id", "key", "n", "fp").join(classes, "fp", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
