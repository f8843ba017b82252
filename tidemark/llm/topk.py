"""Exact top-k search by inner product with norm-bucketed retrieval.

Candidates are sorted by length and cut into buckets. The longest vectors (``BUCKET`` of them) give every query a first threshold,
the k-th best score among them. In every bucket a query's threshold, divided by its own and the bucket's greatest length, is a local
cosine threshold: above 1 the bucket is skipped; if it is high, candidates are pruned by coordinates (each of the query's largest
coordinates bounds where a candidate's may lie), else by length. What is left is verified with exact integer products.

Queries are a stated set of rows. They are packed in blocks in the order of the length that a vector must have to reach their first
threshold, and a block meets only the buckets that hold such a length. Only each query's k best per bucket leave a task.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null id, take no part; components
floor(scale * x) and scores are exact, but held at the ends of a long where they lie beyond; shorter vectors count as padded with
zeros; rows with the query's own id, repeated ones too, are the query's own and no candidates; a repeated candidate row takes a rank of its own, a repeated query id is asked once (its
smallest vector); fewer candidates than k give fewer ranks; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SIDE_DATA_LIMIT, bound_batches, check_side_data, materialize

#: Candidates in a bucket, queries in a block, and bytes of either at most (one longer vector takes one alone).
BUCKET = 4096
QUERIES = 1024
PACK_BYTES = 8 << 20
#: Local cosine threshold from which on coordinates prune better than lengths, and how many coordinates are used.
COORDINATE = 0.55
FOCUS = 5
#: Queries that are multiplied with a bucket together.
GROUP = 128
LONG = (1 << 63) - 1
#: The largest double below 2**63.
LARGEST = float((1 << 63) - 1024)


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    ok = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-LARGEST)), F.lit(LARGEST))).cast("long"))
    return F.when(ok, whole)


def packed(rows: DataFrame, size: int, name: str, level: bool = False) -> DataFrame:
    """Consecutive rows (id, v) of a partition as blocks: ``{name}_ids``, ``{name}_rows`` (int64 matrix), ``longest``, ``n`` and ``bytes``.

    With ``level``, the rows' thresholds are packed as ``levels``, and ``need`` is the least length that a vector must have to reach any.
    """

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        levels: list[int] = []
        width = 0

        def block() -> pa.RecordBatch:
            m = np.zeros((len(vectors), width), np.int64)
            for i, v in enumerate(vectors):
                m[i, : len(v)] = v
            lengths = np.sqrt((m.astype(float) ** 2).sum(1))
            made = {f"{name}_ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), f"{name}_rows": pa.array([m.tobytes()], pa.binary()), "longest": pa.array([float(lengths.max())]), "n": pa.array([len(ids)], pa.int64()), "bytes": pa.array([m.nbytes], pa.int64())}
            if level:
                own = np.array(levels, np.int64)
                # a threshold of 0 or less, or a query of length 0, asks for every bucket
                needs = np.where((own > 0) & (lengths > 0), own / np.maximum(lengths, 1e-300), 0.0)
                made |= {"levels": pa.array([own.tobytes()], pa.binary()), "need": pa.array([float(needs.min()) * (1 - 1e-9)])}
            ids.clear()
            vectors.clear()
            levels.clear()
            return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

        for batch in parts:
            column = batch.column("v")
            for i, id_ in enumerate(batch.column("id").to_pylist()):
                v = column[i].values.to_numpy(zero_copy_only=False)
                if ids and max(width, len(v)) * 8 * (len(ids) + 1) > PACK_BYTES:
                    yield block()
                    width = 0
                ids.append(id_)
                vectors.append(v)
                width = max(width, len(v))
                if level:
                    levels.append(batch.column("level")[i].as_py())
                if len(ids) == size:
                    yield block()
                    width = 0
        if ids:
            yield block()

    return rows.mapInArrow(task, f"{name}_ids binary, {name}_rows binary, longest double, n long, bytes long" + (", levels binary, need double" if level else ""))


def products(a: np.ndarray, b: np.ndarray, b_float: np.ndarray | None = None, b_most: float | None = None) -> np.ndarray:
    """Exact inner products of the rows, held within the range of a long; ``b_float`` and ``b_most`` are b as doubles and its largest value, if they are known."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    a_float = a.astype(float)
    b_float = b.astype(float) if b_float is None else b_float[:, :width]
    most = float(np.abs(a_float).max()) * (float(np.abs(b_float).max()) if b_most is None else b_most) * width
    if most < 2.0**53:
        return (a_float @ b_float.T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    whole = a.astype(object) @ b.astype(object).T
    return np.vectorize(lambda x: max(-LONG - 1, min(LONG, x)), otypes=[np.int64])(whole)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Indexes of the k best, ties to smaller ids, the query's own left out."""
    index = np.flatnonzero(ids != own)
    if len(index) > k:
        least = np.partition(scores[index], len(index) - k)[len(index) - k]
        index = index[scores[index] >= least]
    return index[np.lexsort((ids[index], ~scores[index]))][:k]


class Bucket:
    """A bucket's vectors, longest first, with its coordinates sorted when they are first needed."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        lengths = np.sqrt((rows.astype(float) ** 2).sum(1))
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.rows, self.lengths = ids[order], rows[order], lengths[order]
        self.floats = self.rows.astype(float)
        self.most = float(np.abs(self.floats).max(initial=0.0))
        self.unit = self.floats / np.maximum(self.lengths, 1e-300)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = order, self.unit[order, f]
        return self.sorted[f]

    def candidates(self, query: np.ndarray, length: float, threshold: float) -> np.ndarray:
        """Indexes of all vectors whose product with the query can reach the threshold."""
        everything = np.arange(len(self.ids))
        if threshold <= 0 or length == 0 or self.lengths[0] == 0:
            return everything
        local = threshold / (length * self.lengths[0]) * (1 - 1e-9)
        if local > 1:
            return everything[:0]
        if local < COORDINATE:  # by length
            return everything[: np.searchsorted(-self.lengths, -threshold / length * (1 - 1e-9), side="right")]
        unit = query / length
        counts = np.zeros(len(self.ids), np.int8)
        focus = np.argsort(-np.abs(unit[: self.unit.shape[1]]), kind="stable")[:FOCUS]
        for f in focus:
            middle, spread = unit[f] * local, np.sqrt(max(0.0, 1 - unit[f] ** 2) * max(0.0, 1 - local**2))
            order, values = self.coordinate(int(f))
            # beyond the cap's pole the bound is 1 (or -1): every cosine from local to 1 counts
            low = -1.0 if unit[f] <= -local else middle - spread
            high = 1.0 if unit[f] >= local else middle + spread
            counts[order[np.searchsorted(values, low - 1e-9, side="left") : np.searchsorted(values, high + 1e-9, side="right")]] += 1
        return np.flatnonzero(counts == len(focus))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, thresholds: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(index of the query, vec_id, score) of each query's k best that reach its threshold.

        Queries whose candidates are a stretch of the longest vectors, or most of the bucket, are multiplied together.
        """
        lengths = np.sqrt((queries.astype(float) ** 2).sum(1))
        together: list[tuple[int, int]] = []
        for i, own in enumerate(query_ids.tolist()):
            found = self.candidates(queries[i], float(lengths[i]), float(thresholds[i]))
            if not len(found):
                continue
            if found[-1] + 1 <= 4 * len(found):
                together.append((int(found[-1]) + 1, i))
                continue
            scores = products(queries[i : i + 1], self.rows[found])[0]
            keep = np.flatnonzero(scores >= thresholds[i])
            found, scores = found[keep], scores[keep]
            for j in best(scores, self.ids[found], own, k).tolist():
                yield i, int(self.ids[found[j]]), int(scores[j])
        together.sort()
        for at in range(0, len(together), GROUP):
            n, index = together[min(at + GROUP, len(together)) - 1][0], np.array([i for _, i in together[at : at + GROUP]])
            scores = products(queries[index], self.rows[:n], self.floats[:n], self.most)
            who, which = np.nonzero(scores >= thresholds[index][:, None])
            edges = np.searchsorted(who, np.arange(len(index) + 1))
            for q, i in enumerate(index.tolist()):
                found = which[edges[q] : edges[q + 1]]
                own_scores = scores[q, found]
                for j in best(own_scores, self.ids[found], int(query_ids[i]), k).tolist():
                    yield i, int(self.ids[found[j]]), int(own_scores[j])


def top_k(df: DataFrame, query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``query`` (a condition on ``vec_id``) holds, against all rows."""
    bound_batches(df)
    rows = df.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), integers(F.col(vector), scale).alias("v"), query.alias("asks")).where("v is not null")
    rows = rows.withColumn("length2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    buckets = materialize(packed(rows.repartitionByRange(F.desc("length2"), "id").sortWithinPartitions(F.desc("length2"), "id").select("id", "v"), BUCKET, "bucket"), "topk-buckets")
    # the longest vectors, BUCKET of them or a bucket more: sizes first, then these buckets only
    order, m, seen, size = [F.desc("longest"), "n"], 0, 0, 0
    for r in buckets.select("longest", "n", "bytes").orderBy(*order).limit(BUCKET).collect():
        if not m or (seen < BUCKET and size + r["bytes"] <= SIDE_DATA_LIMIT // 2):
            m, seen, size = m + 1, seen + r["n"], size + r["bytes"]
    if not m:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    check_side_data(size, "the longest vectors")
    top = [(np.frombuffer(bytes(r["bucket_ids"]), np.int64), bytes(r["bucket_rows"])) for r in buckets.orderBy(*order).limit(m).collect()]

    def begin(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [Bucket(ids, np.frombuffer(raw, np.int64).reshape(len(ids), -1)) for ids, raw in top]
        every = np.concatenate([b.ids for b in first])
        for batch in parts:
            levels = []
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                vectors = [v.values.to_numpy(zero_copy_only=False) for v in part.column("v")]
                queries = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
                for i, v in enumerate(vectors):
                    queries[i, : len(v)] = v
                scores = np.concatenate([products(queries, b.rows, b.floats, b.most) for b in first], axis=1)
                for i, own in enumerate(part.column("id").to_pylist()):
                    index = best(scores[i], every, own, k)
                    levels.append(int(scores[i, index[-1]]) if len(index) == k else -LONG - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(levels, pa.int64())], names=["id", "v", "length2", "level"])

    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"), F.min_by("length2", "v").alias("length2"))
    asked = materialize(asked.mapInArrow(begin, "id long, v array<long>, length2 double, level long"), "topk-asked")
    need = F.when((F.col("level") > 0) & (F.col("length2") > 0), F.col("level") / F.sqrt("length2")).otherwise(0.0)
    asked = asked.withColumn("by", need).repartitionByRange("by", "id").sortWithinPartitions("by", "id")
    blocks = materialize(packed(asked.select("id", "v", "level"), QUERIES, "query", level=True).drop("longest", "n", "bytes"), "topk-queries")

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, Bucket] | None = None
        for batch in parts:
            for q_ids, q_rows, levels, b_ids, b_rows in zip(*[batch.column(c).to_pylist() for c in ("query_ids", "query_rows", "levels", "bucket_ids", "bucket_rows")], strict=True):
                own = np.frombuffer(q_ids, np.int64)
                if not held or held[0] != b_ids:
                    ids = np.frombuffer(b_ids, np.int64)
                    held = b_ids, Bucket(ids, np.frombuffer(b_rows, np.int64).reshape(len(ids), -1))
                found = list(held[1].search(own, np.frombuffer(q_rows, np.int64).reshape(len(own), -1), np.frombuffer(levels, np.int64), k))
                yield pa.RecordBatch.from_arrays([pa.array([int(own[i]) for i, _, _ in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], names=["query_id", "vec_id", "score"])

    # a block of queries meets the buckets that are long enough for one of them; blocks, not rows, are combined
    n = 2 * df.sparkSession.sparkContext.defaultParallelism
    met = buckets.drop("n", "bytes").repartition(n).join(blocks, F.col("longest") >= F.col("need")).drop("longest", "need")
    found = met.mapInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
