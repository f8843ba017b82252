"""Large components, skipped buckets and packing of the top-k search."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import topk


def brute(rows, asks, k, scale=64):
    whole = {i: [math.floor(scale * x) for x in v] for i, v in rows}
    out = []
    for q in asks:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_large_components_are_exact(spark):
    rows = [(0, [1.0]), (1, [1e11]), (2, [2e11]), (3, [-3e12]), (4, [2.0**45 + 0.5]), (20, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == brute(rows, [0, 20], 3)


def test_scores_beyond_a_long_are_held_at_its_ends(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    assert got == [(1, topk.LONG), (3, 4096), (2, -topk.LONG - 1)]


def test_buckets_of_few_vectors_against_brute_force(spark, monkeypatch):
    """Lengths from 1 to 1000, so that most buckets are skipped; buckets and blocks cut by rows and by bytes."""
    monkeypatch.setattr(topk, "BUCKET", 32)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) * 10 ** rng.uniform(0, 3)]) for i in range(600)] + [(600, [0.0] * 6), (620, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = brute(rows, range(0, 621, 20), 5)
    for limit in (1 << 20, 500):
        monkeypatch.setattr(topk, "PACK_BYTES", limit)
        got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect())
        assert got == want
