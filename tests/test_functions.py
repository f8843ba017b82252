"""Unit vectors and properties of the functions and operators that have no SQL form, and pinned edge rules."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import intervals as iv
from tidemark.functions import sequences as sq
from tidemark.functions import stats as st
from tidemark.operators import counting as ct
from tidemark.operators import intervals as ops
from tidemark.operators import matrix as mx
from tidemark.operators import sequences as seqs
from tidemark.operators import stats as so


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_relationship(spark):
    r = lambda *x: iv.relationship(*[F.lit(v) for v in x])
    assert tuple(one(spark, r(2, 5, 4, 8), r(2, 5, 5, 8), r(2, 5, 3, 4), r(9, 10, 5, 8))) == (3, 1, 7, 4)
    d = lambda *x: iv.distance(*[F.lit(v) for v in x])
    assert tuple(one(spark, d(2, 5, 9, 10), d(2, 5, 5, 8), d(9, 10, 2, 5))) == (4, 0, 4)
    assert one(spark, iv.intersection(*[F.lit(v) for v in (2, 5, 5, 8)]).alias("x"))["x"] is None


def test_windows(spark):
    region = spark.createDataFrame([("s", 0, 10)], "name string, start long, end long")
    assert [r["start"] for r in ops.sliding_windows(region, 4, 2).orderBy("start").collect()] == [0, 2, 4]
    refs = spark.createDataFrame([("c", 10), ("empty", 0)], "chr string, length long")
    assert [(r["start"], r["end"]) for r in ops.fixed_windows(refs, 4, 4).orderBy("start").collect()] == [(0, 4), (4, 8), (8, 12)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlap_join_whatever_the_bins(spark, width):
    rng = random.Random(width)
    make = lambda n: [(i, rng.choice("ab"), s, s + rng.randrange(0, 30)) for i in range(n) for s in [rng.randrange(100)]]
    a, b = make(40), make(40)
    x = spark.createDataFrame(a, "i long, chr string, start long, end long")
    y = spark.createDataFrame(b, "j long, chr string, start long, end long")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] < q[3] and q[2] < p[3])
    assert sorted((r["i"], r["j"]) for r in ops.overlap_join(x, y, width).collect()) == want
    assert sorted(r["i"] for r in ops.overlap_join(x, y, width, how="left_semi").collect()) == sorted({i for i, _ in want})
    assert sorted(r["i"] for r in ops.overlap_join(x, y, width, how="left_anti").collect()) == sorted({p[0] for p in a} - {i for i, _ in want})


def test_islands_and_coverage_in_small_bins(spark):
    rng = random.Random(1)
    rows = [("a", s, s + rng.randrange(1, 25)) for s in (rng.randrange(400) for _ in range(60))]
    df = spark.createDataFrame(rows, "chr string, start long, end long")
    covered = {p for _, s, e in rows for p in range(s, e)}
    for width in (5, 64, 1 << 16):
        assert ops.merge(df, width=width).agg(F.sum(F.col("end") - F.col("start"))).first()[0] == len(covered)
        depth = ops.coverage(df, width=width)
        assert depth.agg(F.sum((F.col("end") - F.col("start")) * F.col("depth"))).first()[0] == sum(e - s for _, s, e in rows)
    twice = spark.createDataFrame([("a", 0, 3), *[("a", 5, 9)] * 3, ("a", 6, 9)], "chr string, start long, end long")
    assert sorted(map(tuple, ops.merge(twice).collect())) == [("a", 0, 3, 1), ("a", 5, 9, 4)]
    touch = spark.createDataFrame([("a", 0, 5), ("a", 5, 9)], "chr string, start long, end long")
    assert ops.merge(touch).count() == 2 and ops.touching(touch).count() == 1


def test_block_functions(spark):
    blocks = F.array(*[F.struct(F.lit(s).cast("long").alias("start"), F.lit(e).cast("long").alias("end")) for s, e in ((10, 20), (15, 25), (25, 30), (40, 50))])
    r = one(spark, iv.merge_blocks(blocks).alias("m"), iv.clip_blocks(blocks, F.lit(18), F.lit(27)).alias("c"), iv.minus_blocks(blocks, F.lit(12), F.lit(45)).alias("d"), iv.introns(iv.merge_blocks(blocks)).alias("i"))
    pairs = lambda x: [(b["start"], b["end"]) for b in x]
    assert pairs(r["m"]) == [(10, 25), (25, 30), (40, 50)]
    assert pairs(r["c"]) == [(18, 20), (18, 25), (25, 27)]
    assert pairs(r["d"]) == [(10, 12), (45, 50)]
    assert pairs(r["i"]) == [(25, 25), (30, 40)]


def test_scan_pvalues(spark):
    got = one(spark, *[st.scan_pvalue(F.lit(k), F.lit(0.01), F.lit(100), F.lit(10_000)).alias(f"k{k}") for k in (2, 3, 5, 8, 12)])
    assert np.allclose(list(got), [1, 0.999995088, 0.704080765, 0.006313165, 8.371974e-07], atol=1e-9)
    quick = one(spark, st.approximate_scan_pvalue(F.lit(8), F.lit(0.01), F.lit(100), F.lit(10_000), 0.0).alias("p"))["p"]
    assert abs(quick - 0.006313165) < 1e-9


def test_poisson_far_out(spark):
    got = one(spark, st.poisson_cdf(F.lit(757), F.lit(731.0)).alias("a"), st.poisson_cdf(F.lit(3), F.lit(2.0)).alias("b"), st.poisson_cdf(F.lit(5000), F.lit(800.0)).alias("c"))
    assert abs(got["a"] - sum(math.exp(i * math.log(731) - 731 - math.lgamma(i + 1)) for i in range(758))) < 1e-9
    assert abs(got["b"] - math.exp(-2) * (1 + 2 + 2 + 4 / 3)) < 1e-12 and got["c"] == 1.0


def test_tails(spark):
    got = one(spark, st.binomial_tail(F.lit(7), F.lit(10), F.lit(0.4)).alias("b"), st.hypergeometric_tail(F.lit(3), F.lit(5), F.lit(8), F.lit(20)).alias("h"), st.normal_cdf(F.lit(1.5)).alias("n"))
    assert abs(got["b"] - sum(math.comb(10, i) * 0.4**i * 0.6 ** (10 - i) for i in range(7, 11))) < 1e-9
    assert abs(got["h"] - sum(math.comb(8, i) * math.comb(12, 5 - i) for i in range(3, 6)) / math.comb(20, 5)) < 1e-9
    assert abs(got["n"] - 0.5 * (1 + math.erf(1.5 / math.sqrt(2)))) < 1e-12


def test_fisher(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.2), ("a", 0.05), ("b", 0.0), ("b", 0.5), ("c", 0.1), ("c", 0.1)], "k string, p double")
    got = {r["k"]: r for r in so.fisher_combined(df, "p", ["k"]).collect()}
    assert abs(got["a"]["x2"] - 18.420681) < 1e-6 and abs(got["a"]["p"] - 0.0052625526) < 1e-9 and got["b"]["p"] == 0.0
    assert {r["k"]: r["n"] for r in so.fisher_combined(df, "p", ["k"], distinct=True).collect()}["c"] == 1


def test_skellam():
    def mass(k, a, b):
        return sum(math.exp(-a + (i + k) * math.log(a) - math.lgamma(i + k + 1) - b + i * math.log(b) - math.lgamma(i + 1)) for i in range(max(0, -k), 200))

    for k, a, b in itertools.product((-6, -1, 0, 3, 9), (0.5, 3.0), (1.0, 5.0)):
        assert abs(st.skellam_cdf(k, a, b) - sum(mass(j, a, b) for j in range(-60, k + 1))) < 1e-9


def test_enrichment_against_the_running_sum(spark):
    rng = random.Random(3)
    scores = sorted((round(rng.uniform(-5, 5), 3) for _ in range(60)), reverse=True)
    ranked = spark.createDataFrame([(f"g{i}", i + 1, s) for i, s in enumerate(scores)], "gene string, rank long, score double")
    sets = {f"s{j}": rng.sample(range(60), 7) for j in range(8)}
    df = spark.createDataFrame([(n, f"g{i}") for n, m in sets.items() for i in m], "set_name string, gene string")
    got = {r["set_name"]: r for r in so.enrichment_score(ranked, df).collect()}
    for name, members in sets.items():
        total, run, best, at = sum(abs(scores[i]) for i in members), 0.0, 0.0, 0
        for i, s in enumerate(scores):
            run += abs(s) / total if i in members else -1 / (60 - 7)
            if abs(run) > abs(best) + 1e-12:
                best, at = run, i + 1
        assert abs(got[name]["es"] - best) < 1e-9 and got[name]["at_rank"] == at


def test_fdr_rules(spark):
    o = spark.createDataFrame([(3.0,), (-2.0,), (1.0,)], "s double")
    e = spark.createDataFrame([(0, 2.0), (0, 0.5), (1, -4.0), (1, 1.0)], "p long, s double")
    got = {r["score"]: (r["observed"], r["expected"], r["fdr"]) for r in so.permutation_fdr(o, e, "s", "p").collect()}
    assert got == {3.0: (1, 0.5, 0.5), 2.0: (2, 0.5, 0.25), 1.0: (3, 1.0, 1 / 3)}


def test_hamming(spark):
    assert one(spark, ct.hamming(F.lit("ACGT"), F.lit("AGGA")).alias("d"))["d"] == 2
    for bad in (F.lit("ACG"), F.lit(None).cast("string")):
        with pytest.raises(Exception, match="equal length"):
            one(spark, ct.hamming(F.lit("ACGT"), bad).alias("d"))


def test_predicates(spark):
    assert tuple(one(spark, ct.all_of(), ct.any_of())) == (True, False)


def test_die(spark):
    got = [r[0] for r in spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (0.0, 0.49, 0.5, 0.99)])).alias("u")).select(st.unfair_die(F.col("u"), [0.2, 0.3, 0.5])).collect()]
    assert got == [0, 1, 2, 2]
    assert one(spark, st.unfair_die(F.lit(0.3), [1.0]).alias("x"))["x"] == 0
    with pytest.raises(ValueError):
        st.unfair_die(F.lit(0.3), [0.5])


def brute(a, b, local):
    """Best score over all alignments, by memoized enumeration of affine gaps."""
    from functools import cache

    @cache
    def go(i, j, gap):
        best = 0.0 if local or (i == len(a) and j == len(b)) else -1e9
        if i < len(a) and j < len(b):
            best = max(best, (1 if a[i] == b[j] else -1) + go(i + 1, j + 1, 0))
        if i < len(a):
            best = max(best, -(0.5 if gap == 1 else 2) + go(i + 1, j, 1))
        if j < len(b):
            best = max(best, -(0.5 if gap == 2 else 2) + go(i, j + 1, 2))
        return best

    return max(go(i, j, 0) for i in range(len(a) + 1) for j in range(len(b) + 1)) if local else go(0, 0, 0)


def test_alignments():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        for local in (True, False):
            score, x, y, i, j, same, gaps = sq.align(a, b, local=local)
            assert abs(score - brute(a, b, local)) < 1e-9
            assert x.replace("-", "") == a[i : i + len(x.replace("-", ""))] and y.replace("-", "") == b[j : j + len(y.replace("-", ""))]
            cost = sum(1 if p == q else -1 for p, q in zip(x, y, strict=True) if "-" not in (p, q))
            runs = [r for s in (x, y) for k, r in ((k, len(list(g))) for k, g in itertools.groupby(s)) if k == "-"]
            assert abs(score - (cost - sum(2 + (r - 1) * 0.5 for r in runs))) < 1e-9
            assert gaps == sum(runs) and same == sum(p == q for p, q in zip(x, y, strict=True))
    assert sq.align("ANT", "ACT")[0] == 3
    assert "|" in sq.render_pair("a", "b", "AC-T", "ACGT") and sq.render_fasta("x", "A" * 61).count("\n") == 3


def test_pwm_helpers():
    pwm = [[1.0, 0, 0, 0], [0.25] * 4, [0, 0, 0, 1.0]]
    assert sq.information(pwm) == [2.0, 0.0, 2.0] and sq.consensus(pwm) == "AAT"
    assert sq.trim_by_information([[0.25] * 4, *pwm, [0.25] * 4], 1.0) == pwm
    assert sq.pwm_reverse_complement(pwm) == pwm
    assert sq.possible_kmers("A[CG]N") == 8


def test_combinations(spark):
    assert seqs.combinations(spark.range(12), "id", 2).count() == 66


def test_permuted_annotations(spark):
    a = spark.createDataFrame([(i, "c", 0, 1 + i % 7) for i in range(50)], "name long, chr string, start long, end long")
    lengths = spark.createDataFrame([("c", 100)], "chr string, length long")
    mask = spark.createDataFrame([("c", 0, 40)], "chr string, start long, end long")
    got = seqs.permute_annotations(a, lengths, mask, 3, attempts=30, width=10)
    rows = got.collect()
    assert {r["name"]: r["end"] - r["start"] for r in rows} == {i: 1 + i % 7 for i in range(50)}
    assert all(40 <= r["start"] and r["end"] <= 100 for r in rows) and sorted(map(tuple, rows)) == sorted(map(tuple, got.collect()))
    with pytest.raises(Exception, match="no place"):
        seqs.permute_annotations(a, lengths, spark.createDataFrame([("c", 0, 100)], "chr string, start long, end long"), 3).collect()


def test_paths_too_long(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    assert [r["path"] for r in seqs.all_paths(e, 6).collect()] == [list(range(7))]
    with pytest.raises(ValueError):
        seqs.all_paths(e, 3)


def test_viterbi_against_enumeration(spark):
    start, moves = {"x": 0.6, "y": 0.4}, {"x": {"x": 0.7, "y": 0.3}, "y": {"x": 0.4, "y": 0.6}}
    emits = {"x": {"a": 0.5, "b": 0.5}, "y": {"a": 0.1, "b": 0.9}}
    seen = "abbab"
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(seen)], "k long, i long, s string")
    got = mx.viterbi(df, ["k"], "i", "s", start, moves, emits).orderBy("i").collect()

    def like(path):
        p = math.log(start[path[0]]) + math.log(emits[path[0]][seen[0]])
        return p + sum(math.log(moves[u][v]) + math.log(emits[v][c]) for u, v, c in zip(path, path[1:], seen[1:], strict=False))

    best = max(itertools.product("xy", repeat=5), key=like)
    assert tuple(r["state"] for r in got) == best and abs(got[0]["log_likelihood"] - like(best)) < 1e-9
    with pytest.raises(ValueError):
        mx.viterbi(df, ["k"], "i", "s", {"x": 0.5}, moves, emits)


def test_clusters(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 4.0), ("b", "c", 6.0)], "a string, b string, distance double")
    assert [(r["left"], r["right"], r["height"], r["size"]) for r in mx.cluster_columns(df).orderBy("step").collect()] == [("a", "b", 1.0, 2), ("(a,b)", "c", 5.0, 3)]


def test_linear_algebra(spark):
    a = np.array([[4.0, 2, 0], [2, 5, 1], [0, 1, 3]])
    df = spark.createDataFrame([(f"r{i}", f"r{j}", float(a[i, j])) for i in range(3) for j in range(3)], "row string, col string, value double")
    back = lambda what: np.array([r["value"] for r in mx.linear_algebra(df, what).orderBy("row", "col").collect()])
    low = back("cholesky").reshape(3, 3)
    assert np.allclose(low @ low.T, a) and np.allclose(back("inverse").reshape(3, 3) @ a, np.eye(3))
    assert np.allclose(back("singular"), np.linalg.svd(a, compute_uv=False)) and np.allclose(sorted(back("eigen")), sorted(np.linalg.eigvalsh(a)))
    r = back("qr_r").reshape(3, 3)
    assert np.allclose(r.T @ r, a.T @ a)


def test_loess_of_a_line(spark):
    df = spark.createDataFrame([("k", float(i), 2.0 * i + 1) for i in range(30)], "k string, x double, y double")
    assert all(abs(r["fit"] - r["y"]) < 1e-6 for r in mx.loess(df, ["k"], "x", "y").collect())


def test_swap_test_null(spark):
    df = spark.createDataFrame([(i, float((-1) ** i), 0.0) for i in range(40)], "u long, a double, b double")
    r = so.swap_test(df, "a", "b", 200, "u", 5).first()
    assert r["observed"] == 0 and r["p"] == 1.0 and r["n"] == 200


def test_roots(spark):
    got = one(spark, st.polynomial_roots(F.array(F.lit(1.0), F.lit(-3.0), F.lit(2.0))).alias("r"))["r"]
    assert np.allclose(got, [1, 0, 2, 0])
