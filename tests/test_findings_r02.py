"""Findings of round 2: crowds of overlapping intervals without their pairs, ties, sums beyond a long."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells
from tidemark.operators import counting as ct
from tidemark.operators import extra as ex
from tidemark.operators import further as fu
from tidemark.operators import intervals as ops
from tidemark.operators import stats as so


def most_rows(df):
    """The most rows that a node of the executed plan has put out, and the rows of the result."""
    rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
            n = node.metrics().get("numOutputRows")
            most = max(most, n.get().value() if n.isDefined() else 0)
    return most, rows


def crowd(spark, n, seed, first=0):
    rng = random.Random(seed)
    return [(first + i, "c", s, s + rng.randrange(20, 60)) for i, s in enumerate(rng.randrange(0, 300) for _ in range(n))]


SPANS = "name long, chr string, start long, end long"


def islands_within(reads, s, e):
    out = []
    for a, b in sorted((max(s, a), min(e, b)) for _, _, a, b in reads if a < e and s < b):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_f1_regions_meet_islands_not_reads(spark):
    reads, regions = crowd(spark, 400, 1), crowd(spark, 400, 2)
    few = [(0, "c", 0, 5), (1, "c", 5, 9), (2, "c", 8, 20), (3, "c", 40, 60), (4, "c", 41, 42)]
    for r in (reads, few):
        most, rows = most_rows(fu.collapsed_within(spark.createDataFrame(r, SPANS), spark.createDataFrame(regions, SPANS), 64))
        got = {}
        for x in rows:
            got.setdefault(x["name"], []).append((x["start"], x["end"]))
        assert {k: sorted(v) for k, v in got.items()} == {n: w for n, _, s, e in regions if (w := islands_within(r, s, e))}
        assert most < 4_000


def test_f2_parts_are_counted_not_made(spark):
    rows = crowd(spark, 400, 3) + [(900, "c", 7, 7), (901, "d", 7, 9)]
    df = spark.createDataFrame(rows, SPANS)
    want = {n: (len({p for _, k, a, b in rows if k == c for p in (a, b) if s < p < e}) + 1, e - s) for n, c, s, e in rows}
    for width in (16, 1 << 16):
        most, got = most_rows(fu.dissected_parts(df, width))
        assert {r["name"]: (r["parts"], r["length"]) for r in got} == want and most < 2_000
    made = fu.dissect(df.where("start < end"), 64).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in made} == {n: w[0] for n, w in want.items() if n != 900}


def test_f3_only_outermost_intervals_are_met(spark):
    rows = crowd(spark, 500, 4) + [(900 + i, "c", 100, 190) for i in range(3)] + [(910, "c", 400, 410)]
    held = lambda n, s, e: [(s2 - e2, m) for m, _, s2, e2 in rows if m != n and s2 <= s and e <= e2]
    want = {n: min(h)[1] for n, _, s, e in rows if (h := held(n, s, e))}
    most, got = most_rows(ops.largest_parents(spark.createDataFrame(rows, SPANS), 64))
    assert {r["name"]: r["parent"] for r in got} == want and len(got) == len(want) and most < 10_000


def test_f4_regions_meet_places_not_points(spark):
    rng, regions = random.Random(5), crowd(spark, 200, 6)
    points = [("c", 40 + rng.randrange(20)) for _ in range(2_000)]
    most, rows = most_rows(fu.position_counts(spark.createDataFrame(points, "chr string, pos long"), spark.createDataFrame(regions, SPANS), 64))
    want = {n: (len(set(h)), max(map(h.count, h)), len(h), len(h) / (e - s)) for n, _, s, e in regions if (h := [p for _, p in points if s <= p < e])}
    assert {r["name"]: tuple(r)[1:] for r in rows} == want and most < 8_000


def test_f11_ranks_of_millions(spark):
    n = 2_200_000
    df = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") % 2).cast("double").alias("a"), F.lit(0.5).alias("b"), (F.col("id") % 2).cast("int").alias("flag"))
    r = so.signed_rank(df, "a", "b", ["k"]).first()
    assert r["n"] == n and r["u"] == n / 2 * (n + 1) / 2 and r["z"] == 0 and r["p"] == 1
    r = so.rank_sum(spark.range(6_000_000).select(F.lit("k").alias("k"), F.lit(1.0).alias("v"), (F.col("id") % 2).cast("int").alias("flag")), "flag", "v", ["k"]).first()
    assert r["z"] == 0


def test_f6_barcodes_are_dealt_to_many_tasks(spark):
    rng = random.Random(7)
    codes = ["".join(rng.choice("ACGTñ😀") for _ in range(5)) for _ in range(300)]
    df = ct.barcode_distances(spark.createDataFrame([(c,) for c in codes], "barcode string"))
    want = {}
    for i, a in enumerate(codes):
        for b in codes[:i]:
            d = sum(x != y for x, y in zip(a, b, strict=True))
            want[d] = want.get(d, 0) + 1
    assert {r["distance"]: r["n"] for r in df.collect()} == want
    plan = df._jdf.queryExecution().toString()
    assert f", {ct.PAIR_TASKS})" in plan and "zip_with" not in plan
    with pytest.raises(Exception, match="equal length"):
        ct.barcode_distances(spark.createDataFrame([("AA",), ("A",)], "barcode string")).collect()


def test_f12_equal_intervals_by_name(spark):
    rows = [(i, "c", 5, 9) for i in (3, 1, 2, 0)] + [(4, "c", 5, 10)]
    got = {r["name"]: r["place"] for r in ex.interval_index(spark.createDataFrame(rows, SPANS).repartition(4, "name"), ties=("name",)).collect()}
    assert got == {4: 0, 0: 1, 1: 2, 2: 3, 3: 4}


def genes_and_reads(spark, seed):
    """Genes with exons, one beyond a stretch and one across its bound, and reads, some with rows at several places."""
    rng = random.Random(seed)
    genes = [(n, "c", s, s + 400) for n, s in enumerate(rng.randrange(16_000, 16_700) for _ in range(25))] + [(90, "c", 100, 20_000), (91, "d", 3, 9)]
    exons = [(n, "c", a, a + rng.randrange(1, 60), f"{n}.{a}") for n, _, s, e in genes[:-1] for a in rng.sample(range(s - 30, e), 5)]
    reads = [(rng.randrange(300), "c", a, a + rng.randrange(1, 90), 1 + rng.randrange(2), rng.choice(["x", "y"])) for a in (rng.randrange(15_900, 17_200) for _ in range(400))]
    frames = [spark.createDataFrame(x, f"{SPANS}{more}") for x, more in ((genes, ""), (exons, ", exon string"), (reads, ", nh int, exp string"))]
    return genes, exons, reads, frames


@pytest.mark.parametrize("most_widths", [0, 64])
def test_f7_f8_exonic_reads_without_pairs(spark, monkeypatch, most_widths):
    monkeypatch.setattr(cells, "WIDTHS", most_widths)
    genes, exons, reads, (g, x, r) = genes_and_reads(spark, 8)
    want = {}
    for n, c, s, e in genes:
        parts = [(max(s, a), min(e, b)) for m, k, a, b, _ in exons if m == n and k == c and a < e and s < b]
        parts = parts if len(parts) > 1 else [(s, e)]
        for name, nh, exp in {(q, nh, exp) for q, k, a, b, nh, exp in reads if k == c and any(a < t and u < b for u, t in parts)}:
            m, w = want.get((n, exp), (0, 0))
            want[n, exp] = m + 1, w + 1 / nh
    most, rows = most_rows(ct.count_exonic(r, g, x, 128))
    got = {(q["name"], q["exp"]): (q["n"], q["weight"]) for q in rows}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    # without the gene that is left to a join no node makes pairs
    assert most_rows(ct.count_exonic(r, g.where("name <> 90"), x, 128))[0] < 1_500


def test_f10_intronic_reads_without_pairs(spark):
    genes, exons, reads, (g, x, r) = genes_and_reads(spark, 9)
    blocks = x.groupBy("name", "chr").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("blocks"))
    want = {}
    for n, c, _, _ in genes:
        own = sorted((a, b) for m, _, a, b, _ in exons if m == n)
        gaps = [(a[1], b[0]) for a, b in zip(own, own[1:], strict=False) if a[1] < b[0]]
        over = lambda spans: {q for q, k, a, b, *_ in reads if k == c and any(a < t and u < b for u, t in spans)}
        if k := len(over(gaps) - over(own)):
            want[n] = k
    assert {q["name"]: q["n"] for q in ct.count_intronic(r, blocks, 128).collect()} == want
