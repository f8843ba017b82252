"""Findings of round 2 on queries that return every pair: none is exchanged, and none is met needlessly."""

import random

import pytest

from tidemark.operators import cells
from tidemark.operators import further as fu
from tidemark.operators import genes as ge

MODELS = "name string, chr string, strand string, blocks array<struct<start:bigint,end:bigint>>"


def nodes(df):
    """The rows of the result and the nodes of the executed plan."""
    rows, out, todo = df.collect(), [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            out.append(node)
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, out


def exchanged(found):
    """Rows that exchanges of the plan have written."""
    metrics = [n.metrics().get("shuffleRecordsWritten") for n in found]
    return sum(m.get().value() for m in metrics if m.isDefined())


def models(seed, n, first=0, place=700):
    """Genes with exons of many lengths, some of them twice, overlapping or empty, and one gene over several stretches."""
    rng, out = random.Random(seed), []
    for i in range(n):
        at = rng.randrange(0, place)
        exons = [(s, s + rng.choice([0, 5, 20, 60])) for s in (at + rng.randrange(0, 200) for _ in range(rng.randrange(1, 6)))]
        out.append((f"g{first + i}", rng.choice("cd"), rng.choice("+-"), sorted(exons + exons[: rng.randrange(0, 2)])))
    return [*out, (f"g{first + n}", "c", "+", [(10, 40), (300, 310), (5_000, 5_100)]), (f"g{first + n + 1}", "c", None, [(10, 40)]), (None, "c", "+", [(10, 40)]), (f"g{first + n + 2}", "d", "-", [])]


def pairs_of(a, b, stranded):
    out = {}
    gaps = lambda x: [(u[1], v[0]) for u, v in zip(x, x[1:], strict=False)]
    for n, c, s, x in a:
        for m, d, t, y in b:
            if None in (n, m) or n == m or c != d or (stranded and (s is None or s != t)):
                continue
            met = [(u, min(u[1], v[1]) - max(u[0], v[0])) for u in x for v in y if u[0] < v[1] and v[0] < u[1]]
            if met:
                low, high = max(min(u[0] for u in x), min(v[0] for v in y)), min(max(u[1] for u in x), max(v[1] for v in y))
                inside = [[g for g in gaps(z) if g[0] < high and low < g[1]] for z in (x, y)]
                shared, length = sum(k for _, k in met), sum(v - u for u, v in x)
                out[n, m] = len({u for u, _ in met}), shared, shared / length if length else None, inside[0] == inside[1]
    return out


@pytest.mark.parametrize("stranded", [True, False])
@pytest.mark.parametrize("most", [1 << 6, 1 << 17])
def test_f5_pairs_of_genes_against_brute_force(spark, monkeypatch, most, stranded):
    monkeypatch.setattr(cells, "MET", most)
    a, b = models(1, 60), models(2, 50, 30)
    for x, y in ((a, a), (a, b)):
        left = spark.createDataFrame(x, MODELS)
        right = left if x is y else spark.createDataFrame(y, MODELS)
        rows = ge.exon_overlaps(left, right, 8, stranded).collect()
        want = pairs_of(x, y, stranded)
        assert len(rows) == len(want) and {(r["a"], r["b"]): (r["exons"], r["shared"], r["share"], r["compatible"]) for r in rows} == want
        few = ge.exon_overlaps(left, right, 8, stranded, compatible=False)
        assert {tuple(r) for r in few.collect()} == {(*k, *v[:3]) for k, v in want.items()}


def test_f5_pairs_are_not_exchanged(spark):
    m = spark.createDataFrame(models(3, 300, place=300), MODELS)
    rows, found = nodes(ge.exon_overlaps(m, m, 32))
    assert len(rows) > 10_000 and exchanged(found) < 1_000
    assert spark.createDataFrame([], MODELS).transform(lambda d: ge.exon_overlaps(d, d, 32)).count() == 0


def test_f9_reads_lie_in_one_bin_and_may_be_empty(spark):
    rng = random.Random(4)
    genes = [(i, rng.choice("cd"), s, s + rng.randrange(0, 90), rng.choice(["+", "-", None])) for i, s in enumerate(rng.randrange(0, 300) for _ in range(80))] + [(90, "c", 16, 32, "-"), (91, None, 0, 99, "+")]
    reads = [(i, rng.choice("cd"), s, s + rng.choice([0, 3, 40])) for i, s in enumerate(rng.randrange(0, 390) for _ in range(150))] + [(900 + p, "c", p, p) for p in (15, 16, 32, 33)] + [(990, None, 5, 9)]
    g, r = spark.createDataFrame(genes, "name long, chr string, start long, end long, strand string"), spark.createDataFrame(reads, "name long, chr string, start long, end long")
    rows, found = nodes(fu.gene_relative(r, g, 16))
    want = [(n, m, *((e - v, e - u) if t == "-" else (u - s, v - s))) for n, c, s, e, t in genes for m, d, u, v in reads if c is not None and c == d and s <= u and v <= e]
    assert sorted(map(tuple, rows)) == sorted(want) and {916, 932} <= {m for n, m, *_ in want if n == 90}
    # in all bins that they touch the reads were more
    assert exchanged(found) <= len(reads) + sum(max(s, e) // 16 - s // 16 + 1 for _, _, s, e, _ in genes)
