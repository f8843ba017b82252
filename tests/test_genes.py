import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import genes as g

SCHEMA = "name string, chr string, start long, end long, strand string, blocks array<struct<start:bigint,end:bigint>>, cds_start long, cds_end long"
ROWS = [
    ("f", "c", 0, 100, "+", [(0, 30), (50, 100)], 10, 80), ("r", "c", 0, 100, "-", [(0, 30), (50, 100)], 10, 80), ("h", "c", 50, 130, "+", [(50, 100), (110, 130)], None, None), ("i", "c", 20, 100, "+", [(20, 30), (50, 100)], None, None),
]
pairs = lambda x: [(b["start"], b["end"]) for b in x]


@pytest.fixture(scope="module")
def genes(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_parts(genes):
    p = {r["name"]: r for r in g.parts(genes, 20).collect()}
    assert pairs(p["f"]["cds"]) == [(10, 30), (50, 80)] and pairs(p["f"]["utr5"]) == [(0, 10)] and pairs(p["f"]["utr3"]) == [(80, 100)]
    assert pairs(p["r"]["utr5"]) == [(80, 100)] and tuple(p["r"]["promoter"]) == (100, 120) and tuple(p["f"]["promoter"]) == (0, 0)
    assert pairs(p["h"]["cds"]) == [] and pairs(p["h"]["introns"]) == [(100, 110)] and p["f"]["junctions"] == ["30-50"]


def test_transcript_windows(genes):
    w = {(r["name"], r["at"]): pairs(r["blocks"]) for r in g.transcript_windows(genes, 40, 40).collect()}
    assert w["f", 0] == [(0, 30), (50, 60)] and w["f", 40] == [(60, 100)] and w["r", 0] == [(60, 100)] and w["r", 40] == [(0, 30), (50, 60)]
    assert w["h", 40] == [(90, 100), (110, 130)] and w["i", 40] == [(80, 100)]


def test_overlaps_and_loci(genes):
    o = {(r["a"], r["b"]): r for r in g.exon_overlaps(genes, genes, 32).collect()}
    assert (o["f", "i"]["exons"], o["f", "i"]["shared"], o["f", "i"]["compatible"]) == (2, 60, True)
    assert o["f", "h"]["shared"] == 50 and o["f", "h"]["compatible"] and ("f", "r") not in o
    loci = {(r["strand"], r["start"], r["end"], r["n"], r["union_length"]) for r in g.loci(genes).collect()}
    assert loci == {("+", 0, 130, 3, 100), ("-", 0, 100, 1, 80)}
    iso = genes.select(F.lit("x").alias("gene"), "name", "blocks")
    assert g.longest_isoform(iso).first()["name"] == "f"
    assert {(r["name"], r["before"]) for r in g.neighbours(genes).collect()} >= {("h", "i")}


def test_reading_frames(spark):
    r = spark.range(1).select(g.open_reading_frames(F.lit("ccATGAAATAAgATGTAGATGCC")).alias("o")).first()["o"]
    assert r == ["ATGAAATAA", "ATGTAG"]


def test_peaks_profiles_and_reads(spark, genes):
    w = spark.createDataFrame([("c", 0, 5, 0.01), ("c", 50, 9, 0.001), ("c", 100, 9, 0.2), ("c", 400, 3, 0.04)], "chr string, window_start long, n long, p double")
    assert sorted(map(tuple, g.peaks(w, 100, 0.05).collect())) == [("c", 0, 150, 2, 0.001, 50), ("c", 400, 500, 1, 0.04, 400)]
    reads = g.simulated_reads(genes, 5, 10, 3)
    assert reads.count() == 20 and reads.where("start < 0 or end > 130").count() == 0 and sorted(map(tuple, reads.collect())) == sorted(map(tuple, g.simulated_reads(genes, 5, 10, 3).collect()))
    one = spark.createDataFrame([("c", 5, 6)], "chr string, start long, end long")
    assert {(r["bin"], r["n"]) for r in g.aggregate_profile(one, genes.where("name in ('f', 'r')"), 10, 64).collect()} == {(0, 1), (9, 1)}


def test_conservation(spark):
    a = spark.createDataFrame([(1, "x", "AC-A"), (1, "y", "ACGT"), (1, "z", "AGGa")], "block long, species string, seq string")
    ident = {r["at"]: (r["n"], r["identity"]) for r in g.column_identity(a).collect()}
    assert ident[0] == (3, 1.0) and ident[2] == (2, 1.0) and abs(ident[3][1] - 2 / 3) < 1e-12
    tree = {"x": ("n", 0.1), "y": ("n", 0.2), "n": ("root", 0.1), "z": ("root", 0.3)}
    got = {r["at"]: r["log_likelihood"] for r in g.site_likelihoods(a, tree).collect()}

    def p(u, v, t):
        e = math.exp(-4 / 3 * t)
        return 0.25 + 0.75 * e if u == v else 0.25 - 0.25 * e

    def by_hand(x, y, z):
        return math.log(sum(0.25 * p(r, n, 0.1) * (p(n, x, 0.1) if x else 1) * p(n, y, 0.2) * p(r, z, 0.3) for r in "ACGT" for n in "ACGT"))

    for at, col in enumerate([("A", "A", "A"), ("C", "C", "G"), (None, "G", "G"), ("A", "T", "A")]):
        assert abs(got[at] - by_hand(*col)) < 1e-9
