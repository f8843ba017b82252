"""Repeated rows in joins, passes in two levels, splits of files, binary alignments, and operators that SQL doesn't reach."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import counting as ct
from tidemark.operators import extra as ex
from tidemark.operators import further as fu
from tidemark.operators import intervals as ops
from tidemark.operators import regions as rg
from tidemark.operators import stats as so
from tidemark.sources import bam, sinks, text


def test_semi_and_anti_joins_keep_repeated_rows(spark):
    left = spark.createDataFrame([("c", 0, 10, {"a": 1}), ("c", 0, 10, {"a": 1}), ("c", 50, 60, {"a": 2}), (None, 0, 5, {"a": 3})], "chr string, start long, end long, tags map<string,int>")
    right = spark.createDataFrame([("c", 5, 6), ("c", 5, 6), ("c", 0, 3)], "chr string, start long, end long")
    for width in (1, 4, 100):
        assert ops.overlap_join(left, right, width, how="left_semi").count() == 2
        assert sorted(r["start"] for r in ops.overlap_join(left, right, width, how="left_anti").collect()) == [0, 50]
    assert ops.overlap_join(left, right, 8, how="left_semi").columns == left.columns


def test_passes_over_many_bins(spark):
    rng = random.Random(1)
    rows = [("c", s, s + rng.randrange(1, 40)) for s in (rng.randrange(1000) for _ in range(120))]
    df = spark.createDataFrame(rows, "chr string, start long, end long")
    depth = [sum(s <= p < e for _, s, e in rows) for p in range(1100)]
    for width in (3, 64, 1 << 16):
        cov = ops.coverage(df, width=width).collect()
        assert all(depth[p] == r["depth"] for r in cov for p in range(r["start"], r["end"]))
        covered = {p for r in ops.touching(df, width=width).collect() for p in range(r["start"], r["end"])}
        assert covered == {p for p in range(1100) if depth[p]}
        parts = sorted((r["start"], r["end"]) for r in ops.touching(df, width=width).collect())
        assert all(a[1] < b[0] for a, b in zip(parts, parts[1:], strict=False))
        index = {(r["start"], r["end"]): r["place"] for r in ex.interval_index(df.distinct(), width=width).collect()}
        order = sorted(set((s, e) for _, s, e in rows), key=lambda x: (x[0], -x[1]))
        assert [index[x] for x in order] == list(range(len(order)))
        probes = spark.createDataFrame([("c", p) for p in range(0, 1100, 7)], "chr string, pos long")
        starts = sorted({s for _, s, _ in rows})
        for r in ex.floor_lookup(probes, df, width=width).collect():
            assert r["floor"] == max((s for s in starts if s <= r["pos"]), default=None)
            assert r["above"] == min((s for s in starts if s > r["pos"]), default=None)


def test_running_sums_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(40) / 8]), rng.randrange(5)) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    for down in (False, True):
        for r in so.running(df, "v", ["k"], {"upto": "n"}, down).where("v is not null").collect():
            lower = [n for k, v, n in rows if k == r["k"] and v is not None and (v >= r["v"] if down else v <= r["v"])]
            nulls = 0 if down else sum(n for k, v, n in rows if k == r["k"] and v is None)
            assert r["upto"] == sum(lower) + nulls
    ranks = {r["i"]: r["rank"] for r in so.average_rank(spark.createDataFrame([(i, float(i % 3)) for i in range(9)], "i long, v double"), "v", []).collect()}
    assert ranks == {i: 2.0 + 3 * (i % 3) for i in range(9)}


def test_barcode_distances_count_equal_ones(spark):
    df = spark.createDataFrame([("AA",), ("AA",), ("AC",), ("TT",)], "barcode string")
    assert {r["distance"]: r["n"] for r in ct.barcode_distances(df).collect()} == {0: 1, 1: 2, 2: 3}


def test_lines_are_numbered_across_splits(spark, tmp_path):
    names = {f"f{i}": [f"{i}-{k}" for k in range(4000 + i)] for i in range(2)}
    for name, rows in names.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = {}
        for r in text.lines(spark, str(tmp_path)).collect():
            got.setdefault(r["file"].rsplit("/", 1)[-1], {})[r["no"]] = r["value"]
        assert {f: [v for _, v in sorted(x.items())] for f, x in got.items()} == names
        records = [(f"r{i}", "ACGT" * (i % 5 + 1)) for i in range(900)]
        p = tmp_path / "x.fastq"
        p.write_text("".join(f"@{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in records))
        assert [(r["id"], r["seq"]) for r in text.fastq(spark, str(p)).orderBy("i").collect()] == records
        p = tmp_path / "x.fasta"
        p.write_text("".join(f">{n} d\n{s}\n{s}\n" for n, s in records))
        assert sorted((r["id"], r["seq"]) for r in text.fasta(spark, str(p)).collect()) == sorted((n, s + s) for n, s in records)
        numbered = [r["value"] for r in sinks.fasta(text.fastq(spark, str(tmp_path / "x.fastq")), numbered=True).collect()]
        assert sorted(numbered) == sorted(f">{i + 1}\n{s}" for i, (_, s) in enumerate(records))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sortedness(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(100)], "place long, v long")
    assert text.assert_sorted(df, ["v"], "place").count() == 100
    with pytest.raises(Exception, match="not sorted"):
        text.assert_sorted(df.withColumn("v", F.when(F.col("place") == 70, 3).otherwise(F.col("v"))), ["v"], "place").collect()


def packed(raw):
    """Blocks of a blocked gzip file, few bytes each, so that records lie across them."""
    out = b""
    for at in range(0, len(raw), 50):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(raw[at : at + 50]) + c.flush()
        size = 18 + len(body) + 8
        out += struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, size - 1) + body + struct.pack("<II", zlib.crc32(raw[at : at + 50]), len(raw[at : at + 50]))
    return out


def test_binary_alignments_read_like_text(spark, tmp_path):
    lines = ["r1\t99\tchr1\t101\t60\t5M100N3M1I\t=\t301\t250\tACGTNACGT\tIIIIIIIII\tNH:i:2\tXX:Z:abc", "r2\t16\tchr2\t8\t3\t4M\t*\t0\t0\tACGT\t*", "r3\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"]
    refs = [("chr1", 1000), ("chr2", 500)]
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in refs)
    number = {n: i for i, (n, _) in enumerate(refs)} | {"*": -1}
    import re

    for cells in (x.split("\t") for x in lines):
        ops_ = [int(n) << 4 | bam.OPERATIONS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cells[5])]
        seq = "" if cells[9] == "*" else cells[9]
        codes = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        qual = bytes([255] * len(seq)) if cells[10] == "*" else bytes(ord(c) - 33 for c in cells[10])
        body = struct.pack("<iiBBHHHiiii", number[cells[2]], int(cells[3]) - 1, len(cells[0]) + 1, int(cells[4]), 0, len(ops_), int(cells[1]), len(seq), number[cells[2]] if cells[6] == "=" else number[cells[6]], int(cells[7]) - 1, int(cells[8]))
        body += cells[0].encode() + b"\0" + struct.pack(f"<{len(ops_)}I", *ops_) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + qual
        if len(cells) > 11:
            body += b"NHC\2" + b"XXZabc\0"
        raw += struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(packed(raw))
    (tmp_path / "a.sam").write_text("@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:500\n" + "\n".join(lines) + "\n")
    assert [r["value"] for r in bam.bam_lines(spark, str(tmp_path / "a.bam")).collect()][2:] == lines
    for keep in (False, True):
        a, b = (sorted(map(str, bam.alignments(spark, str(tmp_path / f"a.{kind}"), keep).collect())) for kind in ("bam", "sam"))
        assert a == b and len(a) == 2 + keep
    assert sorted(map(tuple, bam.references(spark, str(tmp_path / "a.bam")).collect())) == refs
    (tmp_path / "bad.bam").write_bytes(packed(raw[:-3]))
    with pytest.raises(Exception, match="ends within a record"):
        bam.bam_lines(spark, str(tmp_path / "bad.bam")).collect()


def test_models_against_known_ones(spark):
    schema = "name string, chr string, strand string, start long, end long, blocks array<struct<start:bigint,end:bigint>>"
    known = spark.createDataFrame([("k", "c", "+", 0, 100, [(0, 10), (50, 100)])], schema)
    found = spark.createDataFrame([("a", "c", "+", 5, 90, [(5, 10), (50, 90)]), ("b", "c", "+", 20, 40, [(20, 40)]), ("d", "c", "+", 80, 140, [(80, 140)]), ("e", "c", "-", 0, 9, [(0, 9)])], schema)
    assert {r["name"]: r["kind"] for r in rg.compare_models(found, known, 16).collect()} == {"a": "equal", "b": "contained", "d": "overlapping", "e": "novel"}


def test_score_distribution_and_pieces():
    from tidemark.functions.sequences import with_pseudocounts

    pwm = [[0.7, 0.1, 0.1, 0.1], [0.25, 0.25, 0.25, 0.25]]
    d = fu.score_distribution(pwm)
    assert abs(sum(d.values()) - 1) < 1e-12
    import math

    top = round(math.log2(with_pseudocounts(pwm)[0][0] / 0.25), 2)
    assert abs(d[top] - 0.25) < 1e-12


def test_full_length_matches_and_ns(spark):
    df = spark.createDataFrame([("CNT", "AACGTT"), ("GGG", "AAC"), ("", "A"), ("A", "N")], "a string, b string")
    assert [r["at"] for r in rg.full_length_matches(df, "a", "b").collect()] == [2, -1, -1, 0]


def test_bins_of_two_widths(spark):
    """A reference-long interval on either side, short ones and both kinds of joins, each pair once."""
    rng = random.Random(4)
    rows = lambda n: [("c", s, s + rng.randrange(1, 30)) for s in (rng.randrange(5000) for _ in range(n))]
    a, b = [*rows(60), ("c", 0, 5000), ("c", 100, 1700)], [*rows(60), ("c", 0, 5000), ("c", 4000, 4600)]
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(a)], "i long, chr string, start long, end long")
    right = spark.createDataFrame([(i, *r) for i, r in enumerate(b)], "j long, chr string, start long, end long")
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2])
    for long_from in (None, 160, 1600):
        got = ops.overlap_join(left, right, 16, long_from=long_from)
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want
        assert got.columns == ["i", "chr", "start", "end", "j", "chr_r", "start_r", "end_r"]
        assert ops.overlap_join(left, right, 16, how="left_semi", long_from=long_from).count() == len({i for i, _ in want})
    inside = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] <= y[1] and y[2] <= x[2])
    assert sorted((r["i"], r["j"]) for r in ops.overlap_join(left, right, 16, contained=True, long_from=160).collect()) == inside


def test_decompositions(spark):
    import numpy as np

    from tidemark.operators import matrix as mx

    a = np.array([[4.0, 1.0, 2.0], [1.0, 3.0, 0.5], [2.0, 0.5, 5.0]])
    m = spark.createDataFrame([(f"x{i}", f"x{j}", float(a[i, j])) for i in range(3) for j in range(3)], "row string, col string, value double")

    def get(what):
        rows = mx.linear_algebra(m, what).collect()
        r, c = sorted({x["row"] for x in rows}), sorted({x["col"] for x in rows})
        out = np.zeros((len(r), len(c)))
        for x in rows:
            out[r.index(x["row"]), c.index(x["col"])] = x["value"]
        return out

    assert np.allclose(get("qr_q") @ get("qr_r"), a) and np.allclose(get("lu_l") @ get("lu_u"), a)
    values = get("eigen")[:, 0]
    assert np.allclose(a @ get("eigen_vectors"), get("eigen_vectors") * values)
    assert np.allclose(np.abs(get("singular_left").T @ a @ get("singular_right")), np.diag(get("singular")[:, 0]), atol=1e-9)
    tall = spark.createDataFrame([(f"r{i}", f"c{j}", float((i + 1) ** j)) for i in range(4) for j in range(2)], "row string, col string, value double")
    right = spark.createDataFrame([(f"r{i}", 3.0 + 2.0 * (i + 1)) for i in range(4)], "row string, value double")
    assert {r["row"]: round(r["value"], 9) for r in fu.solve(tall, right).collect()} == {"c0": 3.0, "c1": 2.0}


def test_batches_of_alignments():
    from tidemark.functions import sequences as sq

    rng = random.Random(5)
    pairs = [("".join(rng.choice("ACGTN") for _ in range(rng.randrange(12))), "".join(rng.choice("ACGT") for _ in range(rng.randrange(12)))) for _ in range(80)]
    for local in (True, False):
        assert sq.align_all(pairs, local=local) == [sq.align(a, b, local=local) for a, b in pairs]
        for (a, b), (score, x, y, i, j, _, _) in zip(pairs, sq.align_all(pairs, local=local), strict=True):
            assert x.replace("-", "") == a[i : i + len(x.replace("-", ""))] and y.replace("-", "") == b[j : j + len(y.replace("-", ""))]
            total, gap = 0.0, ""
            for p, q in zip(x, y, strict=True):
                side = "x" if p == "-" else "y" if q == "-" else ""
                total += -(0.5 if side == gap else 2.0) if side else 1.0 if p == q or "N" in (p, q) else -1.0
                gap = side
            assert abs(total - score) < 1e-9


def test_sampled_states_follow_the_model(spark):
    df = spark.createDataFrame([(k, 200) for k in range(60)], "k long, length long")
    start, moves, emits = {"a": 1.0, "b": 0.0}, {"a": {"a": 0.9, "b": 0.1}, "b": {"a": 0.5, "b": 0.5}}, {"a": {"x": 1.0, "y": 0.0}, "b": {"x": 0.2, "y": 0.8}}
    got = fu.sample_states(df, "k", start, moves, emits, 3)
    rows = sorted((r["k"], r["at"], r["state"], r["symbol"]) for r in got.collect())
    assert rows == sorted((r["k"], r["at"], r["state"], r["symbol"]) for r in got.repartition(3).collect()) and len(rows) == 12_000
    assert all(r[2] == "a" for r in rows if r[1] == 0) and all(r[3] == "x" for r in rows if r[2] == "a")
    assert abs(sum(r[2] == "a" for r in rows) / len(rows) - 5 / 6) < 0.03
    own = fu.path_likelihood(got, ["k"], "at", "symbol", "state", start, moves, emits)
    assert own.where("log_likelihood is null").count() == 0


def test_rates_chosen_among_given_ones(spark):
    tree = {"s1": ("r", 0.5), "s2": ("r", 0.5)}
    rows = [(0, "s1", "ACGTACGTACGTACGT"), (0, "s2", "ACGTACGTACGTACGT"), (1, "s1", "ACGTACGTACGTACGT"), (1, "s2", "CATGCTGAGTACACTT")]
    got = {r["block"]: r["rate"] for r in fu.best_rates(spark.createDataFrame(rows, "block long, species string, seq string"), tree, [0.1, 1.0, 3.0]).collect()}
    assert got[0] == 0.1 and got[1] > 0.1


def test_reading_until_a_line(spark, tmp_path):
    (tmp_path / "a").write_text("1\n2\nstop\n3\n")
    (tmp_path / "b").write_text("4\n")
    rows = text.lines(spark, str(tmp_path))
    assert sorted(r["value"] for r in fu.until(rows, F.col("value") == "stop").collect()) == ["1", "2", "4"]
