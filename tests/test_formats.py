"""Readers against literal files and the round trips through the writers."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import sinks, text


def put(tmp_path, name, content):
    (tmp_path / name).write_text(content)
    return str(tmp_path / name)


def test_tabbed_and_annotations(spark, tmp_path):
    p = put(tmp_path, "t.tsv", "head\nx\t1\ny\tz\n")
    assert sorted(tuple(r) for r in text.tabbed(spark, p, {"a": "string", "n": "int"}, skip_rows=1).collect()) == [("x", 1), ("y", None)]
    p = put(tmp_path, "a.tsv", "#c\n\nx\t1\n")
    assert [tuple(r) for r in text.annotation_table(spark, p, {"a": "string", "n": "int"}, F.col("n") > 0).collect()] == [("x", 1)]
    with pytest.raises(Exception, match="track line"):
        text.annotation_table(spark, put(tmp_path, "b.tsv", "track name=x\nx\t1\n"), {"a": "string"}).collect()


def test_bed_round_trip(spark, tmp_path):
    line = "chr1\t100\t200\tg\t5\t-\t110\t190\t0\t2\t30,40\t0,60"
    p = put(tmp_path, "g.bed", f"track x\nbrowser y\n# z\n\n{line}\n{line}\nchr2\t1\t5\n")
    df = text.bed(spark, p)
    assert df.count() == 2
    assert [r["value"] for r in sinks.bed(df.where("name is not null")).collect()] == [line]
    assert [r["value"] for r in sinks.ref_seq(df.where("name is not null")).collect()] == ["g\tchr1\t-\t100\t200\t110\t190\t2\t100,160,\t130,200,"]
    assert df.where("chr = 'chr2'").first()["strand"] == "*"
    assert [r["value"] for r in sinks.ucsc(df.where("name is not null")).collect()] == ["chr1:100-200"]


def test_chromosome_sizes(spark, tmp_path):
    p = put(tmp_path, "s", "a\t5\nb  7\na 6\n\nc 9\n")
    assert sorted(map(tuple, text.chromosome_sizes(spark, p).collect())) == [("a", 6), ("b", 7)]


def test_psl(spark, tmp_path):
    good = "\t".join(map(str, [8, 1, 0, 0, 0, 0, 1, 50, "+", "q", 10, 0, 9, "chr1", 1000, 100, 159, 2, "4,5,", "0,4,", "100,154,"]))
    r = text.psl(spark, put(tmp_path, "p.psl", "psLayout version 3\n" + good + "\n")).first()
    assert abs(r["identity"] - 8 / 9) < 1e-9 and [(b["start"], b["end"]) for b in r["blocks"]] == [(100, 104), (154, 159)]
    assert sinks.sam(text.psl(spark, str(tmp_path / "p.psl"))).first()["value"].split("\t")[5] == "4M50N5M"
    for bad in (good.replace("159\t2", "160\t2"), good.replace("4,5,", "4,"), "8\t1"):
        with pytest.raises(Exception, match="blocks disagree|too few"):
            text.psl(spark, put(tmp_path, "bad.psl", bad + "\n")).collect()


def test_mapping_table(spark, tmp_path):
    p = put(tmp_path, "m", "a\tb\tc\n1\t2\t3\n")
    assert tuple(text.mapping_table(spark, p, ["c", "a"]).first()) == ("3", "1")
    with pytest.raises(ValueError, match="lacks"):
        text.mapping_table(spark, p, ["z"])


def test_fastq_and_fasta(spark, tmp_path):
    p = put(tmp_path, "r.fastq", "@a\nACGT\n+\n@III\n@b\nAAAA\n+\nIIII\n")
    df = text.fastq(spark, p)
    assert [(r["id"], r["seq"], r["qual"]) for r in df.orderBy("i").collect()] == [("a", "ACGT", "@III"), ("b", "AAAA", "IIII")]
    assert [r["value"] for r in sinks.fasta(df, numbered=True).collect()] == [">1\nACGT", ">2\nAAAA"]
    p = put(tmp_path, "s.fa", ">x one two\nAC\nGT # note\n>y\nTT")
    assert sorted(map(tuple, text.fasta(spark, p).collect())) == [("x", "one two", "ACGT"), ("y", "", "TT")]
    assert sinks.fasta(spark.createDataFrame([("x", "ACGTA")], "id string, seq string"), width=2).first()["value"] == ">x\nAC\nGT\nA"
    q = text.fasta_quality(spark, put(tmp_path, "q", ">x\n10 20\n30\n>y\n1\n"))
    assert sorted(map(tuple, q.collect())) == [("x", [10, 20, 30]), ("y", [1])]


def test_gene_sets(spark, tmp_path):
    p = put(tmp_path, "x.gmt", "s\td\tb\ta\tB\nt\td\tq\n\nu\td\tz\tw\n")
    assert sorted(map(tuple, text.gene_sets(spark, p, 1).collect())) == [("s", "A"), ("s", "B")]
    assert [r["value"] for r in sinks.gmt(text.gmt(spark, p, 1)).collect()] == ["s\ts\tA\tB"]
    p = put(tmp_path, "x.gmx", "s\tt\nna\tna\na\tb\nc\t\n")
    assert sorted(map(tuple, text.gene_sets(spark, p, 1).collect())) == [("s", "a"), ("s", "c")]
    c = text.chip(spark, put(tmp_path, "x.chip", "p1\tg\np2\tG\np1\th\n"))
    assert sorted(map(tuple, c.collect())) == [("p1", "H"), ("p2", "G")]
    assert text.probes_by_gene(c).where("gene = 'G'").first()["probes"] == ["p2"]


def test_sam(spark, tmp_path):
    body = "@SQ\tSN:chr1\tLN:500\nr1\t99\tchr1\t101\t60\t5S10M20N5M2D3M\t=\t301\t210\t*\t*\tNH:i:2\nr2\t16\tchr1\t11\t9\t*\t*\t0\t0\t*\t*\n"
    p = put(tmp_path, "x.sam", body)
    r = text.sam(spark, p).collect()
    assert len(r) == 1 and [(b["start"], b["end"]) for b in r[0]["blocks"]] == [(100, 110), (130, 140)]
    assert (r[0]["start"], r[0]["end"], r[0]["nh"], r[0]["is_first"], r[0]["mate_chr"], r[0]["mate_start"], r[0]["mate_strand"]) == (100, 140, 2, True, "chr1", 300, "-")
    assert text.sam(spark, p, keep_unmapped=True).count() == 2
    assert tuple(text.sam_references(spark, p).first()) == ("chr1", 500)


def test_gff_and_repeats(spark, tmp_path):
    p = put(tmp_path, "x.gtf", '#c\nchr1\ts\texon\t11\t20\t.\t+\t.\tgene_id "g 1"; transcript_id "t";\nchr1\ts\tgene\t1\t5\t2\t-\t0\tID=q;Name=n\n')
    a, b = text.gff(spark, p).orderBy("start", ascending=False).collect()
    assert (a["start"], a["end"], a["attributes"]) == (10, 20, {"gene_id": "g 1", "transcript_id": "t"}) and b["attributes"] == {"ID": "q", "Name": "n"}
    r = text.repeat_masker(spark, put(tmp_path, "r.out", "SW\nscore\n\n  463 1.3 0.6 1.7 chr1 10001 10468 (9) C (TAACCC)n Simple_repeat 1 471 (0) 1\n")).first()
    assert (r["start"], r["end"], r["strand"], r["family"]) == (10000, 10468, "-", "Simple_repeat")


def test_matrices(spark, tmp_path):
    m = spark.createDataFrame([("r1", "a", 1.5), ("r1", "b", 2.0), ("r2", "a", 3.0)], "row string, col string, value double")
    sinks.write_text(sinks.gct(m), str(tmp_path / "m"), one_file=True)
    part = next((tmp_path / "m").glob("part-*"))
    assert part.read_text().splitlines()[:3] == ["#1.2", "2\t2", "Name\tDescription\ta\tb"]
    assert sorted(map(tuple, text.gct(spark, str(part)).select("row", "col", "value").collect())) == sorted(map(tuple, m.collect()))
    plain = text.gct(spark, put(tmp_path, "plain", "id\tx\ty\nq\t1\t2\n"))
    assert sorted(map(tuple, plain.collect())) == [("q", None, "x", 1.0), ("q", None, "y", 2.0)]
    assert [r["label"] for r in text.cls(spark, put(tmp_path, "c.cls", sinks.cls(["u", "v", "u"]))).orderBy("i").collect()] == ["u", "v", "u"]


def test_alignment_files(spark, tmp_path):
    p = put(tmp_path, "x.maf", "##maf\na score=1\ns hg.chr1 5 3 + 100 AC-G\ns mm.chr2 7 4 - 90 ACTG\n\na\ns hg.chr1 9 1 + 100 T\n")
    assert [(r["block"], r["species"], r["start"], r["seq"]) for r in text.maf(spark, p).orderBy("block", "species").collect()] == [(1, "hg", 5, "AC-G"), (1, "mm", 7, "ACTG"), (2, "hg", 9, "T")]
    p = put(tmp_path, "i.phy", "2 8\na  ACGT\nb  TTTT\n\nAA CC\nGGGG\n")
    assert sorted(map(tuple, text.phylip(spark, p, interleaved=True).collect())) == [("a", "ACGTAACC"), ("b", "TTTTGGGG")]
    p = put(tmp_path, "s.phy", "2 6\na  ACG\n   TAA\nb  TTTTTT\n")
    assert sorted(map(tuple, text.phylip(spark, p).collect())) == [("a", "ACGTAA"), ("b", "TTTTTT")]


def test_reports(spark, tmp_path):
    report = "MOTIF  1\twidth =    2   sites =   3   llr = 30   E-value = 1.2e-004\n\tMotif 1 sites sorted by position p-value\nq1   5  1.0e-03  AC GT TT\n\nletter-probability matrix: x\n 0.5 0.5 0.0 0.0\n 0.1 0.2 0.3 0.4\n--\n"
    motifs, sites = text.motif_report(spark, report)
    r = motifs.first()
    assert (r["motif"], r["width"], r["sites"], r["llr"], r["evalue"], r["pwm"]) == ("1", 2, 3, 30.0, 1.2e-4, [[0.5, 0.5, 0.0, 0.0], [0.1, 0.2, 0.3, 0.4]])
    assert sites.count() == 1
    p = put(tmp_path, "e", "x\n1. A B C D M3 p 1e-3 q r (2e-2)\n")
    r = text.motif_enrichment(spark, put(tmp_path, "e2", "junk\n1. a b c d M3 0.001 x y 0.02)\n")).first()
    assert (r["motif"], r["p"], r["corrected_p"]) == ("M3", 0.001, 0.02) and p


def test_experiments_and_barcodes(spark, tmp_path):
    p = put(tmp_path, "e", "b\te\tp\tA1\td\tno\tControl\t12\tx\t3\n")
    r = text.experiments(spark, p).first()
    assert (r["qc_flag_no"], r["is_control"], r["time_point"], r["batch"]) == (True, True, 12, "3")
    assert sorted(map(tuple, text.barcode_map(spark, put(tmp_path, "b", "AC s1\nGT  s2\nAC s3\n")).collect())) == [("AC", "s3"), ("GT", "s2")]
    d = spark.createDataFrame([(1, 3), (3, 1)], "distance int, n long")
    assert sinks.barcode_report(d).splitlines()[:2] == ["min\t1", "max\t3"]


def test_fields_and_order(spark, tmp_path):
    df = spark.createDataFrame([("a 5 x",)], "v string")
    parts = text.parse_fields(F.col("v"))
    assert tuple(df.select(text.typed(parts, 1, "int"), text.index_of(parts, "x"), text.index_of(parts, "q")).first()) == (5, 2, -1)
    with pytest.raises(Exception, match="field 2 is no int"):
        df.select(text.typed(parts, 2, "int")).collect()
    rows = spark.createDataFrame([(0, "a", 1), (1, "a", 3), (2, "a", 2)], "i long, chr string, start long")
    with pytest.raises(Exception, match="not sorted"):
        text.assert_sorted(rows, ["chr", "start"], "i").collect()
    assert text.assert_sorted(rows.where("i < 2"), ["chr", "start"], "i").count() == 2
    (tmp_path / "sub").mkdir()
    put(tmp_path / "sub", "x.bed", "c\t1\t2\n")
    assert [r["name"] for r in text.annotation_files(spark, str(tmp_path), ["bed"]).collect()] == ["sub.x"]


def test_other_writers(spark):
    df = spark.createDataFrame([("c", 0, 5, 1.0, "g", "+")], "chr string, start long, end long, score double, name string, strand string")
    assert sinks.bedgraph(df).first()["value"] == "c\t0\t5\t1"
    assert [r["value"] for r in sinks.wig(df, "start", "score").collect()] == ["variableStep chrom=c", "1 1"]
    assert sinks.short_bed(df).first()["value"] == "c\t0\t5\tg"
