from pyspark.sql import functions as F

from tidemark.operators import extra as ex


def test_amplicons_and_hairpins(spark):
    df = spark.createDataFrame([("a", "ttACGTccccTTGGaaACGTgTTGG")], "id string, seq string")
    assert [r["amplicon"] for r in ex.amplicons(df, "ACGT", "CCAA", 8, 20).collect()] == ["ACGTCCCCTTGG", "ACGTGTTGG"]
    r = spark.range(1).select(ex.has_hairpin(F.lit("GGGGAAATCCCC"), 4).alias("a"), ex.has_hairpin(F.lit("GGGGAAATAAAA"), 4).alias("b"), ex.has_hairpin(F.lit("GG"), 4).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (True, False, False)


def test_discrete(spark):
    m = spark.createDataFrame([("r", "a", -2.0), ("r", "b", 0.0), ("r", "c", 3.0)], "row string, col string, value double")
    assert [r["value"] for r in ex.discrete(m, -1, 1).orderBy("col").collect()] == [-1, 0, 1]
