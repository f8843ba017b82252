"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, langid, linededup, neardup, sharding, substring, topk, urlfilter, warc

LONG = " ".join(f"w{i}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, "one two three four five six", "en"), (2, "one two three four five six", "en"), (2, "one two three four five six", "en"), (3, None, "fr"), (4, "", None), (None, "text without an id", "en"),
    (None, None, None), (5, LONG, "en"), (6, LONG + " x", "en"), (7, "a " + PASSAGE + " b", "fr"), (8, "c " + PASSAGE + " d", "fr"), (9, " \n\t ", "fr"), (10, "123 456 !!", "en"), (11, "x\ny\nz\nx\ny\nz\nq", "en"),
]
#: Names that operators use inside.
CLASHES = ["key", "uid", "ord", "gone", "cut", "spans", "fp", "n", "size", "shard", "text_key", "n_words", "items", "component_id", "kept", "lang_pred", "score"]


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(c) for c in CLASHES}).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(0).cast("long")).select("source", *CLASHES, "doc_id", "text", "lang", "n_chars")


def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (None, "one two"), (4, "five SIX")], "item_id long, text string")


TOK = public_tokenizers.path("word_bpe_49k.json")
RUNS = {
    "bpe": lambda s, d: bpe.encode_digest(d, TOK, keep=["doc_id"]),
    "lines": lambda s, d: linededup.dedup_digest(d),
    "lines_whole": lambda s, d: linededup.dedup_lines(d, drop_emptied=False),
    "decontam": lambda s, d: decontam.contamination(d, benchmark(s), keep=["doc_id"]),
    "sharding": lambda s, d: sharding.shard(d, 3),
    "neardup": lambda s, d: neardup.near_duplicates(d, 4),
    "langid": lambda s, d: langid.identify(d, keep=["doc_id"]),
    "langid_whole": lambda s, d: langid.identify(d.drop("lang_pred", "score"), keep=d.drop("lang_pred", "score").columns),
    "substring": lambda s, d: substring.dedup_digest(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_for_every_row(spark, name):
    assert RUNS[name](spark, frame(spark)).count() == len(ROWS)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, frame(spark, [])).count() == 0


def test_decontam_values(spark):
    got = {r["doc_id"]: r for r in RUNS["decontam"](spark, frame(spark)).collect() if r["doc_id"] is not None}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["items"]) == (6, 4, ["4"])
    assert (got[7]["n_words"], got[7]["n_hit"], got[7]["items"]) == (62, 60, ["1"])
    assert (got[3]["n_words"], got[3]["contaminated"], got[3]["items_sha256"]) == (0, False, hashlib.sha256(b"").hexdigest())
    assert max(m["length"] for m in got[7]["matches"] + got[8]["matches"]) == 60
    kept = decontam.clean_documents(frame(spark), benchmark(spark))
    assert kept.columns == frame(spark).columns
    assert not {1, 2, 7, 8} & {r["doc_id"] for r in kept.collect()}


def test_decontam_in_blocks(spark):
    one = decontam.contamination(frame(spark), benchmark(spark), keep=["doc_id"]).drop("matches")
    some = decontam.contamination(frame(spark), benchmark(spark), keep=["doc_id"], limit=len(PASSAGE)).drop("matches")
    assert sorted(map(str, one.collect())) == sorted(map(str, some.collect()))


def test_neardup_values(spark):
    got = {(r["doc_id"], r["n_shingles"]): r for r in neardup.near_duplicates(frame(spark), 4).collect()}
    assert got[2, 3]["component_id"] == 1 and not got[2, 3]["kept"]
    assert got[6, 29_998]["component_id"] == 5
    assert got[3, 0]["component_id"] == 3 and got[3, 0]["kept"]
    assert got[None, 1]["component_id"] is None


def test_substring_values(spark):
    got = {r["doc_id"]: r for r in substring.dedup_digest(frame(spark)).collect()}
    assert got[8]["n_removed"] == 60 and got[7]["n_removed"] == 0
    assert got[8]["kept_sha256"] == hashlib.sha256(b"c d").hexdigest()
    assert got[6]["n_removed"] == 30_000
    hot = {r["doc_id"]: r for r in substring.dedup_digest(frame(spark), hot=0).collect()}
    assert hot == got


def test_lines_values(spark):
    got = {r["doc_id"]: r for r in linededup.dedup_digest(frame(spark)).collect()}
    assert got[2]["n_removed"] == 0 and got[3]["n_lines"] == 0 and got[4]["n_lines"] == 1
    text = "".join(f"line number {i}\n" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, "other start\n" + text), (3, text), (3, text)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert out[1] == text and 3 not in out and out[2].startswith("other start") and len(out[2]) < 200


def test_langid_values(spark):
    got = {r["doc_id"]: r for r in langid.identify(frame(spark), keep=["doc_id"]).collect()}
    for i in (3, 4, 9, 10):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert langid.identify(frame(spark, [(1, "abc", None)])).first()["lang_pred"] == "und"


def test_sharding_values(spark):
    rows = sharding.shard(frame(spark), 3).collect()
    slots = sorted((r["shard"], r["slot"]) for r in rows)
    assert slots == sorted((i % 3, i // 3) for i in range(len(ROWS)))


PAGES = [(1, "http://Sub.Example.org/es/1?q", "a"), (2, None, None), (3, "no scheme", ""), (4, "x://a.org", "a"), (4, "x://a.org", "a"), (None, "https://b.com/fr/", "a"), (5, "http://ads.net/\n", "ü" * 100_000), (6, "u://example.org/en/1", "q"), (None, None, "only")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("host", "path", "digest", "payload", "n", "token", "verdict", "weight")})


def test_urls(spark):
    rules = [urlfilter.host_rule("allow", "org/"), urlfilter.host_rule("block", "example.org/es/"), *urlfilter.PATTERNS]
    for limit in (1 << 20, 1):
        got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages(spark), rules, keep=["page_id"], limit=limit).orderBy("page_id", "host").collect()]
        assert ("sub.example.org", "/es/1", "example.org/es/", "block") in got
        assert got.count(("", "", None, "allow")) == 3
        assert got.count(("a.org", "", None, "allow")) == 2
        assert ("ads.net", "/\n", None, "block") in got
        assert ("example.org", "/en/1", "org/", "allow") in got
        assert len(got) == len(PAGES)
    assert urlfilter.filter_urls(pages(spark, []), rules).count() == 0


def test_warc(spark, tmp_path):
    archives = warc.write_archives(pages(spark)).cache()
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(archives).collect()), key=str)
    assert got == sorted([(1, 1, "revisit", 4), (2, 0, "revisit", 3), (3, 0, "response", None), (4, 1, "response", None), (4, 1, "response", None), (0, 1, "revisit", 4), (5, 200_000, "response", None), (6, 1, "response", None), (0, 4, "response", None)], key=str)
    warc.save_archives(archives, str(tmp_path))
    assert sum(len(list(warc.read_archive(p.read_bytes()))) for p in tmp_path.glob("*.warc.zst")) == len(PAGES)
    assert warc.read_archives(warc.write_archives(pages(spark, []))).count() == 0


def test_warc_dictionary():
    records = [warc.record(i, f"http://a/{i}", b"<html>common words in every page %d</html>" % i * 20, None, False) for i in range(200)]
    content = warc.write_archive(records)
    assert content[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert [int(f["WARC-Record-ID"][10:-1]) for f, _ in warc.read_archive(content)] == list(range(200))


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, []), (8, [-1.0]), (None, [9.0, 9.0]), (9, [1e12, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in ("id", "v", "rank", "score")})
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=4).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(1, 9, 64 * 64 * 999_999_995_904), (2, 1, 4096), (3, 2, 4096), (4, 2, 4096)]
    everything = topk.top_k(df, F.col("vec_id") == 0, k=50).collect()
    assert len(everything) == 7
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_stages(spark, tmp_path):
    import corpus_pipeline

    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    cols = ["doc_id", "text", "lang", "source", "n_chars", "key", "uid", "ord", "gone"]
    for name, stage in corpus_pipeline.STAGES:
        for rows in (ROWS, []):
            out = stage(spark, frame(spark, rows).select(*cols), str(tmp_path))
            assert out.count() <= len(rows)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == cols
