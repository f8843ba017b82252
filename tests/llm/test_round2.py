"""Hot keys, periodic texts, crowded buckets, archives of few records, clashing columns and lost caps."""

import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm import common, neardup, oracles, substring, urlfilter, warc


def test_spread_join_is_a_join(spark):
    rng = random.Random(1)
    rows = [(("hot" if i % 3 == 0 else f"k{rng.randrange(200)}"), i) for i in range(3000)]
    left = spark.createDataFrame(rows, "k string, i long")
    right = left.groupBy("k").agg(F.count("*").alias("met"), F.min("i").alias("least")).where("met > 1")
    got = sorted(tuple(r) for r in common.spread_join(left, right, "k", "met", len(rows), ["i"]).collect())
    assert got == sorted(tuple(r) for r in left.join(right.drop("met"), "k").collect())
    assert common.spread_join(left, right, "k", "met", len(rows), ["i"]).columns == ["k", "i", "least"]


def brute_substring(rows, k):
    starts = {}
    for d, text in rows:
        w = (text or "").split()
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            starts[key] = min(starts.get(key, d), d)
    out = {}
    for d, text in rows:
        w = (text or "").split()
        gone = {j for i in range(len(w) - k + 1) if starts[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


def test_periodic_and_crowded_texts(spark):
    """One word over and over, two in turn, and a passage in the midst of many different texts, with buckets sorted and dealt on."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    rows = [(1, "a " * 3000), (2, "x " + "a " * 2000 + "y"), (3, "a b " * 900), (4, "c " + "b a " * 400), (5, "a " * 60)]
    rows += [(10 + i, " ".join([f"u{rng.randrange(40)}" for _ in range(rng.randrange(25, 40))] + passage + [f"u{rng.randrange(40)}" for _ in range(25)])) for i in range(60)]
    rows += [(100 + i, rows[5 + i][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k in (50, 20):
        want = brute_substring(rows, k)
        for hot in (1_000, 3, 0):
            got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup_digest(df, k=k, hot=hot).collect()}
            assert got == want


def test_super_kmers_are_bounded():
    import numpy as np

    words = [b"a"] * 20_000
    mins, first, size = substring.super_kmers(words, common.WordHashes(), 50, 14)
    assert size.max() <= substring.LONGEST and size.sum() == 20_000 - 49 and (np.diff(first) == size[:-1]).all()


def test_near_dedup_equals_an_exact_join(spark):
    """All rows of the smallest tables against all pairs that share a shingle."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sets, holders = {}, {}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = s = {tuple(w[k : k + min(4, len(w))]) for k in range(max(1, len(w) - 3))} if w else set()
        for x in s:
            holders.setdefault(x, []).append(r["doc_id"])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    # a pair at 0.8 shares one of the rarest fifth (and one) of either set
    seen = set()
    for a, s in sets.items():
        rare = sorted(s, key=lambda x: (len(holders[x]), x))[: len(s) - -(-4 * len(s) // 5) + 1]
        for b in {b for x in rare for b in holders[x]} - {a}:
            if (min(a, b), max(a, b)) not in seen:
                seen.add((min(a, b), max(a, b)))
                common_ = len(s & sets[b])
                if 100 * common_ >= 80 * (len(s) + len(sets[b]) - common_):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 4).collect()}
    assert got == {i: find(i) for i in sets}


def test_blocks_bounded_in_bytes(spark, monkeypatch):
    """Crowded buckets cut to a few members a block by the size of their sets give what whole ones give."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(50):
        w = list(base)
        for k in rng.sample(range(60), 3):
            w[k] = f"c{rng.randrange(9)}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 4).collect()}
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2_000)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 4).collect()} == whole


def test_archives_of_few_records_have_a_dictionary():
    for n in (1, 2, 7, 8):
        records = [warc.record(i, "http://a/", b"x" * (10 ** (i % 5)), None, False) for i in range(n)]
        content = warc.write_archive(records)
        assert content[:4] == warc.DICT_FRAME.to_bytes(4, "little")
        assert content[8:12] == (0xEC30A437).to_bytes(4, "little")
        assert [len(b) for _, b in warc.read_archive(content)] == [len(r) - len(r.split(b"\r\n\r\n", 1)[0]) - 8 for r in records]


def test_one_payload_in_a_third_of_all_pages(spark):
    rows = [(i, f"http://h/{i}", "" if i % 3 == 0 else f"page {i % 50}") for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    largest = {}
    for i, _, html in rows:
        largest[html] = max(largest.get(html, i), i)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(df)).collect()}
    assert got == {i: ("response", None) if largest[h] == i else ("revisit", largest[h]) for i, _, h in rows}


def test_url_patterns_end_at_the_end(spark):
    rules = [urlfilter.host_rule("block", "example.org"), *urlfilter.PATTERNS]
    urls = ["http://example.org", "http://a.example.org/x", "http://example.organic.net/", "http://b.net/x.exe", "http://b.net/x.exe\n", "http://b.net/login\n", "http://b.net/login/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for limit in (1 << 20, 1):
        got = [r["verdict"] for r in urlfilter.filter_urls(df, rules, keep=["page_id"], limit=limit).orderBy("page_id").collect()]
        assert got == ["block", "block", "allow", "block", "allow", "allow", "block"]


def test_stages_with_columns_of_their_own_names(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "never seen words of a benchmark item that is long enough")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = {"en": "the house of words and rivers", "fr": "la maison des mots et rivières"}
    rows = [(i, f"{words[x]} {x} {i} " * 8, x) for i in range(60) for x in ("en", "fr")]
    names = ["text_key", "kept_id", "kept_key", "key", "ord", "gone", "cut", "kept", "component_id", "uid", "n", "__text", "lang_pred", "score", "ambiguous"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(f"own {c}") for c in names}).withColumns({"source": F.lit("s"), "n_chars": F.lit(0).cast("long")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        got = out.collect()
        assert got, name
        assert all(r[c] == f"own {c}" for r in got for c in names)
    assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == len(rows)


def test_line_query_against_its_sql(spark, tmp_path):
    """The registered SQL on texts with blank lines, repeats within a text and nulls."""
    import duckdb

    from tidemark.llm import linededup

    rng = random.Random(12)
    lines = ["a", "b", "c", "", " ", "\t", "d e", "f"]
    rows = [(i, None if i % 17 == 0 else "\n".join(rng.choice(lines) for _ in range(rng.randrange(9)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = sorted(db.execute(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({oracles.SQL['op3_line_dedup']})").fetchall())
    assert sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in linededup.dedup_digest(df).collect()) == want
