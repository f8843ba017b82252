
import random

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, linededup, oracles


def test_every_repeated_run_of_lines_goes(spark):
    """Runs planted at random places, whose first and last lines have foreign neighbours, against brute force."""
    rng = random.Random(11)
    fresh = (f"line {i} of its own" for i in range(10_000))
    runs = [[next(fresh) for _ in range(n)] for n in (2, 3, 4, 5, 6, 7, 8, 20)]
    rows = []
    for d in range(40):
        text = [next(fresh) for _ in range(rng.randrange(4))]
        for run in rng.sample(runs, 2):
            text += run + [next(fresh) for _ in range(rng.randrange(1, 4))]
        rows.append((d, "\n".join(text)))
    seen, want = set(), {}
    for d, text in rows:
        lines = text.split("\n")
        pairs = list(zip(lines, lines[1:], strict=False))
        drop = {k for i, p in enumerate(pairs) if p in seen for k in (i, i + 1)}
        seen |= set(pairs)
        want[d] = "\n".join(x for i, x in enumerate(lines) if i not in drop)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df, drop_emptied=False).collect()}
    assert got == want
    assert sum(r["n_removed"] for r in linededup.dedup_digest(df).collect()) == sum(len(t.split("\n")) - (len(want[d].split("\n")) if want[d] else 0) for d, t in rows)


def test_lines_of_the_first_occurrence_stay(spark):
    rows = [(1, "a\na\na"), (2, "b\nc\n\nd\nb\nc\n\nd\n"), (3, "\n \nb\nc\n"), (4, "x\nb\nc"), (5, "c\nb")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df, drop_emptied=False).collect()}
    assert got == {1: "a\na\na", 2: "b\nc\n\nd", 3: "", 4: "x", 5: "c\nb"}


def test_copies_do_not_crowd_the_language_sample(spark):
    """A text of 6000 copies whose hash lies in the sample's share, beside other languages."""
    texts = spark.range(3000).select(F.concat(F.lit("common text "), "id").alias("t"))
    common = texts.orderBy(F.pmod(F.xxhash64("t"), F.lit(1_000_000_000))).first()["t"]
    rows = [(common, "aa")] * 6000 + [(f"{lang} words {i} {'xyz'[k]}", lang) for k, lang in enumerate(("aa", "bb", "cc")) for i in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    vectors, langs = langid.sample(df, "text", "lang", 250)
    assert {x: langs.count(x) for x in set(langs)} == {"aa": 301, "bb": 300, "cc": 300}
    held = langid.features(common).astype("float16").tobytes()
    assert [v.astype("float16").tobytes() for v in vectors].count(held) == 1


def test_items_without_an_id_hit_words(spark, tmp_path):
    """Against the registered SQL, whole windows and items shorter than one."""
    passage = " ".join(f"p{i}" for i in range(12))
    spark.createDataFrame([(1, f"a {passage} b"), (2, "x one two y five six"), (3, None), (4, "clean words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(None, passage), (None, "One two"), (7, "five SIX"), (8, None), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark")
    docs, items = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("documents", "benchmark"))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}/*.parquet'")
    want = sorted(db.execute(f"SELECT {', '.join(names)} FROM ({oracles.SQL['op4_decontamination']})").fetchall())
    for limit in (1 << 20, len(passage)):
        found = decontam.contamination(docs, items, keep=["doc_id"], limit=limit)
        assert sorted(tuple(r[c] for c in names) for r in found.collect()) == want
    assert [(r[0], r[2], r[3]) for r in want] == [(1, 12, 0), (2, 4, 1), (3, 0, 0), (4, 0, 0)]
    assert [r["doc_id"] for r in decontam.clean_documents(docs, items).orderBy("doc_id").collect()] == [3, 4]


def test_every_label_is_learned(spark):
    rng = random.Random(5)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)] for k in range(80)}
    rows = [(" ".join(rng.choice(w) for _ in range(12)), lang) for lang, w in words.items() for _ in range(20)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = langid.learn(df)
    assert model.languages == sorted(words)
    got = langid.predict(df, model, keep=["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.95 * len(rows)
