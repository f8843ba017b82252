"""Long items, shards and the longest matches over all of them."""

import random

from tidemark.llm import decontam


def grown(words, at, item, k):
    n = 0
    while at + n < len(words) and k + n < len(item) and words[at + n] == item[k + n]:
        n += 1
    return n


def test_longest_matches_over_all_shards(spark, monkeypatch):
    """Against brute force, with shards of one document and of all."""
    rng = random.Random(9)
    item = [f"t{rng.randrange(6)}" for _ in range(40)]
    docs = []
    for d in range(60):
        words = [f"t{rng.randrange(7)}" for _ in range(30)]
        k = rng.randrange(30)
        docs.append((d, words + item[k : k + rng.randrange(4, 12)] + ["x"] + [f"t{rng.randrange(6)}" for _ in range(20)]))
    want = {}
    for k in range(len(item) - 3):
        best = min((-grown(w, at, item, k), d, at) for d, w in docs for at in range(len(w)))
        if -best[0] >= 4:
            want[k] = (-best[0], best[1], best[2])
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    for size in (1, 1 << 20):
        monkeypatch.setattr(decontam, "SHARD_BYTES", size)
        got = {r["item_word"]: (r["length"], r["doc_id"], r["doc_word"]) for r in decontam.longest_matches(df, bench, window=4).collect()}
        assert got == want and len(want) > 20


def test_items_longer_than_a_block(spark):
    """An item of many blocks hits what it hits as one."""
    item = " ".join(f"w{i % 700}x{i % 11}" for i in range(5000))
    words = item.split()
    rows = [(i, "before " + " ".join(words[i * 97 : i * 97 + 14]) + " after") for i in range(40)] + [(50, " ".join(words[300:900])), (51, "w1x1 w2x2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "w1x1 w2x2")], "item_id long, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    whole, cut = (sorted(tuple(r[c] for c in names) for r in decontam.contamination(df, bench, keep=["doc_id"], limit=limit).collect()) for limit in (1 << 20, 9_000))
    assert whole == cut
    assert all(r[2] == 14 for r in whole[:40])


def test_words_longer_than_a_block(spark):
    long = "y" * 50_000
    passage = " ".join(f"{long}{i}" for i in range(12))
    df = spark.createDataFrame([(1, "a " + passage), (2, "a " + passage.replace("y0", "z0"))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontam.contamination(df, spark.createDataFrame([(1, passage)], "item_id long, text string"), keep=["doc_id"], limit=10_000).collect()}
    assert got == {1: (13, 12), 2: (13, 11)}
