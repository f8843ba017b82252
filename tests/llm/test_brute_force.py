"""The operators against brute-force versions, libraries, round trips and held-out accuracy."""

import hashlib
import random

import naive
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, decontam, langid, linededup, neardup, queries, sharding, substring, topk
from tidemark.llm.common import WordHashes, power_hashes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_bpe_against_the_library(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.PairIndexBpe(open(path).read())
    rng = random.Random(3)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(1, 0xD000)])) for _ in range(30)) for _ in range(300)]
    for text in [*[t for _, t in docs[:60]], *odd, "", "a<|endoftext|>b it'll \x1c\x85ΑΣ İ", "aaaaaaa"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_with_merges_out_of_order():
    import json

    spec = {"model": {"type": "BPE", "vocab": {c: i for i, c in enumerate(["a", "b", "c", "d", "bc", "abc", "dabc", "da"])}, "merges": ["da bc", "d abc", "a bc", "b c", "d a"]}, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "decoder": None}
    spec["model"]["vocab"]["dabc"] = 6
    own = bpe.PairIndexBpe(json.dumps({"version": "1.0", "truncation": None, "padding": None, "post_processor": None} | spec))

    def plain(word):
        parts = list(word)
        while True:
            ranked = [(own.ranks[own.vocab[a] * own.width + own.vocab[b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if own.vocab[a] * own.width + own.vocab[b] in own.ranks]
            if not ranked:
                return [own.vocab[p] for p in parts]
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14))) for _ in range(500)]
    got = own.encode_words(words)
    assert all(got[w] == plain(w) for w in words)


def test_bpe_query(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in queries.op1_bpe(spark, SF).collect()}
    for i, text in docs:
        ids = library.encode(text, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_line_dedup_query(spark, docs):
    got = {r["doc_id"]: r for r in queries.op3_line_dedup(spark, SF).collect()}
    for i, (left, removed) in naive.without_repeated_lines(dict(docs)).items():
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (removed, hashlib.sha256((left or "").encode()).hexdigest())


def test_language_query_against_plain_version(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in queries.op7_language_id(spark, SF).collect()}
    for i, (lang, score, ambiguous) in naive.languages(rows).items():
        assert abs(got[i]["score"] - score) < 1e-3
        assert got[i]["lang_pred"] == lang or ambiguous


def test_chunk_ends_resist_shifts():
    lines = [b"line %d" % i for i in range(200)]
    whole = {c for _, _, c in linededup.chunks(b"\n".join(lines))}
    shifted = {c for _, _, c in linededup.chunks(b"\n".join([b"new", *lines]))}
    assert len(whole - shifted) <= 3


def test_suffix_array_and_longest_matches():
    rng = random.Random(5)
    words = [b"w%d" % i for i in range(6)]
    texts = [b" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(40)]
    items = [(str(i), b" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(12)]
    window = 4
    test = decontam.prepare(items, window)
    windows = [(i, tuple(w[k : k + min(window, len(w))])) for i, w in ((i, t.split()) for i, t in items) for k in range(max(1, len(w) - window + 1))]
    for raw, (n, hit, found, _) in zip(texts, decontam.scan(texts, test, window), strict=True):
        own = raw.split()
        marks, its = set(), set()
        for i, w in windows:
            for p in range(len(own) - len(w) + 1):
                if tuple(own[p : p + len(w)]) == w:
                    marks |= set(range(p, p + len(w)))
                    its.add(i)
        assert (n, set(hit), {test.ids[i] for i in found}) == (len(own), marks, its)
    text = np.array([rng.randrange(4) for _ in range(300)])
    order = decontam.suffix_array(text, 300).tolist()
    assert order == sorted(range(300), key=lambda i: text[i:].tolist())


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 999, 1000, 1025):
        a, b = sharding.halves(n)
        x = np.arange(n)
        steps = 1
        x = sharding.permute(x, a, b)
        while (far := x >= n).any():
            x[far] = sharding.permute(x[far], a, b)
            steps += 1
        assert sorted(x.tolist()) == list(range(n))
        assert steps <= sharding.longest_walk(n)


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, 900).astype(np.uint64), rng.integers(0, 1 << 63, 100).astype(np.uint64)
    assert (np.maximum(neardup.sketch(a), neardup.sketch(b)) == neardup.sketch(np.concatenate([a, b]))).all()
    same = [(neardup.sketch(x[:900]) == neardup.sketch(x[100:])).mean() for x in rng.integers(0, 1 << 63, (60, 1000)).astype(np.uint64)]
    assert abs(np.mean(same) - 0.8) < 0.03
    other = [(neardup.sketch(x[:500]) == neardup.sketch(x[500:])).mean() for x in rng.integers(0, 1 << 63, (60, 1000)).astype(np.uint64)]
    assert np.mean(other) < 0.02


def test_neardup_in_crowded_buckets(spark):
    """A chain of texts in which neighbours are linked and far ones aren't, and many unlinked texts that share buckets."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[3 * i :], *[f"n{i}x{k}" for k in range(3 * i)]])) for i in range(40)]
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    for i in range(100, 160):
        w = list(base)
        for k in rng.sample(range(60), 2):
            w[k] = f"c{i}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in rows)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 4).collect()}
    assert got == {i: find(i) for i in ids}


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op7_language_id(spark, sf).collect() if r["held_out"]]
    assert len(held) > 200
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in held)


def test_codewords_are_distinct():
    for n in (1, 2, 3, 5, 6, 7, 20, 64):
        codes = langid.codewords(n)
        assert len({tuple(c) for c in codes}) == n


def test_substring_windows_sorted_whole():
    rng = random.Random(7)
    rows = [(" ".join(rng.choice("ab") for _ in range(12)).encode(), rng.randrange(5)) for _ in range(40)]
    got = substring.least_by_window(rows, 8)
    for i, (packed, first) in enumerate(rows):
        own = packed.split()
        for j in range(5):
            window = own[j : j + 8]
            less = any(window == p.split()[q : q + 8] and f < first for p, f in rows for q in range(5))
            assert less == any(lo <= j <= hi for lo, hi in got[i])


def test_power_hashes_tell_runs_apart():
    words = [b"a", b"b", b"a", b"b", b"c"] * 30
    h = power_hashes(WordHashes().of(words), 5, 3)
    for i in range(len(h)):
        for j in range(i):
            assert (h[i] == h[j]) == (words[i : i + 5] == words[j : j + 5])


def test_bucket_pruning_loses_nothing():
    rng = np.random.default_rng(1)
    rows = rng.integers(-40, 40, (3000, 16)) + 60 * rng.integers(-1, 2, (3000, 1)) * np.eye(16, dtype=np.int64)[rng.integers(0, 16, 3000)]
    ids = np.arange(3000)
    bucket = topk.Bucket(ids, rows)
    pruned = 0
    for q in rows[:100]:
        scores = topk.products(q[None], rows)[0]
        level = np.sort(scores)[-20]
        found = bucket.candidates(q, float(np.sqrt((q.astype(float) ** 2).sum())), float(level))
        assert set(ids[scores >= level].tolist()) <= set(bucket.ids[found].tolist())
        pruned += 3000 - len(found)
    assert pruned > 0


def test_pipeline_against_its_stages(spark, tmp_path):
    """run() gives what brute-force versions of the stages give one after the other."""
    import corpus_pipeline

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    told = {i for i, (lang, _, ambiguous) in naive.languages([(r["doc_id"], r["text"], r["lang"]) for r in rows.values()]).items() if lang != "und" and not ambiguous}
    cut = naive.without_repeated_lines({i: rows[i]["text"] for i in told})
    texts = {i: left.encode() for i, (left, removed) in cut.items() if left or not removed}
    sets = {i: {tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in sorted(sets):
        for y in sorted(sets):
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontam.fold_words(r["text"].encode())
        windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in texts.items():
        w = decontam.fold_words(t)
        if find(i) == i and not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            want[i] = len(library.encode(t.decode(), add_special_tokens=False).ids)
    assert {i: r["n_tokens"] for i, r in got.items()} == want
