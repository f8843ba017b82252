"""Whole batches through the chunk cache, against the tokenizers library."""

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
BLANKS = [chr(x) for x in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, 0x2003, 0x200B, 0x2028, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]


def odd_texts(rng, n):
    words = ["hello", "New", "york's", "ÄRA", "ΑΣ", "été", "́x", "İs", "漢字", "12", "a-b", "<|endoftext|>", "naïve", "ẛ̣", "ﬁ"]
    return ["".join(rng.choice(words) + rng.choice(BLANKS) * rng.randrange(3) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_batches_with_odd_blanks(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(8)
    texts = ["hello   new york times", "plain words between", " ", "　 x 　y", "a\x1cb \x85 c", *odd_texts(rng, 600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in bpe.encode(df, PATH, keep=["doc_id"]).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i]["ids"] == " ".join(map(str, ids)), repr(text)
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)


def test_small_generations_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "GENERATION_BYTES", 2_000)
    library = Tokenizer.from_file(PATH)
    cache = bpe.ChunkCache(bpe.PairIndexBpe(open(PATH).read()))
    rng = random.Random(2)
    for _ in range(30):
        texts = odd_texts(rng, 20)
        docs = [t.encode().split() for t in texts]
        known = cache.learn(docs)
        for text, doc in zip(texts, docs, strict=True):
            values = [known[c].split(b"\n")[0].decode() for c in doc if known[c]]
            assert " ".join(values) == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))
        assert cache.chunks.size < 60_000 and len(cache.chunks.young) + len(cache.chunks.old) < 600


def test_groups_are_cut_by_bytes():
    import pyarrow as pa

    texts = ["x" * n for n in (10, bpe.GROUP_BYTES * 2, 5, bpe.GROUP_BYTES - 5, 1, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    assert [p.num_rows for p in bpe.grouped(batch, 0)] == [1, 1, 2, 3]


def test_added_tokens_that_reach_out_are_refused():
    spec = json.loads(open(PATH).read())
    spec["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError, match="added tokens"):
        bpe.PairIndexBpe(json.dumps(spec))
