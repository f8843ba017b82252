"""BPE encoding and decoding with a pair occurrence index.

The words that a worker has not met before are laid out in one array of symbols. An index maps every mergeable pair to all its
positions there; ranks with positions are applied in ascending order from a heap, each merge updating the position lists of the
neighbouring pairs only. Words are independent, so this gives each word what merging it alone would give.

Defined results: null text is empty text; empty text has no tokens (the hash of the empty string); long texts are processed whole;
repeated rows give repeated results; an empty table gives an empty result; further columns of the input are left out, whatever
their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import blobs, bound_batches, check_side_data, release_memory

#: Bytes of text whose unknown words are encoded together (one longer text makes a group of its own).
GROUP_BYTES = 1 << 19
#: Bytes that one generation of a task's cache may hold; there are two generations of chunks and two of words.
GENERATION_BYTES = 24 << 20
#: What an entry takes beside its key's and its value's own bytes: two object heads and a place in the table.
ENTRY_BYTES = 112
#: White space of any Unicode version: a chunk with one of these may normalize to none, or to several, words.
BLANK = re.compile("[\\s\u180e\u200b\u2060\ufeff]")

#: Below this code point, character classes are the same in all Unicode versions in use.
STABLE = 0x250


def byte_symbols() -> str:
    """The printable character that stands for each byte in byte-level vocabularies, by byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(spare)) for b in range(256))


def stable_pattern(pattern: str) -> re.Pattern:
    """A splitting expression with its classes of letters, numbers and white space spelled out below ``STABLE``."""
    members = lambda keep: "".join(re.escape(chr(i)) for i in range(STABLE) if keep(unicodedata.category(chr(i)), chr(i)))
    letters, numbers = members(lambda c, _: c[0] == "L"), members(lambda c, _: c[0] == "N")
    spaces = members(lambda c, x: c == "Zs" or x in "\t\n\v\f\r\x85")
    spelled = pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")
    return re.compile(spelled.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", spaces))


class PairIndexBpe:
    """The merges of a byte-level BPE tokenizer file; ``encode`` and ``decode`` agree with the tokenizers library.

    Normalizing and splitting are the library's; laying out, merging and decoding are done here.
    """

    def __init__(self, spec: str) -> None:
        tok = json.loads(spec)
        model = tok["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or tok.get("decoder"):
            raise ValueError("only plain BPE models without a decoder are supported")
        if any(x.get(k) for x in tok["added_tokens"] for k in ("normalized", "lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that are normalized, strip their neighbours or match whole words only are not supported")
        library = Tokenizer.from_str(spec)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in tok["added_tokens"]}
        self.added = {x["content"]: x["id"] for x in tok["added_tokens"]}
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.width = max(self.names) + 1
        split = next((x for x in (tok.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"), None)
        byte_level = [x["type"] for x in (tok.get("pre_tokenizer") or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"]
        self.quick = stable_pattern(split["pattern"]["Regex"]) if byte_level and split["behavior"] == "Removed" and split["invert"] else None
        self.bytes = {i: c for i, c in enumerate(byte_symbols())}
        steps = tok.get("normalizer") or {"type": "Sequence", "normalizers": []}
        steps = steps.get("normalizers", [steps])
        # each of these leaves a blank between two words alone and looks at nothing beyond it
        self.apart = all(x["type"] in ("NFC", "Lowercase") or x == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for x in steps)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks: dict[int, int] = {}
        self.merged: list[tuple[int, int, int]] = []
        for rank, (a, b) in enumerate(merges):
            self.merged.append((self.vocab[a], self.vocab[b], self.vocab[a + b]))
            self.ranks[self.vocab[a] * self.width + self.vocab[b]] = rank
        # the symbols of characters within a word and at its end
        top = max((ord(t[0]) for t in self.vocab if len(t) in (1, 1 + len(self.suffix))), default=0) + 2
        self.inner, self.outer = np.full(top, -1, np.int64), np.full(top, -1, np.int64)
        for token, i in self.vocab.items():
            if len(token) == 1:
                self.inner[ord(token)] = i
            if len(token) == 1 + len(self.suffix) and token.endswith(self.suffix):
                self.outer[ord(token[0])] = i
        keys = np.array(list(self.ranks), np.int64)
        self.order = np.argsort(keys)
        self.keys, self.key_ranks = keys[self.order], np.array(list(self.ranks.values()), np.int64)[self.order]

    def split(self, text: str) -> list[str]:
        """The pieces of a text without added tokens, in the vocabulary's byte characters."""
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        return [x for x, _ in self.splitter.pre_tokenize_str(text)] if self.splitter else [text]

    def split_all(self, chunks: list[str]) -> list[list[str]]:
        """``split`` of many texts without ASCII white space: those without any other white space are normalized together, and split
        here where their characters allow it."""
        if not self.quick or not self.apart:
            return [self.split(c) for c in chunks]
        together = [c for c in chunks if not BLANK.search(c)] if BLANK.search("".join(chunks)) else chunks
        normal = self.normalizer.normalize_str(" ".join(together)).split(" ") if self.normalizer and together else together
        if len(normal) != len(together):
            raise AssertionError("the normalizer moved a boundary between words")
        out, find, table = [], self.quick.findall, self.bytes
        texts = iter(normal)
        for chunk in chunks:
            if together is not chunks and BLANK.search(chunk):
                out.append(self.split(chunk))
                continue
            text = next(texts)
            if text.isascii():
                out.append(find(text) if text.isprintable() else self.split(chunk))
            elif text and max(text) < chr(STABLE) and text.isprintable():
                out.append([w.encode().decode("latin-1").translate(table) for w in find(text)])
            else:
                out.append(self.split(chunk))
        return out

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of each word."""
        words = [w for w in dict.fromkeys(words) if w]
        if not words:
            return {"": []}
        codes = np.minimum(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), len(self.inner) - 1)  # the last place is no symbol
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.concatenate([[0], ends[:-1]])
        flat = self.inner[codes]
        flat[ends - 1] = self.outer[codes[ends - 1]]
        if (flat < 0).any():
            raise KeyError("".join(words)[np.flatnonzero(flat < 0)[0]])
        place = np.arange(len(flat))
        last, first = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
        last[ends - 1] = first[starts] = True
        sym, after, before = flat.tolist(), np.where(last, -1, place + 1).tolist(), np.where(first, -1, place - 1).tolist()
        rank_of, width, merged = self.ranks.get, self.width, self.merged
        places: dict[int, list[int]] = {}
        at = np.flatnonzero(~last)
        if len(at) and len(self.keys):
            pair = flat[at] * width + flat[at + 1]
            spot = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = self.keys[spot] == pair
            at, found_ranks = at[known], self.key_ranks[spot[known]]
            by = np.argsort(found_ranks, kind="stable")
            ordered, lists = found_ranks[by], at[by].tolist()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1, [len(by)]]).tolist()
            if lists:
                places = {int(ordered[i]): lists[i:j] for i, j in zip(edges, edges[1:], strict=False)}
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, new = merged[rank]
            found = places.pop(rank)
            found.sort()
            for k, p in enumerate(found):
                q = after[p]
                if q < 0 or sym[p] != left or sym[q] != right:
                    continue
                sym[p], sym[q] = new, -1
                r = after[p] = after[q]
                sooner = False
                if r >= 0:
                    before[r] = p
                    x = rank_of(new * width + sym[r])
                    if x is not None:
                        if x in places:
                            places[x].append(p)
                        else:
                            places[x] = [p]
                            heapq.heappush(active, x)
                        sooner = x < rank
                o = before[p]
                if o >= 0:
                    x = rank_of(sym[o] * width + new)
                    if x is not None:
                        if x in places:
                            places[x].append(o)
                        else:
                            places[x] = [o]
                            heapq.heappush(active, x)
                        sooner = sooner or x < rank
                if sooner and k + 1 < len(found):  # a merge list out of order: the new pair goes first
                    if rank not in places:
                        places[rank] = []
                        heapq.heappush(active, rank)
                    places[rank].extend(found[k + 1 :])
                    break
        flat = np.array(sym)
        left = flat >= 0
        ids, ends = flat[left].tolist(), np.cumsum(np.add.reduceat(left, starts)).tolist()
        return {"": []} | {word: ids[i:j] for word, i, j in zip(words, [0, *ends], ends, strict=False)}

    def segments(self, text: str) -> Iterator[str | int]:
        """Ids of added tokens, and the texts between them."""
        at = 0
        for m in self.added_pattern.finditer(text) if self.added_pattern else ():
            if m.start() > at:
                yield text[at : m.start()]
            yield self.added[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:]

    def encode(self, text: str | None) -> list[int]:
        """Token ids of one text."""
        ids: list[int] = []
        for part in self.segments(text or ""):
            if isinstance(part, int):
                ids.append(part)
            else:
                pieces = self.split(part)
                known = self.encode_words(pieces)
                for piece in pieces:
                    ids.extend(known[piece])
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens, special ones included, joined by spaces as the library does without a decoder; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


class Generations:
    """bytes or str -> bytes in two generations: what is asked for moves to the young one, and the old one goes when the young one
    holds ``GENERATION_BYTES``."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0

    def missing(self, wanted: set) -> set:
        """Those of ``wanted`` that are not known; the others are in the young generation afterwards."""
        if self.size > GENERATION_BYTES:
            self.young, self.old, self.size = {}, self.young, 0
        out = wanted - self.young.keys()
        found = out & self.old.keys()
        old = self.old
        self.put([(x, old[x]) for x in found])
        return out - found

    def put(self, pairs: list[tuple]) -> None:
        self.young.update(pairs)
        self.size += sum([len(k) + len(v) for k, v in pairs]) + ENTRY_BYTES * len(pairs)


class ChunkCache:
    """What each chunk between ASCII white space gives: its ids as decimals, a line feed and its decoded text; nothing if it has no tokens.

    Neither normalization nor splitting looks across white space, so texts are put together from their chunks.
    """

    def __init__(self, bpe: PairIndexBpe) -> None:
        self.bpe = bpe
        self.words, self.chunks = Generations(), Generations()
        top = max(bpe.names) + 1
        self.numbers = [b"%d" % i for i in range(top)]
        self.tokens = [bpe.names.get(i, "").encode() for i in range(top)]

    def value(self, ids: list[int]) -> bytes:
        return b" ".join([self.numbers[i] for i in ids]) + b"\n" + b" ".join([self.tokens[i] for i in ids]) if ids else b""

    def learn(self, docs: list[list[bytes]]) -> dict[bytes, bytes]:
        """What each chunk of the documents gives; the unknown ones are encoded all at once."""
        unknown = list(self.chunks.missing(set().union(*docs)))
        texts = b"\n".join(unknown).decode("utf-8", "replace").split("\n") if unknown else []
        pattern = self.bpe.added_pattern
        special = {i for i, t in enumerate(texts) if pattern.search(t)} if pattern and pattern.search("\n".join(texts)) else set()
        plain = [t for i, t in enumerate(texts) if i not in special] if special else texts
        split = iter(self.bpe.split_all(plain))
        parts = [[x if isinstance(x, int) else self.bpe.split(x) for x in self.bpe.segments(t)] if i in special else next(split) for i, t in enumerate(texts)]
        wanted = {w for i, own in enumerate(parts) if i not in special for w in own}
        wanted.update(w for i in special for x in parts[i] if not isinstance(x, int) for w in x)
        new = self.bpe.encode_words(self.words.missing(wanted))
        self.words.put([(word, self.value(ids)) for word, ids in new.items()])
        known = self.words.young
        for i in special:
            parts[i] = [y for x in parts[i] for y in ([self.value([x])] if isinstance(x, int) else [known[w] for w in x])]
        made = [_joined(own if i in special else [known[w] for w in own]) if len(own) != 1 or i in special else known[own[0]] for i, own in enumerate(parts)]
        self.chunks.put(list(zip(unknown, made, strict=True)))
        return self.chunks.young


def _joined(values: list[bytes]) -> bytes:
    """One value for the pieces in their order."""
    both = b"\n".join([v for v in values if v]).split(b"\n")
    return b" ".join(both[::2]) + b"\n" + b" ".join(both[1::2]) if len(both) > 1 else b""


#: The tokenizers of this worker, by digest: one at a time.
_MODELS: dict[str, PairIndexBpe] = {}


def read_tokenizer(path: str) -> str:
    """The tokenizer file at ``path`` on the driver, if it is small enough to be shipped."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    check_side_data(len(spec), "the tokenizer")
    return spec


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep``, and for each row: ``n_tokens``, ``ids`` (decimal ids joined by a space) and ``decoded``."""
    return _run(df, path, text, keep or [], digest=False)


def encode_digest(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As ``encode``, with SHA-256 digests (lower-case hex) in place of the ids and the decoded text."""
    return _run(df, path, text, keep or [], digest=True)


def _run(df: DataFrame, path: str, text: str, keep: list[str], *, digest: bool) -> DataFrame:
    spec = read_tokenizer(path)
    bound_batches(df)
    chosen = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    schema = f"{kept}{', ' if kept else ''}n_tokens long, {names[0]} string, {names[1]} string"

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        name = hashlib.sha256(spec.encode()).hexdigest()
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = PairIndexBpe(spec)
        bpe = _MODELS[name]
        cache = ChunkCache(bpe)  # goes with the task
        # an added token with white space in it could lie across chunks
        across = [x.encode() for x in bpe.added if any(c.isspace() for c in x)]
        for batch in parts:
            for part in grouped(batch, batch.num_columns - 1):
                texts = [t or b"" for t in blobs(part.column(part.num_columns - 1))]
                docs = [t.split() for t in texts]
                known = cache.learn(docs)
                counts, ids, decoded = [], [], []
                for raw, chunks in zip(texts, docs, strict=True):
                    if across and any(x in raw for x in across):
                        value = cache.value(bpe.encode(raw.decode("utf-8", "replace")))
                        line, _, plain = value.partition(b"\n")
                    else:
                        both = b"\n".join([v for v in map(known.__getitem__, chunks) if v]).split(b"\n")
                        line, plain = b" ".join(both[::2]), b" ".join(both[1::2])
                    counts.append(line.count(b" ") + 1 if line else 0)
                    ids.append(hashlib.sha256(line).hexdigest() if digest else line)
                    decoded.append(hashlib.sha256(plain).hexdigest() if digest else plain)
                strings = [pa.array(x, pa.string() if digest else pa.binary()).cast(pa.string()) for x in (ids, decoded)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts, pa.int64()), *strings], names=[*part.schema.names[:-1], "n_tokens", *names])

    return chosen.mapInArrow(task, schema)


def grouped(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose column ``text`` holds about ``GROUP_BYTES`` each."""
    sizes = [len(x) if x else 0 for x in blobs(batch.column(text))]
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > GROUP_BYTES:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)
