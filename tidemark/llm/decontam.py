"""Benchmark decontamination with suffix arrays of the training text.

Documents are dealt into shards of ``SHARD_BYTES`` of text (one longer text is a shard of its own). A shard's words are numbered by the
benchmark's vocabulary. Words outside it match no test suffix: they are left out of the array and part the runs of words inside it, and
so are runs too short to hold a window. The runs get a suffix array (prefix doubling). All test suffixes are looked up in it at
once by binary search, which gives the longest verbatim match of each and where it lies; windows that match in full mark the
document's words as hit. ``longest_matches`` reduces the shards' longest matches to one a test suffix over all shards.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased; those of more than ``LONG_WORD`` bytes are compared by a
128-bit digest. A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window.

Defined results: null and empty texts have no words and nothing is hit; items without words match nothing; items that repeat an id
count once; items without an id hit words like any other, but are left out of ``n_items``, ``items`` and ``items_sha256``; long texts
are processed whole; repeated rows give repeated results; an empty table of either kind gives no hits; further columns are left out.
A benchmark of any size is served: in blocks of bounded size, one on the driver at a time, with one pass over the documents each. An
item longer than a block is cut into pieces that share a window less one word, so no window is lost; its longest matches end with the
pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIDE_DATA_LIMIT, blobs, bound_batches, materialize

#: Bytes of text in a shard (a batch of rows holds no more), and bytes from which on a word is compared by its digest.
SHARD_BYTES = 4 << 20
LONG_WORD = 256

#: Bytes to bytes: A-Z lower-cased, everything but digits, letters and bytes beyond ASCII blanked.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold_words(text: bytes | None) -> list[bytes]:
    """The words of a text; a long one as a digest behind a byte that no UTF-8 text holds."""
    words = (text or b"").translate(FOLD).split()
    if words and max(map(len, words)) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else b"\xff" + xxhash.xxh3_128_hexdigest(w).encode() for w in words]
    return words


@dataclass
class TestSuffixes:
    """The benchmark's words as numbers from 1; ``text`` holds the items one after another, each followed by a 0."""

    numbers: dict[bytes, int]
    text: np.ndarray
    starts: np.ndarray  # of the suffixes: positions in text
    items: np.ndarray  # index of each suffix's item
    needed: np.ndarray  # words of the window that starts there; 0 if none does
    ids: list[str | None]
    longest: int
    heads: frozenset[int]  # first words of items shorter than a window
    shortest: int
    offsets: list[int]  # of each item's first word: other than 0 for pieces of a long item


def prepare(items: list[tuple], window: int) -> TestSuffixes:
    """Items are (id, text) or, for a piece of a long one, (id, text, number of its first word)."""
    numbers: dict[bytes, int] = {}
    text: list[int] = []
    starts, owners, needed, heads, shortest = [], [], [], set(), window
    for i, (_, raw, *_) in enumerate(items):
        words = [numbers.setdefault(w, len(numbers) + 1) for w in fold_words(raw)]
        base, size = len(text), min(window, len(words))
        if words and len(words) < window:
            heads.add(words[0])
            shortest = min(shortest, len(words))
        starts.extend(range(base, base + len(words)))
        owners.extend([i] * len(words))
        needed.extend([size if k + size <= len(words) else 0 for k in range(len(words))])
        text += [*words, 0]
    longest = max(np.diff([i for i, x in enumerate([0, *text]) if x == 0]) - 1, default=0)
    return TestSuffixes(numbers, np.array([*text, *[0] * (longest + 1)], np.int64), np.array(starts, np.int64), np.array(owners, np.int64), np.array(needed, np.int64), [x[0] for x in items], int(longest), frozenset(heads), shortest, [x[2] if len(x) > 2 else 0 for x in items])


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of their first ``depth`` numbers at least (prefix doubling)."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, width = len(text), 1
    order = np.argsort(rank, kind="stable")
    while width < depth and n:
        after = np.zeros(n, np.int64)
        after[:-width or n] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        width *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


def kept_runs(words: np.ndarray, test: TestSuffixes, window: int) -> np.ndarray:
    """Mask of the positions in runs of known words that can hold a window: as long as one, or after the first word of a short item."""
    known = words > 0
    n = len(words)
    if not known.any():
        return known
    edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    keep = end - begin >= window
    if test.heads:
        head = np.isin(words, list(test.heads))
        counts = np.concatenate([[0], np.cumsum(head)])
        keep |= (end - begin >= test.shortest) & (counts[end] > counts[begin])
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, begin[keep], 1)
    np.add.at(marks, end[keep], -1)
    return np.cumsum(marks[:-1]) > 0


def compare(text: np.ndarray, at: np.ndarray, test: np.ndarray, starts: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common words of text[at:] and test[starts:], up to ``limit``, and where text sorts before test at the first difference."""
    common = np.zeros(len(at), np.int64)
    less = np.zeros(len(at), bool)
    open_ = np.arange(len(at))
    step = 0
    while len(open_):
        done = limit[open_] <= step
        open_ = open_[~done]
        if not len(open_):
            break
        i = at[open_] + step
        a = np.where(i < len(text), text[np.minimum(i, len(text) - 1)], -1)
        b = test[starts[open_] + step]
        same = (a == b) & (b > 0)
        common[open_[same]] = step + 1
        differ = open_[~same]
        less[differ] = a[~same] < b[~same]
        open_ = open_[same]
        step += 1
    return common, less


def look_up(text: np.ndarray, order: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each test suffix: length of the longest match, and the ranges in ``order`` of these matches and of those of its window (empty
    where the window has none)."""
    n, m = len(order), len(test.starts)
    full = np.full(m, test.longest, np.int64)

    def bound(limit: np.ndarray, upper: bool) -> np.ndarray:
        low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            common, less = compare(text, order[mid], test.text, test.starts[open_], limit[open_])
            right = less | (upper & (common >= limit[open_]))
            low[open_] = np.where(right, mid + 1, low[open_])
            high[open_] = np.where(right, high[open_], mid)
        return low

    place = bound(full, upper=False)
    length = np.zeros(m, np.int64)
    for side in (place - 1, place):
        ok = (side >= 0) & (side < n)
        common = np.zeros(m, np.int64)
        common[ok] = compare(text, order[side[ok]], test.text, test.starts[ok], full[ok])[0]
        length = np.maximum(length, common)
    found = (test.needed > 0) & (length >= test.needed)
    ranges = [np.zeros(m, np.int64)] * 4
    if found.any():
        ranges = [np.where(found, bound(np.where(found, limit, 0), upper), 0) for limit in (length, test.needed) for upper in (False, True)]
    return length, *ranges


def scan(texts: list[bytes | None], test: TestSuffixes, window: int) -> list[tuple[int, list[int], set[int], list[tuple[int, int, int, int]]]]:
    """For each text: words, positions of hit words, indexes of matching items, and the longest matches (item, its word, the text's word, length) of a window at least."""
    counts, pieces, owners, places = [], [], [], []
    at = 0
    get = test.numbers.get
    for d, raw in enumerate(texts):
        words = fold_words(raw)
        counts.append(len(words))
        numbered = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        keep = kept_runs(numbered, test, window)
        index = np.flatnonzero(keep)
        if len(index):
            gaps = np.flatnonzero(np.diff(index) > 1) + 1
            for run in np.split(index, gaps):
                pieces += [numbered[run], np.zeros(1, np.int64)]
                owners += [np.full(len(run), d), np.full(1, -1)]
                places += [run, np.full(1, -1)]
                at += len(run) + 1
    hits: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    items: list[set[int]] = [set() for _ in texts]
    matches: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if pieces and len(test.starts):
        text, owner, place = np.concatenate(pieces), np.concatenate(owners), np.concatenate(places)
        order = suffix_array(text, test.longest)
        length, first, last, low, high = look_up(text, order, test)
        marks = np.zeros(len(text) + 1, np.int64)
        for s in np.flatnonzero(high > low):
            found = order[low[s] : high[s]]
            np.add.at(marks, found, 1)
            np.add.at(marks, found + test.needed[s], -1)
            for d in np.unique(owner[found]).tolist():
                items[d].add(int(test.items[s]))
            item = int(test.items[s])
            item_word = int(s - np.searchsorted(test.items, item)) + test.offsets[item]
            found = np.sort(order[first[s] : last[s]])
            for at_ in found[np.unique(owner[found], return_index=True)[1]].tolist():  # the first place in each document
                matches[owner[at_]].append((item, item_word, int(place[at_]), int(length[s])))
        hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        by = np.argsort(owner[hit], kind="stable")
        edges = np.searchsorted(owner[hit][by], np.arange(len(texts) + 1))
        hits = [place[hit[by[edges[d] : edges[d + 1]]]] for d in range(len(texts))]
    return [(counts[d], hits[d].tolist(), items[d], matches[d]) for d in range(len(texts))]


def pieces(raw: bytes, window: int, limit: int) -> Iterator[tuple[int, bytes]]:
    """The number of the first word and the text of the pieces of an item: the whole text if it isn't longer than ``limit``."""
    if len(raw) <= limit:
        yield 0, raw
        return
    words = fold_words(raw)
    begin = 0
    while True:
        end, size = begin, 0
        while end < len(words) and (end - begin < 2 * window or size + len(words[end]) < limit):
            size += len(words[end]) + 1
            end += 1
        yield begin, b" ".join(words[begin:end])
        if end >= len(words):
            return
        begin = end - window + 1


def read_items(benchmark: DataFrame, item_id: str, text: str, limit: int, window: int) -> Iterator[list[tuple[str | None, bytes, int]]]:
    """The items' pieces in blocks of at most ``limit`` bytes (but of one piece at least), each on the driver at a time; one empty block if there are none."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").cast("binary").alias("t")).where("t is not null").distinct()

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i, raw in zip(batch.column("i").to_pylist(), batch.column("t"), strict=True):
                for first, piece in pieces(raw.as_py(), window, limit):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.string()), pa.array([first], pa.int64()), pa.array([piece], pa.binary())], names=["i", "first", "t"])

    held: list[tuple[str | None, bytes, int]] = []
    size = 0
    for r in rows.mapInArrow(cut, "i string, first long, t binary").orderBy("i", "first", "t").toLocalIterator():
        raw = bytes(r["t"])
        if held and size + len(raw) > limit:
            yield held
            held, size = [], 0
        held.append((r["i"], raw, r["first"]))
        size += len(raw)
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = SIDE_DATA_LIMIT // 8) -> DataFrame:
    """Columns ``keep`` and ``n_words, n_hit, n_items, items_sha256, contaminated, items, matches`` for every document.

    ``matches`` holds, for each test suffix whose longest match within the shard (of a window at least) lies in this document, the item,
    the word it starts at in the item and in the document, and its length.
    """
    keep = keep or []
    bound_batches(docs)
    place = keep.index(text) if text in keep else len(keep)  # a text that is kept goes to the workers once
    out = docs.select(*[F.col(f"`{c}`") for c in keep], *[F.col(text).cast("string").alias("__text")] * (place == len(keep)))
    blocks = read_items(benchmark, item_id, item_text, limit, window)
    block, first = next(blocks), True
    while block is not None:
        after = next(blocks, None)
        out = _look_through(out, prepare(block, window), window, len(keep), place, first=first, last=after is None)
        if after is not None:  # the plan must not gather the blocks
            out = materialize(out, "decontam-block")
        block, first = after, False
    return out.select(
        *[F.col(f"`{c}`") for c in keep], "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"), "items", "matches",
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """``item, item_word, length, doc_id, doc_word``: the longest verbatim match of every test suffix that has one of a window at least,
    over all shards, and the first place of it (by doc_id, null ids last, then by word)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = contamination(rows, benchmark, window, keep=["doc_id"], **names).select("doc_id", F.explode("matches").alias("m"))
    place = F.struct((-F.col("m.length")).alias("l"), F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("m.doc_word").alias("w"))
    best = found.groupBy(F.col("m.item").alias("item"), F.col("m.item_word").alias("item_word")).agg(F.min(place).alias("b"))
    return best.select("item", "item_word", (-F.col("b.l")).alias("length"), F.col("b.d").alias("doc_id"), F.col("b.w").alias("doc_word"))


MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("length", pa.int64())])
FOUND = {"n_words": pa.int64(), "hit": pa.list_(pa.int64()), "items": pa.list_(pa.string()), "matches": pa.list_(MATCH)}


def shards(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose column ``text`` holds ``SHARD_BYTES`` at most, or one row."""
    begin, held = 0, 0
    for i, raw in enumerate(blobs(batch.column(text))):
        if i > begin and held + len(raw or b"") > SHARD_BYTES:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += len(raw or b"")
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _look_through(docs: DataFrame, test: TestSuffixes, window: int, n_keep: int, place: int, *, first: bool, last: bool) -> DataFrame:
    """Adds what one block of items finds to what the blocks before it found; the text goes on only if there are more blocks."""
    fields = docs.schema.fields[: n_keep + (place == n_keep and not last)]
    carried = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    schema = f"{carried}n_words long, hit array<long>, items array<string>, matches array<struct<item:string,item_word:long,doc_word:long,length:long>>"

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in shards(batch, place):
                found = scan(blobs(part.column(place)), test, window)
                hit, items = [x[1] for x in found], [sorted({test.ids[i] for i in x[2]} - {None}) for x in found]
                matches = [[{"item": test.ids[i], "item_word": a, "doc_word": b, "length": n} for i, a, b, n in x[3]] for x in found]
                if not first:
                    hit = [sorted({*a, *b}) for a, b in zip(hit, part.column("hit").to_pylist(), strict=True)]
                    items = [sorted({*a, *b}) for a, b in zip(items, part.column("items").to_pylist(), strict=True)]
                    matches = [a + b for a, b in zip(part.column("matches").to_pylist(), matches, strict=True)]
                made = zip(([x[0] for x in found], hit, items, matches), FOUND.values(), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(fields)], *[pa.array(x, kind) for x, kind in made]], names=[*[f.name for f in fields], *FOUND])

    return docs.mapInArrow(task, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """The documents none of whose words is hit, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    found = contamination(rows, benchmark, window, keep=names, text=names[docs.columns.index(text)])
    return found.where("not contaminated").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
