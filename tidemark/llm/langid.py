"""Language ID with error-correcting output codes.

Every language has a codeword. One binary classifier a bit, fitted on hashed character n-grams, predicts that bit of the codeword;
decoding adds up each language's loss over the bits, weighted by how far each classifier is to be trusted, and the language with
the least loss wins. A text whose two best languages are close is flagged ``ambiguous``.

Fitted on a bounded sample: about ``per_language`` distinct texts of every language (fewer of each, but ``FEWEST`` at least,
where all would be more than ``SAMPLE``), the choice made by a hash of the text within each language; copies of a text count once and cannot push out another language.
Predictions use the text alone, and all of it.

Defined results: a null text, or one without letters, is ``und`` with score 0; without any labelled text everything is ``und``;
repeated rows give repeated results; an empty table gives an empty result; columns not named in ``keep`` are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Buckets of hashed n-grams.
DIM = 2048
PER_LANGUAGE = 250
#: Texts that the whole sample may hold, and the fewest wanted of a language even so.
SAMPLE = 16_000
FEWEST = 16
RIDGE = 1e-3
#: Values of the texts' hash by which the sample is chosen.
SLOTS = 1_000_000_000
#: Score difference of the two best languages below which a text is ambiguous.
MARGIN = 0.05

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of the text's hashed character 1- to 3-grams, words kept apart; None without letters."""
    a = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(letters()[a], a, 0).astype(np.uint32)
    if not a.any():
        return None
    a = np.concatenate([[0], a, [0]]).astype(np.uint32)
    a = a[np.concatenate([[True], (a[1:] != 0) | (a[:-1] != 0)])]
    one = a * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (a[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (a[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    counts = np.zeros(DIM)
    for h, keep in ((one, a != 0), (two, a[:-1] != 0), (three, a[1:-1] != 0)):
        h = h[keep]
        counts += np.bincount((h ^ (h >> np.uint32(15))) % np.uint32(DIM), minlength=DIM)
    counts = np.sqrt(counts)
    return (counts / np.linalg.norm(counts)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """Codewords of n languages in bits of -1 and 1: the exhaustive code for up to 6, else the columns of a seeded draw that lie furthest apart."""
    if n <= 6:
        bits = [[1 if i == 0 else 1 - 2 * (k >> (i - 1) & 1) for i in range(n)] for k in range(1, 1 << (n - 1))] or [[1] * n]
        return np.array(bits, float).T
    rng, width = np.random.default_rng(7), 6 * int(np.ceil(np.log2(n)))
    draws = (np.where(rng.permuted(np.tile(np.arange(n)[:, None], width), axis=0) < n // 2, 1.0, -1.0) for _ in range(200))
    near = lambda m, at: (m[at : at + 512] @ m.T - 2 * width * np.eye(min(512, n - at), n, at)).max()
    apart = lambda m: (width - max(near(m, at) for at in range(0, n, 512))) / 2
    return max(draws, key=apart)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector, the languages' shares (they add up to 1): soft minima of the weighted hinge losses."""
        out = np.clip(vectors @ self.weights + self.bias, -1.5, 1.5)
        plus = self.codes > 0
        losses = (np.maximum(0, 1 - out) * self.trust @ plus.T + np.maximum(0, 1 + out) * self.trust @ ~plus.T) / self.trust.sum()
        power = np.exp(-6 * (losses - losses.min(1, keepdims=True)))
        return power / power.sum(1, keepdims=True)


def fit(vectors: np.ndarray, langs: list[str]) -> Model:
    """One ridge classifier a bit; a bit's trust is its rate of hits beyond chance when each row is left out (at least 0.05)."""
    languages = sorted(set(langs))
    codes = codewords(len(languages))
    place = {x: i for i, x in enumerate(languages)}
    owner = np.array([place[x] for x in langs])
    n, step = len(langs), 2048
    gram, right = RIDGE * n * np.eye(vectors.shape[1] + 1), np.zeros((vectors.shape[1] + 1, codes.shape[1]))
    with_one = lambda at: np.hstack([vectors[at : at + step], np.ones((len(vectors[at : at + step]), 1))]).astype(float)
    for at in range(0, n, step):
        x = with_one(at)
        gram += x.T @ x
        right += x.T @ codes[owner[at : at + step]]
    inverse = np.linalg.inv(gram)
    weights = inverse @ right
    hits = np.zeros(codes.shape[1])
    for at in range(0, n, step):
        x, target = with_one(at), codes[owner[at : at + step]]
        held = target - (target - x @ weights) / (1 - ((x @ inverse) * x).sum(1))[:, None]  # leave-one-out predictions
        hits += (np.sign(held) == target).sum(0)
    trust = np.maximum(0.05, 2 * hits / n - 1)
    return Model(languages, codes, weights[:-1].astype(np.float32), weights[-1].astype(np.float32), trust)


def sample(df: DataFrame, text: str, lang: str, per_language: int) -> tuple[list[np.ndarray], list[str]]:
    """Feature vectors and languages of the sample; what comes to the driver grows with the number of languages only."""
    bound_batches(df)
    rows = df.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    # copies of a text count once, so that no group of them fills a language's share; texts of ASCII digits and signs alone have no letters
    hashed = rows.where(F.col("text").rlike(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]")).withColumns({"x": F.xxhash64("text"), "h": F.pmod(F.xxhash64("text"), F.lit(SLOTS))})
    counts = hashed.select("lang", "x").distinct().groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not counts:
        return [], []
    per_language = min(per_language, max(FEWEST, SAMPLE // len(counts)))
    # a little over what is wanted, by the text's hash, so that no sort is needed
    shares = [(r["lang"], int(min(1.0, (per_language + 4 * per_language**0.5 + 16) / r["n"]) * SLOTS)) for r in counts]
    shares_df = df.sparkSession.createDataFrame(shares, "lang string, share long")
    chosen = hashed.join(F.broadcast(shares_df), "lang").where("h < share").groupBy("lang", "h", "x").agg(F.min("text").alias("text"))

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            vectors = [features(t.as_py()) for t in batch.column("text")]
            some = [i for i, v in enumerate(vectors) if v is not None]
            v = pa.array([vectors[i].astype(np.float16).tobytes() for i in some], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some, pa.int64())) for c in ("lang", "h", "x")), v], names=["lang", "h", "x", "v"])

    most = int(per_language + 8 * per_language**0.5 + 64)
    by: dict[str, list] = {}
    for r in chosen.mapInArrow(task, "lang string, h long, x long, v binary").collect():
        by.setdefault(r["lang"], []).append(r)
    found = [r for rows_ in by.values() for r in sorted(rows_, key=lambda r: (r["h"], r["x"]))[:most]]
    found.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    return [np.frombuffer(r["v"], np.float16).astype(np.float32) for r in found], [r["lang"] for r in found]


def learn(df: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    vectors, langs = sample(df, text, lang, per_language)
    return fit(np.array(vectors), langs) if vectors else None


def predict(df: DataFrame, model: Model | None, text: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """Columns ``keep`` and ``lang_pred, score, ambiguous`` for every row."""
    keep = list(keep or [])
    n_keep = len(keep)
    bound_batches(df)
    place = next((i for i, c in enumerate(keep) if isinstance(c, str) and c == text), n_keep)  # a text that is kept goes to the workers once
    chosen = df.select(*[F.col(f"`{c}`") if isinstance(c, str) else c for c in keep], *[] if place < n_keep else [F.col(text).cast("string").alias("__text")])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:n_keep])

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                vectors = [features(t.as_py()) for t in part.column(place)]
                some = [i for i, v in enumerate(vectors) if v is not None]
                pred, score, unsure = ["und"] * len(vectors), [0.0] * len(vectors), [True] * len(vectors)
                if some and model:
                    shares = model.scores(np.array([vectors[i] for i in some]))
                    order = np.argsort(-shares, axis=1, kind="stable")
                    for k, i in enumerate(some):
                        best = order[k, 0]
                        pred[i], score[i] = model.languages[best], float(min(1.0, shares[k, best]))
                        unsure[i] = len(model.languages) > 1 and bool(shares[k, best] - shares[k, order[k, 1]] < MARGIN)
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=[*part.schema.names[:n_keep], "lang_pred", "score", "ambiguous"])

    return chosen.mapInArrow(task, f"{kept}{', ' if kept else ''}lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned_rows(df: DataFrame) -> DataFrame:
    """The rows that may be learned from: those with an id that are not held out."""
    return df.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def identify(df: DataFrame, labelled: DataFrame | None = None, keep: list[str | Column] | None = None) -> DataFrame:
    """Learns from the rows of ``labelled`` (default ``df``) that are not held out, and predicts every row of ``df``."""
    return predict(df, learn(learned_rows(labelled if labelled is not None else df)), keep=keep)
