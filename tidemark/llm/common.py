"""Helpers shared by the corpus operators: shared storage, word splitting and word hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import scratch_dir

#: Entries a worker's word cache may hold before it is emptied.
CACHE_ENTRIES = 200_000
#: Bytes of side data (rules, models, vocabularies) that may be shipped to every executor.
SIDE_DATA_LIMIT = 64 << 20

MASK64 = (1 << 64) - 1


#: Bytes of a batch of rows that travels between a task and its Python worker, and Spark's setting of them.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(df: DataFrame) -> None:
    """Has the session send batches of ``BATCH_BYTES`` to Python workers, unless they are smaller already: long texts would make ten thousand rows a large batch."""
    conf = df.sparkSession.conf
    if conf.isModifiable(BATCH_SETTING) and int(re.sub("[^0-9]", "", conf.get(BATCH_SETTING))) > BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))


def release_memory() -> None:
    """Gives back to the system what earlier tasks of this worker have freed; workers serve one stage after another."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library
    if trim:
        trim(0)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    place = f"{scratch_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    out = spark.read.schema(df.schema).parquet(place)
    out._tidemark_place = place
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        place = getattr(df, "_tidemark_place", None)
        if place:
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that may count as hot in a join, and the parts that each of them is spread over.
HOT_KEYS = 1024
SALTS = 64


def spread_join(left: DataFrame, right: DataFrame, key: str, met: str, total: int, by: list[str]) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, hot keys spread over ``SALTS`` parts. All of ``left`` has ``total`` rows.

    ``key`` is unique in ``right``, whose column ``met`` says how many rows of ``left`` hold it (it is left out of the result). Hot are
    the keys held by more than one in ``HOT_KEYS`` of all rows, so there are fewer than that, and the list of them may be broadcast.
    Rows of ``left`` with a hot key are dealt by the columns ``by``.
    """
    limit = max(64, total // HOT_KEYS)
    hot = F.broadcast(right.where(F.col(met) > limit).select(F.col(key).alias("__key"), F.lit(True).alias("__hot")))
    many = right.withColumn("__salt", F.explode(F.when(F.col(met) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(met)
    marked = left.join(hot, F.col(key) == F.col("__key"), "left").drop("__key")
    dealt = marked.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("__hot")
    return dealt.join(many, [key, "__salt"]).drop("__salt")


def check_side_data(size: int, what: str, limit: int = SIDE_DATA_LIMIT) -> None:
    """Refuses to ship more than ``limit`` bytes to the executors."""
    if size > limit:
        raise ValueError(f"{what} takes {size} bytes; at most {limit} are shipped to executors")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variation of it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


class WordHashes(dict):
    """bytes -> 64-bit hash, kept for words seen; emptied when it grows past ``CACHE_ENTRIES``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` word hashes (uint64); order matters. Empty if there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, (0x9E3779B97F4A7C15 * (2 * seed + 1)) & MASK64, np.uint64)
    for i in range(n):
        out = (out ^ words[i : i + count]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return out


def power_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Polynomial hash (mod 2**64) of each run of ``n`` word hashes in time independent of ``n``, mixed at the end."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    base = ((0xD6E8FEB86659FD93 + 2 * 0x632BE59BD9B4E019 * seed) | 1) & MASK64
    inverse = pow(base, -1, 1 << 64)
    seeded = mix64(words ^ np.uint64((0xA0761D6478BD642F * (seed + 1)) & MASK64))
    powers = np.full(len(words), base, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(seeded * powers, dtype=np.uint64)])
    back = np.full(count, inverse, np.uint64)
    back[0] = 1
    return mix64((sums[n:] - sums[:-n]) * np.multiply.accumulate(back))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
