"""Binary alignment files, decoded on the executors into the lines of the text format and read like these.

A file is read by one task and must be smaller than 2 GB, many files are read in parallel; its blocks are unpacked one after another.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import text

#: Letters of bases and of CIGAR operations by their codes, and sizes of the numeric tag types; fixed values of the format.
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def blocks(content: bytes) -> Iterator[bytes]:
    """The unpacked blocks of a blocked gzip file."""
    at, view = 0, memoryview(content)
    while at < len(view):
        extra = struct.unpack_from("<H", view, at + 10)[0]
        size, p = None, at + 12
        while p < at + 12 + extra:
            kind, n = bytes(view[p : p + 2]), struct.unpack_from("<H", view, p + 2)[0]
            if kind == b"BC":
                size = struct.unpack_from("<H", view, p + 4)[0] + 1
            p += 4 + n
        if size is None:
            raise ValueError("a block without its size: no blocked gzip file")
        yield zlib.decompress(view[at : at + size], 31)
        at += size


def records(content: bytes) -> tuple[list[tuple[str, int]], Iterator[bytes]]:
    """Names and lengths of the references, and the bytes of each record."""
    parts = blocks(content)
    held = bytearray()

    def take(n: int) -> bytes | None:
        while len(held) < n:
            more = next(parts, None)
            if more is None:
                if held and n > 4:
                    raise ValueError("the file ends within a record")
                return None
            held.extend(more)
        out = bytes(held[:n])
        del held[:n]
        return out

    if take(4) != b"BAM\1":
        raise ValueError("no binary alignment file")
    take(struct.unpack("<i", take(4))[0])
    references = []
    for _ in range(struct.unpack("<i", take(4))[0]):
        name = take(struct.unpack("<i", take(4))[0])[:-1].decode()
        references.append((name, struct.unpack("<i", take(4))[0]))

    def each() -> Iterator[bytes]:
        while (size := take(4)) is not None:
            yield take(struct.unpack("<i", size)[0])

    return references, each()


def tags(raw: bytes, at: int) -> Iterator[str]:
    """The tags from ``at`` on as text."""
    while at < len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in NUMBERS:
            value = struct.unpack_from(NUMBERS[kind], raw, at)[0]
            yield f"{name}:{'f' if kind == 'f' else 'i'}:{value}"
            at += struct.calcsize(NUMBERS[kind])
        elif kind == "A":
            yield f"{name}:A:{chr(raw[at])}"
            at += 1
        elif kind in "ZH":
            end = raw.index(0, at)
            yield f"{name}:{kind}:{raw[at:end].decode()}"
            at = end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            step = struct.calcsize(NUMBERS[sub])
            values = [struct.unpack_from(NUMBERS[sub], raw, at + 5 + i * step)[0] for i in range(n)]
            yield f"{name}:B:{sub}," + ",".join(map(str, values))
            at += 5 + n * step
        else:
            raise ValueError(f"unknown tag type {kind}")


def line(raw: bytes, references: list[tuple[str, int]]) -> str:
    """A record as a line of the text format."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq, next_ref, next_pos, span = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32
    name = raw[at : at + n_name - 1].decode()
    at += n_name
    ops = struct.unpack_from(f"<{n_ops}I", raw, at)
    at += 4 * n_ops
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in raw[at : at + (n_seq + 1) // 2])[:n_seq] or "*"
    at += (n_seq + 1) // 2
    qual = raw[at : at + n_seq]
    at += n_seq
    of = lambda i: references[i][0] if i >= 0 else "*"
    cells = [name, flag, of(ref), pos + 1, mapq, "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops) or "*", "=" if next_ref == ref and ref >= 0 else of(next_ref), next_pos + 1, span, seq]
    quality = "*" if not n_seq or qual[0] == 255 else "".join(chr(q + 33) for q in qual)
    return "\t".join([*map(str, cells), quality, *tags(raw, at)])


def bam_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: header lines of the references, then a line a record."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for content in batch.column("content"):
                references, found = records(content.as_py())
                held = [f"@SQ\tSN:{n}\tLN:{size}" for n, size in references]
                for raw in found:
                    held.append(line(raw, references))
                    if len(held) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held)], names=["value"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held)], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(task, "value string")


def alignments(spark: SparkSession, path: str, keep_unmapped: bool = False) -> DataFrame:
    """Reads of binary or text alignment files, told apart by how their names end, with the columns of ``text.sam``."""
    rows = bam_lines(spark, path) if path.rstrip("/").endswith(".bam") else spark.read.text(path)
    return text.decode_sam(rows, keep_unmapped)


def references(spark: SparkSession, path: str) -> DataFrame:
    """``chr, length`` from the header."""
    rows = bam_lines(spark, path) if path.rstrip("/").endswith(".bam") else spark.read.text(path)
    head = rows.where(F.col("value").startswith("@SQ"))
    return head.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chr"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("length")).distinct()
