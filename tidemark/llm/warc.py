"""WARC archives compressed with a Zstandard dictionary of their own.

Pages with equal payloads are archived once: the one with the largest page_id as ``response``, the others as ``revisit`` records that
refer to it. Each archive, however few its records, starts with a skippable frame that holds a dictionary built from the archive's own records; every record
after it is a frame of its own, compressed with that dictionary. Archives are rows (``archive``, ``content``), so any store that
Spark can write to serves; ``save_archives`` puts them out as files.

Defined results: a null payload is empty; a null url gives no target; a null page_id is archived as ``none`` and refers to the
largest id of its payload, or is a response if none has an id; rows that repeat the largest id are responses, too; an empty table
gives no archives; further columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, spread_join

#: The skippable frame that holds the dictionary, and the dictionary's own magic number; fixed values of the formats.
DICT_FRAME = 0x184D2A5D
#: Bytes of records and records that one archive takes at most (one longer record makes an archive of its own).
ARCHIVE_BYTES = 8 << 20
ARCHIVE_RECORDS = 2_000
#: Size of a dictionary, and bytes of records that it is built from at most, spread evenly over the archive.
DICT_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20
#: Bytes of the pieces that serve as samples of an archive with few records.
PIECE_BYTES = 4 << 10
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit holds the HTTP header only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        head += [f"WARC-Refers-To: {page_urn(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records spread evenly over the archive; where these are few, their pieces are the samples."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples = [r[: SAMPLE_BYTES // 4] for r in records[::step]]
    for pieces in (1, 8, 64):
        if pieces > 1:  # what follows from evenly spread places of each sample
            samples = [r[at : at + PIECE_BYTES] for r in samples for at in range(0, len(r), max(8, len(r) // pieces))]
        try:
            if len(samples) >= 8:
                return zstandard.train_dictionary(DICT_BYTES, samples, level=3, k=256, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.train_dictionary(DICT_BYTES, [s + b"%d" % i for i in range(64) for s in samples[:64]], level=3, k=64, d=8)


def write_archive(records: list[bytes]) -> bytes:
    """The archive of the records: the frame that holds their dictionary, then a frame a record."""
    dictionary = build_dictionary(records)
    raw = dictionary.as_bytes()
    out = io.BytesIO()
    out.write(struct.pack("<II", DICT_FRAME, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
    for r in records:
        out.write(packer.compress(r))
    return out.getvalue()


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    dictionary = None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICT_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + size])
        content = content[8 + size :]
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    with unpacker.stream_reader(content, read_across_frames=True) as stream:
        whole = stream.read()
    at = 0
    while at < len(whole):
        end = whole.index(b"\r\n\r\n", at)
        version, *lines = whole[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("a record doesn't start with its version")
        fields = dict(line.split(": ", 1) for line in lines)
        at = end + 4 + int(fields["Content-Length"])
        if whole[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield fields, whole[end + 4 : at]
        at += 4


def assign_types(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, refers_to, revisit``: the largest page_id of each payload, found by a pre-aggregated digest.

    Only ids and digests are grouped. The pages of a payload that very many share are spread when they get its largest id.
    """
    bound_batches(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    found = materialize(rows.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("met")), "warc-digests")
    total = found.agg(F.sum("met")).first()[0] or 0
    revisit = F.coalesce(F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")), F.lit(False))
    typed = spread_join(rows, found, "digest", "met", total, ["page_id", "url"])
    return typed.select("page_id", "url", "payload", F.when(revisit, F.col("largest")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame) -> DataFrame:
    """``archive`` (name) and ``content`` of archives that hold a record for every page."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{count:06d}.warc.zst"]), pa.array([write_archive(held)], pa.binary())], names=["archive", "content"])

        for batch in parts:
            for page_id, url, payload, refers_to, revisit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(record(page_id, url, payload, refers_to, revisit))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS:
                    yield archive()
                    count, held, size = count + 1, [], 0
        if held:
            yield archive()

    return assign_types(pages).mapInArrow(task, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """What the archives hold, a row a record: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` (null for revisits).

    The payload of every response is checked against its digest.
    """

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(urn[10:-1]) if urn and urn != "<urn:page:none>" else None
        for batch in parts:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for fields, block in read_archive(content.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
                    rows.append((number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), length, digest, kind, number(fields.get("WARC-Refers-To")), payload if kind == "response" else None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return archives.mapInArrow(task, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def save_archives(archives: DataFrame, folder: str) -> None:
    """Puts the archives out as files in a folder that all executors mount; a file appears whole or not at all."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in parts:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, f"{folder}/{name}")
            yield batch.select(["archive"])

    archives.mapInArrow(task, "archive string").count()
