"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing: each task streams its rows into archive files and returns an index row per record, with
file, offset, length, URL and digest. The index is written before anything is read. Files carry a
name of their own for each attempt, so a task that runs again leaves files that no index row names.

Reading: selected index rows are dealt by stretches of a file, sorted by offset, and neighbouring
records become one read, up to a size and across gaps up to a size. Records are then checked
against their digests.

Equal payloads are stored once. The record of the smallest id is the response; the others are
revisits that refer to it and have no payload of their own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import Scratch

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
TASK_READ = 64 << 20  # bytes one task reads, about
STRETCH = 4 << 20  # bytes of a file that one group of reads covers
MOST_READ = 4 << 20  # bytes of one read, if no record is longer
GAP = 64 << 10  # bytes that a read may cover and not use
_END = b"\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four base32 letters."""
    digits = F.sha1(payload)
    letters = []
    for part in range(8):
        number = F.conv(F.substring(digits, 5 * part + 1, 5), 16, 10).cast("int")
        letters += [
            F.substring(F.lit(ALPHABET), F.shiftright(number, 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in (3, 2, 1, 0)
        ]
    return F.concat(*letters)


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def record(kind: str, page: int, url: str, digest: str, size: int, refers: int | None, payload: bytes) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if refers is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers}>",
        ]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _END + payload + _END


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, of one record."""
    cut = raw.index(_END)
    lines = raw[:cut].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record starts here")
    head = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])}
    size = int(head["content-length"])
    block = raw[cut + 4 : cut + 4 + size]
    if len(block) != size or raw[cut + 4 + size :] != _END:
        raise ValueError("a record is cut short")
    return head, block


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


_INDEX = "page_id long, file string, offset long, length long, url string, digest string, kind string"


def write(pages: DataFrame, folder: str, file_bytes: int = 256 << 20) -> DataFrame:
    """Write the rows (page_id, url, html, digest, response_id) below ``folder`` and return their index.

    The index is a lazy result: store it before reading from it, as ``archive`` does.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        out, name, offset = None, "", 0
        try:
            for part in parts:
                rows = []
                for page, url, html, digest, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if out is None or offset >= file_bytes:
                        if out is not None:
                            out.close()
                        system.create_dir(base, recursive=True)
                        name, offset = f"{uuid.uuid4().hex}.warc", 0
                        out = system.open_output_stream(f"{base}/{name}")
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    again = first != page
                    kind = "revisit" if again else "response"
                    raw = record(kind, page, url or "", digest, len(payload), first if again else None, b"" if again else payload)
                    out.write(raw)
                    rows.append((page, name, offset, len(raw), url, digest, kind))
                    offset += len(raw)
                names = ["page_id", "file", "offset", "length", "url", "digest", "kind"]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        finally:
            if out is not None:
                out.close()

    return pages.select("page_id", "url", "html", "digest", "response_id").mapInArrow(run, _INDEX)


def ranges(spots: list[tuple[int, int]], most: int = MOST_READ, gap: int = GAP) -> list[tuple[int, int, int]]:
    """(start, end, records) of the reads that cover the sorted (offset, length) pairs."""
    out: list[tuple[int, int, int]] = []
    for offset, length in spots:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            out[-1] = (out[-1][0], max(out[-1][1], offset + length), out[-1][2] + 1)
        else:
            out.append((offset, offset + length, 1))
    return out


_RECORD = "page_id long, url string, kind string, digest string, payload_bytes long, refers_to long, payload binary"


def read(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index rows ``selected``: page_id, url, kind, digest, payload_bytes, refers_to, payload.

    A payload is checked against its digest. A revisit has none; its length is that of its response.
    Without ``payloads`` they are read and checked, but not returned.
    """
    placed = selected.select("page_id", "file", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch"))
    # Index rows are small and what they stand for is not: the number of tasks follows the bytes to read.
    total = placed.agg(F.sum("length")).first()[0] or 0
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_READ))
    dealt = placed.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        name, source = None, None
        for part in parts:
            files = part.column("file").to_pylist()
            spots = list(zip(part.column("offset").to_pylist(), part.column("length").to_pylist(), strict=True))
            at = 0
            while at < len(files):
                upto = at
                while upto < len(files) and files[upto] == files[at]:
                    upto += 1
                if files[at] != name:
                    if source is not None:
                        source.close()
                    name, source = files[at], system.open_input_file(f"{base}/{files[at]}")
                for start, end, count in ranges(spots[at:upto]):
                    raw = source.read_at(end - start, start)
                    rows = []
                    for offset, length in spots[at : at + count]:
                        rows.append(_checked(raw[offset - start : offset - start + length], payloads))
                    at += count
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES
                    )
        if source is not None:
            source.close()

    return dealt.mapInArrow(run, _RECORD)


_NAMES = ["page_id", "url", "kind", "digest", "payload_bytes", "refers_to", "payload"]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def _checked(raw: bytes, payloads: bool) -> tuple:
    head, block = parse(raw)
    number = lambda field: int(re.search(r"-?\d+", head[field])[0]) if field in head else None
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    kind = head["warc-type"]
    if kind == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
        raise ValueError(f"the payload of {head['warc-record-id']} does not have its digest")
    size = number("x-payload-length")
    if kind == "response" and size != len(block):
        raise ValueError(f"the payload of {head['warc-record-id']} does not have its length")
    return (
        number("warc-record-id"), head.get("warc-target-uri"), kind, digest, size, number("warc-refers-to"),
        block if payloads and kind == "response" else None,
    )


def archive(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """(index, folder): every row of ``pages`` (page_id, url, html) in archives below the shared folder.

    Of equal payloads of at least ``least_bytes`` bytes, the record with the smallest page_id is the
    response and the others are revisits. A null html is an empty payload, a null url an empty one;
    a page_id must be given and be unique for records to refer to each other: rows without one are
    left out, and rows that repeat an id with equal payloads are all responses. Empty tables make
    no file and an empty index.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", base32_sha1(html.cast("binary")).alias("digest"))
    rows = rows.where("page_id IS NOT NULL")
    shared = (F.octet_length(html) >= least_bytes) if least_bytes else F.lit(True)
    firsts = scratch.put(
        rows.where(shared).groupBy("digest").agg(F.min("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "firsts",
    )
    # Only payloads that occur again are joined, on id and digest, before their text is read.
    again = rows.where(shared).select("page_id", "digest").join(firsts, "digest").where("page_id > response_id")
    revisits = scratch.put(again.select("page_id", "response_id").distinct(), "revisits")
    named = rows.join(revisits, "page_id", "left").withColumn("response_id", F.coalesce("response_id", "page_id"))
    folder = scratch.path("records")
    return scratch.put(write(named, folder), "index"), folder


def read_all(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read from the archives."""
    index, folder = archive(pages, least_bytes)
    back = read(index, folder, payloads=False)
    return back.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
