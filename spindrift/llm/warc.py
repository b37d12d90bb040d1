"""WARC archives with a Zstandard dictionary in a leading skippable frame, each record compressed on its own.

The dictionary is trained on a bounded sample of the records to be archived
(`sample` records, chosen by hash, each with a piece of its payload) and stands at
the head of every archive, in a skippable frame of magic 0x184D2A5D, so that each
file is read without the others.  Of records with equal payloads one is a
`response` with the payload, the others are `revisit` records that name it.
Archives are written to a folder that all executors share, through a temporary
name and under a name of their task's attempt.  The manifest lists the archives of
the attempts that were committed: what a lost attempt has left behind is not in it,
and reading goes by the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm._common import bounded_batches, checkpointed, hash_sample, piece_of, quoted

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space of URLs
#: Bytes of compressed records after which a task starts its next archive, and characters of a payload that the dictionary learns from.
ARCHIVE, PIECE = 16 << 20, 4096


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}:{digest}')}>"


def safe_uri(url: str | None) -> str:
    """The URL with white space and control characters percent-encoded, for a header line."""
    return re.sub(r"[\x00-\x20\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")


def make_record(page_id, url: str | None, payload: bytes, digest: str, response_id=None) -> bytes:
    """One record; with response_id a revisit of that page's response, which holds no payload."""
    revisit = response_id is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(response_id, digest)}", f"X-Refers-To-Page: {response_id}"] if revisit else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (None in a revisit); a malformed record raises."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("malformed record")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("the payload does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page"),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page"),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def train_dictionary(records: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary of at most `size` bytes; too few records for training serve as one themselves."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:size]


def archive_head(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, a frame each, with the dictionary in its head; a frame is fed in slices, so no rest is copied."""
    magic, n = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("an archive without its dictionary frame")
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + n]) if n else None)
    view, at = memoryview(content), 8 + n
    while at < len(content):
        frame, out = press.decompressobj(), []
        while not frame.eof:
            if at >= len(content):
                raise ValueError("a truncated archive")
            out.append(frame.decompress(view[at : at + 8192]))
            at = min(at + 8192, len(content)) - len(frame.unused_data)
        yield b"".join(out)


def _write_file(folder: str, name: str, content: bytes) -> None:
    scheme, _, path = urlsplit(folder)[:3]
    if scheme in ("", "file"):
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(content)
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, f"{path}/{name}")


def _read_file(folder: str, name: str) -> bytes:
    scheme, _, path = urlsplit(folder)[:3]
    if scheme in ("", "file"):
        with open(f"{path}/{name}", "rb") as f:
            return f.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def _payload(html) -> bytes:
    return (html or "").encode()


def _archive(folder: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, dictionary = TaskContext.get(), shared.value
        task, attempt = context.partitionId(), context.taskAttemptId()
        press = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        head = archive_head(dictionary)
        held, size, records, k, out = [head], 0, 0, 0, []

        def close():
            nonlocal held, size, records, k
            name = f"part-{task:06d}-{attempt}-{k:04d}.warc.zst"
            _write_file(folder, name, b"".join(held))
            out.append((name, records, size + len(head)))
            held, size, records, k = [head], 0, 0, k + 1

        for b in batches:
            for page, url, html, digest, refers in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"], b["digest"].to_pylist(), b["refers_to"].to_pylist(), strict=True):
                frame = press.compress(make_record(page, url, _payload(html.as_py()), digest, refers))
                held.append(frame)
                size += len(frame)
                records += 1
                if size >= ARCHIVE:
                    close()
        if records:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "records", "bytes"])

    return run


def base32_sha1(payload):
    """Upper-case base32 of the SHA-1, as an expression: 40 hex digits in eight groups of five are four groups of 20 bits each."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", digits)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, sample: int = 2000, dictionary_bytes: int = 64 << 10) -> DataFrame:
    """Writes a record per row of pages into archives in folder; gives file, records, bytes of each archive.

    The payload is the html in UTF-8, a null one is empty.  Of equal payloads of
    at least `least_bytes` bytes the record of the largest page_id is the
    response and the others revisit it; a null page_id is smaller than all
    others, and rows that share the largest page_id are all responses.  Smaller
    payloads are always responses.  A null URL is archived as about:blank, white
    space and control characters in one are percent-encoded.  An empty table
    writes nothing.  A payload is held whole by its task, however long; other
    columns are left out, whatever their names.  The result is the manifest of
    the archives, to be kept for `read_archives`.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    id_col, url_col, html_col = map(quoted, (id_col, url_col, html_col))
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    # the largest id and whether there is a smaller one, of every payload; pre-aggregated, whatever the number of copies
    last = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1 and last is not null").select(F.col("digest").alias("d"), "last")
    rows = rows.join(last, F.col("digest") == F.col("d"), "left")
    older = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    rows = rows.select("page_id", "url", "html", "digest", F.when(older, F.col("last")).alias("refers_to"))
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), piece_of(html, PIECE).alias("html"))
    chosen = hash_sample(chosen, ["page_id", "url"], sample)
    records = [make_record(r.page_id, r.url, _payload(r.html), "A" * 32) for r in chosen.collect()]
    shared = spark.sparkContext.broadcast(train_dictionary(records, dictionary_bytes))
    return checkpointed(rows.mapInArrow(_archive(folder, shared), "file string, records long, bytes long"))


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(with_payload: bool, folder: str | None = None):
    names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], t) for c, t in zip(names, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0):
                held, size = [], 0
                for record in read_archive(archive.as_py() if folder is None else _read_file(folder, archive.as_py())):
                    held.append(parse_record(record))
                    size += len(record) if with_payload else 200
                    if size > 8 << 20:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)

    return run


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False, manifest: DataFrame | None = None) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and the payload of responses).

    With the manifest of `write_archives` exactly its archives are read; without
    one all archives in the folder, which may hold some of lost attempts.
    Payloads are checked against their digests; an archive that is missing,
    truncated or lacks its dictionary makes the job fail.
    """
    ddl = READ + ", payload binary" * with_payload
    if manifest is None:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content").mapInArrow(_read(with_payload), ddl)
    return manifest.select("file").mapInArrow(_read(with_payload, folder), ddl)


def archive_and_read(pages: DataFrame, folder: str, with_payload: bool = False, **options) -> DataFrame:
    """Archives the pages in folder and reads the archives back."""
    return read_archives(pages.sparkSession, folder, with_payload, write_archives(pages, folder, **options))
