"""Media columns in content-defined chunks: each distinct chunk is kept once, ordered lists of digests give the media back.

A payload is a run of 8-bit samples; its media form is a mono RIFF/WAVE file.
Cuts fall where a gear hash of the last 32 bytes has its upper bits clear, so
equal passages are cut alike wherever they stand.  `manifests` lists the digests
of a payload in order, `chunks` holds each digest's bytes once, and `restore`
joins the two, checks every chunk's digest, reads the samples back out of the file
and compares them with the digest of the payload from before it was stored.
Chunks are kept compressed with a Zstandard dictionary, which is trained on a
bounded sample of texts (`sample` of them, chosen by hash).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm._common import bounded_batches, hash_sample, piece_of, quoted, utf8

LEAST, MEAN_BITS, MOST, RATE, LEVEL = 1024, 12, 16384, 8000, 19
_GEAR = np.random.Generator(np.random.PCG64(51)).integers(0, 2**32, 256, dtype=np.uint32)


def _cut_marks(data: np.ndarray) -> np.ndarray:
    """Positions after which the gear hash allows a cut."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def cuts(marks: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of data[start:end]."""
    out = []
    while end - start > LEAST:
        k = bisect_left(marks, start + LEAST)
        start = min(marks[k] if k < len(marks) else end, start + MOST, end)
        out.append(start)
    if not out or out[-1] < end:
        out.append(end)
    return out


def payload_of(text: bytes) -> bytes:
    """The bytes, then zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def _payloads(b: pa.RecordBatch):
    """(row, chunks) of every row, over slabs of about a megabyte."""
    data, offsets = utf8(b["text"])
    held, size, rows = [], 0, []
    for r in range(b.num_rows):
        held.append(payload_of(data[offsets[r] : offsets[r + 1]].tobytes()))
        rows.append(r)
        size += len(held[-1])
        if size > 1 << 20 or r == b.num_rows - 1:
            joined = b"".join(held)
            marks, at = _cut_marks(np.frombuffer(joined, np.uint8)).tolist(), 0
            for row, p in zip(rows, held, strict=True):
                ends = cuts(marks, at, at + len(p))
                yield row, [joined[x:y] for x, y in zip([at, *ends], ends, strict=False)]
                at += len(p)
            held, size, rows = [], 0, []


def _digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:20]


CHUNK = pa.schema([("digest", pa.binary()), ("packed", pa.binary())])
PART = pa.schema([("key", pa.binary()), ("ordinal", pa.int32()), ("count", pa.int32()), ("digest", pa.binary())])
SEEN = 1_000_000


def train_dictionary(docs: DataFrame, text_col: str = "text", sample: int = 2000, size: int = 112 << 10) -> bytes:
    """A dictionary for the chunks of docs' texts, empty if there are too few to train one.

    It learns from a piece of MOST characters, anywhere in the text, of each of
    `sample` texts; chunks are stored whole whatever it has seen.
    """
    text = F.col(quoted(text_col)).cast("string")
    rows = hash_sample(docs.select(text.alias("text")), ["text"], sample).where("text is not null").select(piece_of(F.col("text"), MOST).alias("text")).collect()
    try:
        return zstandard.train_dictionary(size, [r.text.encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _shared(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _map_chunks(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _shared(shared.value), set()
        if known:
            known.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_dict_id=False)
        for b in batches:
            digests, packed = [], []
            for _, parts in _payloads(b):
                for p in parts:
                    d = _digest(p)
                    if d not in seen:
                        seen.add(d)
                        digests.append(d)
                        packed.append(press.compress(p))
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], schema=CHUNK)
            if len(seen) > SEEN:
                seen.clear()

    return run


def _map_manifests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for b in batches:
        keys, out = b["key"], ([], [], [], [])
        for row, parts in _payloads(b):
            key = keys[row].as_py()
            if key in seen:
                continue
            seen.add(key)
            for k, p in enumerate(parts):
                for column, value in zip(out, (key, k, len(parts), _digest(p)), strict=True):
                    column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, PART, strict=True)], schema=PART)
        if len(seen) > SEEN:
            seen.clear()


def _key(text_col: str):
    """The SHA-256 of the payload, taken before anything is stored, in its first 20 bytes."""
    data = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).cast("binary")
    n = F.octet_length(data)
    zeros = F.unhex(F.repeat(F.lit("00"), F.when(n == 0, 64).otherwise(F.pmod(-n, F.lit(64))).cast("int")))
    return F.unhex(F.substring(F.sha2(F.concat(data, zeros), 256), 1, 40))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"), _key(text_col).alias("key"))


def manifests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, ordinal, count, digest): the ordered chunks of each distinct payload; a list may occur once per map task."""
    return _keyed(docs, text_col).select("text", "key").mapInArrow(_map_manifests, "key binary, ordinal int, count int, digest binary")


def chunks(docs: DataFrame, text_col: str = "text", dictionary: bytes = b"") -> DataFrame:
    """(digest, packed): every distinct chunk once, compressed with the dictionary."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)
    return _keyed(docs, text_col).select("text").mapInArrow(_map_chunks(shared), "digest binary, packed binary").dropDuplicates(["digest"])


def wave(payload: bytes) -> bytes:
    """The samples as a mono 8-bit RIFF/WAVE file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(file: bytes) -> bytes:
    """The samples of such a file; anything else raises."""
    riff, size, kind, fmt, n, coding, channels, _, _, align, bits, tag, length = struct.unpack_from("<4sI4s4sIHHIIHH4sI", file)
    if (riff, kind, fmt, n, coding, channels, align, bits, tag) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 1, 8, b"data") or size + 8 != len(file) or length + 44 != len(file):
        raise ValueError("not an 8-bit mono wave file")
    return file[44:]


def feature(payload: bytes, n_chunks: int) -> str:
    """Loudness and zero crossings of the samples around their midpoint, and a 16-bin histogram's mode."""
    x = np.frombuffer(payload, np.uint8)
    level = x.astype(np.int64) - 128
    sign = level < 0
    return f"mean={level.mean():.4f};rms={np.sqrt((level * level).mean()):.4f};crossings={int((sign[1:] != sign[:-1]).sum())};mode={int(np.bincount(x >> 4, minlength=16).argmax())};chunks={n_chunks}"


RESTORED = "key binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string, media binary"


def _restore(with_media: bool, shared):
    names = [x.split()[0] for x in RESTORED.split(", ")][: 8 if with_media else 7]
    types = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, key, parts, count, out = zstandard.ZstdDecompressor(dict_data=_shared(shared.value)), None, [], 0, []

        def close():
            if len(parts) != count:
                raise ValueError(f"chunk list of {count} has {len(parts)} chunks")
            file = wave(b"".join(parts))
            payload = samples(file)
            digest = hashlib.sha256(payload).digest()
            if digest[:20] != key:
                raise ValueError("the samples read back are not the payload that was stored")
            got = (key, len(payload), digest, zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).digest(), feature(payload, count), file)
            out.append(got[: len(names)])

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for b in batches:
            for k, ordinal, n, digest, packed in zip(b["key"].to_pylist(), b["ordinal"].to_pylist(), b["count"].to_pylist(), b["digest"], b["packed"], strict=True):
                if k != key:
                    if key is not None:
                        close()
                    key, parts, count = k, [], n
                if ordinal < len(parts):
                    continue  # the same list from another task
                chunk = press.decompress(packed.as_py())
                if _digest(chunk) != digest.as_py():
                    raise ValueError("a chunk does not match its digest")
                parts.append(chunk)
            if len(out) > 2000:
                yield emit()
                out = []
        if key is not None:
            close()
        if out:
            yield emit()

    return run


def _restored(lists: DataFrame, store: DataFrame, with_media: bool, dictionary: bytes) -> DataFrame:
    """As restore, with digests as bytes, which take half the room in a shuffle."""
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = lists.join(store, "digest", "left").select("key", "ordinal", "count", "digest", "packed")
    ddl = RESTORED if with_media else RESTORED.rpartition(", ")[0]
    shared = lists.sparkSession.sparkContext.broadcast(dictionary)
    return joined.repartition(n, "key").sortWithinPartitions("key", "ordinal").mapInArrow(_restore(with_media, shared), ddl)


def _hexed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})


def restore(lists: DataFrame, store: DataFrame, with_media: bool = False, dictionary: bytes = b"") -> DataFrame:
    """Each listed payload read back from the store: sizes, digests, features and, if asked for, the media file.

    A missing or altered chunk makes the job fail; nothing is returned unchecked.
    """
    return _hexed(_restored(lists, store, with_media, dictionary))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_bytes and what `restore` reads back of its payload.

    A null text is an empty one and has 64 zero samples; equal texts have equal
    values in all columns but the id.  A payload is held whole by its task,
    however long.  Ids may be null or repeated, other columns are left out,
    whatever their names, an empty table gives no rows.
    """
    keys = docs.select(F.col(quoted(id_col)).alias(id_col), F.octet_length(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))).cast("long").alias("n_bytes"), _key(text_col).alias("key"))
    bounded_batches(docs.sparkSession)
    dictionary = train_dictionary(docs, text_col)
    found = _restored(manifests(docs, text_col), chunks(docs, text_col, dictionary), False, dictionary)
    return _hexed(keys.join(found, "key").drop("key"))
