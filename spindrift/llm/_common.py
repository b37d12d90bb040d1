"""Shared plumbing of the training-data operators: scratch storage, Arrow text access and rolling byte hashes."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.storage import settled, shared_folder

MISSING_ID = -(2**63)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share (spark.checkpoint.dir).

    On one machine without that setting a temporary folder takes its place; on a
    cluster that raises.
    """
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint in the shared folder."""
    return settled(df)


def quoted(name: str) -> str:
    """A column's name as Spark reads it whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def row_type(df: DataFrame, names: list[str]) -> str:
    """The type of a struct of these columns."""
    types = dict(df.dtypes)
    return "struct<" + ",".join(f"{quoted(c)}:{types[c]}" for c in names) + ">"


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lowers the session's size of an Arrow batch to `most` bytes, if it is larger.

    Both sides of a Python worker hold whole batches several times over; texts of
    a few kilobytes would otherwise come in tens of megabytes.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    if (int(now.rstrip("kmg")) << unit) > most:
        spark.conf.set(key, f"{most}b")


def releasing(f):
    """A batch function that, once done, gives the memory it has freed back to the system, as workers stay for later stages."""

    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as compressed Parquet in the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def order_id(column: str = "doc_id"):
    """The id as a non-null long; a null id sorts before all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(MISSING_ID))


def hash_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most n rows of distinct keys, chosen by a hash of the keys, alike on every run.

    A share of the hashes is taken that holds about twice n rows, so little more
    than the sample ever leaves the tasks, whatever the size of df.
    """
    share = min(1.0, 2.0 * n / max(df.count(), 1))
    hashed = df.withColumn("__hash", F.xxhash64(*keys)).where(F.pmod("__hash", F.lit(1 << 40)) < int(share * (1 << 40)))
    return hashed.dropDuplicates(["__hash"]).orderBy("__hash").limit(n).drop("__hash")


def piece_of(text, size: int):
    """At most `size` characters of a text, from a place in it that its hash decides, so that no part of long texts is left out."""
    return F.substring(text, (F.pmod(F.xxhash64(text), F.greatest(F.length(text) - size + 1, F.lit(1)).cast("long")) + 1).cast("int"), F.lit(size))


def crc_mod(column: str, n: int):
    """crc32 of the id written as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) end to end, and the n + 1 offsets of its rows."""
    return utf8_bytes(pc.fill_null(column.cast(pa.large_string()), ""))


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slabs(offsets: np.ndarray, target: int = 1 << 20):
    """Runs of rows [i, j) of about target bytes; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def batch(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class RollingHash:
    """Polynomial hashes, modulo 2**64, of any substring, from one prefix sum over random byte values."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**62, dtype=np.uint64)) * 4 + 1 + 2 * (seed % 2)
        self.n = 0

    def _grow(self, n: int) -> None:
        if n <= self.n:
            return
        self.n = max(n, 1 << 19)
        up = np.full(self.n, self.base, np.uint64)
        down = np.full(self.n, pow(self.base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], for arrays of starts and ends."""
        return (prefix[end] - prefix[start]) * self.down[start]

    def every(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all k-byte substrings."""
        n = len(prefix) - k
        return (prefix[k:] - prefix[:n]) * self.down[:n]
