"""Mixture-controlled packing: a deficit round robin over source queues fills every window to its token proportions.

Each source is a queue of its documents' ids.  A window of `length` ids credits
each queue its share of the window; the queue serves the whole ids of what it
has been credited and not served, and the ids that are still free go, one each,
to the queues of largest deficit.  Deficits carry over to the next window.  What
a queue has served after w windows depends on w alone - the whole part of its
credit, and one more if its deficit is among the largest - so any task can take
up the round robin at any window, with the deficits that all windows before it
would have left.  As every id is packed exactly once, the proportions that can
hold to the end are the sources' shares of all ids.

Sources with under 1/1024 of the ids (of short windows, under two ids a window)
are the leaves of binary trees of bounded size, tied to one.  A node passes on
the ids it is served to its two children by their totals, to the first the whole
part of its credit and to the other the rest, so what any of these sources has
been served also follows in closed form from the ids packed so far, and differs
from its credit by a few ids at most, however rare it is.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm._common import bounded_batches, quoted, releasing, written

END = 1
MAIN_QUEUES = 1024
#: Mean number of rare sources in a tree.
TREE = 512
_ENCODERS: dict = {}


def encoder(ranks_path: str | None = None, tokenizer_path: str | None = None):
    """A function from a text to its ids: those that the `tokenizers` file gives with add_special_tokens=False.

    The byte-level BPE runs by its ranks, which is several times as fast; the
    file's added tokens (`<|endoftext|>`) are found in the text first, as there, and
    what stands between them is encoded on its own.
    """
    import base64
    import json
    import re

    import public_tokenizers
    import tiktoken

    key = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    if key not in _ENCODERS:
        with open(key[0], "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        with open(key[1], encoding="utf-8") as f:
            added = {t["content"]: t for t in json.load(f)["added_tokens"]}
        if any(t[k] for t in added.values() for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in what stands beside them")
        plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        apart = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        def encode(text: str) -> list[int]:
            if apart is None or not any(t in text for t in added):
                return plain(text)
            return [i for part in apart.split(text) for i in ([added[part]["id"]] if part in added else plain(part))]

        _ENCODERS[key] = encode
    return _ENCODERS[key]


def _tokenize(ranks_path):
    names = ["task", "doc_id", "source", "n", "before", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task, served = encoder(ranks_path), TaskContext.get().partitionId(), {}
        for b in batches:
            n, before, ids = [], [], []
            for text, source in zip(b["text"], b["source"].to_pylist(), strict=True):
                own = np.array([*encode(text.as_py() or ""), END], "<u2")
                n.append(len(own))
                before.append(served.get(source, 0))
                served[source] = before[-1] + len(own)
                ids.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * len(n), pa.int32()), b["doc_id"], b["source"], pa.array(n, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())], names=names
            )

    return run


def scaled(ids: np.ndarray, by, of: int) -> tuple[np.ndarray, np.ndarray]:
    """ids * by divided by `of`: whole parts and rests, exactly, though the products may not fit 64 bits.

    A long division, over as many bits of ids at once as the other numbers leave free.
    """
    ids, by = np.asarray(ids).astype(np.uint64), np.asarray(by, np.uint64)
    width = 62 - max(int(by.max(initial=0)), of).bit_length()
    if width < 1:
        raise ValueError("more than 2**61 ids")
    q = r = np.zeros(np.broadcast_shapes(ids.shape, by.shape), np.uint64)
    shift, mask, of = np.uint64(width), np.uint64((1 << width) - 1), np.uint64(of)
    for k in reversed(range(-(-int(ids.max(initial=0)).bit_length() // width))):
        x = (r << shift) + ((ids >> np.uint64(k * width)) & mask) * by
        q, r = (q << shift) + x // of, x % of
    return q.astype(np.int64), r.astype(np.int64)


class RoundRobin:
    """Ids that each queue has served after any number of windows, of which the rare sources have `rest` ids in all."""

    def __init__(self, totals: list[int], length: int, rest: int = 0):
        self.totals, self.length, self.own, self.all = totals, length, sum(totals), sum(totals) + rest

    def served(self, windows: np.ndarray) -> np.ndarray:
        ids, _ = scaled(np.minimum(windows.astype(np.int64) * self.length, self.all), self.own, self.all)
        whole, deficit = scaled(ids[:, None], np.array(self.totals)[None, :], self.own)
        spare = ids - whole.sum(axis=1)
        rank = np.argsort(np.argsort(-deficit, axis=1, kind="stable"), axis=1, kind="stable")
        return whole + (rank < spare[:, None])


def routes(totals: list[int]) -> list[list[int]]:
    """Of each leaf of a Huffman tree over the totals: its parents' totals up to the root, negative where it comes second."""
    heap, up, k = [(n, i) for i, n in enumerate(totals)], {}, len(totals)
    heapq.heapify(heap)
    while len(heap) > 1:
        (m, x), (n, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (k, m + n), (k, -m - n)
        heapq.heappush(heap, (m + n, k))
        k += 1
    out = []
    for x in range(len(totals)):
        out.append([])
        while x in up:
            x, n = up[x]
            out[-1].append(n)
    return out


def place(ids: np.ndarray, total: int, route: list[int]) -> np.ndarray:
    """Where in the root's order the source of this total has its ids of these numbers."""
    for t in route:
        whole, rest = scaled(ids + (t > 0), abs(t), total)
        ids, total = whole + (rest > 0) - 1 if t > 0 else whole, abs(t)
    return ids


def given(ids: np.ndarray, total: int, route: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the root's first ids: how many the source has, and how many those before it in the tree."""
    nodes, before = [total, *map(abs, route)], np.zeros(len(ids), np.int64)
    for k in range(len(route) - 1, -1, -1):
        whole = nodes[k + 1]
        first, _ = scaled(ids, nodes[k] if route[k] > 0 else whole - nodes[k], whole)
        if route[k] < 0:
            before = before + first
        ids = first if route[k] > 0 else ids - first
    return ids, before


def _rare_parts(docs: np.ndarray, begin: np.ndarray, n: np.ndarray, total: int, route: list[int], length: int):
    """Pieces (document, start, size, window, offset) of documents of one rare source."""
    ends = np.cumsum(n[docs])
    for own in np.split(docs, np.searchsorted(ends, np.arange(1 << 18, int(ends[-1]), 1 << 18))):
        if not len(own):
            continue
        size = n[own]
        doc = np.repeat(np.arange(len(own)), size)
        ids = np.repeat(begin[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        window = place(ids, total, route) // length
        head = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(window, prepend=-1) != 0))
        row, window, start = own[doc[head]], window[head], ids[head]
        root = abs(route[-1]) if route else total
        had, before = given(window * length, total, route)
        _, after = given(np.minimum((window + 1) * length, root), total, route)
        yield row, start - begin[row], np.diff(np.append(head, len(ids))), window, after - before + start - had


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _pieces(totals: list[int], length: int, rest: int):
    names = [x.split()[0] for x in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        robin = RoundRobin(totals, length, rest)
        last = -(-robin.all // length)
        for b in batches:
            queue, n = b["queue"].to_numpy(), b["n"].to_numpy()
            begin = b["base"].to_numpy() + b["before"].to_numpy()
            parts = []
            rare, names_of = np.flatnonzero(queue < 0), {}
            for r, source in zip(rare.tolist(), b["source"].take(pa.array(rare)).to_pylist(), strict=True):
                names_of.setdefault(source, []).append(r)
            for docs in names_of.values():
                docs = np.array(docs)[np.argsort(begin[docs], kind="stable")]
                parts += _rare_parts(docs, begin, n, b["total"][docs[0]].as_py(), b["route"][docs[0]].as_py(), length)
            for q in np.unique(queue[queue >= 0]).tolist():
                own = np.flatnonzero(queue == q)
                share = totals[q] / robin.all * length
                order = own[np.argsort(begin[own], kind="stable")]
                for docs in np.array_split(order, max(1, int(n[order].sum() / share / 5000))):
                    if not len(docs):
                        continue
                    a, e = begin[docs], begin[docs] + n[docs]
                    lo, hi = max(0, int(a.min() / share) - 2), min(last, int(e.max() / share) + 3)
                    served = robin.served(np.arange(lo, hi + 1))
                    cut, before = served[:, q], np.diff(served[:, :q], axis=0).sum(axis=1)
                    first = np.searchsorted(cut, a, "right") - 1
                    count = np.searchsorted(cut, e, "left") - first
                    row = np.repeat(np.arange(len(docs)), count)
                    w = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(row))
                    s, t = np.maximum(a[row], cut[w]), np.minimum(e[row], cut[w + 1])
                    parts.append((docs[row], s - a[row], t - s, w + lo, before[w] + s - cut[w]))
            row, start, size, window, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, row))
            row, start, size, window, offset = (x[order] for x in (row, start, size, window, offset))
            crc, at, ids = np.zeros(len(row), np.int64), -1, b""
            for k, (r, s, z) in enumerate(zip(row.tolist(), start.tolist(), size.tolist(), strict=True)):
                if r != at:
                    at, ids = r, memoryview(np.frombuffer(b["ids"][r].as_py(), "<u2").astype("<u4").tobytes())
                crc[k] = zlib.crc32(ids[4 * s : 4 * (s + z)])
            take = pa.array(row)
            for k in range(0, len(row), 50_000):
                c = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(take[c]), *(pa.array(x[c], pa.int64()) for x in (start, size, crc)), b["n"].take(take[c]), *(pa.array(x[c], pa.int64()) for x in (window, offset)), b["source"].take(take[c])], names=names
                )

    return run


def pack(docs: DataFrame, length: int = 2048, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    A document's ids are the tokenizer's, then the end id 1; a null or empty text
    is the end id alone.  Every id is in exactly one piece, sequences are filled
    without gaps from offset 0, and only the last one is shorter than `length`
    (padded, unless its size is a power of two).  Repeated rows are packed once
    each, a null source is a source, other columns are left out, whatever their
    names, and an empty table gives no pieces.  A text is tokenized whole by one
    task, however long; its pieces may lie in thousands of sequences.  A source's order is that of the input's partitions
    and rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(source_col)).cast("string").alias("source"), F.col(quoted(text_col)).cast("string").alias("text"))
    ids = written(rows.mapInArrow(releasing(_tokenize(ranks_path)), "task int, doc_id long, source string, n long, before long, ids binary"), "ids")
    shares = ids.groupBy("task", "source").agg(F.sum("n").alias("n"))
    total = shares.agg(F.sum("n")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], PIECE)
    sources = written(shares.groupBy("source").agg(F.sum("n").alias("n")), "sources")
    is_main = F.col("n") >= total / max(1, min(MAIN_QUEUES, length // 2))
    main = [(r.source, r.n) for r in sources.where(is_main).orderBy(F.col("source").asc_nulls_last()).collect()]
    totals = [n for _, n in main]
    rest = total - sum(totals)
    queues = spark.createDataFrame([(s, k, 0, []) for k, (s, _) in enumerate(main)], "source string, queue int, total long, route array<long>")
    if rest:
        queues = queues.unionByName(_rare(sources.where(~is_main), rest, total))
    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = shares.select("task", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = bases.join(queues.withColumnRenamed("source", "q"), F.col("source").eqNullSafe(F.col("q"))).select(F.col("task").alias("t"), F.col("source").alias("s"), "queue", "base", "total", "route")
    placed = ids.join(bases, (F.col("task") == F.col("t")) & F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "n", "before", "ids", "queue", "base", "total", "route")
    return placed.mapInArrow(releasing(_pieces(totals, length, rest)), PIECE)


def _rare(sources: DataFrame, rest: int, total: int) -> DataFrame:
    """source, queue -1, total and route of the rare sources: trees by hash of the source, tied by one tree, second to the main queues."""
    trees = -(-sources.count() // TREE)
    dealt = sources.withColumn("tree", F.pmod(F.xxhash64("source"), F.lit(trees)).cast("int"))
    sums = [(r.tree, r.n) for r in dealt.groupBy("tree").agg(F.sum("n").alias("n")).orderBy("tree").collect()]
    above = {t: [*route, *([-total] if rest < total else [])] for (t, _), route in zip(sums, routes([n for _, n in sums]), strict=True)}

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["source", "n", "tree"]).to_pylist(), key=lambda r: (r["n"], r["source"] is None, r["source"] or ""))
        found = [route + above[r["tree"]] for r, route in zip(rows, routes([r["n"] for r in rows]), strict=True)]
        return pa.table([pa.array([r["source"] for r in rows], pa.string()), pa.array([-1] * len(rows), pa.int32()), pa.array([r["n"] for r in rows], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["source", "queue", "total", "route"])

    return dealt.groupBy("tree").applyInArrow(run, "source string, queue int, total long, route array<long>")
