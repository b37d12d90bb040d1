"""Exact top-k inner products over a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it, in annuli.
The directory knows of every annulus the largest norm in it and the range of its
distances to each pivot.  The triangle inequality bounds the distance between a
query and an annulus from below, by the best of all pivots, and as
2 q.x = |q|^2 + |x|^2 - |q - x|^2, this and the largest norm bound its scores.  So
a long vector loosens the bound of its own annulus only.  A query first reads its
most promising annuli, until they hold k others; then only annuli whose bound
reaches the k-th score so far.

Pivots and annuli are fitted on a bounded sample (`sample` vectors); every
vector is indexed.  There are more pivots for more vectors, up to MOST_PIVOTS, so
the directory stays bounded.  An annulus with many vectors, or asked by many queries, is
dealt out in blocks, so no task holds more than a block of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm._common import bounded_batches, hash_sample, quoted, written

SCALE = 1024
ROWS, QUERIES = 4096, 1024
MOST_PIVOTS = 256


def _quantize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dim, norm2, packed): whole components as 64-bit integers; unusable vectors are left out."""
    for b in batches:
        vectors = b["embedding"]
        values = vectors.values.cast(pa.float64())
        flat, null = values.to_numpy(zero_copy_only=False), np.asarray(values.is_null())
        bounds, valid, ids = vectors.offsets.to_numpy(), np.asarray(vectors.is_valid()), b["id"]
        out = ([], [], [], [])
        for r in np.flatnonzero(valid & np.asarray(ids.is_valid())).tolist():
            v = flat[bounds[r] : bounds[r + 1]]
            if null[bounds[r] : bounds[r + 1]].any() or not np.isfinite(v).all():
                continue
            x = np.floor(v * SCALE).astype(np.int64)
            for column, value in zip(out, (ids[r].as_py(), len(x), int(x @ x), x.tobytes()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["id", "dim", "norm2", "packed"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows; shorter ones go on with zeros."""
    return np.frombuffer(b"".join([v.ljust(8 * dim, b"\0") for v in column.to_pylist()]), np.int64).reshape(len(column), dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T, 0.0))


def fit_pivots(sample: np.ndarray, pivots: int, annuli: int, seed: int = 71) -> tuple[np.ndarray, np.ndarray]:
    """Pivots by weighted farthest choice and a few mean steps; inner edges of each one's annuli, by the sample's quantiles."""
    rng = np.random.Generator(np.random.PCG64(seed))
    chosen = [sample[rng.integers(len(sample))]]
    near = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < pivots and near.sum() > 0:
        chosen.append(sample[rng.choice(len(sample), p=near / near.sum())])
        near = np.minimum(near, ((sample - chosen[-1]) ** 2).sum(axis=1))
    centres = np.array(chosen)
    for _ in range(5):
        own = _distances(sample, centres).argmin(axis=1)
        centres = np.array([sample[own == p].mean(axis=0) if (own == p).any() else c for p, c in enumerate(centres)])
    d = _distances(sample, centres)
    own = d.argmin(axis=1)
    edges = np.array([np.quantile(d[own == p, p], np.arange(1, annuli) / annuli) if (own == p).any() else np.zeros(annuli - 1) for p in range(len(centres))])
    return centres, edges


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 8192):
                c = b.slice(k, 8192)
                d = _distances(_matrix(c["packed"], m["dim"]).astype(np.float64), m["pivots"])
                p = d.argmin(axis=1)
                ring = (d[np.arange(len(p)), p][:, None] >= m["edges"][p]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([c["id"], pa.array(p * (m["edges"].shape[1] + 1) + ring, pa.int32()), c["norm2"], c["packed"]], names=["id", "cell", "norm2", "packed"])

    return run


def _ranges(shared):
    """(cell, pivot, near, far): least and largest distance of a task's vectors of each cell to each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, near, far = shared.value, {}, {}
        for b in batches:
            for k in range(0, b.num_rows, 8192):
                c = b.slice(k, 8192)
                cell = c["cell"].to_numpy()
                order = np.argsort(cell, kind="stable")
                d = _distances(_matrix(c["packed"], m["dim"]).astype(np.float64), m["pivots"])[order]
                at = np.flatnonzero(np.diff(cell[order], prepend=-1))
                for key, low, high in zip(cell[order][at].tolist(), np.minimum.reduceat(d, at), np.maximum.reduceat(d, at), strict=True):
                    near[key], far[key] = np.minimum(near.get(key, low), low), np.maximum(far.get(key, high), high)
        for key in near:
            n = len(near[key])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(near[key]), pa.array(far[key])], names=["cell", "pivot", "near", "far"])

    return run


ASK = "query_id long, cell int, least long, packed binary"


def _ask(shared, k: int, first: bool):
    """The cells each query reads: at first by falling bound until they hold k others, then all others that can reach its k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = ["query_id", "cell", "least", "packed"]
        for b in batches:
            x = _matrix(b["packed"], m["dim"]).astype(np.float64)
            norm2 = (x * x).sum(axis=1)
            d, short = _distances(x, m["pivots"]), np.zeros((len(x), len(m["cell"])))
            for p in range(d.shape[1]):
                np.maximum(short, np.maximum(m["near"][None, :, p] - d[:, p, None], d[:, p, None] - m["far"][None, :, p]) - m["slack"], out=short)
            bound = np.minimum((norm2[:, None] + m["norm2"] - short * short) / 2, np.sqrt(norm2[:, None] * m["norm2"])) + m["slack"]
            order = np.argsort(-bound, axis=1, kind="stable")
            held = np.cumsum(m["count"][order], axis=1)
            probes = (held < k + 1).sum(axis=1) + 1
            rank = np.argsort(order, axis=1, kind="stable")
            probed = rank < probes[:, None]
            if first:
                asked, least = probed, np.full(len(x), -(2**63))
            else:
                least = b["least"].fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                asked = ~probed & (bound >= least[:, None].astype(np.float64) - m["slack"])
            row, cell = np.nonzero(asked)
            for s in range(0, len(row), 20_000):
                at = pa.array(row[s : s + 20_000])
                yield pa.RecordBatch.from_arrays([b["id"].take(at), pa.array(m["cell"][cell[s : s + 20_000]], pa.int32()), pa.array(least[row[s : s + 20_000]], pa.int64()), b["packed"].take(at)], names=names)

    return run


HIT = "query_id long, vec_id long, score long"


def _search(dim: int, k: int, exact_floats: bool):
    """Over rows sorted by (unit, vectors after queries): each query's k best of the unit that reach its least score."""

    def best(ids, asked, least, x, q):
        kind = np.float64 if exact_floats else np.int64
        x, q = x.astype(kind), q.astype(kind)
        out = []
        for s in range(0, len(q), 256):
            scores = (q[s : s + 256] @ x.T).astype(np.int64)
            scores[asked[s : s + 256, None] == ids[None, :]] = -(2**63)
            reach = np.maximum(least[s : s + 256], -(2**63) + 1)
            if scores.shape[1] > k:
                reach = np.maximum(reach, np.partition(scores, -k, axis=1)[:, -k])
            row, col = np.nonzero(scores >= reach[:, None])
            found = scores[row, col]
            order = np.lexsort((ids[col], -found, row))
            row, col, found = row[order], col[order], found[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = place < k
            out.append((asked[s + row[keep]], ids[col[keep]], found[keep]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, queries, held, n = None, [], [], 0

        def emit():
            if not queries or not held:
                return
            q, c = pa.Table.from_batches(queries).combine_chunks(), pa.Table.from_batches(held).combine_chunks()
            got = best(c["id"].to_numpy(), q["id"].to_numpy(), q["least"].to_numpy(), _matrix(c["packed"], dim), _matrix(q["packed"], dim))
            if len(got[0]):
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()) for g in got], names=["query_id", "vec_id", "score"])

        for b in batches:
            keys = [b[c].to_numpy() for c in ("cell", "block", "asker", "side")]
            new = np.ones(b.num_rows, bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
            cuts = [*np.flatnonzero(new).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                now = tuple(int(x[lo]) for x in keys[:3])
                if now != unit:
                    yield from emit()
                    unit, queries, held, n = now, [], [], 0
                part = b.slice(lo, hi - lo)
                if keys[3][lo] == 0:
                    queries.append(part)
                else:
                    held.append(part)
                    n += part.num_rows
                    if n >= 2 * ROWS:
                        yield from emit()
                        held, n = [], 0
        yield from emit()

    return run


def _units(cells: DataFrame, asks: DataFrame, dim: int, k: int, exact_floats: bool, counts: dict[int, int]) -> DataFrame:
    """Hits of the asked cells; a cell is dealt out in blocks of vectors x blocks of queries."""
    spark = cells.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    askers = {r.cell: r["count"] for r in asks.groupBy("cell").count().collect()}  # at most pivots x annuli rows
    plan = spark.createDataFrame([(c, -(-counts[c] // ROWS), -(-q // QUERIES)) for c, q in askers.items()], "c int, blocks int, shares int")
    plan = F.broadcast(plan)
    left = cells.join(plan, F.col("cell") == F.col("c")).select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("asker"), F.lit(1).alias("side"), "id", F.lit(0).cast("long").alias("least"), "packed")
    right = asks.join(plan, F.col("cell") == F.col("c")).select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int").alias("asker"), F.lit(0).alias("side"), F.col("query_id").alias("id"), "least", "packed")
    rows = left.unionByName(right).repartition(n, "cell", "block", "asker").sortWithinPartitions("cell", "block", "asker", "side", "id")
    return rows.mapInArrow(_search(dim, k, exact_floats), HIT)


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, annuli: int = 8, sample: int = 4096, report: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest integer inner products among all other rows.

    Components are floor(1024 * x).  Ties go to the smaller vec_id; with fewer
    others all are returned.  Vectors that are null, or hold a null or non-finite
    component, take no part; nor do rows without an id.  A vector shorter than
    the longest one goes on with zeros.  Rows of one id are several candidates, but
    never answers to that id's own query, which is asked once.  `is_query` is a
    condition on the id; other columns, whatever their names, are not read.
    Scores must fit 63 bits.  An empty table, or one without queries, gives no
    rows.  report, if given, gets the pairs that were scored ("read") and all pairs
    of a query and a vector ("all").
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    ready = written(vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("embedding")).mapInArrow(_quantize, "id long, dim int, norm2 long, packed binary"), "vectors")
    n, dim, longest = ready.agg(F.count("*"), F.max("dim"), F.max("norm2")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = hash_sample(ready.select("id", "packed"), ["id"], sample).toArrow()["packed"].combine_chunks()
    pivots = pivots or int(min(MOST_PIVOTS, max(16, n ** (1 / 3))))
    centres, edges = fit_pivots(_matrix(chosen, dim).astype(np.float64), pivots, annuli)
    model = {"dim": dim, "pivots": centres, "edges": edges, "slack": 1e-6 * max(1.0, float(longest)) ** 0.5 + 1e-3}
    shared = spark.sparkContext.broadcast(model)
    cells = written(ready.mapInArrow(_assign(shared), "id long, cell int, norm2 long, packed binary"), "cells")
    directory = sorted(cells.groupBy("cell").agg(F.max("norm2").alias("norm2"), F.count("*").alias("n")).collect())
    place = {r.cell: at for at, r in enumerate(directory)}
    model |= {"cell": np.array([r.cell for r in directory]), "norm2": np.array([float(r.norm2) for r in directory]), "count": np.array([r.n for r in directory])}
    model |= {"near": np.zeros((len(directory), len(centres))), "far": np.zeros((len(directory), len(centres)))}
    # at most pivots x annuli x pivots rows
    ranges = cells.select("cell", "packed").mapInArrow(_ranges(shared), "cell int, pivot int, near double, far double").groupBy("cell", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far")).toArrow()
    at = np.array([place[c] for c in ranges["cell"].to_pylist()]), ranges["pivot"].to_numpy()
    model["near"][at], model["far"][at] = ranges["near"].to_numpy(), ranges["far"].to_numpy()
    shared, counts = spark.sparkContext.broadcast(model), {r.cell: r.n for r in directory}
    exact_floats = 2 * float(longest) < 2**52
    cells = cells.select("id", "cell", "packed")
    queries = ready.withColumn(id_col, F.col("id")).where(is_query).select("id", "packed").dropDuplicates(["id"])
    asks = written(queries.mapInArrow(_ask(shared, k, True), ASK), "asks")
    hits = written(_units(cells, asks, dim, k, exact_floats, counts), "hits")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    more = written(queries.join(kth, "id", "left").select("id", "packed", "least").mapInArrow(_ask(shared, k, False), ASK), "asks")
    if report is not None:
        asked = asks.select("cell").unionByName(more.select("cell")).groupBy("cell").count().collect()
        report |= {"read": sum(counts[r.cell] * r["count"] for r in asked), "all": n * queries.count()}
    hits = hits.unionByName(_units(cells, more, dim, k, exact_floats, counts))
    return hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
