import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def brute(rows, step, k):
    usable = [(i, [math.floor(1024 * f32(x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v in usable), default=0)
    usable = [(i, v + [0] * (longest - len(v))) for i, v in usable]
    out, asked = [], set()
    for q, x in usable:
        if q % step or q in asked:
            continue
        asked.add(q)
        found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def rows_of(seed, n=700, dim=8):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [c + rnd.gauss(0, 0.3) for c in rnd.choice(centres)], "x") for i in range(n)]
    rows += [(n + i, rows[0][1], "tie") for i in range(40)]
    rows += [(5000, None, ""), (5010, [None] * dim, ""), (5020, [float("nan")] * dim, ""), (5030, [float("inf")] * dim, ""), (5040, [1.0], ""), (None, rows[1][1], ""), (5050, [0.0] * dim, "")]
    return rows


@pytest.mark.parametrize("seed,k,block", [(1, 10, 4096), (2, 3, 16)])
def test_equals_brute_force(spark, monkeypatch, seed, k, block):
    monkeypatch.setattr(topk, "ROWS", block)
    monkeypatch.setattr(topk, "QUERIES", block)
    rows = rows_of(seed)
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.expr("vec_id % 10 = 0"), k, pivots=5, annuli=3).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 10, k)


def test_edges(spark):
    def run(rows):
        return sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA), F.expr("vec_id % 10 = 0"), 10).collect())

    assert run([]) == [] and run([(1, None, "")]) == []
    few = [(0, [1.0, 2.0], ""), (3, [0.5, -0.25], ""), (10, [1.0, 2.0], "")]
    assert run(few) == brute(few, 10, 10)


def test_bounds_leave_out_far_annuli(spark):
    rng = np.random.Generator(np.random.PCG64(7))
    centres = rng.normal(size=(20, 8)) * 5
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 8)) * 0.1
    x[17] *= 50  # one long vector loosens no other annulus
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    report = {}
    got = {}
    for r in topk.top_k(df, F.expr("vec_id % 100 = 0"), k=10, report=report).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = np.floor(x * 1024).astype(np.int64)
    for q in range(0, 3000, 100):
        scores = whole @ whole[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores.tolist()) if i != q)[:10]
        assert [(i, -s) for s, i in want] == [(i, s) for _, i, s in sorted(got[q])]
    assert report["all"] == 30 * 3000 and report["read"] < 0.3 * report["all"]


def test_shorter_vectors_go_on_with_zeros(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [5.0]), (2, [0.0, 9.0]), (3, []), (4, [1.0, 1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.expr("vec_id = 0"), k=10).collect()
    assert [(r.vec_id, r.score >> 20) for r in sorted(got, key=lambda r: r.rank)] == [(2, 18), (4, 6), (1, 5), (3, 0)]
