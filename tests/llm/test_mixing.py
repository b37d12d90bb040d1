import random
import re

import pytest

from spindrift.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes, weights=(5, 2, 1), most=3.0):
    """By the rule as it is stated: cap, share again what is over, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        rest, share = total - sum(capped.values()), sum(w[s] for s in open_)
        out = {s: rest * w[s] / share for s in open_}
        above = [s for s in open_ if out[s] > most * sizes[s]]
        if not above:
            return out | capped
        capped |= {s: most * sizes[s] for s in above}


def brute_fit(lengths, budget):
    sums = {0}
    for n, c in lengths:
        for _ in range(c):
            sums |= {s + n for s in sums if s + n <= budget}
    return max(sums)


def test_budget_is_met_as_nearly_as_can_be():
    rnd = random.Random(1)
    for _ in range(300):
        lengths = [(n, rnd.randint(1, 4)) for n in rnd.sample(range(1, 40), rnd.randint(1, 6))]
        budget = rnd.randint(0, sum(n * c for n, c in lengths))
        take = mixing.fit_budget(lengths, budget)
        assert all(0 <= take[n] <= c for n, c in lengths)
        got = sum(n * t for n, t in take.items())
        assert got <= budget
        left = [(n, c - c * budget // sum(a * b for a, b in lengths)) for n, c in lengths]
        base = sum(n * (c * budget // sum(a * b for a, b in lengths)) for n, c in lengths)
        assert got == base + brute_fit(left, budget - base)
    big = [(n, 1000) for n in range(1, 3000, 7)]
    total = sum(n * c for n, c in big)
    for budget in (total // 3, total - 1, total // 2 + 1):
        assert sum(n * t for n, t in mixing.fit_budget(big, budget).items()) == budget


@pytest.mark.parametrize("seed,cls", [(1, 20_000), (2, 5)])
def test_sources_meet_their_targets(spark, monkeypatch, seed, cls):
    monkeypatch.setattr(mixing, "CLASS", cls)
    rnd = random.Random(seed)
    names = ["s0", "s1", "s10", "s2", "Z", "é", None]
    rows = [(i, rnd.choices(names, [30, 5, 5, 5, 1, 1, 3])[0], " ".join(["w"] * rnd.choice([0, 1, 2, 3, 50, 120])) or None, i) for i in range(3000)]
    rows += [(i, "empty", "\t \n", i) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mixing.mix(df.repartition(3)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = expected_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 120
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_ties_and_edges(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 4), ("c", 2), ("d", 100), ("e", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sized).collect()}
    assert got == pytest.approx(expected_targets({"a": 10, "b": 4, "c": 2, "d": 100, "e": 0}))
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(empty).count() == 0
    rows = [(None, None, "a b c"), (None, None, "a b c"), (7, "x", "word " * 100_000), (7, "x", "one")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), with_row=True).collect()
    assert len(got) == 4 and all(r.row.text for r in got)


def test_other_weights_set_the_targets(spark):
    rows = [(i, "abc"[i % 3], "w " * (1 + i % 7)) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(1, 1, 4)).collect()
    sizes = {r.source: r.source_size for r in got}
    assert {r.source: r.target for r in got} == pytest.approx(expected_targets(sizes, (1, 1, 4)))
