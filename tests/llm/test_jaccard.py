import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from spindrift.llm import jaccard
from spindrift.llm.jaccard import near_duplicates


def shingles(text, k=5):
    w = (text or "").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    sets = {t: shingles(t) for t in texts}
    parent = {t: t for t in texts}
    links = dict.fromkeys(texts, 0)

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in combinations(texts, 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= threshold * len(x | y):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = {}
    for t, ids in texts.items():
        known = [i for i in ids if i is not None]
        if known:
            least[find(t)] = min(least.get(find(t), known[0]), *known)
    return sorted(((i, least.get(find(t or "")), len(texts[t or ""]), links[t or ""]) for i, t in rows), key=str)


def corpus(seed, n=150):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdef", k=rnd.randint(2, 6))) for _ in range(400)]
    rows = []
    for i in range(n):
        if rows and i % 2:
            w = (rnd.choice(rows)[1] or "x").split()
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 5, 6, 60, 200])))))
    rows += [(1000, None), (1001, ""), (1002, rows[0][1]), (1002, rows[0][1]), (None, rows[1][1]), (1003, "\t" + rows[4][1] + " \n"), (1004, "a b c"), (1005, "a  b c")]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    rows = corpus(seed)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_a_large_family_lists_no_pairs(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rnd.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.class_id for r in got} == {0} and len(got) == 400
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_edges(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicates(spark.createDataFrame([(1, "one two three four five six", "clash")], "doc_id long, text string, cls string")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 0)]


def test_posterior_bound_keeps_true_pairs():
    for n, least in jaccard.fewest_matches(200, 0.8, 1e-9):
        assert 0 < least < 0.8 * n


def test_keep_one_with_clashing_columns_and_null_ids(spark):
    from spindrift.llm.jaccard import keep_one

    text = " ".join(f"word{i}" for i in range(40))
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(None, text, 1), (3, text, 2), (None, "quite another text of seven words here", 3), (None, text + " more", 4), (8, long, 5), (9, long + " end", 6), (None, "and one more that resembles no other text", 7)]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, `a.k` int").withColumns({"k": F.lit(1), "c": F.lit("x"), "__k": F.lit(2)}))
    assert got.columns == ["doc_id", "text", "a.k", "k", "c", "__k"]
    assert sorted(r["a.k"] for r in got.collect()) == [2, 3, 5, 7]
