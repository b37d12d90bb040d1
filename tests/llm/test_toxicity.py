import random
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import toxicity

BAD = ["idiot", "moron", "sludgeface"]


def corpus(seed, n=1200):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        w = rnd.choices(words, k=rnd.randint(5, 80))
        y = int(rnd.random() < 0.2)
        for _ in range(y * rnd.randint(1, 4)):
            bad = rnd.choice(BAD)
            w.insert(rnd.randrange(len(w)), bad + rnd.choice(["", "", "en", "ando"]))
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    return rows, labels


def test_held_out_quality_and_calibration(spark):
    rows, labels = corpus(1)
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id % 5 <> 0")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, known, examples=300).collect()}
    held = [(got[i], y) for i, y in labels if i % 5 == 0]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([r.predicted == y for r, y in held]) > 0.97
    assert abs(np.mean([r.score for r, _ in held]) - np.mean([y for _, y in held])) < 0.05
    toxic = [r for r, y in held if y]
    ids = {i for i, y in labels if i % 5}
    assert np.mean([bool(r.evidence) and all(e.id in ids for e in r.evidence) for r in toxic]) > 0.95


def test_index_equals_brute_force():
    rng = np.random.Generator(np.random.PCG64(3))
    vectors = rng.random((700, 40)) * (rng.random((700, 40)) < 0.1)
    vectors[600:650] = vectors[0]
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]).astype(np.float32)
    index = toxicity.BlockMaxIndex.build(vectors)
    for q in range(200):
        at = np.flatnonzero(vectors[q])
        if not len(at):
            continue
        scores = np.array([np.float32(vectors[q, at] @ v[at]) for v in vectors])
        scores[q] = 0
        near, cosine = index.nearest(at, vectors[q, at], 10, q)
        want = np.sort(scores[scores > 0])[::-1][:10]
        assert cosine == pytest.approx(want, abs=1e-5) and scores[near] == pytest.approx(cosine, abs=1e-5) and len(set(near)) == len(near)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "idiot"), (3, "idiot " * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score_toxicity(docs, none).collect()} == {(0.0, 0)}
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7), (2, 0), (3, 0), (3, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, odd).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(docs.limit(0), odd).count() == 0


def test_every_document_is_searched_with_all_its_terms(spark):
    rows, labels = corpus(4, 400)
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id % 5 <> 0")).collect()
    texts = {i: Counter(t for w in text.split() for t in toxicity.terms_of(w)) for i, text in rows}
    df = Counter(t for c in texts.values() for t in c)
    known = sorted({t for i, c in texts.items() if i % 5 for t in c})
    has = [Counter(t for i, y in labels if i % 5 and y == kind for t in texts[i]) for kind in (1, 0)]
    n = [sum(y == kind for i, y in labels if i % 5) for kind in (1, 0)]
    factor = dict(zip(known, toxicity.emphasis(*(np.array([h[t] for t in known], float) for h in has), *n), strict=True))
    assert min(factor.values()) == 1
    unit = {}
    for i, c in texts.items():
        x = {t: (1 + np.log(m)) * (np.log((1 + len(rows)) / (1 + df[t])) + 0.1) * factor[t] for t, m in c.items() if t in factor}
        size = np.sqrt(sum(v * v for v in x.values()))
        unit[i] = {t: v / size for t, v in x.items()}
    for r in got[::7]:
        want = sorted((sum(v * unit[j].get(t, 0) for t, v in unit[r.doc_id].items()) for j, _ in rows if j % 5), reverse=True)[:3]
        assert [e.cosine for e in r.evidence] == pytest.approx(want, abs=1e-5)


def test_terms_are_counted_as_words_are():
    texts = ["", "ab abc abcd", "Abcdefg abcdefg abcde; abcdef\u00e9 zzzz", "\u00df STRASSE stra\u00dfe", "abcd " * 50_000]
    found = sorted({t for text in texts[1:4] for w in text.lower().split() for t in toxicity.terms_of(w)} - {"zzzz"})
    numbered = {n: {} for n in (0, *toxicity.BEGINNINGS)}
    for i, t in enumerate(found):
        numbered[len(t) - 1 if t.endswith("-") else 0][t.removesuffix("-")] = i
    words = toxicity.Words(numbered)
    for _ in range(2):
        for text, (at, times) in zip(texts, words.counts(texts), strict=True):
            want = Counter(found.index(t) for w in toxicity.WORD.findall(text.lower()) for t in toxicity.terms_of(w) if t in found)
            assert dict(zip(at.tolist(), times.tolist(), strict=True)) == want and at.tolist() == sorted(at.tolist())
        words.forget()
    assert list(words.counts([])) == []


def test_alike_examples_share_blocks():
    rng = np.random.Generator(np.random.PCG64(5))
    kind = rng.integers(0, 4, 1000)
    vectors = (rng.random((1000, 400)) < 0.2) * (np.arange(400) // 100 == kind[:, None])
    row, at = np.nonzero(vectors)
    order = toxicity.coherent(row, at, np.ones(len(row), np.float32), *vectors.shape)
    assert sorted(order.tolist()) == list(range(1000))
    blocks = [set(kind[order[i : i + toxicity.BLOCK]].tolist()) for i in range(0, 1000, toxicity.BLOCK)]
    assert sum(map(len, blocks)) <= 2 * len(blocks)
    assert toxicity.coherent(row[:0], at[:0], np.zeros(0, np.float32), 0, 400).tolist() == []
