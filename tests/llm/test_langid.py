import random

import numpy as np

from spindrift.llm import langid

STEMS = {"xa": "tion ing the and er st", "xb": "une ment eux ou le ré", "xc": "ung sch ein für und ö"}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choices(STEMS[lang].split(), k=rnd.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_calibration(spark):
    rnd = random.Random(1)
    rows = [(i, text(rnd, lang, rnd.randint(3, 60)), lang) for i in range(600) for lang in [rnd.choice(list(STEMS))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 3 <> 1"), per_language=120)
    got = langid.identify(df.where("doc_id % 3 = 1"), model).collect()
    right = [r.lang == r.lang_pred for r in got]
    assert np.mean(right) > 0.97 and abs(np.mean(right) - np.mean([r.score for r in got])) < 0.05
    assert all(0 <= r.score <= 1 for r in got)
    assert (model.weights == 0).mean() > 0.3  # the penalties leave it sparse


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "123 !?", None), (4, "abc " * 100_000, "a"), (4, "x", "b")], "doc_id long, text string, score string")
    out = langid.identify(df, None)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"] and {r.lang_pred for r in out.collect()} == {"und"}
    labelled = df.withColumnRenamed("score", "lang")
    model = langid.train(labelled)
    got = {(r.doc_id, (r.text or "")[:3]): r.lang_pred for r in langid.identify(labelled, model).collect()}
    assert got[1, ""] == got[2, ""] == got[3, "123"] == "und" and got[4, "abc"] == "a"
    assert langid.train(labelled.limit(0)) is None
    assert langid.identify(labelled.limit(0), model).count() == 0


def test_temperature_recovers_a_known_scale():
    rng = np.random.Generator(np.random.PCG64(2))
    logits = rng.normal(size=(20000, 4))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    truth = (p.cumsum(axis=1) > rng.random((20000, 1))).argmax(axis=1)
    assert abs(langid.calibrate(logits * 3, truth) - 3) < 0.15


def test_follows_the_regularised_leader_like_a_plain_loop():
    rng = np.random.Generator(np.random.PCG64(4))
    samples = []
    for _ in range(12):
        at = np.sort(rng.choice(50, 6, replace=False))
        samples.append((at, rng.integers(1, 4, 6), "pq"[int(at[0] > 5)]))
    alpha, beta, l1, l2 = 2.0, 1.0, 1e-4, 1e-3
    model = langid.fit(samples, passes=2, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=61)
    df = [sum(f in s[0] for s in samples) for f in range(1 << langid.BITS)]
    idf = [float(np.log((1 + 12) / (1 + d)) + 0.1) for d in df]
    order = np.random.Generator(np.random.PCG64(61))
    train = order.permutation(12)[12 // 5 :]
    z, g2, size = {}, {}, 1 << langid.BITS

    def weight(f, c):
        v = z.get((f, c), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((beta + g2.get((f, c), 0.0) ** 0.5) / alpha + l2)

    for _ in range(2):
        for i in order.permutation(train):
            at, counts, lang = samples[i]
            x = {int(f): (1 + np.log(n)) * idf[f] for f, n in zip(at, counts)}
            length = sum(v * v for v in x.values()) ** 0.5
            x = {f: v / length for f, v in x.items()} | {size: 1.0}
            s = [sum(v * weight(f, c) for f, v in x.items()) for c in range(2)]
            p = np.exp(np.array(s) - max(s))
            p /= p.sum()
            step = {(f, c): v * (p[c] - (c == "pq".index(lang))) for f, v in x.items() for c in range(2)}
            old = {k: weight(*k) for k in step}
            for k, g in step.items():
                before = g2.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / alpha * old[k]
                g2[k] = before + g * g
    for f in range(50):
        for c in range(2):
            assert abs(model.weights[f, c] - weight(f, c)) < 1e-5
    assert all(abs(model.bias[c] - weight(size, c)) < 1e-9 for c in range(2))


def test_every_language_is_learned_within_the_sample(spark):
    rnd = random.Random(9)
    rows = [(None if i % 2 else i, f"l{i % 30} " + "".join(rnd.choices("abcdefgh", k=9)), f"l{i % 30}") for i in range(300)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=60)
    assert model.languages == sorted({f"l{k}" for k in range(30)})
