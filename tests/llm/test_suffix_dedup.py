import hashlib
import random

import pytest

from spindrift.llm.suffix_dedup import remove_repeats


def brute(rows, threshold):
    """rows: (id, text). First start of each window, then the cover of all later ones."""
    seen, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text in order:
        b = (text or "").encode()
        mask = bytearray(len(b))
        for s in range(len(b) - threshold + 1):
            w = b[s : s + threshold]
            if seen.setdefault(w, (doc, s)) != (doc, s):
                mask[s : s + threshold] = b"\1" * threshold
        kept = bytes(x for x, m in zip(b, mask) if not m)
        spans = sum(1 for k in range(len(b)) if mask[k] and (k == 0 or not mask[k - 1]))
        out.append((doc, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def in_order(spark, rows):
    """Rows as the operator orders them: null ids first, texts of one id by their hash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, t or "") for k, (_, t) in enumerate(rows)], "k long, t string")
    tag = {r.k: r.h for r in df.select("k", F.xxhash64("t").alias("h")).collect()}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, tag[k]))
    return [rows[k] for k in order]


@pytest.mark.parametrize("ids", ["null", "repeated"])
def test_many_texts_without_ids_of_their_own(spark, ids):
    rnd = random.Random(31)
    passage = "".join(rnd.choices("abcdefghij ", k=400))
    rows = []
    for i in range(3000):
        text = "".join(rnd.choices("abcdefghij é", k=rnd.randint(90, 200)))
        if i % 2:
            at = rnd.randint(0, 250)
            text += passage[at : at + 150]
        rows.append((None if ids == "null" else i % 3, text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect())
    want = {}
    seen = {}
    for k, (_, text) in enumerate(in_order(spark, rows)):
        b = text.encode()
        mask = bytearray(len(b))
        for s in range(len(b) - 99):
            if seen.setdefault(b[s : s + 100], (k, s)) != (k, s):
                mask[s : s + 100] = b"\1" * 100
        kept = bytes(x for x, m in zip(b, mask) if not m)
        want[k] = (len(b), sum(mask), sum(1 for j in range(len(b)) if mask[j] and (j == 0 or not mask[j - 1])), hashlib.sha256(kept).hexdigest())
    assert got == sorted(want.values())


def test_radix_groups_equal_a_dictionary():
    import numpy as np

    from spindrift.llm.suffix_dedup import radix_groups

    rnd = random.Random(8)
    data = bytes(rnd.choices(b"ab", k=4000)) + b"abc" * 200
    for threshold in (1, 7, 8, 12, 100):
        at = np.arange(len(data) - threshold + 1)
        alive, group = radix_groups(np.frombuffer(data, np.uint8), at, threshold)
        found, want = {}, {}
        for w, g in zip(alive.tolist(), group.tolist()):
            found.setdefault(g, set()).add(w)
        for w in at.tolist():
            want.setdefault(data[w : w + threshold], set()).add(w)
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
        assert [data[w : w + threshold] for w in alive] == sorted(data[w : w + threshold] for w in alive)


def test_kept_text_has_whole_characters(spark):
    tail = "é" * 80  # equal from its second byte on in both texts
    rows = [(1, "b" + tail), (2, "cÃ" + tail + "end©")]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame([(i, i, t) for i, t in rows], "doc_id long, `a.b` long, text string"), keep="text").collect()}
    assert set(got[1].kept) <= set("bé")
    assert set(got[2].kept) <= set("cÃend©é") and got[2].kept.startswith("c") and got[2].kept.endswith("end©")
    assert got[1]["a.b"] == 1


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 5))) for _ in range(300)]
    passage = " ".join(rnd.choices(words, k=60))
    rows = []
    for i in range(n):
        text = " ".join(rnd.choices(words, k=rnd.randint(0, 120)))
        if i % 3 == 0:
            cut = rnd.randint(0, 80)
            at = rnd.randint(0, len(text))
            text = text[:at] + passage[cut : cut + rnd.randint(80, 250)] + text[at:]
        if rows and i % 7 == 0:
            text = rnd.choice(rows)[1] or ""
            if text:
                at = rnd.randrange(len(text))
                text = text[:at] + "X" + text[at + 1 :]
        rows.append((i * 3 % n if n % 3 else i, text))
    rows += [(n + 1, "ab" * 400), (n + 2, None), (n + 3, ""), (n + 4, "z" * 1000), (None, passage), (n + 5, "z" * 99)]
    return rows


@pytest.mark.parametrize("seed,threshold", [(1, 100), (2, 50), (3, 100)])
def test_equals_brute_force(spark, seed, threshold):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = remove_repeats(df, threshold).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    got = sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == brute(rows, threshold)


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0
    long = "".join(random.Random(4).choices("abcdefgh ", k=5_000_000))
    df = spark.createDataFrame([(1, "x" * 300, 7), (1, "x" * 300, 7), (5, long, 8), (6, long[4_193_000:4_195_000], 9)], "doc_id long, text string, n_bytes int")
    got = {(r.doc_id, r.n_bytes): r for r in remove_repeats(df).collect()}
    assert got[1, 300].n_removed == 299 and got[1, 300].n_spans == 1
    assert got[5, 5_000_000].n_removed == 0
    assert got[6, 2000].n_removed == 2000 and got[6, 2000].kept == b""


def test_hot_digit_is_dealt_out_by_windows(spark, monkeypatch):
    from spindrift.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "LIMIT", 3)
    rows = corpus(9, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r[0] or 0)) == brute(rows, 100)
