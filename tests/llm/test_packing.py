import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spindrift.llm.packing import RoundRobin, encoder, pack, scaled

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, got, length):
    """Every id once, sequences gapless and full."""
    by_doc, by_seq = {}, {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {r[0] for r in rows}
    for doc, text, _ in rows:
        ids, at = np.array(ids_of(text), "<u4"), 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, pieces in by_seq.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length if s < len(by_seq) - 1 else 0 < at <= length


@pytest.mark.parametrize("length", [64, 2048])
def test_packs_every_id_once(spark, length):
    rnd = random.Random(length)
    sources = ["a"] * 6 + ["b"] * 3 + [None] + [f"rare{k}" for k in range(3)]
    rows = [(i, " ".join(rnd.choices(["the", "naïve", "Zürich", "42", "<|endoftext|>", "\n\n", "  "], k=rnd.randint(0, 300))) if i % 11 else None, rnd.choice(sources)) for i in range(300)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), length).collect()
    check(rows, got, length)
    total = sum(p.length for p in got)
    share = {}
    for p in got:
        share[p.source] = share.get(p.source, 0) + p.length
    full = [s for s in range(total // length)]
    for source in ("a", "b"):  # each window holds its proportion, to one id
        own = {s: sum(p.length for p in got if p.sequence_id == s and p.source == source) for s in full}
        assert all(abs(n - share[source] * length / total) < 2 for n in own.values())


def test_served_is_monotone_and_exact():
    rnd = random.Random(5)
    totals = [rnd.randint(2000, 90000) for _ in range(30)]
    robin = RoundRobin(totals, 2048)
    served = robin.served(np.arange(-(-robin.all // 2048) + 1))
    assert (served[-1] == totals).all() and (np.diff(served, axis=0) >= 0).all()
    assert (served.sum(axis=1)[:-1] == np.arange(len(served) - 1) * 2048).all()


def test_scaled_is_exact_beyond_64_bits():
    rnd = random.Random(6)
    for bits in (10, 31, 45, 58):
        by, of = rnd.getrandbits(bits) + 1, rnd.getrandbits(bits) + 2
        ids = [rnd.randrange(of) for _ in range(50)] + [0, of]
        q, r = scaled(np.array(ids), by, of)
        assert [divmod(i * by, of) for i in ids] == list(zip(q.tolist(), r.tolist()))
    totals = [rnd.randint(10**11, 10**13) for _ in range(20)]
    robin, windows = RoundRobin(totals, 2048), np.array([0, 1, 10**9, 10**10 + 7])
    for w, got in zip(windows.tolist(), robin.served(windows).tolist()):
        ids = min(w * 2048, sum(totals))
        assert sum(got) == ids and all(abs(g - ids * t / sum(totals)) < 1.01 for g, t in zip(got, totals))


def test_edges(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    rows = [(1, "same", "s"), (1, "same", "s"), (None, None, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(p.length for p in got) == 5 and {p.sequence_id for p in got} == {0}


def test_ids_equal_the_tokenizers_file():
    encode = encoder()
    rnd = random.Random(1)
    pool = [chr(c) for c in [*range(32, 127), 9, 10, 13, 0xA0, 0xE9, 0x3B1, 0x4E2D, 0x1F600, 0x300, 0x200B, 0x2028, 0x661, 0xAD]] + ["<|endoftext|>", "<|endoftext", " <|endoftext|> "]
    for _ in range(2000):
        text = "".join(rnd.choices(pool, k=rnd.randint(0, 60)))
        assert encode(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n_main,length", [(0, 64), (2, 64), (1, 256)])
def test_rare_sources_keep_their_proportions(spark, monkeypatch, n_main, length):
    monkeypatch.setattr("spindrift.llm.packing.TREE", 40)
    rnd = random.Random(length + n_main)
    names = [None, *(f"rare{k}" for k in range(199))] + ["main0", "main1"][:n_main] * 100
    rows = [(i, " ".join(rnd.choices(["the", "naïve", "42", "\n\n"], k=rnd.randint(0, 30))), rnd.choice(names)) for i in range(1500)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), length).collect()
    check(rows, got, length)
    total, share, own = sum(p.length for p in got), {}, {}
    for p in got:
        share[p.source] = share.get(p.source, 0) + p.length
        own[p.source, p.sequence_id] = own.get((p.source, p.sequence_id), 0) + p.length
    for source, n in share.items():
        served = 0
        for w in range(total // length):
            served += own.get((source, w), 0)
            assert abs(served - n * (w + 1) * length / total) < 5
