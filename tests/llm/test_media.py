import hashlib
import random
import zlib

import pytest

from spindrift.llm import media


def expected(text):
    b = (text or "").encode()
    p = b + bytes(-len(b) % 64 if b else 64)
    w = media.wave(p)
    return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(w), hashlib.sha256(w).hexdigest()


def rows_of(seed):
    rnd = random.Random(seed)
    passage = "".join(rnd.choices("abcdefgh é", k=30000))
    rows = [(i, "".join(rnd.choices("abcdefg é", k=rnd.choice([0, 1, 63, 64, 65, 900, 5000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "x"), (102, passage), (103, "intro " + passage), (103, "intro " + passage), (104, "x" * 100_000), (105, rows[5][1])]
    return rows


def test_round_trip(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", df_lit()).repartition(4)
    got = media.media_features(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((i, *expected(t)) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got), key=key) == want
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add(r.feature)
    assert all(len(x) == 1 for x in by.values())


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("a clashing name")


def test_shared_passages_are_kept_once(spark):
    df = spark.createDataFrame(rows_of(2), "doc_id long, text string")
    lists, store = media.manifests(df), media.chunks(df)
    n = lists.count()
    assert store.count() < n
    assert store.select("digest").distinct().count() == store.count()
    files = {bytes(r.key): bytes(r.media) for r in media.restore(lists, store, with_media=True).collect()}
    texts = {hashlib.sha256(p).digest()[:20]: p for p in (media.payload_of((t or "").encode()) for _, t in rows_of(2))}  # keyed by the payload's digest
    assert {k: media.samples(f) for k, f in files.items()} == texts


def test_missing_chunk_fails(spark):
    df = spark.createDataFrame(rows_of(3), "doc_id long, text string")
    with pytest.raises(Exception):
        media.restore(media.manifests(df), media.chunks(df).limit(3)).collect()
    assert media.media_features(df.limit(0)).count() == 0


def test_a_list_that_gives_other_samples_fails(spark):
    df = spark.createDataFrame([(1, "".join(random.Random(4).choices("abcdefgh", k=60_000)))], "doc_id long, text string")
    lists, store = media.manifests(df), media.chunks(df)
    assert media.restore(lists, store).count() == 1
    turned = lists.selectExpr("key", "cast(`count` - 1 - ordinal as int) as ordinal", "`count`", "digest")
    with pytest.raises(Exception, match="not the payload"):
        media.restore(turned, store).collect()
