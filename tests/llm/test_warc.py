import base64
import glob
import hashlib
import random
import struct

import pytest
import zstandard

from spindrift.llm import warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least):
    last, copies = {}, {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least:
            copies[h or ""] = copies.get(h or "", 0) + 1
            if i is not None:
                last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        j = last.get(h or "")
        old = j is not None and i != j
        out.append((i, len((h or "").encode()), digest(h), "revisit" if old else "response", j if old else None))
    return sorted(out, key=str)


def rows_of(seed, n=200):
    rnd = random.Random(seed)
    htmls = ["<html>" + "".join(rnd.choices("abc é\r\n<>", k=rnd.randint(0, 4000))) for _ in range(n // 2)]
    rows = [(i, f"http://h{i % 7}.net/\r\nX: {i}", rnd.choice(htmls)) for i in range(n)]
    return rows + [(900, None, None), (901, "u", ""), (None, "v", ""), (902, "w", "x" * 200_000), (902, "w", "x" * 200_000), (None, "y", "only one")]


@pytest.mark.parametrize("seed,least", [(1, 0), (2, 2000)])
def test_round_trip(spark, tmp_path, monkeypatch, seed, least):
    monkeypatch.setattr(warc, "ARCHIVE", 20_000)
    rows = rows_of(seed)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archive_and_read(df, f"file://{tmp_path}/a", least_bytes=least).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows, least)
    texts = {digest(h): (h or "").encode() for _, _, h in rows}
    for r in warc.read_archives(spark, f"file://{tmp_path}/a", with_payload=True).collect():
        assert r.record_type == "revisit" or bytes(r.payload) == texts[r.payload_digest]


def test_archives_carry_their_dictionary(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://a/{i}", f"<html><head><title>{i}</title></head><body>" + "lorem ipsum " * 30 + f"{i * i}</body></html>") for i in range(500)], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "b"))
    files = glob.glob(f"{tmp_path}/b/*.warc.zst")
    content = open(files[0], "rb").read()
    magic, n = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D and 0 < n <= 64 << 10
    frames = list(warc.read_archive(content))
    plain = sum(len(zstandard.ZstdCompressor(level=6).compress(f)) for f in frames)
    assert len(content) - n < plain  # what the dictionary is for
    with pytest.raises(ValueError):
        list(warc.read_archive(content[:-3]))


def test_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_read(empty, str(tmp_path / "c")).count() == 0
    with pytest.raises(ValueError):
        warc.parse_record(warc.make_record(1, "u", b"abc", "A" * 32))


def test_archives_of_lost_attempts_are_not_read(spark, tmp_path):
    rows = rows_of(5, 60)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/d"
    manifest = warc.write_archives(df, folder)
    for f in glob.glob(f"{tmp_path}/d/*.warc.zst"):  # what other attempts of the same tasks would leave
        content = open(f, "rb").read()
        for name in (f.replace("part-", "part-9"), f.replace("-0000.warc", "-0001.warc")):
            open(name, "wb").write(content)
    got = warc.read_archives(spark, folder, manifest=manifest).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows, 0)
    assert warc.read_archives(spark, folder).count() == 3 * len(rows)
