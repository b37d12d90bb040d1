import random

import pytest

import corpus_pipeline as P
from tests.llm.test_jaccard import brute as near_brute
from tests.llm.test_packing import check as packing_check
from tests.llm.test_suffix_dedup import brute as repeats_brute

WORDS = {"en": "the and er th in on st re".split(), "de": "und sch ein für ö ung be ge".split()}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choices(WORDS[lang], k=rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    passage = text(rnd, "en", 70)
    rows = []
    for i in range(400):
        lang = rnd.choice(["en", "de"])
        t = text(rnd, lang, rnd.randint(5, 120))
        if i % 10 == 0:
            t = f"{t} {passage} end{i}"
        rows.append((i, t, lang, rnd.choice(["a", "a", "a", "b", None]), len(t)))
    rows += [(1000, rows[3][1], "en", "b", 9), (1001, rows[7][1] + " more", "en", "a", 9), (1002, None, "en", "a", 0), (1003, "12345 !", "de", "b", 7), (1004, "", None, "a", 0)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    told = P.language(spark, docs, "")
    kept = rows_of(told)
    assert told.columns == docs.columns and not {1002, 1003, 1004} & {r[0] for r in kept}
    assert len(kept) >= len(corpus) - 3 - 8

    one = P.near_duplicates(spark, told, "")
    groups = {i: c for i, c, _, _ in near_brute([r[:2] for r in kept])}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(groups.values())) and one.columns == docs.columns

    left = rows_of(one)
    cut = {r.doc_id: r for r in P.repeated_passages(spark, one, "").collect()}
    for i, n, removed, _, _ in repeats_brute([r[:2] for r in left], 100):
        assert (i in cut) if removed < n else True
        if i in cut:
            assert len(cut[i].text.encode()) == n - removed and cut[i].n_chars == len(cut[i].text)

    mixed = P.mixture(spark, spark.createDataFrame(list(cut.values()), SCHEMA), "")
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert mixed.columns == docs.columns and max(copies.values()) <= 3
    once = {r.doc_id: (r.doc_id, r.text, r.source) for r in mixed.collect()}
    distinct = spark.createDataFrame(list(once.values()), "doc_id long, text string, source string")
    packing_check(list(once.values()), P.packed(spark, distinct, "").collect(), 2048)


def test_run_takes_nulls_clashing_names_and_nothing(spark, corpus, tmp_path):
    extra = spark.createDataFrame(corpus, SCHEMA).selectExpr("*", "1 as cls", "2 as id", "3 as row", "4 as size", "5 as kept", "6 as score")
    extra.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() > 0
    extra.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
