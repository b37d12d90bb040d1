"""The operators over the test tables, under their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.suffix_dedup import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, threshold=100, keep=None)


def op3_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.media import media_features

    return media_features(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), length=2048)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), weights=(5, 2, 1))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.url_filter import judge_urls

    rules = spark.sql("select * from values " + ", ".join(map(str, RULES)) + " as rules(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm._common import crc_mod
    from spindrift.llm.toxicity import score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnable = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_mod("doc_id", 5) != 0)
    scored = score_toxicity(docs, learnable)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.expr("vec_id % 100 = 0"), k=10)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm._common import crc_mod
    from spindrift.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(crc_mod("doc_id", 3) != 1))
    found = identify(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm._common import scratch
    from spindrift.llm.warc import archive_and_read

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return archive_and_read(pages, scratch(spark, "warc"), least_bytes=0).drop("url")


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_url_filter, op3_media_chunks, op4_toxicity, op5_suffix_dedup, op6_topk, op7_jaccard_join, op8_language, op9_packing, op10_warc)
}

_RULES_SQL = ", ".join(map(str, RULES))

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": f"""
        WITH rules(r_host, r_path, r_verdict) AS (VALUES {_RULES_SQL}),
        parts AS (
            SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS raw_host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages
        ),
        cut AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts)
        SELECT page_id, host, path,
               (SELECT max_by(r_host || r_path, length(r_host || r_path)) FROM rules
                WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)) AS rule,
               coalesce((SELECT max_by(r_verdict, length(r_host || r_path)) FROM rules
                WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)), 'allow') AS verdict
        FROM cut
    """,
    "op7_jaccard_join": r"""
        WITH RECURSIVE texts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS rep, count(*) AS n_copies FROM documents GROUP BY ALL),
        words AS (SELECT t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
        sets AS (
            SELECT t, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                           WHEN len(w) > 0 THEN [array_to_string(w, ' ') || '#' || len(w)] ELSE [] END AS s
            FROM words
        ),
        long AS (SELECT t, len(s) AS n, unnest(s) AS g FROM sets),
        shared AS (SELECT a.t AS x, b.t AS y, count(*) AS k, any_value(a.n) AS nx, any_value(b.n) AS ny FROM long a JOIN long b ON a.g = b.g AND a.t <> b.t GROUP BY a.t, b.t),
        links AS (SELECT x, y FROM shared WHERE k >= 0.8 * (nx + ny - k) - 1e-9),
        reach AS (SELECT x AS a, y AS b FROM links UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x),
        least AS (SELECT a, min(rep) AS c FROM reach JOIN texts ON b = t GROUP BY a),
        degree AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
        SELECT doc_id, least(rep, coalesce(c, rep)) AS class_id, n_copies, coalesce(n_links, 0)::BIGINT AS n_links
        FROM documents JOIN texts ON coalesce(text, '') = t LEFT JOIN least ON a = t LEFT JOIN degree ON x = t
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS hex FROM p),
        e AS (
            SELECT *, array_to_string([
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::INTEGER >> (15 - 5 * (k % 4))) & 31)::INTEGER, 1)
                FOR k IN range(32)], '') AS payload_digest
            FROM d
        ),
        l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM e)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM last AND last IS NOT NULL THEN last END AS refers_to
        FROM l
    """,
    "op6_topk": """
        WITH usable AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
}
