"""A corpus made ready for training: language, near duplicates, repeated passages, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import jaccard, langid, mixing, packing, suffix_dedup
from spindrift.llm._common import crc_mod, written

#: A document is rejected when its language is unknown or less likely than not.
LEAST_SCORE = 0.5


def _apart(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """docs with further columns of these names renamed, and how to select docs' own columns again."""
    other = {c: f"__{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(other), [F.col(other.get(c, c)).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a calibrated probability of LEAST_SCORE or more; lang stays as it was."""
    model = langid.train(docs.where(crc_mod("doc_id", 3) != 1))
    plain, own = _apart(docs, "lang_pred", "score", "row")
    told = langid.identify(plain, model)
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group tied by a similarity of 0.8 or more on five-word shingles."""
    return jaccard.keep_one(docs, words=5, threshold=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated 100-byte strings out of the texts; a document of which nothing is left goes."""
    plain, own = _apart(docs, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    cut = suffix_dedup.remove_repeats(plain, threshold=100, keep="text")
    kept = cut.where("n_removed = 0 or length(trim(kept)) > 0").withColumnRenamed("kept", "text")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*own)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mixture says: never, or up to three times."""
    mixed = mixing.mix(docs, weights=(5, 2, 1), with_row=True)
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 ids."""
    return packing.pack(docs, length=2048)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packed", packed),
]

#: No stage but the mixture's targets can be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
