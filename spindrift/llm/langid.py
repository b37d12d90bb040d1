"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

The weights are trained on the driver with follow-the-regularised-leader and
elastic-net penalties, over a bounded sample of labelled rows of every language:
`per_language` rows of each, chosen by a hash of the id, or fewer where there are
so many languages that this would be over `sample` rows, and of each row a piece
of `piece` characters.  A fifth of it is kept back to calibrate the probabilities
by one temperature.  Prediction reads every whole text in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm._common import bounded_batches, piece_of, quoted, releasing, row_type, written

BITS = 15
UNKNOWN = "und"
_STEP = np.uint32(0x9E3779B1)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def ngrams(text: str, largest: int = 3):
    """(buckets, counts) of the n-grams of 1 to `largest` characters, or None without a letter.

    Letters are lower-cased; every run of other characters is one space, which
    n-grams may start or end with.
    """
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, c, 32)[keep]
    if c[0] != 32:
        c = np.concatenate([np.array([32], c.dtype), c])
    if c[-1] != 32:
        c = np.append(c, np.array([32], c.dtype))
    h, found = np.zeros(len(c), np.uint32), []
    for n in range(1, largest + 1):
        h = (h[: len(c) - n + 1] + c[n - 1 :].astype(np.uint32) + np.uint32(n)) * _STEP
        h = h ^ (h >> np.uint32(15))
        found.append((h if n > 1 else h[c != 32]) >> np.uint32(32 - BITS))
    counts = np.bincount(np.concatenate(found), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at, counts):
        x = (1 + np.log(counts)) * self.idf[at]
        return x @ self.weights[at] / max(np.sqrt(x @ x), 1e-12) + self.bias

    def probabilities(self, at, counts):
        z = self.logits(at, counts) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def fit(samples: list[tuple[np.ndarray, np.ndarray, str]], passes: int = 6, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3, seed: int = 61) -> LanguageModel:
    """samples: (buckets, counts, language)."""
    languages = sorted({s[2] for s in samples})
    n, size, k = len(samples), 1 << BITS, len(languages)
    df = np.zeros(size)
    for at, _, _ in samples:
        df[at] += 1
    idf = np.log((1 + n) / (1 + df)) + 0.1
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(n)
    held, train = order[: n // 5], order[n // 5 :]
    if len({samples[i][2] for i in train}) < k:
        held, train = order[:0], order
    z, g2 = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(z, g2):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(g2)) / alpha + l2))

    for _ in range(passes):
        for i in rng.permutation(train):
            at, counts, language = samples[i]
            x = (1 + np.log(counts)) * idf[at]
            x = np.append(x / max(np.sqrt(x @ x), 1e-12), 1.0)
            at = np.append(at, size)
            w = weights(z[at], g2[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[languages.index(language)] -= 1
            g = x[:, None] * p[None, :]
            grown = g2[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(g2[at])) / alpha * w
            g2[at] = grown
    w = weights(z, g2)
    model = LanguageModel(languages, idf.astype(np.float32), w[:size].astype(np.float32), w[size])
    if len(held):
        logits = np.stack([model.logits(*samples[i][:2]) for i in held])
        truth = np.array([languages.index(samples[i][2]) for i in held])
        model.temperature = calibrate(logits, truth)
    return model


def calibrate(logits: np.ndarray, truth: np.ndarray, low: float = 0.05, high: float = 20.0) -> float:
    """The temperature of least negative log likelihood, by golden section over its logarithm."""

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean()

    a, b, r = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [(ngrams(t), lang) for t, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True)]
        got = [(x[0].astype(np.uint16).tobytes(), x[1].astype(np.uint32).tobytes(), lang) for x, lang in got if x]
        yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.string()))], names=["buckets", "counts", "lang"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, sample: int = 20_000, piece: int = 4096) -> LanguageModel | None:
    """A model of the labelled rows (null languages and texts without a letter are left out), or None if there are none.

    No language is left out, so the model grows with their number (0.8 MB each
    while it is trained).  Repeated rows may be picked as often as they stand
    there; other columns are not read.
    """
    bounded_batches(labelled.sparkSession)
    columns = ((id_col, None, "id"), (text_col, "string", "text"), (lang_col, "string", "lang"))
    rows = labelled.select(*[(F.col(quoted(c)).cast(kind) if kind else F.col(quoted(c))).alias(name) for c, kind, name in columns]).where("lang is not null and text rlike '\\\\p{L}'")
    # written, so that its size is known: small, it is broadcast, and no text is shuffled by its language
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    found = counts.count()
    if not found:
        return None
    most = max(1, min(per_language, sample // found))
    hashed = F.xxhash64("id", "text")
    unit = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    near = rows.join(counts, "lang").where(unit < F.lit(2.0 * most) / F.col("n")).select("lang", hashed.alias("hash"), piece_of(F.col("text"), piece).alias("text"))
    first = Window.partitionBy("lang").orderBy("hash", "text")
    picked = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most).select("text", "lang")
    got = picked.mapInArrow(releasing(_features), "buckets binary, counts binary, lang string").collect()
    samples = [(np.frombuffer(r.buckets, np.uint16).astype(np.int64), np.frombuffer(r.counts, np.uint32).astype(np.int64), r.lang) for r in got]
    samples.sort(key=lambda s: (s[2], s[0].tobytes(), s[1].tobytes()))
    return fit(samples) if samples else None


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of docs (without keep_text all but the text), then lang_pred and score (columns of those names are replaced).

    score is the calibrated probability of lang_pred.  A null text, or one
    without a letter, is 'und' with score 0; so is every text without a model.
    Repeated rows come out alike, ties go to the language that sorts first, an
    empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            names, scores = [], []
            for t in b["row"].field(text_col).cast(pa.string()) if keep_text else b["text"]:
                x = ngrams(t.as_py()) if model is not None else None
                if x is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = model.probabilities(*x)
                k = int(p.argmax())
                names.append(model.languages[k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    ddl = f"row {row_type(docs, rest)}, lang_pred string, score double"
    text = [] if keep_text else [F.col(quoted(text_col)).cast("string").alias("text")]
    return docs.select(F.struct(*map(quoted, rest)).alias("row"), *text).mapInArrow(releasing(run), ddl).select("row.*", "lang_pred", "score")
