"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

The classifier is fitted on a bounded sample: at most `examples` labelled rows
of each label, chosen by a hash of the id.  The vectors' terms are all words of
the examples, and their beginnings of 3 to 5 characters, without selection;
their inverse document frequencies are counted over all documents, and a term
weighs more the more it tells of the label (by its G² among the examples), none
less than its TF-IDF.  Every document is searched with all its terms; those that no example has match
nothing and do not count in the document's length.  Examples that are alike
share a block of the index, so that its bounds pass over more blocks; which
block an example is in changes no cosine.  Votes are turned into
probabilities by a logistic curve fitted to the examples' own leave-one-out
votes, weighted to the label counts of all learnable rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm._common import bounded_batches, checkpointed, quoted, row_type, slabs, written

WORD = re.compile(r"\w+")
BEGINNINGS = (3, 4, 5)
BLOCK = 128
#: Blocks that a search reads before it knows a bound to pass over others by.
FIRST = 3
#: A term that more than one in so many examples have is kept as a whole row of weights.
COMMON = 16
#: G² at which a term weighs twice its TF-IDF.
TELLING = 12.0
#: Characters whose words are looked up at once, and words that a task remembers.
AT_ONCE, REMEMBERED = 1 << 20, 200_000
#: Documents whose common terms are multiplied at once; always so many rows, so that equal texts get equal sums.
SLAB = 64


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a hyphen."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


@dataclass
class BlockMaxIndex:
    """Sparse unit vectors of the examples in blocks: whole rows of the common terms, and of each other term its postings and its largest weight in each block that has it."""

    common: np.ndarray  # row in dense of each term, or -1
    dense: np.ndarray  # common terms x examples, padded to whole blocks
    start: np.ndarray  # where each other term's blocks start
    block: np.ndarray
    largest: np.ndarray
    first: np.ndarray  # where each block's postings start
    example: np.ndarray
    weight: np.ndarray
    n: int
    plain: tuple

    @classmethod
    def build(cls, vectors: np.ndarray) -> BlockMaxIndex:
        row, at = np.nonzero(vectors)
        return cls.of(row, at, vectors[row, at], *vectors.shape)

    @classmethod
    def of(cls, row: np.ndarray, at: np.ndarray, weights: np.ndarray, n: int, terms: int) -> BlockMaxIndex:
        """From the weights of single (example, term)."""
        order = np.lexsort((row, at))
        return cls._sorted(row[order].astype(np.int64), weights[order].astype(np.float32), np.bincount(at, minlength=terms).astype(np.int32), n)

    @classmethod
    def _sorted(cls, row, weights, held, n) -> BlockMaxIndex:
        blocks, terms = -(-max(n, 1) // BLOCK), len(held)
        at = np.repeat(np.arange(terms), held)
        chosen = held * COMMON > n
        common = np.where(chosen, np.cumsum(chosen) - 1, -1)
        dense = np.zeros((int(chosen.sum()), blocks * BLOCK), np.float32)
        is_common = chosen[at]
        dense[common[at[is_common]], row[is_common]] = weights[is_common]
        plain = (row, weights, held, n)
        row, at, weights = row[~is_common], at[~is_common], weights[~is_common]
        first = np.flatnonzero(np.diff(at * blocks + row // BLOCK, prepend=-1))
        largest = np.maximum.reduceat(weights, first) if len(first) else np.zeros(0, np.float32)
        start = np.searchsorted(at[first], np.arange(terms + 1))
        return cls(common, dense, start, (row // BLOCK)[first], largest, np.append(first, len(row)), row, weights, n, plain)

    def __reduce__(self):
        return BlockMaxIndex._sorted, self.plain  # the tables that follow from it are made anew where it is used

    def common_sums(self, queries: list[tuple[np.ndarray, np.ndarray]]):
        """What the common terms of each of the (at, values) add to all examples."""
        for k in range(0, len(queries), SLAB):
            q = np.zeros((SLAB, len(self.dense)), np.float32)
            for i, (at, values) in enumerate(queries[k : k + SLAB]):
                c = self.common[at]
                q[i, c[c >= 0]] = values[c >= 0]
            yield from (q @ self.dense)[: len(queries) - k]

    def nearest(self, at: np.ndarray, values: np.ndarray, k: int, without: int = -1, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine over zero (ties: the earlier one), and those cosines, exactly.

        The blocks of largest bound are read first, then those of the others that can hold a better example.
        """
        if sums is None:
            sums = next(self.common_sums([(at, values)]))
        rare = self.common[at] < 0
        at, values = at[rare], values[rare]
        start, count = self.start[at], self.start[at + 1] - self.start[at]
        entry = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        of, value = self.block[entry], np.repeat(values, count)
        bounds = sums.reshape(-1, BLOCK).max(axis=1) + np.bincount(of, self.largest[entry] * value, len(sums) // BLOCK)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        best, score, least, size = np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, FIRST
        while len(order):
            now, order, size = order[:size], order[size:], len(bounds)
            read = np.zeros(len(bounds), bool)
            read[now] = True
            own = np.flatnonzero(read[of])
            lo = self.first[entry[own]]
            n = self.first[entry[own] + 1] - lo
            post = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            s = sums + np.bincount(self.example[post], self.weight[post] * np.repeat(value[own], n), len(sums))
            got = (now[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            got = got[(s[got] >= max(least - 1e-6, 1e-30)) & (got != without)]
            if len(got) > 4 * k:
                got = got[s[got] >= np.partition(s[got], -k)[-k] - 1e-6]
            best, score = np.append(best, got), np.append(score, s[got].astype(np.float32))
            if len(best) > k:
                top = np.lexsort((best, -score))[:k]
                best, score = best[top], score[top]
            least = float(score.min()) if len(best) == k else 0.0
            order = order[bounds[order] >= least - 1e-6]
        top = np.lexsort((best, -score))
        return best[top], score[top]


def coherent(row: np.ndarray, at: np.ndarray, weights: np.ndarray, n: int, terms: int, rounds: int = 4) -> np.ndarray:
    """An order of the n examples in which those of one block are alike, so that a block's largest weights say more of it.

    Groups are halved, in whole blocks, along the direction in which their vectors differ most (by power iteration).
    row is sorted.
    """
    first = np.searchsorted(row, np.arange(n + 1))
    start = np.random.default_rng(0).standard_normal(n)

    def halves(group: np.ndarray) -> list[np.ndarray]:
        if len(group) <= BLOCK:
            return [group]
        held = first[group + 1] - first[group]
        entry = np.repeat(first[group] - np.cumsum(held) + held, held) + np.arange(held.sum())
        of, term, weight = np.repeat(np.arange(len(group)), held), at[entry], weights[entry].astype(np.float64)
        mean, u = np.bincount(term, weight, terms) / len(group), start[: len(group)]
        for _ in range(rounds):
            v = np.bincount(term, weight * (u - u.mean())[of], terms)
            u = np.bincount(of, weight * v[term], len(group)) - mean @ v
            u = u / max(float(np.abs(u).max()), 1e-30)
        group = group[np.argsort(-u, kind="stable")]
        half = -(-len(group) // BLOCK) // 2 * BLOCK
        return [*halves(group[:half]), *halves(group[half:])]

    return np.concatenate(halves(np.arange(n)))


@dataclass
class ToxicityModel:
    idf: np.ndarray
    index: BlockMaxIndex
    labels: np.ndarray
    ids: list
    k: int
    base: float  # score of texts without any term of the examples
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, at, counts):
        x = ((1 + np.log(counts)) * self.idf[at]).astype(np.float32)
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def vote(self, at, x, without: int = -1, sums=None):
        near, cosine = self.index.nearest(at, x, self.k, without, sums)
        weight = cosine.astype(np.float64) ** 2
        share = (weight @ self.labels[near] + 0.5 * self.base) / (weight.sum() + 0.5)
        return float(np.log(share) - np.log1p(-share)), near, cosine

    def votes(self, queries, own: bool = False):
        """Of each unit vector (at, values); own: they are the examples, in order, and each is left out of its vote."""
        for i, ((at, x), sums) in enumerate(zip(queries, self.index.common_sums(queries), strict=True)):
            yield self.vote(at, x, i if own else -1, sums)

    def scores(self, rows):
        """score, nearest examples and cosines of each (at, counts)."""
        votes = self.votes([(at, self.vector(at, counts)) for at, counts in rows if len(at)])
        for at, _ in rows:
            if not len(at):
                yield self.base, [], []
                continue
            z, near, cosine = next(votes)
            p = 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -35, 35)))
            yield float(p), near[:3], cosine[:3]


def emphasis(a, b, n_a, n_b):
    """Factor of at least 1 for terms that a of n_a toxic and b of n_b other examples have, by G² where toxic ones have them more often."""
    if not n_a or not n_b:
        return np.ones(len(a))
    share = (a + b) / (n_a + n_b)
    g2 = np.zeros(len(a))
    for seen, expected in ((a, n_a * share), (b, n_b * share), (n_a - a, n_a * (1 - share)), (n_b - b, n_b * (1 - share))):
        g2 += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)
    return 1 + np.where(a * n_b > b * n_a, np.maximum(g2, 0), 0) / TELLING


def logistic_curve(z, y, w, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the weighted logistic fit of y on z, with a small ridge around the identity."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        v = w * np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(w * (p - y) * z).sum() + 0.1 * (a - 1), (w * (p - y)).sum() + 0.1 * b])
        hessian = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(hessian, gradient)
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    for b in batches:
        words = {w for text in b["text"] for w in WORD.findall((text.as_py() or "").lower())} - seen
        seen |= words
        yield pa.RecordBatch.from_arrays([pa.array(list({t for w in words for t in terms_of(w)}), pa.string())], names=["term"])


class Words(dict):
    """Numbers the words as they are met, and holds the terms of each: flat[start[i]:start[i + 1]]."""

    def __init__(self, terms: dict[int, dict[str, int]]):
        self.whole, self.beginnings = terms[0], [(n, terms[n]) for n in BEGINNINGS]
        self.n_terms = sum(map(len, terms.values()))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.start = array("q"), array("q", [0])

    def __missing__(self, word: str) -> int:
        own = self.whole.get(word)
        if own is not None:
            self.flat.append(own)
        for n, beginnings in self.beginnings:
            if len(word) <= n:
                break
            own = beginnings.get(word[:n])
            if own is not None:
                self.flat.append(own)
        self.start.append(len(self.flat))
        number = self[word] = len(self)
        return number

    def counts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the terms it has, in order, and how often: words are counted first, then the terms of each."""
        found = [WORD.findall(t.lower()) for t in texts]
        n = np.array([len(f) for f in found], np.int64)
        number = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), np.int64, int(n.sum()))
        words, start, flat = max(len(self), 1), np.array(self.start), np.array(self.flat)
        key = np.sort(np.repeat(np.arange(len(n)), n) * words + number)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(first, append=len(key))
        text, number = np.divmod(key[first], words)
        held = start[number + 1] - start[number]
        entry = np.repeat(start[number] - np.cumsum(held) + held, held) + np.arange(held.sum())
        key, times = np.repeat(text, held) * max(self.n_terms, 1) + flat[entry], np.repeat(times, held)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(times[order], first) if len(first) else first
        text, at = np.divmod(key[first], max(self.n_terms, 1))
        ends = np.searchsorted(text, np.arange(len(n) + 1))
        for i, j in zip(ends[:-1], ends[1:], strict=True):
            yield at[i:j], times[i:j]


def _extract(shared):
    """(row, packed): how often each of the terms stands in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(shared.value)
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            size = np.cumsum([0, *map(len, texts)])
            out = []
            for i, j in slabs(size, AT_ONCE):
                if len(known) > REMEMBERED:
                    known.forget()
                out.extend(_packed(at, times) for at, times in known.counts(texts[i:j]))
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(out, pa.binary())], names=["row", "packed"])

    return run


def _packed(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Gaps and counts by falling significance of their bytes, most of which are zero."""
    return np.concatenate([np.diff(at, prepend=0), counts]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, counts = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel().reshape(2, -1)
    return np.cumsum(gaps, dtype=np.int64), counts


def _count_held(n: int):
    """How many documents have each of the n terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n, np.int64)
        for b in batches:
            for packed in b["packed"]:
                held[_unpacked(packed.as_py())[0]] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["at", "n"])

    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = 3000, k: int = 15
) -> DataFrame:
    """All columns of docs but the text, then score, predicted, evidence (ids and cosines of the nearest examples).

    labels has the rows that may be learnt from: id_col and label_col 0 or 1; null
    ids or labels are left out, and of several labels of one id the largest
    counts.  Texts that are null, empty or have no term of any example get the rate
    of toxic rows among examples without a word.  Without labels every score is 0.  Equal
    texts get equal scores; an empty table stays empty; columns of docs that
    clash with the result's are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rest = [c for c in docs.columns if c not in (text_col, "score", "predicted", "evidence")]
    text = F.col(quoted(text_col)).cast("string").alias("text")
    row_ddl = f"row {row_type(docs, rest)}"
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    total = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    result = f"{row_ddl}, score double, predicted int, evidence array<struct<id:long,cosine:double>>"
    model = None
    if total:
        unit = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
        share = F.create_map(*[F.lit(x) for y, n in total.items() for x in (y, min(1.0, 1.2 * examples / n))])
        first = Window.partitionBy("y").orderBy(F.xxhash64("id"))
        picked = known.where(unit < share[F.col("y")]).withColumn("k", F.row_number().over(first)).where(F.col("k") <= examples).select("id", "y")
        # at most 2 x `examples` rows of two numbers
        sample = checkpointed(docs.select(F.col(quoted(id_col)).alias("id"), text).join(F.broadcast(picked), "id").dropDuplicates(["id"]))
        size = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
        if size:
            model = _fit(sample, size, total, k)
    if model is None:
        found = docs.select(F.struct(*map(quoted, rest)).alias("row")).select("row", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.expr("cast(array() as array<struct<id:long,cosine:double>>)").alias("evidence"))
        return found.select("row.*", "score", "predicted", "evidence")
    model, terms, complete = model
    features = written(docs.select(F.struct(*map(quoted, rest)).alias("row"), text).mapInArrow(_extract(terms), f"{row_ddl}, packed binary"), "terms")
    df = features.select("packed").mapInArrow(_count_held(len(model.idf)), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n, held = features.count(), np.zeros(len(model.idf))
    held[df["at"].to_numpy()] = df["n"].to_numpy()
    shared = spark.sparkContext.broadcast(complete(np.log((1 + n) / (1 + held)) + 0.1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores, evidence = [], []
            for p, near, cosine in model.scores([_unpacked(x) for x in b["packed"].to_pylist()]):
                scores.append(p)
                evidence.append([{"id": model.ids[i], "cosine": float(c)} for i, c in zip(near, cosine, strict=True)])
            kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(scores, pa.float64()), pa.array([int(p >= 0.5) for p in scores], pa.int32()), pa.array(evidence, kind)], names=["row", "score", "predicted", "evidence"])

    return features.mapInArrow(run, result).select("row.*", "score", "predicted", "evidence")


def _fit(sample, size, total, k):
    """The model without frequencies, its terms for the tasks, and a function that completes it with the frequencies."""
    spark = sample.sparkSession
    found = sample.select("text").mapInArrow(_terms, "term string").distinct().toArrow()["term"].to_pylist()
    numbered: dict[int, dict[str, int]] = {n: {} for n in (0, *BEGINNINGS)}  # whole words under 0
    for i, t in enumerate(sorted(found)):
        numbered[len(t) - 1 if t.endswith("-") else 0][t.removesuffix("-")] = i
    terms = spark.sparkContext.broadcast(numbered)
    # at most 2 x `examples` rows
    rows = sample.select(F.struct("id", "y").alias("row"), "text").mapInArrow(_extract(terms), "row struct<id:long,y:int>, packed binary")
    rows = rows.select("row.id", "row.y", "packed").toArrow().sort_by("id").combine_chunks()
    ids, y = rows["id"].to_numpy(), rows["y"].to_numpy()
    at, counts = zip(*[_unpacked(x) for x in rows["packed"].to_pylist()], strict=True)
    scale = np.array([total[label] / size[label] for label in y.tolist()])
    own = np.array([len(a) > 0 for a in at], bool)
    base = float(((scale * y)[~own].sum() + 0.01) / (scale[~own].sum() + 1))
    at, counts = ([x for x, has in zip(lists, own, strict=True) if has] for lists in (at, counts))
    toxic, other = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(a for a, label in zip(at, y[own], strict=True) if label == kind)]), minlength=len(found)) for kind in (1, 0))
    factor = emphasis(toxic.astype(float), other.astype(float), size.get(1, 0), size.get(0, 0))
    model = ToxicityModel(np.ones(len(found)), None, y[own].astype(float), ids[own].tolist(), k, base)

    def complete(idf: np.ndarray) -> ToxicityModel:
        model.idf = idf * factor
        queries = [(a, model.vector(a, c)) for a, c in zip(at, counts, strict=True)]
        flat = [np.concatenate([q[j] for q in queries]) if queries else np.zeros(0, t) for j, t in ((0, np.int64), (1, np.float32))]
        row = np.repeat(np.arange(len(at)), [len(a) for a in at])
        order = coherent(row, flat[0], flat[1], len(at), len(idf))
        place = np.argsort(order)
        model.index = BlockMaxIndex.of(place[row], flat[0], flat[1], len(at), len(idf))
        model.labels, model.ids = model.labels[order], [model.ids[i] for i in order]
        if queries:
            z = np.array([vote[0] for vote in model.votes([queries[i] for i in order], own=True)])
            model.slope, model.shift = logistic_curve(z, model.labels, scale[own][order])
        return model

    return model, terms, complete
