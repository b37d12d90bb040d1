"""N-gram Jaccard join: all pairs of texts whose word-shingle sets reach a similarity, without listing the pairs.

1. Texts become classes (equal texts are one class, by a 64-bit hash) with a
   MinHash signature of bands x rows values.  Classes that agree in a whole band
   are candidates; each map task ties its own candidates to their least class,
   so one row a band and task is shuffled, however many copies there are.
2. Candidates' components are compared in blocks.  Within a block signatures are
   compared a few values at a time, and a pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold is under
   `tolerance`; the pairs left are verified on the exact shingle sets.
3. A block returns a count of links for each class and a spanning forest, never
   its pairs; the forests' components are the result's groups.

With 40 bands of 5 rows a pair at similarity 0.8 escapes all bands with
probability 1.3e-7, one at 0.9 with 4e-16.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm._common import MISSING_ID, batch, bounded_batches, checkpointed, mix, order_id, quoted, releasing, utf8
from spindrift.llm.components import components
from spindrift.llm.shingles import MinHash, shingle_sets

BAND = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("hub", pa.int64())])
#: Band rows that a map task holds before it ties them, and classes it remembers.
FLUSH, SEEN = 1_000_000, 500_000
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20
STEP = 20


def _map_bands(words: int, bands: int, rows: int):
    """(key, class, none) to be grouped, (any key, class, hub) for ties found within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signature, seen, held, size = MinHash(bands * rows), set(), [], 0
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        step = np.uint64(0x9E3779B97F4A7C15)

        def flush():
            keys, cls = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((cls, keys))
            keys, cls = keys[order], cls[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            hubs = cls[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
            for k in range(0, new.sum(), 100_000):
                at = np.flatnonzero(new)[k : k + 100_000]
                yield batch(BAND, keys[at], cls[at], pa.nulls(len(at), pa.int64()))
            tie = hubs != cls
            if tie.any():
                pairs = np.unique(np.stack([cls[tie], hubs[tie]]), axis=1)
                yield batch(BAND, mix(pairs[0].view(np.uint64)).view(np.int64), pairs[0], pairs[1])

        for b in batches:
            data, offsets = utf8(b["text"])
            own = b["cls"].to_numpy()
            fresh = np.zeros(len(own), bool)
            for r, c in enumerate(own.tolist()):
                if c not in seen:
                    seen.add(c)
                    fresh[r] = True
            if len(seen) > SEEN:
                seen.clear()
            for r, hashes in shingle_sets(data, offsets, words):
                if not fresh[r] or not len(hashes):
                    continue
                values = signature(hashes).astype(np.uint64).reshape(bands, rows)
                key = salt.copy()
                for k in range(rows):
                    key = key * step + values[:, k]
                held.append((mix(key).view(np.int64), np.full(bands, own[r])))
                size += bands
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, class): each class tied to the least one of its key."""
    last_key = last_hub = None
    for b in batches:
        keys, cls = b["key"].to_numpy(), b["cls"].to_numpy()
        known = np.asarray(b["hub"].is_valid())
        if known.any():
            yield batch(EDGE, cls[known], b["hub"].filter(pa.array(known)))
            keys, cls = keys[~known], cls[~known]
        if not len(keys):
            continue
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        hubs = cls[at]
        if last_key == keys[0]:
            hubs[at == 0] = last_hub
        last_key, last_hub = keys[-1], hubs[-1]
        tie = hubs != cls
        if tie.any():
            pairs = np.unique(np.stack([cls[tie], hubs[tie]]), axis=1)
            yield batch(EDGE, pairs[0], pairs[1])


@lru_cache
def fewest_matches(size: int, threshold: float, tolerance: float) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest matches): with fewer, P(similarity >= threshold) < tolerance under a uniform prior."""
    out = []
    for n in range(STEP, size + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


FEATURE = pa.schema([("cls", pa.int64()), ("comp", pa.int64()), ("nb", pa.int32()), ("signature", pa.binary()), ("shingles", pa.binary())])


def _map_features(words: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signature = MinHash(size)
        for b in batches:
            data, offsets = utf8(b["text"])
            held, total = [], 0
            for r, hashes in shingle_sets(data, offsets, words):
                held.append((r, signature(hashes).tobytes(), hashes.tobytes()))
                total += len(hashes) * 8
                if total > 4 << 20 or r == b.num_rows - 1:
                    at = pa.array([x[0] for x in held])
                    yield batch(FEATURE, b["cls"].take(at), b["comp"].take(at), b["nb"].take(at), [x[1] for x in held], [x[2] for x in held])
                    held, total = [], 0

    return run


LINK = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _linked(cls, blocks, signatures, sets, threshold, tolerance):
    """(links, root) of each class: verified partners in this block, and the least class tied to it."""
    size = signatures.shape[1]
    fewest = fewest_matches(size, threshold, tolerance)
    flat = np.concatenate(sets)
    _, ids = np.unique(flat, return_inverse=True)
    lengths = np.array([len(s) for s in sets])
    starts = np.cumsum(lengths) - lengths
    links, parent = np.zeros(len(cls), np.int64), np.arange(len(cls))
    mark = np.zeros(ids.max(initial=-1) + 1, bool)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(cls) - 1):
        js = np.arange(i + 1, len(cls))
        if blocks is not None:
            js = js[blocks[js] != blocks[i]]
        js = js[(np.minimum(lengths[js], lengths[i]) >= threshold * np.maximum(lengths[js], lengths[i]) - 1e-9) & (lengths[js] > 0)]
        matches, done = np.zeros(len(js), np.int64), 0
        for n, least in fewest:
            matches += (signatures[js, done:n] == signatures[i, done:n]).sum(axis=1)
            alive = matches >= least
            js, matches, done = js[alive], matches[alive], n
            if not len(js):
                break
        if not len(js):
            continue
        own = ids[starts[i] : starts[i] + lengths[i]]
        mark[own] = True
        at = np.repeat(starts[js] - np.cumsum(lengths[js]) + lengths[js], lengths[js]) + np.arange(lengths[js].sum())
        shared = np.add.reduceat(mark[ids[at]].astype(np.int64), np.cumsum(lengths[js]) - lengths[js])
        mark[own] = False
        js = js[shared >= threshold * (lengths[js] + lengths[i] - shared) - 1e-9]
        links[i] += len(js)
        links[js] += 1
        for j in js.tolist():
            x, y = find(i), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return links, cls[[find(x) for x in range(len(cls))]]


def _verify(threshold: float, tolerance: float, size: int):
    """Over rows sorted by (component, i, j, class): one block of a component at a time."""

    def block(parts):
        b = pa.Table.from_batches(parts).combine_chunks()
        cls = b["cls"].to_numpy()
        cls, first = np.unique(cls, return_index=True)
        if len(cls) < 2:
            return
        signatures = np.stack([np.frombuffer(b["signature"][k].as_py(), np.uint32) for k in first.tolist()])
        sets = [np.frombuffer(b["shingles"][k].as_py(), np.uint64) for k in first.tolist()]
        i, j = b["i"][0].as_py(), b["j"][0].as_py()
        own = b["own"].to_numpy()[first] if i != j else None
        links, roots = _linked(cls, own, signatures, sets, threshold, tolerance)
        got = links > 0
        if got.any():
            yield batch(LINK, cls[got], links[got], roots[got])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for b in batches:
            keys = [b[k].to_numpy() for k in ("comp", "i", "j")]
            new = np.ones(b.num_rows, bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            cuts = [*np.flatnonzero(new).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                now = tuple(k[lo] for k in keys)
                if now != key and held:
                    yield from block(held)
                    held = []
                key = now
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from block(held)

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, bands: int = 40, rows: int = 5, tolerance: float = 1e-9
) -> DataFrame:
    """One row per row of docs: the id, class_id, n_copies and n_links (long).

    class_id is the least id among all documents tied to this one by links or by
    an equal text; n_copies counts the rows of equal text, itself included;
    n_links counts the *different* texts whose similarity with this one reaches
    `threshold`.  Rows of equal text share all three.  A null text is an empty
    one; texts without words link with nothing but count as copies of equal
    ones.  A null id stays null, and stands last when the least id of a group is
    taken.  Repeated rows are copies of each other; an empty table gives none.
    A very long text is read in slabs and has all its shingles compared; other
    columns are left out, whatever their names.
    """
    base, facts = _grouped(docs, id_col, text_col, words, threshold, bands, rows, tolerance)
    facts = facts.select("cls", "class_id", "n_copies", "n_links")
    return base.select("id", "cls").join(facts, "cls").select(F.col("id").alias(id_col), "class_id", "n_copies", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, bands: int = 40, rows: int = 5, tolerance: float = 1e-9) -> DataFrame:
    """One row of docs, with all its columns, of each group of `near_duplicates`: one of least id.

    Of several texts or rows with that id one is taken; a null id is taken only
    where a group has no other.  All other columns stay, whatever their names.
    """
    _, facts = _grouped(docs, id_col, text_col, words, threshold, bands, rows, tolerance)
    first = facts.groupBy("group").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "cls")).alias("first"))
    kept = first.select(F.coalesce("first.rep", F.lit(MISSING_ID)).alias("k"), F.col("first.cls").alias("c"))
    cls = F.xxhash64(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")))
    keyed = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), order_id(quoted(id_col)).alias("k"), cls.alias("c"))
    return keyed.join(kept, ["k", "c"]).dropDuplicates(["k", "c"]).select("row.*")


def _grouped(docs: DataFrame, id_col, text_col, words, threshold, bands, rows, tolerance) -> tuple[DataFrame, DataFrame]:
    """(id, text, cls) of docs, and cls, rep, group, class_id, n_copies, n_links of every class of equal texts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("cls", F.xxhash64("text"))
    classes = base.groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"), F.max(F.octet_length("text")).alias("bytes"))
    found = base.select("cls", "text").mapInArrow(releasing(_map_bands(words, bands, rows)), "key long, cls long, hub long")
    ties = found.repartition(n, "key").sortWithinPartitions("key", "cls").mapInArrow(releasing(_stars), "a long, b long")
    comps = components(ties).select(F.col("node").alias("cls"), F.col("label").alias("comp"))

    members = checkpointed(comps.join(classes, "cls").select("cls", "comp", "rep", "bytes"))
    blocks = members.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("bytes") * 1.5 / BLOCK_BYTES)).cast("int").alias("nb"))
    members = members.join(blocks, "comp")
    picked = members.select(F.coalesce("rep", F.lit(MISSING_ID)).alias("k"), F.col("cls").alias("c"), "comp", "nb")
    texts = base.withColumn("k", order_id("id")).join(picked, "k").where("c = cls").select("cls", "comp", "nb", "text")
    features = texts.mapInArrow(releasing(_map_features(words, bands * rows)), "cls long, comp long, nb int, signature binary, shingles binary")
    own = F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")
    dealt = features.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "signature", "shingles")
    verified = dealt.repartition(n, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "cls").mapInArrow(releasing(_verify(threshold, tolerance, bands * rows)), "cls long, links long, root long")
    verified = checkpointed(verified)
    groups = components(verified.select(F.col("cls").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cls"), F.col("label").alias("group"))
    links = verified.groupBy("cls").agg(F.sum("links").alias("n_links"))
    linked = links.join(groups, "cls").join(classes.select("cls", "rep"), "cls")
    least = linked.groupBy("group").agg(F.min("rep").alias("class_id"))
    linked = linked.join(least, "group").select("cls", "group", "class_id", "n_links")
    facts = classes.join(linked, "cls", "left").select(
        "cls", "rep", F.coalesce("group", "cls").alias("group"), F.coalesce("class_id", "rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    return base, facts
