"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a budget of words by its weight.  Whole passes over the source
are taken first; what remains of the budget is met by a subset of the documents,
chosen by exact length: of each length a proportional count, then a bounded
knapsack over the counts that are left so that the budget is met to the word
wherever the lengths allow it.  Which documents of a length are taken is decided
by a seeded hash of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm._common import checkpointed, quoted

MOST_COPIES = 3
#: Documents of one source and length that a task ranks at once.
CLASS = 20_000
REACH = 1 << 16


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def fit_budget(lengths: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many items of each (length, count) to take so that their sum comes as near to the budget from below as can be.

    A proportional share of each count is taken; the rest of the budget goes to
    longer lengths first until it is under REACH, and is then met by a bounded
    knapsack over the counts that are left, as bit sets of reachable sums.
    """
    lengths = sorted((n, c) for n, c in lengths if n > 0 and c > 0)
    total = sum(n * c for n, c in lengths)
    budget = max(0, min(budget, total))
    if not total:
        return {}
    take = {n: c * budget // total for n, c in lengths}
    left = {n: c - take[n] for n, c in lengths}
    rest = budget - sum(n * t for n, t in take.items())
    for n, _ in reversed(lengths):
        if rest <= REACH:
            break
        k = min(left[n], (rest - REACH) // n + 1, rest // n)
        take[n] += k
        left[n] -= k
        rest -= k * n
    sums, steps, mask = 1, [], (1 << (rest + 1)) - 1
    for n, _ in lengths:
        if n > rest or sums >> rest & 1:
            break
        c, size = left[n], 1
        while c > 0:
            k = min(size, c)
            before = sums
            sums |= (sums << (n * k)) & mask
            if sums != before:
                steps.append((n, k, before))
            c, size = c - k, size * 2
            if sums >> rest & 1:
                break
    best = sums.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> best & 1:
            take[n] += k
            best -= n * k
    return take


PLAN = pa.schema([("source", pa.string()), ("size", pa.int64()), ("class_count", pa.int64()), ("target", pa.float64()), ("source_size", pa.int64()), ("passes", pa.int64()), ("more", pa.int64())])
PLAN_DDL = "source string, size long, class_count long, target double, source_size long, passes long, more long"


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the length counts sorted by source: how much of each length to take."""

    def close(rows):
        target, total = rows[0]["target"], rows[0]["source_size"]
        goal = int(target + 0.5)
        passes = min(goal // total, MOST_COPIES) if total else 0
        take = fit_budget([(r["size"], r["n"]) for r in rows], goal - passes * total) if passes < MOST_COPIES else {}
        return [(r["source"], r["size"], r["n"], target, total, passes, take.get(r["size"], 0)) for r in rows]

    held = []
    for b in batches:
        for r in b.to_pylist():
            if held and held[0]["source"] != r["source"]:
                yield _rows(close(held))
                held = []
            held.append(r)
    if held:
        yield _rows(close(held))


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PLAN, strict=True)], schema=PLAN)


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """source, source_size, target of (source, source_size).

    Sources in code-point order, null last, take the weights in turn and share all
    words by them; a target stops at `most` times its source's size and what is
    over goes to the other sources by weight, until none is above.  In closed
    form: with sources ordered by cap per weight, all before some point are
    capped, and the others share what these leave.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighted = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = weighted.select(
        "*",
        ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    # the first source whose cap per weight is not below the level of those from it on sets the level for all of them
    open_ = level.select("*", F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("cap") / F.col("weight"))).over(whole).alias("edge"))
    final = open_.select("*", F.max(F.when(F.col("cap") / F.col("weight") == F.col("edge"), F.col("level"))).over(whole).alias("share"))
    return final.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce("share", F.lit(float("inf")))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), seed: int = 81, with_row: bool = False) -> DataFrame:
    """One row per row of docs: the id, source, size, source_size, target, copies, taken (with_row: also `row`, all of docs' columns).

    size is the text's number of words (null: 0); a document is taken `copies`
    times, at most three, and taken is copies x size.  Documents without words
    add nothing; they count as taken once.  The same table and seed give the same
    choice however the table is partitioned; repeated rows are separate
    documents, of which any may be the one taken.  A null source is a source, a
    null id sorts with hash zero, an empty table gives no rows.  A very long text is
    one large item; other columns, whatever their names, are only found in `row`.
    A source's distinct lengths and all sources' totals are each held by one task:
    some thousands of the first, as lengths repeat, and some millions of the
    second would still fit.
    """
    id_col_, text_col, source_col_ = map(quoted, (id_col, text_col, source_col))
    row = [F.struct(*map(quoted, docs.columns)).alias("row")] if with_row else []
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = docs.select(F.col(id_col_).cast("long").alias("id"), F.col(source_col_).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), *row)
    light = checkpointed(sized.select("id", "source", "size"))
    lengths = light.groupBy("source", "size").agg(F.count("*").alias("n"))
    wanted = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights)
    per_length = lengths.join(wanted.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "source_size", "target")
    plan = checkpointed(per_length.repartition(n, "source").sortWithinPartitions("source", "size").mapInArrow(_plan, PLAN_DDL))

    # a document's place among those of its source and length: within a range of hashes, after all ranges before
    hashed = F.xxhash64(F.coalesce("id", F.lit(0)), F.lit(seed))
    part = F.floor(F.shiftrightunsigned(hashed, 33) / float(1 << 31) * F.ceil(F.col("class_count") / CLASS)).cast("int")
    same = F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pn"))
    named = plan.withColumnsRenamed({"source": "ps", "size": "pn"})
    placed = light.join(named, same).select("id", "source", "size", hashed.alias("hash"), part.alias("part"))
    counts = placed.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    ranges = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("ps"), F.col("size").alias("pn"), F.col("part").alias("pp"), F.coalesce(F.sum("n").over(ranges), F.lit(0)).alias("before"))
    # the document at which a length's count is reached, per range that is cut: (hash, id) up to it are taken
    edge = named.where("more > 0").join(offsets.withColumnsRenamed({"ps": "os", "pn": "on"}), F.col("ps").eqNullSafe(F.col("os")) & (F.col("pn") == F.col("on")))
    keep = edge.select("ps", "pn", "pp", (F.col("more") - F.col("before")).alias("quota"))
    within = Window.partitionBy("source", "size", "part").orderBy("hash", F.col("id").asc_nulls_last())

    chosen = (sized if with_row else light).join(named, same).withColumn("hash", hashed).withColumn("part", part)
    chosen = chosen.join(keep.withColumnsRenamed({"ps": "ks", "pn": "kn"}), F.col("source").eqNullSafe(F.col("ks")) & (F.col("size") == F.col("kn")) & (F.col("part") == F.col("pp")), "left")
    chosen = chosen.withColumn("place", F.row_number().over(within))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("passes") + F.when(F.col("place") <= F.col("quota"), 1).otherwise(0)).cast("int")
    return chosen.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *(["row"] if with_row else []))
