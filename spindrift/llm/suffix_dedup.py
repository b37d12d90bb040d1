"""Suffix-array deduplication: bytes covered by a long repeated string are removed.

The repeated strings are found as a depth-limited radix sort of suffixes would
find them: suffixes are ordered by digits, most significant first, only through
`threshold` bytes, and what is still equal then is a repeated window.  A sort of
every suffix would move each byte of the corpus many times, so the digits are
chosen to let almost all suffixes leave after the first pass:

1. The suffixes (window starts) of a document that share their *anchor* - the
   `digit`-byte string of least hash within the window - form a run.  The anchor
   is a function of the window's own bytes, so equal windows always have equal
   anchors.  One row stands for a run: the first digit is the anchor, the second
   the whole string that the run's windows cover.
2. The rows are sorted by both digits.  Equal second digits: every window of the
   later run is a repeat.  An anchor in one class of runs only: nothing else can
   repeat, its suffixes leave.
3. Only where an anchor occurs within different runs do the suffixes stay for a
   third digit: the half of the window's other bytes that lies on the anchor's
   heavier side.  A window with more bytes right of its anchor contains the right
   half, any other the left one, so windows that differ in it leave.
4. What shares all three digits is ordered by its own bytes: passes of eight
   bytes, most significant first, that drop every window alone in its group, until
   `threshold` bytes are ordered; the groups then left are exactly the equal
   windows.  More than LIMIT rows of one digit are dealt out again by single windows.

The first two digits are independent 64-bit hashes of the strings they stand
for, together with which equal runs are told; digits that decide between
different runs are bytes.  A document is known by its id and a 64-bit hash of its
text, so different texts under one id, or without one, stay apart.  Each map task
first settles equal runs among its own rows, so a passage shared by a third of
all documents costs a row per task, not per copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm._common import RollingHash, batch, bounded_batches, mix, order_id, quoted, releasing, row_type, slabs, utf8, utf8_bytes, written

DIGIT = 32
SEGMENT = 2 << 20
POSITION_BITS = np.uint64(24)
FLUSH = 300_000
#: `tag` is the text's hash; `place` holds the first start and, in 20 bits, the number of starts; of a run,
#: these last are 7 bits of its anchor's distance from the first start and 7 of the number of starts.
RUN = pa.schema([("anchor", pa.int64()), ("covers", pa.int64()), ("id", pa.int64()), ("tag", pa.int64()), ("place", pa.int64()), ("known", pa.int8())])
RUN_DDL = "anchor long, covers long, id long, tag long, place long, known byte"
MOST = (1 << 20) - 1
#: Rows of one half-window digit that a task takes at once.
LIMIT = 10_000


def _place(start, count):
    return (start.astype(np.int64) << 20) | count.astype(np.int64)


def _unplace(place):
    return place >> 20, place & MOST


def _segments(data, offsets, threshold):
    """Slabs of (bytes, row, start in the row, window starts that are valid)."""
    for i, j in slabs(offsets, 1 << 19):
        length = offsets[j] - offsets[i]
        if length < threshold:
            continue
        step = SEGMENT if j == i + 1 else max(length, 1)
        for at in range(0, max(int(length) - threshold + 1, 1), int(step)):
            part = data[offsets[i] + at : min(offsets[i] + at + step + threshold - 1, offsets[j])]
            bounds = offsets[i : j + 1] - offsets[i] - at
            row = np.repeat(np.arange(i, j), np.diff(np.clip(bounds, 0, len(part))))
            ends = np.clip(bounds[1:], 0, len(part))[row - i]
            starts = (offsets[i:j] - offsets[i] - at)[row - i]
            yield part, row, starts, ends


def _sliding_minimum(x, width):
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def _runs(data, offsets, threshold, digit, first: RollingHash, second: RollingHash):
    """(anchor, covers, row, start in the row, anchor's distance << 7 | number of starts) of every run."""
    width = threshold - digit + 1
    for part, row, starts, ends in _segments(data, offsets, threshold):
        n = len(part) - threshold + 1
        if n <= 0:
            continue
        grams = mix(first.every(first.prefix(part), digit))
        low = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
        least = _sliding_minimum((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width)
        at = np.flatnonzero(np.arange(n) + threshold <= ends[:n])
        if not len(at):
            continue
        anchor = (least[at] & low).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(at)) - 1
        covers = mix(second.between(second.prefix(part), at[lo], at[hi] + threshold))
        yield grams[anchor[lo]].view(np.int64), covers.view(np.int64), row[at[lo]], at[lo] - starts[at[lo]], ((anchor[lo] - at[lo]) << 7) | (at[hi] - at[lo] + 1)


def _settled(anchor, covers, id_, start, tag, count):
    """Rows to sort on; of runs that cover equal strings, all but the first are known repeats, joined where they touch."""
    order = np.lexsort((start, tag, id_, covers))
    a, c, i, s, t, n = (x[order] for x in (anchor, covers, id_, start, tag, count))
    later = np.zeros(len(a), bool)
    later[1:] = (c[1:] == c[:-1]) & (a[1:] == a[:-1])
    same = np.zeros(len(a), bool)  # a repeated row of the table: the same place, which is not earlier than itself
    same[1:] = later[1:] & (i[1:] == i[:-1]) & (s[1:] == s[:-1]) & (t[1:] == t[:-1])
    if same.any():
        first = np.maximum.accumulate(np.where(~later, np.arange(len(a)), 0))
        later &= ~((i == i[first]) & (s == s[first]) & (t == t[first]))
    keep = ~later & ~same
    yield a[keep], c[keep], i[keep], t[keep], _place(s[keep], n[keep]), np.zeros(keep.sum(), np.int8)
    if later.any():
        yield _known(i[later], t[later], s[later], n[later] & 127)


def _known(i, t, s, n):
    """Rows of starts that are repeats, joined where they touch; their first digit only spreads them."""
    order = np.lexsort((s, t, i))
    i, s, t, e = i[order], s[order], t[order], (s + n)[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (s[1:] > e[:-1])
    lo = np.flatnonzero(new)
    s, n, i, t = s[lo], np.maximum.reduceat(e, lo) - s[lo], i[lo], t[lo]
    parts = -(-n // MOST)
    if (parts > 1).any():
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        s, n, i, t = np.repeat(s, parts) + k * MOST, np.minimum(np.repeat(n, parts) - k * MOST, MOST), np.repeat(i, parts), np.repeat(t, parts)
    return mix(t.view(np.uint64) + s.astype(np.uint64)).view(np.int64), np.zeros(len(i), np.int64), i, t, _place(s, n), np.ones(len(i), np.int8)


def _map_runs(threshold: int, digit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = RollingHash(11), RollingHash(12)
        held, size = [], 0

        def flush():
            for cols in _settled(*(np.concatenate(x) for x in zip(*held, strict=True))):
                for k in range(0, len(cols[0]), 100_000):
                    yield batch(RUN, *(c[k : k + 100_000] for c in cols))

        for b in batches:
            ids, tags = b["id"].to_numpy(), b["tag"].to_numpy()
            data, offsets = utf8(b["text"])
            for anchor, covers, row, start, count in _runs(data, offsets, threshold, digit, first, second):
                held.append((anchor, covers, ids[row], start, tags[row], count))
                size += len(row)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, covers, id, tag, place): repeats (known 1), and the first of each class where an anchor has several (known 0)."""
    prev = None  # last row of the batch before: anchor, covers
    first = None  # id, tag and place of the class's first row
    lead = None  # the anchor's first class, as long as it is its only one
    for b in batches:
        known = b["known"].to_numpy()
        if known.any():
            keep = pa.array(known == 1)
            yield b.filter(keep)
            b = b.filter(pa.array(known == 0))
        if not b.num_rows:
            continue
        a, c, *own = (b[k].to_numpy() for k in ("anchor", "covers", "id", "tag", "place"))
        n = len(a)
        new_anchor, new_class = np.ones(n, bool), np.ones(n, bool)
        new_anchor[1:] = a[1:] != a[:-1]
        new_class[1:] = new_anchor[1:] | (c[1:] != c[:-1])
        if prev is not None and prev[0] == a[0]:
            new_anchor[0] = False
            new_class[0] = prev[1] != c[0]
        at = np.maximum.accumulate(np.where(new_class, np.arange(n), -1))
        of = [np.where(at >= 0, x[at], first[k] if first else 0) for k, x in enumerate(own)]
        again = ~new_class & np.any([x != y for x, y in zip(own, of, strict=True)], axis=0)
        if again.any():
            i, t, p = (x[again] for x in own)
            yield batch(RUN, a[again], c[again], i, t, p & ~MOST | p & 127, np.ones(len(i), np.int8))
        heads = np.flatnonzero(new_class)
        if len(heads):
            group = np.cumsum(new_anchor)[heads]  # 0: the anchor that the batch before ended with
            starts = np.ones(len(heads), bool)
            starts[1:] = group[1:] != group[:-1]
            several = np.zeros(len(heads), bool)
            several[1:] |= ~starts[1:]
            several[:-1] |= ~starts[1:]
            if group[0] == 0:
                several[group == 0] = True
                if lead is not None:
                    yield batch(RUN, *([x] for x in lead), np.zeros(1, np.int8))
                lead = None
            if several.any():
                h = heads[several]
                yield batch(RUN, a[h], c[h], *(x[h] for x in own), np.zeros(len(h), np.int8))
            if group[-1] != 0 or new_anchor.any():
                last = heads[-1]
                if starts[-1] and not several[-1]:
                    lead = (a[last], c[last], *(x[last] for x in own))
                elif new_anchor.any():
                    lead = None
        prev, first = (a[-1], c[-1]), [x[-1] for x in of]


CONTEXT = pa.schema([("half", pa.int64()), ("id", pa.int64()), ("tag", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])
CONTEXT_DDL = "half long, id long, tag long, place long, bytes binary"
PACKED = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("packed", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, compressed for the shuffle."""
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        data, offsets = utf8(b["text"])
        yield batch(PACKED, b["id"], b["tag"], [press.compress(data[offsets[r] : offsets[r + 1]].tobytes()) for r in range(b.num_rows)])


def _map_contexts(threshold: int, digit: int):
    """Of every run, the windows that contain the anchor's right half and those that contain its left half."""
    right = (threshold - digit) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, press = RollingHash(21), zstandard.ZstdDecompressor()
        for b in batches:
            ids, tags, packed, places = b["id"].to_numpy(), b["tag"].to_numpy(), b["packed"], b["places"]
            bounds, flat = places.offsets.to_numpy(), places.values.to_numpy()
            for r in range(b.num_rows):
                text = press.decompress(packed[r].as_py())
                start, n = _unplace(flat[bounds[r] : bounds[r + 1]])
                anchor, last = start + (n >> 7), start + (n & 127) - 1
                whole = np.frombuffer(text, np.uint8)
                out = []
                for lo, hi, a, e, salt in (
                    (np.maximum(start, anchor - right), last, anchor, anchor + threshold - right, 0),
                    (start, np.minimum(last, anchor - right - 1), anchor - right - 1 + threshold - digit - 2 * right, anchor + digit, 1),
                ):
                    got = np.flatnonzero(lo <= hi)
                    if not len(got):
                        continue
                    lo, hi, a, e = lo[got], hi[got], a[got], e[got]
                    base = int(a.min())
                    part = whole[base : int(e.max())]
                    half = _hash_parts(first, part, a - base, e - base) ^ np.uint64(salt)
                    out.append((half.view(np.int64), _place(lo, hi - lo + 1), [text[x:y] for x, y in zip(lo.tolist(), (hi + threshold).tolist(), strict=True)]))
                if out:
                    half, place, held = (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), sum((x[2] for x in out), []))
                    yield batch(CONTEXT, half, np.full(len(half), ids[r]), np.full(len(half), tags[r]), place, held)

    return run


def _hash_parts(h: RollingHash, data, start, end):
    """Hashes of data[start:end], taken over stretches of bounded memory."""
    out = np.zeros(len(start), np.uint64)
    order = np.argsort(start, kind="stable")
    at = 0
    while at < len(order):
        base = start[order[at]]
        stop = max(at + 1, int(np.searchsorted(start[order], base + SEGMENT)))
        k = order[at:stop]
        part = data[base : int(end[k].max())]
        out[k] = mix(h.between(h.prefix(part), start[k] - base, end[k] - base))
        at = stop
    return out


def _windows(held):
    """The contexts' bytes end to end, and of each window where it is there, its id, tag and start."""
    b = pa.Table.from_batches(held).combine_chunks()
    data, offsets = utf8_bytes(b["bytes"])
    start, n = _unplace(b["place"].to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return data, offsets[row] + k, b["id"].to_numpy()[row], b["tag"].to_numpy()[row], start[row] + k


def radix_groups(data: np.ndarray, at: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, group) of those of the `threshold`-byte windows of data at `at` that have an equal one, in the windows' order.

    Passes of eight bytes, most significant first; after each one the windows
    that are alone in their group leave.
    """
    alive, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for depth in range(0, threshold, 8):
        digit = np.zeros((len(alive), 8), np.uint8)
        width = min(8, threshold - depth)
        digit[:, :width] = data[at[alive][:, None] + np.arange(depth, depth + width)]
        digit = digit.view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((digit, group))
        digit, group = digit[order], group[order]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        several = ~new
        several[:-1] |= ~new[1:]
        alive, group = alive[order][several], (np.cumsum(new) - 1)[several]
        if not len(alive):
            break
    return alive, group


def _map_windows(threshold: int):
    """Each window of each context, settled within the task as far as may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = RollingHash(21), RollingHash(22)
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                data, at, ids, tags, start = _windows([b.slice(k, 2048)])
                h1, h2 = (mix(h.between(h.prefix(data), at, at + threshold)).view(np.int64) for h in (first, second))
                for cols in _settled(h1, h2, ids, start, tags, np.ones(len(at), np.int64)):
                    yield batch(RUN, *cols)

    return run


def _resolve(threshold: int):
    """Over contexts sorted by half: the windows that also start earlier."""

    def done(held):
        data, at, ids, tags, start = _windows(held)
        alive, group = radix_groups(data, at, threshold)
        if not len(alive):
            return
        i, t, s = ids[alive], tags[alive], start[alive]
        order = np.lexsort((s, t, i, group))
        i, t, s, group = i[order], t[order], s[order], group[order]
        first = np.searchsorted(group, group)
        later = (i != i[first]) | (t != t[first]) | (s != s[first])
        if later.any():
            yield batch(RUN, *_known(i[later], t[later], s[later], np.ones(later.sum(), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, None
        for b in batches:
            half = b["half"].to_numpy()
            new = np.ones(len(half), bool)
            new[1:] = half[1:] != half[:-1]
            new[0] = half[0] != last
            alone = new & np.append(new[1:], False)
            alone[0] = False  # it may go on from the batch before
            cuts = np.flatnonzero(new)
            if rows >= 4096 and len(cuts):
                yield from done([*held, b.slice(0, cuts[0])])
                held, rows = [], 0
                b, alone = b.slice(cuts[0]), alone[cuts[0] :]
            held.append(b.filter(pa.array(~alone)))
            rows += held[-1].num_rows
            last = half[-1]
        if held:
            yield from done(held)

    return run


def repeated_starts(docs: DataFrame, threshold: int = 100, digit: int = DIGIT) -> DataFrame:
    """(id, tag, start, count): the `count` starts from `start` on whose `threshold`-byte strings also start earlier.

    docs has id (long), tag (a hash of the text, which tells texts of one id apart) and text.
    """
    digit = min(digit, max(1, threshold // 3))
    if not 0 <= threshold - digit < 127:
        raise ValueError("threshold must be under 159 bytes")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def settled(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "anchor").sortWithinPartitions("anchor", "covers", "id", "tag", "place").mapInArrow(releasing(_sorted_runs), RUN_DDL)

    found = written(settled(docs.mapInArrow(releasing(_map_runs(threshold, digit)), RUN_DDL)), "runs")
    open_ = found.where("known = 0").groupBy("id", "tag").agg(F.collect_list("place").alias("places"))
    packed = docs.mapInArrow(releasing(_pack), "id long, tag long, packed binary")
    contexts = packed.join(open_, ["id", "tag"]).select("id", "tag", "packed", "places").mapInArrow(releasing(_map_contexts(threshold, digit)), CONTEXT_DDL)
    contexts = written(contexts, "contexts")
    # written, so that the join knows the size of the keys that are too frequent for one task
    hot = written(contexts.groupBy("half").count().where(F.col("count") > LIMIT).select("half"), "hot")
    parts = [found.where("known = 1")]
    if hot.isEmpty():
        rest = contexts
    else:
        rest = contexts.join(hot, "half", "left_anti")
        parts.append(settled(contexts.join(hot, "half", "left_semi").mapInArrow(releasing(_map_windows(threshold)), RUN_DDL)).where("known = 1"))
    parts.append(rest.repartition(n, "half").sortWithinPartitions("half").mapInArrow(releasing(_resolve(threshold)), RUN_DDL))
    return reduce(DataFrame.unionByName, parts).select("id", "tag", F.expr("cast(shiftright(place, 20) as int)").alias("start"), F.expr("cast(place & 1048575 as int)").alias("count"))


def _removed(starts, counts, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order].astype(np.int64), np.maximum.accumulate((starts + counts)[order].astype(np.int64) + threshold - 1)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    return s[new], np.append(e[np.flatnonzero(new)[1:] - 1], e[-1:])


def _without(text: bytes, lo, hi) -> bytes:
    kept, at = [], 0
    for x, y in zip(lo, hi, strict=True):
        kept.append(text[at:x])
        at = max(at, y)
    kept.append(text[at:])
    return b"".join(kept)


def _whole_characters(text: bytes, lo: list[int], hi: list[int]) -> str:
    """The text without the runs, widened to the borders of the characters that they cut."""
    inside = lambda k: k < len(text) and text[k] & 0xC0 == 0x80
    lo = [next(k for k in range(x, -1, -1) if not inside(k)) for x in lo]
    hi = [next(k for k in range(y, len(text) + 1) if not inside(k)) for y in hi]
    return _without(text, lo, hi).decode()


def remove_repeats(docs: DataFrame, threshold: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: str | None = "bytes") -> DataFrame:
    """All columns of docs but the text, then n_bytes, n_removed, n_spans, kept_sha256 and, as `keep` says, the bytes or the text that is left as kept.


    A byte goes if a string of `threshold` bytes that covers it also starts
    earlier: in a document of smaller id, or before in the same one; all strings
    are judged on the input.  A null text counts as empty and a null id as the
    smallest; texts under `threshold` bytes are untouched.  Two rows that agree
    in id and text are one document to this order: neither is earlier, both come
    out alike.  Of different texts under one id, or without one, that of the
    lesser 64-bit hash (as a signed number) is earlier.  A very long text is read
    in segments.  Kept as text, a character that loses any of its bytes goes
    whole; the four figures are those of the bytes either way.  Clashing column
    names do not matter: the result's five columns replace any of the same name.
    An empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    out = ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", f"kept {'string' if keep == 'text' else 'binary'}"]
    names = [x.split()[0] for x in out]
    rest = [c for c in docs.columns if c not in (*names, text_col)]
    text = F.col(quoted(text_col)).cast("string")
    key = [order_id(quoted(id_col)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"), text.alias("text")]
    spans = repeated_starts(docs.select(*key), threshold).groupBy("id", "tag").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    row_ddl = f"row {row_type(docs, rest)}"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data, offsets = utf8(b["text"])
            texts = pa.array([press.compress(data[offsets[r] : offsets[r + 1]].tobytes()) for r in range(b.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([b["row"], b["id"], b["tag"], texts], names=["row", "id", "tag", "packed"])

    keyed = docs.select(F.struct(*map(quoted, rest)).alias("row"), *key).mapInArrow(releasing(pack), f"{row_ddl}, id long, tag long, packed binary")
    keyed = keyed.join(spans, ["id", "tag"], "left").select("row", "packed", "spans")
    ddl = f"{row_ddl}, " + ", ".join(out if keep else out[:-1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            packed, spans = b["packed"], b["spans"]
            bounds = spans.offsets.to_numpy()
            starts, counts = (spans.values.field(k).to_numpy() for k in (0, 1))
            got = []
            for r in range(b.num_rows):
                lo, hi = bounds[r], bounds[r + 1]
                text = press.decompress(packed[r].as_py())
                runs = [x.tolist() for x in _removed(starts[lo:hi], counts[lo:hi], threshold)]
                kept = _without(text, *runs)
                got.append((len(text), len(text) - len(kept), len(runs[0]), hashlib.sha256(kept).hexdigest(), _whole_characters(text, *runs) if keep == "text" else kept if keep else None))
            cols = list(zip(*got, strict=True)) or [()] * 5
            arrays = [b["row"], *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if keep == "text" else pa.binary()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays if keep else arrays[:-1], names=["row", *names] if keep else ["row", *names[:-1]])

    done = keyed.mapInArrow(releasing(cut), ddl)
    return done.select("row.*", *[n for n in names if keep or n != "kept"])
