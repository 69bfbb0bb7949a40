"""Exact removal of repeated byte strings by suffix order, common prefixes and previous factors.

A byte is removed if a string of ``min_bytes`` that covers it starts elsewhere too.

1. Pieces.  Every window of ``min_bytes`` belongs to its anchor: the first of its GRAM-byte
   strings of least hash.  The choice depends on the window's bytes alone, so equal windows
   have equal anchors at the same offset.  The windows of one anchor follow each other; the
   text they cover is a piece.
2. Equal pieces repeat as a whole and are found by hash, first within a batch of texts, then
   over all.  One of them stands for the others, and its bytes are needed only if the anchor
   has other pieces too.
3. Suffix order.  Those pieces are dealt out by their anchor's hash.  A task puts the suffixes
   that start at the anchors in order, and the mirrored bytes before them, each with the common
   prefixes of neighbours.  Windows at one offset agree if they lie in the same interval of
   common prefixes in both orders.  Ordered by place, the one before a window is its previous
   smaller position and the one behind its next larger: its longest previous (or next) factor
   reaches ``min_bytes`` exactly if there is one.
4. Anchors that very many different pieces share don't go to one task: their pieces are cut
   into strips, equal strips are counted with partial sums, and only strips that differ
   around an equal core are resolved window by window, again by counting.

The texts are dealt out once, by document: pieces are cut from them and spans are cut out of
them in one plan, which reuses that exchange.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import materialise
from pagemill.llm.minhash import U, _mix

MIN_BYTES = 200
GRAM = 64
#: Different pieces of one anchor that a task sorts at most; anchors with more are counted by strips.
BLOCK_ROWS = 65536
#: Pieces that are sorted together, if one anchor has no more.
SORT_ROWS = 8192
#: Windows per strip.
STRIP = 17

PIECE = "h long, c long, doc long, k long, p long, q int"
CONTEXT = "h long, doc long, k long, a long, left int, ctx binary, end long, whole boolean"
SPAN_ROW = "doc long, k long, start long, end long, whole boolean"


# -- pieces -----------------------------------------------------------------
@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


_BASE = 0x5851F42D4C957F2D  # odd, so powers have inverses modulo 2^64
_POWERS = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, dtype=U)
            factors[0] = 1
            _POWERS[i] = np.cumprod(factors, dtype=U)
    return _POWERS[0][:n], _POWERS[1][:n]


def window_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` bytes."""
    n = len(raw)
    up, down = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(_letters()[raw] * up[:n], dtype=U)])
    return _mix((sums[size:] - sums[:n - size + 1]) * down[:n - size + 1])


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` over all windows of ``size`` values."""
    done = 1
    while done * 2 <= size:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[:len(x) - (size - done)], x[size - done:]) if size > done else x


def pieces(raw: np.ndarray, min_bytes: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of a text, in order: hash and place of the anchor, its first and its last window."""
    if len(raw) < min_bytes:
        return (np.zeros(0, np.int64),) * 4
    h = window_hashes(raw, GRAM)
    span = min_bytes - GRAM + 1
    least = _sliding(h, span, np.minimum)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    grams = np.lib.stride_tricks.sliding_window_view(h, span)
    at = first + np.concatenate([grams[first[i:i + 4096]].argmin(axis=1) for i in range(0, len(first), 4096)])
    # Grams of equal hash: the next one has the windows behind the one before.
    tied = np.flatnonzero(at < last)
    if len(tied):
        parts = [(first[at >= last], at[at >= last], last[at >= last])]
        for r in tied:
            same = at[r] + np.flatnonzero(h[at[r]:last[r] + span] == least[first[r]])
            start = np.append(first[r], same[:-1] + 1)
            same, start = same[start <= last[r]], start[start <= last[r]]
            parts.append((start, same, np.minimum(same, last[r])))
        first, at, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(first)
        first, at, last = first[order], at[order], last[order]
    return h[at].astype(np.int64), at, first, last


def _bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of texts, null as empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans united with those that they touch, by row."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    _, number = np.unique(row, return_inverse=True)
    far = np.int64(end.max(initial=0) + 1)  # moves the spans of each row behind those of the row before
    reach = np.maximum.accumulate(end + number * far) if len(end) else end
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] + number[1:] * far > reach[:-1])
    begin = np.flatnonzero(new)
    return row[begin], start[begin], (reach - number * far)[np.append(begin[1:], len(row)) - 1] if len(row) else end


def _piece_rows(keyed: DataFrame, min_bytes: int, first: bool) -> DataFrame:
    """PIECE rows: hash of the anchor and of the whole piece, the text, the first window and, in q, bytes
    before the anchor and windows behind the first.  Of pieces that are equal within a batch one is left
    (the first by place); the bytes they cover come as spans: q is minus their length, h only spreads them."""
    base = min_bytes - GRAM + 1

    def run(batches):
        for b in batches:
            found = [[] for _ in range(5)]
            cs: list[int] = []
            for i, raw in enumerate(_bytes(b.column(2))):
                h, at, lo, hi = pieces(np.frombuffer(raw, dtype=np.uint8), min_bytes)
                left = at - lo
                cs += [xxhash.xxh3_64_intdigest(raw[s:e], x) for s, e, x in zip(lo.tolist(), (hi + min_bytes).tolist(), left.tolist(), strict=True)]
                for col, x in zip(found, (np.full(len(h), i), h, lo, left, hi - lo), strict=True):
                    col.append(x)
            t, h, p, left, width = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in found)
            doc, k = (np.asarray(b.column(i), dtype=np.int64)[t] for i in range(2))
            c = np.array(cs, dtype=U).view(np.int64)
            order = np.lexsort((p, k, doc, c, h) if first else (c, h))
            t, h, c, doc, k, p, left, width = (x[order] for x in (t, h, c, doc, k, p, left, width))
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            if first:  # rows of one document are one place
                group = np.cumsum(new) - 1
                head = np.flatnonzero(new)[group]
                known = ~new & ((doc != doc[head]) | (k != k[head]) | (p != p[head]))
            else:
                known = ~new
                known[:-1] |= ~new[1:]
            row, start, end = _merged(t[known], p[known], (p + width + min_bytes)[known])
            row_doc, row_k = (np.asarray(b.column(i), dtype=np.int64)[row] for i in range(2))
            spread = _mix(_mix(row_doc.astype(U)) ^ row_k.astype(U) ^ start.astype(U)).view(np.int64)
            columns = ((h[new], spread), (c[new], np.zeros(len(row), np.int64)), (doc[new], row_doc), (k[new], row_k), (p[new], start),
                       ((left * base + width)[new], start - end))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(kind)) for x, kind in zip(columns, [np.int64] * 5 + [np.int32], strict=True)],
                                             names=["h", "c", "doc", "k", "p", "q"])
    return keyed.select("doc", "k", "text").mapInArrow(run, PIECE)


def _places(found: DataFrame, first: bool) -> DataFrame:
    """(doc, k, places, most): pieces of each text that repeat (dup), and those whose bytes are compared
    with n - 1 others of the same anchor; ``most`` is the greatest n."""
    anchor, equal = Window.partitionBy("h"), Window.partitionBy("h", "c")
    by_place = equal.orderBy("doc", "k", "p")
    rows = found.withColumn("n", F.count(F.lit(1)).over(anchor)).where("n > 1 OR q < 0")
    rows = rows.withColumn("one", F.row_number().over(by_place) == 1)
    rows = rows.withColumn("dup", (F.rank().over(by_place) if first else F.count(F.lit(1)).over(equal)) > 1)
    rows = rows.withColumn("kinds", F.sum(F.col("one").cast("long")).over(anchor))
    rows = rows.withColumn("n", F.when(F.col("one") & (F.col("kinds") > 1) & (F.col("q") >= 0), F.col("kinds")).otherwise(F.lit(0)))
    rows = rows.withColumn("dup", F.col("dup") | (F.col("q") < 0)).where("dup OR n > 0")
    place = F.struct(F.when(F.col("n") > 0, F.col("h")).otherwise(F.lit(0)).alias("h"), "p", "q", "n", "dup")
    return rows.groupBy("doc", "k").agg(F.collect_list(place).alias("places"), F.max("n").alias("most"))


def _contexts(placed: DataFrame, min_bytes: int, least: int, most: int | None, spans: bool) -> DataFrame:
    """CONTEXT rows of texts with their places: the bytes of pieces that are one of more than ``least`` and
    at most ``most``; with ``spans`` also the spans that are known to repeat, from a to end, without bytes."""
    base = min_bytes - GRAM + 1

    def run(batches):
        for b in batches:
            raws = _bytes(b.column(2))
            lists = b.column(3)
            row = np.repeat(np.arange(len(raws)), np.asarray(lists.value_lengths()))
            h, p, q, n, dup = (np.asarray(lists.flatten().field(i)) for i in range(5))
            doc, k = (np.asarray(b.column(i), dtype=np.int64) for i in range(2))
            q = q.astype(np.int64)
            end = p + np.where(q < 0, -q, q % base + min_bytes)
            pick = n > least if most is None else (n > least) & (n <= most)
            at, start = row[pick], p[pick]
            ctx = [raws[r][s:e] for r, s, e in zip(at.tolist(), start.tolist(), end[pick].tolist(), strict=True)]
            left = q[pick] // base
            known = dup if spans else np.zeros(len(dup), dtype=bool)
            r2, s2, e2 = _merged(row[known], p[known], end[known])
            whole = (s2 == 0) & (e2 == np.array([len(x) for x in raws], dtype=np.int64)[r2])
            spread = _mix(_mix(doc[r2].astype(U)) ^ k[r2].astype(U) ^ s2.astype(U)).view(np.int64)
            none = np.zeros(len(at), np.int64)
            columns = ((h[pick], spread), (doc[at], doc[r2]), (k[at], k[r2]), (start + left, s2), (left, np.zeros(len(r2), np.int64)))
            arrays = [pa.array(np.concatenate(x).astype(np.int64)) for x in columns]
            arrays[4] = arrays[4].cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([*ctx, *[None] * len(r2)], pa.binary()), pa.array(np.concatenate([none, e2]).astype(np.int64)),
                                              pa.array(np.concatenate([none > 0, whole]))],
                                             names=["h", "doc", "k", "a", "left", "ctx", "end", "whole"])
    return placed.select("doc", "k", "text", "places").mapInArrow(run, CONTEXT)


def _spans(doc, k, start, end, whole) -> pa.RecordBatch:
    arrays = [pa.array(np.asarray(c, dtype=np.int64)) for c in (doc, k, start, end)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(np.asarray(whole, dtype=bool))], names=["doc", "k", "start", "end", "whole"])


# -- suffix order of a block --------------------------------------------------
def suffix_order(group: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of every row of ``block`` in the order of (group, bytes), and for every place the length of
    the prefix it has in common with the row before (-1: another group)."""
    rows, width = block.shape
    keyed = np.empty((rows, width + 8), dtype=np.uint8)
    keyed[:, :8] = group.astype(">u8").view(np.uint8).reshape(rows, 8)
    keyed[:, 8:] = block
    order = np.argsort(keyed.view(f"S{width + 8}").reshape(-1), kind="stable")
    ranked = keyed[order]
    common = np.full(rows, -1, dtype=np.int64)
    differ = ranked[1:] != ranked[:-1]
    until = np.where(differ.any(axis=1), differ.argmax(axis=1), width + 8)
    common[1:] = np.where(until < 8, -1, until - 8)
    place = np.empty(rows, dtype=np.int64)
    place[order] = np.arange(rows)
    return place, common


def repeated_windows(h: np.ndarray, left: np.ndarray, sizes: np.ndarray, flat: np.ndarray, min_bytes: int, first: bool):
    """Runs of repeated windows in pieces sorted by (anchor, place), their bytes one after the other in ``flat``:
    (row, first, last), windows counted by how many bytes before their anchor they start, as negative numbers.

    With ``first`` a window counts only if it occurs earlier, else if it occurs anywhere else.
    """
    rows, span = len(h), min_bytes - GRAM
    group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
    row = np.repeat(np.arange(rows), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes + left, sizes)
    behind, before = np.zeros((rows, min_bytes), dtype=np.uint8), np.zeros((rows, span), dtype=np.uint8)
    right = col >= 0
    behind[row[right], col[right]] = flat[right]
    before[row[~right], -1 - col[~right]] = flat[~right]
    del row, col, right
    (place, common), (mirrored, mirrored_common) = suffix_order(group, behind), suffix_order(group, before)
    width = sizes - min_bytes
    open_at, was, out = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=bool), []
    for j in range(span, -2, -1):  # windows that start j bytes before their anchor
        hit = np.zeros(rows, dtype=bool)
        own = np.flatnonzero((left >= j) & (left - width <= j)) if j >= 0 else np.zeros(0, np.int64)
        if len(own) > 1:
            # Intervals of common prefixes: min_bytes - j from the anchor on, j before it.
            key = np.cumsum(common < min_bytes - j)[place[own]] * (rows + 1) + np.cumsum(mirrored_common < j)[mirrored[own]]
            order = np.argsort(key, kind="stable")  # equal ones stay in place order
            same = key[order[1:]] == key[order[:-1]]
            previous = np.concatenate([[False], same])  # longest previous factor reaches min_bytes
            hit[own[order[previous if first else previous | np.concatenate([same, [False]])]]] = True
        over = np.flatnonzero(was & ~hit)
        out.append((over, -open_at[over], np.full(len(over), -j - 1)))
        open_at[hit & ~was] = j
        was = hit
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sorted_blocks(min_bytes: int, first: bool):
    """Spans of repeated windows from contexts sorted by h; known spans pass."""
    def flush(parts):
        t = pa.Table.from_batches(parts)
        t = t.take(pa.array(np.lexsort([t.column(i).to_numpy() for i in (3, 2, 1, 0)])))
        ids = [t.column(i).to_numpy() for i in range(4)]
        again = np.zeros(len(t), dtype=bool)  # rows of one document are one place
        again[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in ids])
        if again.any():
            t = t.filter(pa.array(~again))
        h, doc, k, a, left = (t.column(i).to_numpy().astype(np.int64) for i in range(5))
        ctx = pa.concat_arrays(t.column(5).cast(pa.large_binary()).chunks)
        cuts = np.frombuffer(ctx.buffers()[1], dtype=np.int64)[ctx.offset:ctx.offset + len(ctx) + 1]
        flat = np.frombuffer(ctx.buffers()[2], dtype=np.uint8)[cuts[0]:cuts[-1]]
        row, lo, hi = repeated_windows(h, left, np.diff(cuts), flat, min_bytes, first)
        return _spans(doc[row], k[row], a[row] + lo, a[row] + hi + min_bytes, np.zeros(len(row), dtype=bool))

    def run(batches):
        held, n, last = [], 0, None
        for b in batches:
            known = b.filter(b.column(5).is_null())
            if known.num_rows:
                yield _spans(*(known.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 6, 7)))
            b = b.filter(b.column(5).is_valid()).select(range(6))
            if not b.num_rows:
                continue
            h, at = b.column(0).to_numpy(), 0
            starts = np.flatnonzero(np.concatenate([[last is not None and h[0] != last], h[1:] != h[:-1]]))
            for start in starts.tolist():
                if n + start - at >= SORT_ROWS:
                    yield flush([*held, b.slice(at, start - at)])
                    held, n, at = [], 0, start
            held.append(b.slice(at))
            n, last = n + len(h) - at, h[-1]
        if n:
            yield flush(held)
    return run


# -- strips of very frequent anchors -------------------------------------------
def _strips(min_bytes: int):
    """(core, full, doc, k, p, windows): strips of up to STRIP windows, by hashes of what all their
    windows share and of all their bytes, with the hash of every window."""
    span = min_bytes - GRAM

    def run(batches):
        for b in batches:
            out = []
            for _, doc, k, a, left, ctx in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if len(ctx) < min_bytes:
                    continue
                hashes = window_hashes(np.frombuffer(ctx, dtype=np.uint8), min_bytes)
                # Strips lie on a grid by offset to the anchor, so equal windows fall into equal strips.
                at = np.arange(len(hashes)) + span - left
                for s in range(at[0] // STRIP, at[-1] // STRIP + 1):
                    lo, hi = max(s * STRIP, at[0]) - at[0], min((s + 1) * STRIP - 1, at[-1]) - at[0]
                    grid = s * STRIP - at[0]  # where a full strip starts, maybe before the text
                    core = ctx[grid + STRIP - 1:grid + min_bytes]
                    out.append((xxhash.xxh3_128_digest(b"%d:" % s + core),
                                xxhash.xxh3_128_digest(b"%d:%d:" % (s, lo - grid) + ctx[lo:hi + min_bytes]), doc, k, a - left + lo,
                                s * STRIP + lo - grid, hashes[lo:hi + 1].astype(np.int64)))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)],
                                             names=["core", "full", "doc", "k", "p", "at", "windows"])
    return run


def _hot_spans(contexts: DataFrame, min_bytes: int, first: bool) -> DataFrame:
    """Spans of repeated windows around anchors that many places share."""
    strips = contexts.select("h", "doc", "k", "a", "left", "ctx").mapInArrow(
        _strips(min_bytes), "core binary, full binary, doc long, k long, p long, at long, windows array<long>")
    strips = materialise(strips, "strips")
    place = F.struct("doc", "k", "p")
    fulls = materialise(strips.groupBy("core", "full").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one")), "full_strips")
    whole = strips.join(fulls.where("n > 1"), ["core", "full"])
    if first:
        whole = whole.where(place != F.col("one"))
    whole = whole.select("doc", "k", F.col("p").alias("start"), (F.col("p") + F.size("windows") - 1 + min_bytes).alias("end"))
    # One strip of each kind is compared window by window, if its core occurs in another kind too.
    several = fulls.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    ones = strips.join(fulls, ["core", "full"]).where(place == F.col("one")).join(several, "core")
    windows = ones.select("core", "doc", "k", "p", "at", F.posexplode("windows").alias("i", "w"))
    windows = windows.select("core", "doc", "k", (F.col("p") + F.col("i")).alias("p"), (F.col("at") + F.col("i")).alias("at"), "w")
    counted = windows.groupBy("core", "at", "w").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one")).where("n > 1")
    single = windows.join(counted, ["core", "at", "w"])
    if first:
        single = single.where(place != F.col("one"))
    return whole.unionByName(single.select("doc", "k", F.col("p").alias("start"), (F.col("p") + min_bytes).alias("end"))).withColumn("whole", F.lit(False))


# -- the whole ----------------------------------------------------------------
def _keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc, k, text): k tells rows apart that repeat a doc_id with another text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), text.alias("text")).withColumn("k", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, keep: str = "none", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc, k, spans, whole) of the texts that lose bytes: spans [start, end) may overlap;
    of ``whole`` texts one span is known to cover all."""
    if min_bytes < GRAM + 8 or keep not in ("none", "first"):
        raise ValueError(f"min_bytes must be {GRAM + 8} or more and keep none or first")
    first = keep == "first"
    keyed = _keyed(docs)
    places = materialise(_places(_piece_rows(keyed, min_bytes, first), first), "places")
    placed = keyed.join(places.select("doc", "k", "places"), ["doc", "k"])
    spans = (_contexts(placed, min_bytes, 0, block_rows, True).repartition("h").sortWithinPartitions("h")
             .mapInArrow(_sorted_blocks(min_bytes, first), SPAN_ROW))
    hot = places.where(F.col("most") > block_rows)
    if not hot.isEmpty():
        shared = _contexts(keyed.join(hot.select("doc", "k", "places"), ["doc", "k"]), min_bytes, block_rows, None, False)
        spans = spans.unionByName(_hot_spans(shared, min_bytes, first))
    return spans.groupBy("doc", "k").agg(F.collect_list(F.struct("start", "end")).alias("spans"), F.max("whole").alias("whole"))


def _cut(raw: bytes, spans: list | None, whole: bool) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, bytes left)."""
    if whole:
        return len(raw), int(bool(raw)), b""
    left, at, runs = [], 0, 0
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if start > at or not runs:
            left.append(raw[at:start])
            runs += 1
        at = max(at, end)
    left.append(raw[at:])
    kept = b"".join(left)
    return len(raw) - len(kept), runs, kept


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, keep: str = "none") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_bytes) of every document.

    Texts are taken as UTF-8 bytes, null as empty.  Every byte goes that lies in a string
    of ``min_bytes`` which also starts elsewhere, in the same document or another;
    strings overlap and are judged on the input.  With ``keep="first"`` a string's first
    occurrence, by doc_id and place, stays.  Shorter texts lose nothing.  Rows that
    repeat a document are copies of it; other columns are ignored.
    """
    cuts = repeated_spans(docs, min_bytes, keep)

    def run(batches):
        for b in batches:
            out = []
            for doc_id, raw, spans, whole in zip(b.column(0).to_pylist(), _bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                n, runs, kept = _cut(raw, spans, bool(whole))
                out.append((doc_id, len(raw), n, runs, kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_sha256"])

    rows = _keyed(docs).join(cuts, ["doc", "k"], "left")
    rows = rows.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"), "text", "spans", "whole")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary, kept_sha256 string")
