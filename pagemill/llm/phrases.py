"""Benchmark decontamination with an FM-index per training shard.

A task turns its documents into a sequence of word numbers: words of the benchmark
have a number, all others are 0 and end a run.  Runs shorter than the shortest window
can't hold one and are left out.  Every ``shard_words`` words make a shard, and a shard
gets an FM-index of its own:

* suffix order by prefix doubling; runs end with separators that differ from each
  other, so no order reaches past the end of a run;
* the last column of that order in a wavelet matrix of packed bits, whose ranks are a
  block count and a popcount;
* suffix positions at every SAMPLE-th place and at the start of each run.

Test phrases (windows of the benchmark) are looked for together, one step of backward
search per word, last word first.  A phrase's rows are then located by following the
last-to-first mapping to a sampled position.  Occurrences of all phrases in a document
overlap and are merged into spans of words.

The index costs memory by its shard, not by the documents, and the phrases come in
blocks of bounded size, each of which is searched in a pass over the documents.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_WORDS = 10
#: Indexed words of a shard, and every how many places a suffix position is kept.
SHARD_WORDS, SAMPLE = 1 << 18, 16
#: Words of a run (longer ones are indexed in overlapping pieces).
RUN_WORDS = 4096
#: Bytes of benchmark text that one pass searches for, and windows of one of its rows.
BLOCK_BYTES, PIECE_WINDOWS = 16 << 20, 1000

# A word is a run of characters outside these ASCII ranges, after A-Z became a-z.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

HITS = "doc_id long, key binary, n_words long, spans array<struct<start: int, end: int>>, items array<string>"


def split_words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def word_column(text: Column) -> Column:
    """The same words as an array column."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD_PATTERN), F.lit(0))


# -- the index -----------------------------------------------------------------
class Ranks:
    """Ones before a place in a bit array: counts per 64 bits, and a popcount for the rest."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-len(bits) // 64) * 64 + 64, dtype=bool)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded.reshape(-1, 64), axis=1, bitorder="little").view("<u8").reshape(-1)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Symbols by their bits, highest first; on every level zeros come before ones."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels = []
        for shift in range(depth - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Ranks(bits), int((~bits).sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low = np.zeros_like(at)
        for shift, ranks, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            ones_low, ones_at = ranks.ones(low), ranks.ones(at)
            low = np.where(one, zeros + ones_low, low - ones_low)
            at = np.where(one, zeros + ones_at, at - ones_at)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and how often each occurs before its place."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for shift, ranks, zeros in self.levels:
            one = ranks.get(at).astype(bool)
            ones_low, ones_at = ranks.ones(low), ranks.ones(at)
            low = np.where(one, zeros + ones_low, low - ones_low)
            at = np.where(one, zeros + ones_at, at - ones_at)
            symbol |= one.astype(np.int64) << shift
        return symbol, at - low


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence by prefix doubling; 0 is a separator, and each 0 differs from the others."""
    zeros = np.flatnonzero(seq == 0)
    rank = seq.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    done = 1
    while True:
        # Behind a separator nothing counts, and every suffix reaches one before the end.
        ahead = np.zeros_like(rank)
        ahead[:len(rank) - done] = rank[done:] + 1 if done < len(rank) else 0
        key = rank * (rank.max(initial=0) + 2) + ahead
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], key[order][1:] != key[order][:-1]]).cumsum()
        rank = np.empty_like(rank)
        rank[order] = step
        if not len(step) or step[-1] == len(step) - 1:
            return order
        done *= 2


class ShardIndex:
    """FM-index of a sequence of word numbers that ends with 0; ``starts`` are the first places of its runs."""

    def __init__(self, seq: np.ndarray, starts: np.ndarray, n_symbols: int):
        order = suffix_order(seq)
        self.last = WaveletMatrix(seq[order - 1].astype(np.int64), max(1, (n_symbols - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols))])
        kept = np.zeros(len(seq), dtype=bool)
        kept[::SAMPLE] = True
        kept[starts] = True
        self.marked = Ranks(kept[order])
        self.places = order[kept[order]]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each phrase (rows of words, ``sizes`` of them each)."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.first[-1])
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(sizes[live] >= back) & (lo[live] < hi[live])]
            word = phrases[live, sizes[live] - back]
            lo[live] = self.first[word] + self.last.rank(word, lo[live])
            hi[live] = self.first[word] + self.last.rank(word, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places of rows: back to a sampled place, counting the steps."""
        place, steps = np.empty_like(row), np.zeros_like(row)
        at, open_ = row.copy(), np.arange(len(row))
        while len(open_):
            here = at[open_]
            known = self.marked.get(here).astype(bool)
            place[open_[known]] = self.places[self.marked.ones(here[known])] + steps[open_[known]]
            open_, here = open_[~known], here[~known]
            symbol, before = self.last.access(here)
            at[open_] = self.first[symbol] + before
            steps[open_] += 1
        return place


# -- phrases -------------------------------------------------------------------
class Phrases:
    """The different windows of a block of benchmark rows (item, words, whole), with the items that have them."""

    def __init__(self, rows: list[tuple[str, list[str]]], window: int):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, words in rows:
            ids = [self.numbers.setdefault(w.encode("utf-8", "surrogatepass"), len(self.numbers) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[i:i + window]), set()).add(item)
        self.sizes = np.array([len(w) for w in found], dtype=np.int64)
        self.words = np.zeros((len(found), window), dtype=np.int64)
        for i, w in enumerate(found):
            self.words[i, :len(w)] = w
        self.items = [sorted(s) for s in found.values()]
        self.shortest = int(self.sizes.min(initial=window))


def _pieces(benchmark: DataFrame, window: int, piece_windows: int) -> DataFrame:
    """(item, words): items of the benchmark, long ones cut into pieces that share no window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_column(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    pieces = items.select("item", "w", F.explode(F.sequence(F.lit(0), last, F.lit(piece_windows))).alias("at"))
    return pieces.select("item", F.slice("w", F.col("at") + 1, F.lit(piece_windows + window - 1)).alias("words"))


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES, piece_windows: int = PIECE_WINDOWS):
    """Blocks of about ``block_bytes`` of the benchmark, one at a time; an empty benchmark is one empty block."""
    pieces = _pieces(benchmark, window, piece_windows)
    size = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 1)
    total = pieces.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for i in range(blocks):
        part = pieces if blocks == 1 else pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == i)
        yield Phrases([(r["item"], r["words"]) for r in part.collect()], window)


# -- search ----------------------------------------------------------------------
class _Shard:
    """Documents of a task, gathered until there is enough to index."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.docs: list[tuple] = []
        self.runs: list[np.ndarray] = []
        self.where: list[tuple[int, int]] = []
        self.words = 0

    def add(self, doc_id, text: str | None) -> None:
        words = split_words(text)
        numbers = np.fromiter(map(self.phrases.numbers.get, words, itertools.repeat(0)), dtype=np.int32, count=len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], numbers != 0, [0]])))
        least, step = self.phrases.shortest, RUN_WORDS - self.phrases.words.shape[1] + 1
        for a, b in edge.reshape(-1, 2)[edge[1::2] - edge[::2] >= least].tolist():
            for at in range(a, max(a + 1, b - self.phrases.words.shape[1] + 1), step):
                self.runs.append(numbers[at:min(b, at + RUN_WORDS)].copy())
                self.where.append((len(self.docs), at))
                self.words += len(self.runs[-1]) + 1
        self.docs.append((doc_id, xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass")), len(words)))

    def _occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, phrase) of every occurrence."""
        sizes = np.array([len(r) + 1 for r in self.runs])
        starts = np.cumsum(sizes) - sizes
        seq = np.zeros(self.words, dtype=np.int64)
        for at, run in zip(starts.tolist(), self.runs, strict=True):
            seq[at:at + len(run)] = run
        index = ShardIndex(seq, starts, len(self.phrases.numbers) + 1)
        lo, hi = index.search(self.phrases.words, self.phrases.sizes)
        n = hi - lo
        phrase = np.repeat(np.arange(len(n)), n)
        row = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        place = index.locate(row)
        run = np.searchsorted(starts, place, "right") - 1
        doc, at = np.array(self.where, dtype=np.int64)[run].T
        return doc, at + place - starts[run], phrase

    def rows(self) -> pa.RecordBatch:
        spans: list[list] = [[] for _ in self.docs]
        items: list[list] = [[] for _ in self.docs]
        if self.runs and len(self.phrases.sizes):
            doc, at, phrase = self._occurrences()
            end = at + self.phrases.sizes[phrase]
            order = np.lexsort((at, doc))
            doc, at, end, phrase = doc[order], at[order], end[order], phrase[order]
            cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else []
            for i, j in zip(cuts, cuts[1:], strict=False):
                spans[doc[i]] = merged(at[i:j], end[i:j])
                items[doc[i]] = sorted({x for p in np.unique(phrase[i:j]).tolist() for x in self.phrases.items[p]})
        ids, keys, counts = zip(*self.docs, strict=True)
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(spans, kinds), pa.array(items, pa.list_(pa.string()))],
            names=["doc_id", "key", "n_words", "spans", "items"])


def merged(start: np.ndarray, end: np.ndarray) -> list[dict[str, int]]:
    """Removal spans: the union of [start, end), sorted by start, as disjoint spans."""
    reach = np.maximum.accumulate(end)
    first = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(first)[1:], len(start)) - 1
    return [{"start": a, "end": b} for a, b in zip(start[first].tolist(), reach[last].tolist(), strict=True)]


def _search(docs: DataFrame, phrases: Phrases, shard_words: int) -> DataFrame:
    """(doc_id, key, n_words, spans, items) of every row; ``key`` is a 128-bit hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        shard = _Shard(shared.value)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard.add(doc_id, text)
                if shard.words >= shard_words or len(shard.docs) >= 1 << 16:
                    yield shard.rows()
                    shard = _Shard(shared.value)
        if shard.docs:
            yield shard.rows()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, HITS)


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, shard_words: int = SHARD_WORDS,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, key, n_words, spans, items) of every row of ``docs``.

    ``spans`` are the disjoint spans of words [start, end) that lie in an occurrence of a
    window of the benchmark, ``items`` the item_ids (as text, sorted) that have one of
    them.  Windows are ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  A null text has no words, a null item_id counts as '';
    rows that repeat an id are rows of their own; other columns are ignored.
    """
    passes = [_search(docs, phrases, shard_words) for phrases in phrase_blocks(benchmark, window, block_bytes)]
    if len(passes) == 1:
        return passes[0]
    # Equal texts have equal hits, so the hits of further passes are joined by the text's hash.
    hits = passes[0].select("key", "spans", "items").where(F.size("items") > 0)
    for more in passes[1:]:
        hits = hits.unionByName(more.select("key", "spans", "items").where(F.size("items") > 0))
    hits = hits.dropDuplicates().groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def union(spans):
        def one(s):
            start, end = (np.array([x[k] for x in s], dtype=np.int64) for k in ("start", "end"))
            order = np.argsort(start, kind="stable")
            return merged(start[order], end[order])
        return pd.Series([one(s) for s in spans], dtype=object)

    hits = hits.select("key", union("s").alias("spans"), F.array_sort(F.array_distinct("i")).alias("items"))
    out = passes[0].select("doc_id", "key", "n_words").join(hits, "key", "left")
    return out.select("doc_id", "key", "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in
                                                   (("spans", "array<struct<start: int, end: int>>"), ("items", "array<string>"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    found = find_phrases(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_phrases(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, text, n_removed): every document's text without the words of its removal spans.

    What stands between two removed words of a span goes with them; the rest stays as it
    is, null included.
    """
    found = find_phrases(docs, benchmark, **options).where(F.size("spans") > 0).select("key", "spans").dropDuplicates(["key"])

    @F.pandas_udf("binary")
    def text_key(text):
        return pd.Series([xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in text], dtype=object)

    @F.pandas_udf("string")
    def cut(text, spans):
        def one(t, s):
            if t is None or s is None or not len(s):
                return t
            raw = t.encode("utf-8", "surrogatepass")
            inside = np.frombuffer(raw.translate(_FOLD), dtype=np.uint8) != 0x20
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            left, at = [], 0
            for x in s:
                left.append(raw[at:edge[2 * x["start"]]])
                at = edge[2 * x["end"] - 1]
            return b"".join([*left, raw[at:]]).decode("utf-8", "surrogatepass")
        return pd.Series([one(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", text_key("text"))
    rows = rows.join(found, "key", "left")
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("long"))
    return rows.select("doc_id", cut("text", "spans").alias("text"), removed.alias("n_removed"))
