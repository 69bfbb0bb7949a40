"""Best-fit packing of token sequences by bin completion.

A document's token ids (plus one end id) are cut into pieces of at most
``capacity`` ids, and the pieces are placed into as few sequences as possible.

The packing problem has at most ``capacity`` different piece lengths, whatever
the corpus size, so the search runs on the histogram of lengths (at most 2,048
rows here) and everything that grows with the corpus stays in Spark: pieces are
ranked within their length in parallel, and a rank is mapped to its sequence by
the runs of the solution.

Search: bin completion.  A node takes the largest remaining length, enumerates
the undominated fillings of the room beside it (the last item of a filling is
always the longest that fits, so a filling that differs only by a shorter last
item never appears), and applies the chosen filling as often as the counts
allow.  A branch ends when the waste it has spent means that it cannot use
fewer sequences than the incumbent; incumbents start from best fit.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import materialise

CAPACITY = 2048
END_ID = 0
#: Rows that one (length, bucket) group of the ranking window holds on average.
RANK_GROUP_ROWS = 65_536
#: Nodes that the branch-and-bound search visits before it returns its incumbent.
SEARCH_NODES = 20_000
#: Fillings tried at one node, and steps spent on enumerating them.
FILLINGS, FILL_STEPS = 4, 600
#: Entries of a worker's cache of encoded words; beyond it the cache starts anew.
CACHE_WORDS = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# -- tokens ---------------------------------------------------------------
def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: bytes that print stand for themselves, the rest
    take the letters from code point 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Token ids, as little-endian uint32 bytes, of a space and then the key.

    Keys hold no white space.  Ids of new keys come from the tokenizer: a key of
    letters is one pre-token and goes straight to its BPE model, letters with
    punctuation behind them are two, and anything else is encoded in full.
    """

    # Characters that end a pre-token of letters and never extend it.
    PUNCTUATION = ".,!?:;|#*$%&"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts that hold an added token are encoded in full: it is one token wherever it stands.
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.letters = _byte_letters()
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, key: str) -> bytes:
        stem = key.rstrip(self.PUNCTUATION)
        if key.isalpha():
            token = (" " + key).encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(token)], dtype="<u4").tobytes()
        elif stem.isalpha():
            tail = key[len(stem):]
            if tail not in self.tails:
                self.tails[tail] = self.whole(tail)
            ids = self[stem] + self.tails[tail]
        else:
            ids = self.whole(" " + key)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[key] = ids
        return ids


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One cache per worker process, kept between its tasks."""
    return WordIds(path)


#: A space before white space or the end: such texts are encoded in full.
_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")


def encode(text: str | None, known: WordIds) -> bytes:
    """Token ids of a whole text as little-endian uint32 bytes.

    The byte-level pre-tokeniser starts a new token at every space before a
    visible character, so a text without other spaces has the ids of its
    space-led parts, one after the other; parts repeat and are looked up.
    """
    if not text:
        return b""
    if _LOOSE_SPACE.search(text) or known.added and known.added.search(text):
        return known.whole(text)
    head, *rest = text.split(" ")
    return known.whole(head) + b"".join(map(known.__getitem__, rest))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document: (doc_id, piece, start, length, ids_crc32).

    A null or empty text is the end id alone.  Only texts of more than
    ``capacity`` ids are cut: all pieces but the first have ``capacity`` ids.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        known = word_ids(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text, known) + end
                n = len(ids) // 4
                first = n - (n - 1) // capacity * capacity
                cuts = [0, *range(first, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]))
                         for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


# -- search on the histogram ------------------------------------------------
Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def _fillings(lengths: list[int], counts: dict[int, int], room: int, most: int, steps: int) -> list[tuple[int, list[int]]]:
    """Undominated fillings of ``room`` as (waste, items), least waste first.

    ``lengths`` ascend.  Items of a filling never increase, and its last item
    is the longest that still fits.
    """
    found: list[tuple[int, list[int]]] = []
    left = {"steps": steps, "exact": 0}
    used: dict[int, int] = {}

    def fits(size: int) -> int:
        """Index of the longest available length up to ``size``, or -1."""
        i = bisect.bisect_right(lengths, size) - 1
        while i >= 0 and used.get(lengths[i], 0) >= counts[lengths[i]]:
            i -= 1
        return i

    def extend(items: list[int], room: int, longest: int) -> None:
        i = fits(min(room, longest))
        if i < 0:
            found.append((room, items))
            left["exact"] += room == 0
            return
        while i >= 0 and left["steps"] > 0 and left["exact"] < most:
            left["steps"] -= 1
            x = lengths[i]
            used[x] = used.get(x, 0) + 1
            extend([*items, x], room - x, x)
            used[x] -= 1
            # A shorter item here is dominated when nothing can join it.
            if lengths[0] > room - x and lengths[0] > room - lengths[i - 1]:
                break
            i = fits(x - 1)

    extend([], room, room)
    found.sort(key=lambda f: (f[0], len(f[1])))
    unique = list({tuple(f[1]): f for f in reversed(found)}.values())[::-1]
    return sorted(unique, key=lambda f: (f[0], len(f[1])))[:most]


def _state(hist: dict[int, int]) -> tuple[list[int], dict[int, int]]:
    return sorted(x for x, n in hist.items() if n), {x: n for x, n in hist.items() if n}


def _take(lengths: list[int], counts: dict[int, int], pattern: Pattern, times: int) -> None:
    for x, k in pattern:
        counts[x] -= k * times
        if not counts[x]:
            lengths.pop(bisect.bisect_left(lengths, x))


def _give(lengths: list[int], counts: dict[int, int], pattern: Pattern, times: int) -> None:
    for x, k in pattern:
        if not counts[x]:
            bisect.insort(lengths, x)
        counts[x] += k * times


def _as_pattern(items: list[int]) -> Pattern:
    return tuple((x, items.count(x)) for x in sorted(set(items), reverse=True))


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first: the largest length, then always the longest that fits."""
    lengths, counts = _state(hist)
    out = []
    while lengths:
        pattern = _as_pattern(_greedy(lengths, counts, capacity))
        times = min(counts[x] // k for x, k in pattern)
        _take(lengths, counts, pattern, times)
        out.append((pattern, times))
    return out


def _greedy(lengths: list[int], counts: dict[int, int], capacity: int) -> list[int]:
    items, room, used = [], capacity, {}
    i = len(lengths) - 1
    while i >= 0:
        x = lengths[i]
        if x <= room and used.get(x, 0) < counts[x]:
            items.append(x)
            used[x] = used.get(x, 0) + 1
            room -= x
        else:
            i = min(i - 1, bisect.bisect_right(lengths, room) - 1)
    return items


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: total size, and items that exclude each other."""
    total = sum(x * n for x, n in hist.items())
    best = -(-total // capacity)
    for k in sorted({x for x in hist if 2 * x <= capacity} | {0}):
        big = sum(n for x, n in hist.items() if x > capacity - k)
        mid = [(x, n) for x, n in hist.items() if capacity / 2 < x <= capacity - k]
        room = sum((capacity - x) * n for x, n in mid)
        small = sum(x * n for x, n in hist.items() if k <= x <= capacity / 2)
        best = max(best, big + sum(n for _, n in mid) + max(0, -(-(small - room) // capacity)))
    return best


def bin_completion(hist: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> list[tuple[Pattern, int]]:
    """Fillings and how often each is used; together they hold every item of ``hist``.

    Branch and bound over bin completions; ``nodes`` bounds the search, after
    which the best packing found so far stands.
    """
    best = best_fit(hist, capacity)
    fewest, least = sum(n for _, n in best), lower_bound(hist, capacity)
    lengths, counts = _state(hist)
    total = sum(x * n for x, n in counts.items())
    path: list[tuple[Pattern, int, int]] = []  # filling, times, waste of this step
    waste = bins = 0

    def options() -> list[list[int]]:
        top = lengths[-1]
        rest = counts | {top: counts[top] - 1}
        usable = lengths if rest[top] else lengths[:-1]
        return [[top, *items] for _, items in _fillings(usable, rest, capacity - top, FILLINGS, FILL_STEPS)]

    stack: list[list[list[int]]] = [options()[::-1]] if lengths and fewest > least else []
    while stack and nodes > 0 and fewest > least:
        if not stack[-1]:
            stack.pop()
            if path:
                pattern, times, lost = path.pop()
                _give(lengths, counts, pattern, times)
                waste, bins = waste - lost, bins - times
            continue
        nodes -= 1
        pattern = _as_pattern(stack[-1].pop())
        times = min(counts[x] // k for x, k in pattern)
        lost = (capacity - sum(x * k for x, k in pattern)) * times
        if -(-(total + waste + lost) // capacity) >= fewest:
            continue  # too much waste to beat the incumbent
        _take(lengths, counts, pattern, times)
        path.append((pattern, times, lost))
        waste, bins = waste + lost, bins + times
        if lengths:
            stack.append(options()[::-1])
            continue
        if bins < fewest:
            fewest, best = bins, [(p, n) for p, n, _ in path]
        stack.append([])  # undoes this step
    return best


# -- placement ---------------------------------------------------------------
def solution_runs(solution: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """The solution by (length, first rank): which sequences those ranks fill.

    Rank r of a length from a run's ``start`` on goes to sequence
    ``base + (r - start) // mult`` at ``offset + (r - start) % mult * length``.
    """
    taken: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in solution:
        offset = 0
        for x, k in pattern:
            rows.append((x, taken.get(x, 0), base, k, offset))
            taken[x] = taken.get(x, 0) + k * times
            offset += x * k
        base += times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "start", "base", "mult", "offset"), cols, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to ``capacity``.

    Rows are ranked within (length, bucket), a bucket being a hash range of the
    rows, so one length that a third of all rows share is still ranked by many
    tasks; a prefix sum over the buckets' counts makes the ranks global.  Equal
    rows get places of their own.
    """
    spark = pieces.sparkSession
    pieces = materialise(pieces, "pieces")
    rows = pieces.count()
    buckets = max(1, -(-rows // RANK_GROUP_ROWS))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = materialise(keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    # At most `capacity` rows, however large the corpus is.
    hist = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(solution_runs(bin_completion(hist, capacity, nodes)))

    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (keyed.withColumn("_row", F.row_number().over(order))
              .join(starts, ["length", "_bucket"])
              .withColumn("_rank", F.col("_before") + F.col("_row") - 1)
              .select(*pieces.columns, "_rank"))
    names = pieces.columns

    def place(batches):
        r = runs.value
        span = rows + 1  # above any rank, so one ascending key orders (length, rank)
        keys = r["length"] * span + r["start"]
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "_rank"))
            i = np.searchsorted(keys, length * span + rank, "right") - 1
            k = rank - r["start"][i]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(r["base"][i] + k // r["mult"][i]),
                 pa.array(r["offset"][i] + k % r["mult"][i] * length)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of all documents with their sequence and place in it."""
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity)
