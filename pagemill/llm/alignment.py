"""Cross-tokenizer alignment by white-space anchors.

Every text is tokenised in full by two tokenizers.  A place where tokens of both end
and the next tokens are marked with a space is an anchor.  Anchors cut a document into
windows, mostly words, and a window's alignment depends on nothing but its two tuples
of token ids, so a worker works it out once and looks it up from then on.

Inside a window the ends of both tokenizers cut the bytes into segments.  Each segment
is the overlap of one token of either side, hence one link, and segments that close
with an end of both are the ends of the groups.

How often a pair of ids is linked (in how many documents) is a grouped count over the
documents' distinct pairs; it is joined back to them by the pair.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import materialise

#: Characters of text that a worker aligns at once (a longer text is aligned by itself).
BATCH_CHARS = 1 << 21
#: Windows and words that a worker remembers.
CACHE_WINDOWS, CACHE_WORDS = 200_000, 300_000
#: The pair counts are broadcast up to so many rows of 17 bytes; larger ones are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000

ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, uses array<int>")


def _byte_of_letter() -> dict[int, int]:
    """Code point of the byte-level alphabet -> byte: printing bytes stand for themselves, the
    others are numbered from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {256 + i: b for i, b in enumerate(rest)}


class Tokenizer:
    """Ids of a space and a text by one tokenizer, as little-endian 32-bit bytes; None if their
    tokens don't give the space and the text back.

    Words (parts between single spaces) are independent of each other, so many of
    them are encoded together in one call.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens], dtype=bool)
        self.by_word = True

    def ids(self, text: str) -> list[int]:
        raise NotImplementedError

    def _text(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode(self, text: str) -> bytes | None:
        ids = self.ids(text)
        return np.array(ids, dtype="<u4").tobytes() if self._text(ids) == _raw(text) else None

    def encode_words(self, words: list[str]) -> list[bytes | None]:
        """Ids of each word, by one call over all of them."""
        text = " ".join(words)
        ids = self.ids(text)
        word_ends = np.cumsum([len(w) + 1 for w in map(str.encode, words)])
        ends = np.cumsum(self.length[ids])
        behind = np.minimum(np.searchsorted(ends, word_ends), len(ids) - 1)
        if self._text(ids) == _raw(text) and (ends[behind] == word_ends).all():
            raw = np.array(ids, dtype="<u4").tobytes()
            cuts = (4 * (behind + 1)).tolist()
            return [raw[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]
        if len(words) == 1:
            return [self.encode(words[0])]
        half = len(words) // 2  # a word that isn't given back is among them
        return self.encode_words(words[:half]) + self.encode_words(words[half:])


#: A space before white space or the end: such texts are encoded in full.
_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")


def _raw(text: str) -> bytes:
    return (" " + text).encode()


class ByteTokenizer(Tokenizer):
    """A byte-level vocabulary (tokenizers)."""

    def __init__(self, path: str):
        import tokenizers
        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        letters = _byte_of_letter()
        names = self.model.get_vocab()
        tokens = [b""] * (max(names.values(), default=-1) + 1)
        for name, i in names.items():
            tokens[i] = bytes(letters.get(ord(c), 0) for c in name)
        super().__init__(tokens)

    def ids(self, text: str) -> list[int]:
        return self.model.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids


class PieceTokenizer(Tokenizer):
    """A sentence-piece vocabulary, which puts the space before a text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(n[1:-1], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        # Words are independent only if no piece reaches over the start of a word.
        self.by_word = not any("▁" in n.lstrip("▁") for n in names)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


#: Groups, groups as text, linked pairs as 64-bit bytes.
Solved = tuple[int, bytes, bytes]
#: Ids of a, ids of b, and the alignment.
Aligned = tuple[int, int, int, bytes, bytes]
#: A unit that either side doesn't give back, and the alignment of a text without tokens.
BAD: Aligned = (0, 0, 0, b"", b"")
NOTHING = (0, 0, 0, b"", np.zeros(0, dtype=np.int64))


def _u4(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u4").astype(np.int64)


class Aligner:
    """Aligns the texts of a worker; one for each pair of vocabularies."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokenizer(byte_path), PieceTokenizer(piece_path)
        # Ids as text with what follows them inside a group and at its end, and the length of that.
        self.said_a, self.said_b = (
            (np.array([[b"%d%c" % (i, c) for i in range(len(t.tokens))] for c in seps], dtype=object),
             np.array([len(str(i)) + 1 for i in range(len(t.tokens))])) for t, seps in ((self.a, b",|"), (self.b, b",;")))
        #: Word -> its tokens and alignment.
        self.words: dict[str, Aligned] = {}
        #: (a ids, b ids) of a window -> its alignment.
        self.windows: dict[tuple[bytes, bytes], Solved] = {}

    def _cuts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What ends at every byte where a token ends: 1 for a, 2 for b, 3 for both."""
        ends_a, ends_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        kind = np.zeros((ends_a[-1] if len(ends_a) else 0) + 1, dtype=np.uint8)
        kind[ends_a] |= 1
        kind[ends_b] |= 2
        return kind[kind > 0]

    def split(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``a`` and ``b`` behind each window; documents end behind ``ends_a`` ids of a."""
        kind = self._cuts(a, b)
        shared = kind == 3
        in_a, in_b = np.cumsum(kind & 1, dtype=np.int64)[shared], np.cumsum(kind >> 1, dtype=np.int64)[shared]
        spaced = np.append(self.a.spaced[a], False)[in_a] & np.append(self.b.spaced[b], False)[in_b]
        last = np.zeros(len(a) + 1, dtype=bool)
        last[ends_a] = True
        anchor = spaced | last[in_a]
        return in_a[anchor], in_b[anchor]

    def solve(self, windows: list[tuple[bytes, bytes]]) -> list[Solved]:
        """Alignment of each window."""
        a, b = (_u4(b"".join([w[i] for w in windows])) for i in (0, 1))
        kind = self._cuts(a, b)
        in_a, in_b = np.cumsum(kind & 1, dtype=np.int64), np.cumsum(kind >> 1, dtype=np.int64)
        # The tokens over a segment are those with fewer ends before it.
        pairs = ((a[in_a - (kind & 1)] << 32) | b[in_b - (kind >> 1)]).astype("<i8").tobytes()
        shared = np.flatnonzero(kind == 3)
        behind_a, behind_b = in_a[shared], in_b[shared]
        # Ids as text: a group's a ids, its b ids, the next group's a ids, ...
        last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        last_a[behind_a - 1], last_b[behind_b - 1] = True, True
        of_a = np.searchsorted(behind_a, np.arange(len(a)), "right")
        at_a = np.arange(len(a)) + np.concatenate([[0], behind_b])[of_a]
        at_b = np.arange(len(b)) + behind_a[np.searchsorted(behind_b, np.arange(len(b)), "right")]
        said, size = np.empty(len(a) + len(b), dtype=object), np.empty(len(a) + len(b), dtype=np.int64)
        for at, ids, last, (names, sizes) in ((at_a, a, last_a, self.said_a), (at_b, b, last_b, self.said_b)):
            said[at], size[at] = names[last.astype(np.int8), ids], sizes[ids]
        text, ends = b"".join(said.tolist()), np.cumsum(size)
        group = np.searchsorted(behind_a, np.cumsum([len(w[0]) // 4 for w in windows]))  # a window ends with a group
        text_end = ends[behind_a[group] + behind_b[group] - 1].tolist()
        out, t, g, s = [], 0, 0, 0
        for te, ge, le in zip(text_end, (group + 1).tolist(), (shared[group] + 1).tolist(), strict=True):
            out.append((ge - g, text[t:te - 1], pairs[8 * s:8 * le]))
            t, g, s = te, ge, le
        return out

    def _solved(self, keys: list[tuple[bytes, bytes]]) -> list[Solved]:
        """Alignments of windows, looked up or worked out together."""
        known = self.windows
        missing = list(dict.fromkeys(k for k in keys if k not in known))
        if missing:
            if len(known) + len(missing) > CACHE_WINDOWS:
                known.clear()
                missing = list(dict.fromkeys(keys))
            known.update(zip(missing, self.solve(missing), strict=True))
        return [known[k] for k in keys]

    def _aligned(self, a: list[bytes | None], b: list[bytes | None]) -> list[Aligned]:
        """Alignments of texts by their ids on both sides (None: not given back)."""
        good = [x is not None and y is not None for x, y in zip(a, b, strict=True)]
        all_a, all_b = (b"".join([x for x, ok in zip(side, good, strict=True) if ok]) for side in (a, b))
        n_a, n_b = (np.array([len(x) // 4 if ok else 0 for x, ok in zip(side, good, strict=True)], dtype=np.int64) for side in (a, b))
        if not all_a:
            return [BAD] * len(a)
        ends = np.cumsum(n_a)
        cut_a, cut_b = self.split(_u4(all_a), _u4(all_b), ends[n_a > 0])
        places = zip((4 * cut_a).tolist(), (4 * cut_b).tolist(), strict=True)
        keys, i, j = [], 0, 0
        for k, m in places:
            keys.append((all_a[i:k], all_b[j:m]))
            i, j = k, m
        solved = self._solved(keys)
        out, w = [], 0
        for x, y, u in zip(n_a.tolist(), n_b.tolist(), np.searchsorted(cut_a, ends, "right").tolist(), strict=True):
            if not x:
                out.append(BAD)
                continue
            own = solved[w:u]
            out.append((x, y, *(own[0] if len(own) == 1 else
                                (sum(o[0] for o in own), b";".join([o[1] for o in own]), b"".join([o[2] for o in own])))))
            w = u
        return out

    def _of_words(self, words: list[str]) -> list[Aligned]:
        """Alignments of different words, remembered or worked out together."""
        got = list(map(self.words.get, words))
        new = [w for w, x in zip(words, got, strict=True) if x is None]
        if new:
            if len(self.words) + len(new) > CACHE_WORDS:
                self.words.clear()
            found = self._aligned(self.a.encode_words(new), self.b.encode_words(new))
            self.words.update(zip(new, found, strict=True))
            rest = iter(found)
            got = [next(rest) if x is None else x for x in got]
        return got

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, bytes, np.ndarray]]:
        """(ids of a, ids of b, groups, groups as text, linked pairs) of each text; nothing for a
        text that is empty or that either side doesn't give back."""
        # Both put a word's space in front of it: without white space behind a space, words are
        # independent, and a space-marked token starts at each of them and nowhere else.
        by_word = self.a.by_word and self.b.by_word
        whole = np.array([bool(t) and not (by_word and not _LOOSE_SPACE.search(" " + t)) for t in texts], dtype=bool)
        lists = pc.split_pattern(pa.array([None if w else t or None for t, w in zip(texts, whole, strict=True)], pa.large_string()), " ")
        counts = np.where(whole, 1, pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        words = lists.flatten().dictionary_encode()
        units, unit = self._of_words(words.dictionary.to_pylist()), words.indices.to_numpy()
        # A text that isn't cut at its spaces is one unit.
        rest = np.flatnonzero(whole)
        unit = np.insert(unit, (np.cumsum(counts) - counts - np.cumsum(whole) + whole)[rest], len(units) + np.arange(len(rest)))
        loose = [texts[i] for i in rest.tolist()]
        units += self._aligned([self.a.encode(t) for t in loose], [self.b.encode(t) for t in loose])
        if not units:
            return [NOTHING] * len(texts)

        end = np.cumsum(counts)
        start = end - counts
        size = np.array([len(u[4]) // 8 for u in units], dtype=np.int64)
        pairs = np.frombuffer(b"".join([u[4] for u in units]), dtype="<i8")[_ranges((np.cumsum(size) - size)[unit], size[unit])]
        said = np.array([u[3] for u in units], dtype=object)[unit]
        n_a, n_b, groups, links, bad = (np.concatenate([[0], np.cumsum(x[unit])]) for x in (
            *(np.array([u[i] for u in units], dtype=np.int64) for i in range(3)), size, np.array([u is BAD for u in units], dtype=np.int64)))
        return [(x, y, g, b";".join(said[i:j].tolist()), pairs[k:m]) if x and not wrong else NOTHING for x, y, g, wrong, i, j, k, m in
                zip(*(x.tolist() for x in (n_a[end] - n_a[start], n_b[end] - n_b[start], groups[end] - groups[start], bad[end] - bad[start],
                                           start, end, links[start], links[end])), strict=True)]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


@functools.lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One per worker process, kept between its tasks."""
    return Aligner(byte_path, piece_path)


def align_documents(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, uses) of every row of ``docs``.

    ``pairs`` are the distinct linked id pairs (a << 32 | b) and ``uses`` how often each is
    linked.  A text that is null, empty or not given back by both tokenizers has no
    tokens: zeros, empty arrays and ''.  Rows that repeat a doc_id, or have none, are
    documents of their own; other columns are ignored.
    """
    def run(batches):
        known = aligner(byte_path, piece_path)

        def emit(ids, texts):
            rows = []
            for doc_id, (n_a, n_b, n_groups, said, links) in zip(ids, known.align(texts), strict=True):
                pairs, uses = np.unique(links, return_counts=True)
                rows.append((doc_id, n_a, n_b, n_groups, len(links), hashlib.sha256(said).hexdigest() if n_a else "", pairs, uses))
            cols = list(zip(*rows, strict=True))
            sizes = np.cumsum([0, *map(len, cols[6])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(c).astype(t)))
                     for c, t in ((cols[6], np.int64), (cols[7], np.int32))]
            plain = [pa.array(c, t) for c, t in zip(cols[:6], [pa.int64()] * 5 + [pa.string()], strict=True)]
            return pa.RecordBatch.from_arrays([*plain, *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "uses"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "")
                if size >= BATCH_CHARS:
                    yield emit(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield emit(ids, texts)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs, best): documents that hold a pair linked, and whether no pair of its a id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(of_a))


def align_corpus(docs: DataFrame, byte_path: str, piece_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    ``n_best`` counts the links whose pair is in as many documents as any pair of the
    same a id (ties included), ``count_sum`` adds the documents of the pairs over the links.
    """
    aligned = align_documents(docs, byte_path, piece_path).withColumn("_row", F.monotonically_increasing_id())
    aligned = materialise(aligned, "aligned")
    counts = materialise(pair_counts(aligned), "pair_counts")
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    links = aligned.select("_row", F.inline(F.arrays_zip("pairs", "uses"))).withColumnRenamed("pairs", "pair")
    sums = links.join(counts, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("uses")).otherwise(0).cast("long")).alias("n_best"),
        F.sum(F.col("uses") * F.col("n_docs")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.join(sums, "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
