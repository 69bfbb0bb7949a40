"""Removal of repeated byte strings: pieces, order within blocks, and what it writes."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import suffixes
from pagemill.llm.common import shared_dir
from tests.llm import brute


def _letters(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))


def _written(spark) -> int:
    return sum(f.stat().st_size for f in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))


def test_bytes_of_equal_pieces_are_not_written(spark):
    """Two texts share every passage between heads of their own: only its ends need a look at their bytes."""
    rng = random.Random(7)
    passages = [_letters(rng, 4000) for _ in range(100)]
    rows = [(i, _letters(rng, 300) + passages[i % 100] + _letters(rng, 300)) for i in range(200)]
    before = _written(spark)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(n == 4600 and 4000 <= gone < 4020 and spans == 1 for n, gone, spans in got.values())
    assert _written(spark) - before < sum(len(t) for _, t in rows) / 4


@pytest.mark.parametrize("text", ["a" * 450, "abcdefg" * 70, "ab" * 120 + "ba" * 150, _letters(random.Random(3), 2500), "x" * 200, "é" * 99])
def test_every_window_has_its_first_gram_of_least_hash(text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    hashes = suffixes.window_hashes(raw, 64)
    want = [w + int(np.argmin(hashes[w:w + 137])) for w in range(len(raw) - 199)]
    h, at, first, last = suffixes.pieces(raw)
    assert [a for a, lo, hi in zip(at, first, last, strict=True) for _ in range(lo, hi + 1)] == want
    assert (h == hashes[at].astype(np.int64)).all() and (np.diff(at) > 0).all()


@pytest.mark.parametrize("first", [False, True])
def test_blocks_end_between_anchors_only(first, monkeypatch):
    """However the rows come in batches and blocks, the same windows repeat."""
    rng, rows = random.Random(11), []
    for h in range(40):
        gram, near = _letters(rng, 64), [_letters(rng, 136) for _ in range(2)]
        for doc in range(rng.randrange(1, 6)):
            rows.append((h, doc, h, 136, 136, (near[0][rng.randrange(136):].rjust(136, str(doc)) + gram + near[1][:rng.randrange(136)]).ljust(336, str(doc)).encode()))
    rows += [r for r in rows if r[0] % 7 == 0 and r[1] == 0]  # rows that come twice are one place
    rows.sort()
    rows.insert(5, (0, 99, 99, 3, 0, None))

    def spans(size, sort_rows):
        monkeypatch.setattr(suffixes, "SORT_ROWS", sort_rows)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        batches = []
        for i in range(0, len(rows), size):
            part = rows[i:i + size]
            cols = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)]
            batches.append(pa.RecordBatch.from_arrays([*cols, pa.array([r[3] + 300 for r in part]), pa.array([r[5] is None for r in part])],
                                                      names=["h", "doc", "k", "a", "left", "ctx", "end", "whole"]))
        return sorted(tuple(r.values()) for b in suffixes._sorted_blocks(200, first)(iter(batches)) for r in b.to_pylist())

    want = spans(len(rows), 10 ** 6)
    windows = [(r[0], i, r[5][i:i + 200]) for r in {r[:2]: r for r in rows if r[5]}.values() for i in range(137)]
    assert len(want) > 10 and (99, 99, 3, 303, True) in want
    assert sum(end - start - 199 for _, k, start, end, _ in want if k != 99) == len(windows) - len(set(windows)) + (
        0 if first else sum(1 for w in set(windows) if windows.count(w) > 1))
    for size, sort_rows in ((1, 1), (3, 4), (7, 10 ** 6), (len(rows), 2)):
        assert spans(size, sort_rows) == want


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("block_rows", [3, 1000])
def test_repeats_over_many_batches(spark, keep, block_rows):
    """Copies, common passages and periodic texts in several batches are what brute force finds."""
    rng = random.Random(5)
    passage = _letters(rng, 420)
    rows = [(i, _letters(rng, rng.randrange(300)) + passage[rng.randrange(120):][:rng.randrange(150, 420)] + _letters(rng, rng.randrange(200))) for i in range(50)]
    rows += [(100 + i, rows[i][1]) for i in range(6)] + [(200, "a" * 700), (201, "ab" * 300), (202, "a" * 230), (203, None), (204, passage + "é" * 150 + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = {d: (t or "").encode() for d, t in rows}
    got = {r.doc: suffixes._cut(texts[r.doc], r.spans, r.whole) for r in suffixes.repeated_spans(docs, 200, keep, block_rows).collect()}
    want = brute.remove_repeats(dict(rows), 200, keep)
    assert sum(w[1] > 0 for w in want.values()) > 30
    for d, raw in texts.items():
        n, runs, kept = got.get(d, (0, 0, raw))
        assert (len(raw), n, runs, hashlib.sha256(kept).hexdigest()) == want[d]
