"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct terms of a
text.  The pairwise part has one vector per term, so it learns that a term is
harmful next to another (an insult with the mention of a group) though neither is
by itself, which additive weights can't.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the model is fitted on, at most; taken by hash order of doc_id.
TRAIN_ROWS = 12_000
#: Hash buckets of terms; a bucket needs this many training documents to get a weight.
TERMS, MIN_DOCS = 1 << 18, 3
FACTORS, STEPS = 8, 800
RATE, L2_FACTOR = 1.0, 5e-3
MIN_Z, PENALTY_Z, CHANCE_Z = 5.0, 0.02, 3.0
CACHE_WORDS = 1_000_000
# Characters stripped from both ends of a word.
EDGES = b".,!?:;|#*$%&<>()[]{}\"'`~_-+=/\\"


class _TermIds(dict):
    """Hash bucket of a raw word: lower case, punctuation at its ends stripped; -1 if nothing is left."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        term = word.lower().encode("utf-8", "surrogatepass").strip(EDGES)
        i = self[word] = xxhash.xxh64_intdigest(term) % TERMS if term else -1
        return i


_IDS = _TermIds()


def term_ids(text: str | None) -> np.ndarray:
    """Distinct term buckets of a whole text."""
    words = text.split() if text else []
    ids = np.unique(np.fromiter(map(_IDS.__getitem__, words), dtype=np.int64, count=len(words)))
    return ids[ids >= 0]


@dataclass
class FactorizationMachine:
    bias: float
    weight: np.ndarray  # TERMS
    factor: np.ndarray  # TERMS x FACTORS

    def margins(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid of rows given as concatenated ids and their start offsets."""
        rows = len(starts)
        row = np.repeat(np.arange(rows), np.diff(np.append(starts, len(ids))))
        linear = np.bincount(row, weights=self.weight[ids], minlength=rows)
        v = self.factor[ids]
        pair = np.zeros(rows)
        for f in range(v.shape[1]):
            s = np.bincount(row, weights=v[:, f], minlength=rows)
            pair += s * s - np.bincount(row, weights=v[:, f] ** 2, minlength=rows)
        return self.bias + linear + pair / 2


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> FactorizationMachine:
    """Proximal gradient steps on the logistic loss.

    Every term of ``MIN_DOCS`` documents has a linear weight, which pays a penalty in
    deviations of its own gradient: ``CHANCE_Z`` of them, which keeps weights of chance
    associations at 0, or ``PENALTY_Z`` if the term's share of positive documents is
    ``MIN_Z`` standard deviations from the overall share.  Only the latter terms have
    factors, which pay a square penalty.
    """
    rng = np.random.default_rng(seed)
    rows = len(bags)
    share = float(np.clip(labels.mean() if rows else 0.5, 1e-3, 1 - 1e-3))
    weight, factor = np.zeros(TERMS), np.zeros((TERMS, FACTORS))
    bias = float(np.log(share / (1 - share)))
    if not rows:
        return FactorizationMachine(bias, weight, factor)
    ids, row = np.concatenate(bags), np.repeat(np.arange(rows), [len(b) for b in bags])
    seen = np.bincount(ids, minlength=TERMS)
    spread = np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    z = (np.bincount(ids, weights=labels[row], minlength=TERMS) - seen * share) / spread
    used = np.flatnonzero(seen >= MIN_DOCS)
    # Terms with factors first.
    used = used[np.argsort(np.abs(z[used]) < MIN_Z, kind="stable")]
    strong = int((np.abs(z[used]) >= MIN_Z).sum())
    dense = np.full(TERMS, -1)
    dense[used] = np.arange(len(used))
    take = dense[ids] >= 0
    ids, row = dense[ids[take]], row[take]
    paired = ids < strong
    fids, frow = ids[paired], row[paired]
    penalty = np.where(np.arange(len(used)) < strong, PENALTY_Z, CHANCE_Z) * spread[used]
    w, v = np.zeros(len(used)), rng.normal(0, 0.05, (strong, FACTORS))
    gb, gw, gv = 1e-8, np.full(w.shape, 1e-8), np.full(v.shape, 1e-8)
    for _ in range(STEPS):
        vi = v[fids]
        sums = np.stack([np.bincount(frow, weights=vi[:, f], minlength=rows) for f in range(FACTORS)], axis=1)
        squares = np.bincount(frow, weights=(vi ** 2).sum(axis=1), minlength=rows)
        margin = bias + np.bincount(row, weights=w[ids], minlength=rows) + ((sums ** 2).sum(axis=1) - squares) / 2
        error = sigmoid(margin) - labels
        dw = np.bincount(ids, weights=error[row], minlength=len(used))
        each = error[frow][:, None] * (sums[frow] - vi)
        dv = np.stack([np.bincount(fids, weights=each[:, f], minlength=strong) for f in range(FACTORS)], axis=1) + L2_FACTOR * rows * v
        gb, gw, gv = gb + error.sum() ** 2, gw + dw ** 2, gv + dv ** 2
        bias -= RATE * error.sum() / np.sqrt(gb)
        step = RATE / np.sqrt(gw)
        w = w - step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        v = v - RATE * dv / np.sqrt(gv)
    weight[used], factor[used[:strong]] = w, v
    return FactorizationMachine(float(bias), weight, factor)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> list[tuple[str | None, int]]:
    """(text, label) of at most ``rows`` labelled documents that aren't held out, in order of their hash."""
    picked = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max(label).alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return [(r["text"], int(r["label"])) for r in found.orderBy("doc_id").toLocalIterator()]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorizationMachine:
    bags, marks = [], []
    for text, label in training_rows(docs, labels, "toxic", rows):
        bags.append(term_ids(text))
        marks.append(label)
    return fit(bags, np.array(marks, dtype=np.float64))


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Null and empty texts have no terms and get the model's bias.  Columns other than
    doc_id and text are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS x (FACTORS + 1) numbers

    def run(batches):
        fm = shared.value
        for b in batches:
            bags = [term_ids(t) for t in b.column(1).to_pylist()]
            starts = np.cumsum([0, *map(len, bags)])[:-1]
            ids = np.concatenate(bags) if bags else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(fm.margins(ids, starts)))], names=["doc_id", "score"])

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = slim.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """Fits on the labelled rows that aren't held out and scores every document."""
    return score(docs, train(docs, labels, rows), threshold)
