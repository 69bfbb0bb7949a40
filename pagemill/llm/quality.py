"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad.  A line's features describe the line
and its two neighbours; transitions tie neighbouring labels.  Training lines take
the label of their document.  Forward-backward gives each line its marginal of
being good, and a document's quality is their mean weighted by line length.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.toxicity import held_out, sigmoid, training_rows

#: Labelled documents that the field is fitted on, at most; taken by hash order of doc_id.
TRAIN_ROWS = 4_000
STEPS, RATE, L2 = 250, 0.05, 1e-3
THRESHOLD = 0.3

#: Classes of bytes that a line's characters are counted by.
_CLASS = np.zeros(256, dtype=np.int64)
for _name, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"!?",
                                b".,;:'\"()[]{}-_/\\+=@^~`"), 1):
    _CLASS[list(_chars)] = _name
CLASSES = 7
OWN = 14  # features of a line by itself
WIDTH = 3 * OWN + 2  # the line, the one before, the one after, and whether those exist


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x WIDTH) and byte lengths of the lines that hold a word."""
    lines = [(line, words) for line in (text or "").split("\n") if (words := line.split())]
    if not lines:
        return np.zeros((0, WIDTH)), np.zeros(0)
    raw = [line.encode("utf-8", "surrogatepass") for line, _ in lines]
    size = np.array([len(r) for r in raw], dtype=np.float64)
    starts = np.concatenate([[0], np.cumsum(size[:-1])]).astype(np.int64)
    kinds = _CLASS[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    count = np.stack([np.add.reduceat((kinds == c).astype(np.int64), starts) for c in range(1, CLASSES)], axis=1)
    n = np.array([len(w) for _, w in lines], dtype=np.float64)
    echo = np.array([sum(map(eq, w, w[1:])) for _, w in lines])
    kept = np.array([len(set(w)) for _, w in lines])
    seen: set[str] = set()
    again = []
    for line, _ in lines:
        again.append(line in seen)
        seen.add(line)
    letters = np.maximum(count[:, 0] + count[:, 1], 1)
    own = np.stack([
        np.ones(len(lines)), np.log1p(size) / 6, np.minimum(n, 8) / 8, count[:, 0] / letters,
        (count[:, 0] > 0.5 * letters).astype(float), count[:, 2] / size, np.minimum(count[:, 3] / n, 3),
        (count[:, 3] > 0.3 * n).astype(float), np.minimum(count[:, 4] / n, 3), count[:, 5] / n,
        np.minimum(size / n, 20) / 10, echo / n, kept / n, np.array(again, dtype=float)], axis=1)
    none = np.zeros((1, OWN))
    before, after = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
    ends = np.zeros((len(lines), 2))
    ends[0, 0] = ends[-1, 1] = 1
    return np.concatenate([own, before, after, ends], axis=1), size


@dataclass
class LineField:
    """Weights of the good label (bad is 0), transition scores [from][to], and the share of good documents."""

    weight: np.ndarray
    transition: np.ndarray
    prior: float


def _padded(features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Line positions of all sequences, longest first, as (steps x rows) indices, and rows alive per step."""
    sizes = np.array([len(f) for f in features])
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.array([(sizes > t).sum() for t in range(sizes.max(initial=0))])


def marginals(field: LineField, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over sequences sorted by descending length, none empty.

    Returns every line's marginal of good in the order of the concatenated lines,
    the expected transition counts, and the sum of the log partition functions.
    """
    first, alive = _padded(features)
    total = sum(map(len, features))
    score = np.zeros((total, 2))
    score[:, 1] = np.concatenate(features) @ field.weight
    tr = field.transition
    forward, backward = np.zeros((total, 2)), np.zeros((total, 2))
    for t, n in enumerate(alive):
        at = first[:n] + t
        if t == 0:
            forward[at] = score[at]
        else:
            reach = forward[at - 1][:, :, None] + tr
            forward[at] = score[at] + np.logaddexp(reach[:, 0], reach[:, 1])
    for t in range(len(alive) - 2, -1, -1):
        at = first[:alive[t + 1]] + t
        onward = tr[None] + (score[at + 1] + backward[at + 1])[:, None, :]
        backward[at] = np.logaddexp(onward[:, :, 0], onward[:, :, 1])
    last = first + np.array([len(f) for f in features]) - 1
    log_z = np.logaddexp(forward[last, 0], forward[last, 1])
    z = np.repeat(log_z, [len(f) for f in features])
    inner = np.ones(total, dtype=bool)
    inner[first] = False  # lines that have one before them
    here = np.flatnonzero(inner)
    pair = np.exp(forward[here - 1][:, :, None] + tr + (score[here] + backward[here])[:, None, :] - z[here, None, None])
    both = forward + backward
    return sigmoid(both[:, 1] - both[:, 0]), pair.sum(axis=0), float(log_z.sum())


def fit(features: list[np.ndarray], labels: np.ndarray) -> LineField:
    """Adam on the conditional log-likelihood; a document's lines all carry its label."""
    prior = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    field = LineField(np.zeros(WIDTH), np.zeros((2, 2)), prior)
    some = [k for k in sorted(range(len(features)), key=lambda k: -len(features[k])) if len(features[k])]
    if not some:
        return field
    features, marks = [features[k] for k in some], labels[some]
    sizes = np.array([len(f) for f in features])
    lines, line_mark = np.concatenate(features), np.repeat(marks, sizes)
    steps = sizes - 1
    observed = np.diag([(steps * (1 - marks)).sum(), (steps * marks).sum()]).astype(np.float64)
    params = np.zeros(WIDTH + 4)
    m, s = np.zeros_like(params), np.zeros_like(params)
    scale = len(lines)
    for k in range(1, STEPS + 1):
        field.weight, field.transition = params[:WIDTH], params[WIDTH:].reshape(2, 2)
        good, pairs, _ = marginals(field, features)
        grad = np.concatenate([lines.T @ (good - line_mark), (pairs - observed).ravel()]) / scale + L2 * params
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad ** 2
        params = params - RATE * (m / (1 - 0.9 ** k)) / (np.sqrt(s / (1 - 0.999 ** k)) + 1e-8)
    field.weight, field.transition = params[:WIDTH], params[WIDTH:].reshape(2, 2)
    return field


def document_scores(field: LineField, texts: list[str | None]) -> np.ndarray:
    """Length-weighted mean marginal of good lines; the prior for texts without words."""
    parts = [line_features(t) for t in texts]
    out = np.full(len(texts), field.prior)
    some = [k for k in sorted(range(len(texts)), key=lambda k: -len(parts[k][0])) if len(parts[k][0])]
    if some:
        good, _, _ = marginals(field, [parts[k][0] for k in some])
        weights = np.concatenate([parts[k][1] for k in some])
        starts = np.concatenate([[0], np.cumsum([len(parts[k][0]) for k in some])[:-1]]).astype(np.int64)
        out[some] = np.add.reduceat(good * weights, starts) / np.add.reduceat(weights, starts)
    return np.clip(out, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> LineField:
    features, marks = [], []
    for text, label in training_rows(docs, labels, "quality", rows):
        features.append(line_features(text)[0])
        marks.append(label)
    return fit(features, np.array(marks, dtype=np.float64))


def score(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Texts without words (null, empty, white space) get the share of good training
    documents.  Columns other than doc_id and text are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(document_scores(shared.value, b.column(1).to_pylist()), pa.float64())],
                                             names=["doc_id", "score"])

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """Fits on the labelled rows that aren't held out and scores every document."""
    return score(docs, train(docs, labels, rows), threshold)
