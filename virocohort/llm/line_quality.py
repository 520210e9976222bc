"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  A line's observations are the bins of some measures of its own and of the lines before and
after it; one weight for each bin and four transition weights make the field.  It is fitted by its exact likelihood
(forward-backward gives the gradient) on a bounded, hash-chosen sample of labelled documents, whose lines take their document's
label.  Scoring runs forward-backward over each document's lines; the marginals of good, weighted by the lines' lengths,
make the document's score, put on the labels' scale by a fitted logistic curve.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = 14
BINS = 21
REACH = 3  # the line itself, the one before, the one after
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
STOPS = b".,;:?"
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:?!'\"()-")
ALL_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class Field(NamedTuple):
    """Edges of the bins of each measure, a weight per bin and neighbour, transitions [from, to], the curve of the score."""
    edges: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float]


def measures(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Measures (lines by MEASURES) and lengths in bytes of the lines that hold more than blanks."""
    out, size, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, long = len(words), len(line)
        small = [w.lower() for w in words]
        pairs = list(zip(small, small[1:], strict=False))
        bare = line.translate(None, ALL_SIGNS)
        out.append((
            math.log(n), math.log(long / n), len(set(small)) / n, sum(map(operator.eq, small, small[1:])) / n,
            1 - len(set(pairs)) / len(pairs) if pairs else 0.0, (long - len(line.translate(None, SIGNS))) / n, line.count(b"!") / n,
            (long - len(line.translate(None, UPPER))) / long, (long - len(line.translate(None, DIGITS))) / long, (long - len(line.translate(None, STOPS))) / n,
            1 - len(bare.split()) / n, sum(len(w) <= 3 for w in words) / n, max(map(len, words)) / long, float(line in seen)))
        seen.add(line)
        size.append(long)
    return np.array(out).reshape(-1, MEASURES), np.array(size, float)


def observed(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Numbers of the weights that hold for each line: MEASURES for each of the line and its neighbours (0: none there)."""
    own = 1 + np.stack([np.searchsorted(e, v, side="right") for e, v in zip(edges, values.T, strict=True)], axis=1) + np.arange(MEASURES) * BINS
    width = 1 + MEASURES * BINS
    out = np.zeros((len(own), REACH, MEASURES), np.int64)
    out[:, 0] = own
    out[1:, 1] = own[:-1] + width
    out[:-1, 2] = own[1:] + 2 * width
    return out.reshape(len(own), -1)


def forward_backward(good: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good, expected transitions and the log of the sum over labellings, for one sequence's scores of good."""
    n = len(good)
    local = np.exp(np.stack([np.minimum(0, -good), np.minimum(0, good)], axis=1))  # bad, good; the greater is 1
    step = np.exp(moves - moves.max())
    f, b, total = np.empty((n, 2)), np.ones((n, 2)), np.maximum(0, good).sum() + (n - 1) * moves.max()
    state = np.ones(2)
    for t in range(n):
        state = local[t] * (state @ step if t else state)
        scale = state.sum()
        total += math.log(scale)
        f[t] = state = state / scale
    state = np.ones(2)
    for t in range(n - 2, -1, -1):
        state = step @ (local[t + 1] * state)
        b[t] = state = state / state.sum()
    both = f * b
    marginal = both[:, 1] / both.sum(axis=1)
    pair = f[:-1, :, None] * step * (local[1:] * b[1:])[:, None, :]
    return marginal, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if n > 1 else np.zeros((2, 2)), total


def _all_sequences(good: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected transitions of many sequences at once: sequences in descending length, one step for all."""
    step = np.exp(moves - moves.max())
    local = np.exp(np.stack([np.minimum(0, -good), np.minimum(0, good)], axis=1))
    f, b = np.empty((len(good), 2)), np.ones((len(good), 2))
    active = [starts[:np.searchsorted(-lengths, -t, side="left")] for t in range(lengths[0])]  # those longer than t
    for t, at in enumerate(active):
        state = local[at + t] * (f[at + t - 1] @ step if t else 1)
        f[at + t] = state / state.sum(axis=1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        at = active[t + 1] + t
        state = (local[at + 1] * b[at + 1]) @ step.T
        b[at] = state / state.sum(axis=1, keepdims=True)
    both = f * b
    inner = np.ones(len(good), bool)
    inner[starts + lengths - 1] = False
    at = np.flatnonzero(inner)
    pair = f[at][:, :, None] * step * (local[at + 1] * b[at + 1])[:, None, :]
    return both[:, 1] / both.sum(axis=1), (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fit(samples: list[tuple[int, bytes]], turns: int = 80, rate: float = 0.15, ridge: float = 1.0) -> Field:
    """The field of labelled texts (label 0 or 1, text), by Adam on the mean log likelihood of the lines."""
    seen = [(y, *measures(text)) for y, text in samples]
    seen = sorted((s for s in seen if len(s[1])), key=lambda s: -len(s[1]))
    if not seen:
        return Field(np.zeros((MEASURES, BINS - 1)), np.zeros(REACH * (1 + MEASURES * BINS)), np.zeros((2, 2)), (0.0, 0.0))
    kinds = [np.concatenate(v) for v in ([v for y, v, _ in seen if y == label] for label in (0, 1)) if v]
    halves = [np.quantile(v, np.arange(1, 11) / 11, axis=0) for v in kinds]  # both labels' lines shape the bins
    edges = np.sort(np.concatenate(halves), axis=0).T
    edges = np.pad(edges, ((0, 0), (0, BINS - 1 - edges.shape[1])), mode="edge")
    lengths = np.array([len(v) for _, v, _ in seen])
    starts = np.cumsum(lengths) - lengths
    spots = np.concatenate([observed(v, edges) for _, v, _ in seen])
    truth = np.repeat([y for y, *_ in seen], lengths).astype(float)
    share = np.repeat(np.concatenate([1 / lengths]), lengths)  # a document's lines weigh as much as its label
    labels = np.array([y for y, *_ in seen])
    stays = np.array([[((1 - labels) * (lengths - 1)).sum(), 0], [0, (labels * (lengths - 1)).sum()]], float)
    weights, moves = np.zeros(REACH * (1 + MEASURES * BINS)), np.zeros((2, 2))
    theta = np.zeros(len(weights) + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, turns + 1):
        weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
        marginal, pairs = _all_sequences(weights[spots].sum(axis=1), starts, lengths, moves)
        slope = np.bincount(spots.ravel(), np.repeat((truth - marginal) * share, spots.shape[1]), len(weights))
        gradient = np.r_[slope / len(seen), (stays - pairs).ravel() / len(truth)] - ridge / len(seen) * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
    field = Field(edges, weights, moves, (0.0, 0.0))
    mean = np.array([weighted(v, size, field) for _, v, size in seen])
    a, b = 0.0, 1.0
    for _ in range(60):  # logistic regression on one number, by Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a + b * mean, -30, 30)))
        w = p * (1 - p)
        g = np.array([(labels - p).sum() - 1e-2 * a, ((labels - p) * mean).sum() - 1e-2 * b])
        h = np.array([[w.sum() + 1e-2, (w * mean).sum()], [(w * mean).sum(), (w * mean * mean).sum() + 1e-2]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + move[0], b + move[1]
    return field._replace(curve=(float(a), float(b)))


def weighted(values: np.ndarray, size: np.ndarray, field: Field) -> float:
    """Mean of the lines' marginals of good, by length in bytes."""
    marginal, _, _ = forward_backward(field.weights[observed(values, field.edges)].sum(axis=1), field.moves)
    return float((marginal * size).sum() / size.sum())


def score(text: bytes | None, field: Field) -> float:
    values, size = measures(text or b"")
    mean = weighted(values, size, field) if len(values) else 0.0
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, field.curve[0] + field.curve[1] * mean))))


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          per_label: int = 2000, text_bytes: int = 24_000_000) -> Field:
    """Fit on at most ``per_label`` documents of each label, chosen by a hash of the id, and at most ``text_bytes`` of text.

    Both bounds hold whatever the size of the tables; a document beyond the second is passed over whole.  ``usable``: a
    condition on the labels' id.  Null labels and ids take no part.
    """
    known = labels.where(usable).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    texts = docs.select(F.col(id_col).alias("id"), F.octet_length(F.col(text_col)).alias("size")).where(F.col("size") <= text_bytes // 20)
    some = known.join(texts, "id").select("id", "label").distinct()
    chosen = [some.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(per_label) for y in (0, 1)]
    picked = chosen[0].unionByName(chosen[1])  # at most 2 * per_label rows: a broadcast of bounded size
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id").orderBy(F.xxhash64("id"), "id", "text")
    samples, room = [], text_bytes
    for r in rows.toLocalIterator():
        text = (r.text or "").encode()
        if len(text) <= room:
            room -= len(text)
            samples.append((r.label, text))
    return fit(samples)


def score_documents(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, score between 0 and 1 (higher: label 1 likelier).

    Whole texts count.  A text without words (null, empty, blank) has the score of no good line.  Null and repeated ids are
    carried along, other columns are ignored; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(t, field) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that no label may be learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) of all documents, learnt from those not held out.

    A null id isn't held out, and has no label.
    """
    field = train(docs, labels, ~held_out(id_col), id_col, text_col, **bounds)
    found = score_documents(docs, field, id_col, text_col)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
