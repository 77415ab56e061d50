"""Quality classification by Naive Bayes support vectors.

Texts are sets of hashed n-gram indicators. Each feature is scaled by the log of the ratio
between its shares of good and bad documents, and a linear hinge-loss model is fitted to
the scaled features by dual coordinate descent. A logistic curve through held-back margins
turns a margin into a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from .kernel import BASE, WORD_BYTES, byte_table, mix, rows_of, span_hashes, spans, text_chunks
from .sampling import labelled_sample

BITS = 17  # features are hashed into 2**BITS places
SAMPLE_DOCS = 1500  # labelled documents per class that the model is fitted on, chosen by hash
SMOOTH = 1.0
COST = 1.0
EPOCHS = 40
_SPACE = byte_table(b" \t\n\r\x0b\x0c")
_UPPER = byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = byte_table(b"0123456789")
# token kinds: lower-case word, capitalised word, upper-case word, number, one mark, several marks, same as the one before
_KINDS = 7


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs: words, marks, word pairs, and three kinds of token in a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = WORD_BYTES[data]
    mark = ~word & ~_SPACE[data]
    ws, we = spans(word, offsets)
    ms, me = spans(mark, offsets)
    s, e = np.concatenate((ws, ms)), np.concatenate((we, me))
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, h = rows_of(s, offsets), span_hashes(data, s, e)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    capitals = upper[e] - upper[s]
    kind = np.where(capitals == 0, 0, np.where(capitals < e - s, 1, np.where(e - s > 1, 2, 1)))
    kind = np.where(_DIGIT[data[s]], 3, kind)
    kind = np.where(~word[s], np.where(e - s == 1, 4, 5), kind)
    again = np.zeros(len(s), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    kind = np.where(again, 6, kind)
    top = np.uint64(64 - bits)
    rows, out = [row], [mix(h + np.uint64(1)) >> top]
    if len(s) > 1:
        at = np.flatnonzero(row[1:] == row[:-1])
        rows.append(row[at])
        out.append(mix(h[at] * np.uint64(BASE) + h[at + 1]) >> top)
    if len(s) > 2:
        at = np.flatnonzero(row[2:] == row[:-2])
        code = (kind[at] * _KINDS + kind[at + 1]) * _KINDS + kind[at + 2]
        rows.append(row[at])
        out.append(mix(code.astype(np.uint64) + np.uint64(1 << 40)) >> top)
    keys = np.unique((np.concatenate(rows) << bits) | np.concatenate(out).astype(np.int64))
    return keys >> bits, keys & ((1 << bits) - 1)


def _sets(texts: pa.Array, bits: int) -> Iterator[np.ndarray]:
    for i, j, data, off in text_chunks(texts):
        rows, f = features(data, off, bits)
        at = np.searchsorted(rows, np.arange(j - i + 1))
        for k in range(j - i):
            yield f[at[k] : at[k + 1]]


def log_ratios(sets: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    good, bad = np.full(size, SMOOTH), np.full(size, SMOOTH)
    for s, v in zip(sets, y, strict=True):
        (good if v > 0 else bad)[s] += 1
    return np.log((good / good.sum()) / (bad / bad.sum()))


def dual_descent(sets: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights on scaled indicators, and a bias, of the linear L1-loss support vector machine.

    Coordinate descent in the dual: one variable per document, kept within 0..cost; the bias is
    the weight of a feature that every document has. Documents have unit length.
    """
    rng = np.random.default_rng(7)
    rows = [scale[s] for s in sets]
    norm = [np.sqrt((r * r).sum() + 1) for r in rows]
    rows = [r / n for r, n in zip(rows, norm, strict=True)]
    one = [1 / n for n in norm]
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(sets))
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(sets)):
            s, x = sets[i], rows[i]
            grad = y[i] * (w[s] @ x + bias * one[i]) - 1
            new = min(max(alpha[i] - grad, 0.0), cost)  # the curvature of a unit vector is 1
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[s] += step * x
                bias += step * one[i]
                worst = max(worst, abs(step))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def margins_of(sets: Iterable[np.ndarray], weights: np.ndarray, squares: np.ndarray, bias: float) -> np.ndarray:
    return np.array([(weights[s].sum() + bias) / np.sqrt(squares[s].sum() + 1) for s in sets])


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a small ridge; targets are kept off 0 and 1."""
    pos, neg = max(1, (y > 0).sum()), max(1, (y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, beta = np.stack((m, np.ones_like(m)), 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (t - p) - 1e-3 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


@dataclass(frozen=True)
class Fitted:
    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, sets: Iterable[np.ndarray]) -> np.ndarray:
        z = self.slope * margins_of(sets, self.weights, self.squares, self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_sets(sets: list[np.ndarray], y: np.ndarray, bits: int = BITS) -> Fitted:
    """Fit on feature sets with classes +1 and -1; without both classes every score is the share of +1 seen (or 0.5)."""
    size = 1 << bits
    if not len(y) or abs(y.sum()) == len(y):
        level = 30.0 * np.sign(y.sum()) if len(y) else 0.0
        return Fitted(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0, float(level))
    part = np.arange(len(y)) % 5
    margins = np.zeros(len(y))
    for k in range(5):  # margins from models that have not seen the document
        a, b = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if not len(b) or abs(y[a].sum()) == len(a):
            continue
        scale = log_ratios([sets[i] for i in a], y[a], size)
        w, bias = dual_descent([sets[i] for i in a], y[a], scale, COST, EPOCHS // 4)
        margins[b] = margins_of([sets[i] for i in b], w * scale, scale * scale, bias)
    scale = log_ratios(sets, y, size)
    w, bias = dual_descent(sets, y, scale, COST, EPOCHS)
    slope, shift = _logistic(margins, y)
    return Fitted((w * scale).astype(np.float32), (scale * scale).astype(np.float32), bias, slope, shift)


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label", n: int = SAMPLE_DOCS, bits: int = BITS
) -> Fitted:
    """Fit on at most ``n`` labelled documents of each class, chosen by hash.

    What reaches the driver is their feature sets, each of at most 2**bits numbers. Labels other
    than 0 and 1 are ignored; a document with both labels may be drawn under either. Repeated
    documents count as often as they appear.
    """
    of = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    sample = labelled_sample(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), of, "doc_id", "text", "label", n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.astype(np.int32) for s in _sets(b.column(0), bits)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.tobytes() for s in sets], pa.binary()), b.column(1), b.column(2)], names=["features", "key", "label"]
            )

    got = sample.mapInArrow(run, "features binary, key long, label int").collect()
    got.sort(key=lambda r: (r["key"], r["label"], r["features"]))
    sets = [np.frombuffer(r["features"], np.int32).astype(np.int64) for r in got]
    return fit_sets(sets, np.array([1.0 if r["label"] else -1.0 for r in got]), bits)


def score(docs: DataFrame, model: Fitted, text: str = "text", out: str = "score", bits: int = BITS) -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1; a null or empty text gets that of no features.

    Repeated rows score alike; a column named like ``out`` is replaced; an empty table stays empty.
    """
    base = docs.drop(out) if out in docs.columns and out != text else docs
    names = base.columns
    at = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights, whatever the data

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(_sets(b.column(at), bits)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*names, out])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out, T.DoubleType())]))
