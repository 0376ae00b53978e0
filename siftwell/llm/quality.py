"""Quality scores by naive Bayes support vectors (operator 9).

Indicators of n-grams - of one and two words or signs, and of one to three characters -
are hashed to ``2 ** BITS`` features and scaled by their class log-count ratios; a
linear hinge-loss model is fitted on them by dual coordinate descent; its margins
become probabilities by a logistic fit on sample documents that the model did not see.
Every n-gram of the sample counts, however rare.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._labelled import fold, labelled_sample
from siftwell.llm._shared import in_small_batches, plainly_named
from siftwell.llm.packing import text_chunks

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Most labelled documents of either class that training looks at.
PER_CLASS = 2000
#: Logarithm of the number of hashed features.
BITS = 20
#: Characters of an n-gram at most, and characters whose n-grams are hashed at once.
LETTERS, PART = 3, 1 << 17
MEMORY = 300_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    """Feature numbers of n-gram hashes; every kind of n-gram is spread on its own."""
    x = x ^ np.uint64(kind * int(_MIX[2]) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(64 - BITS)).astype(np.int64)


class _Known(dict):
    """Hashes of tokens in lower case, made as they are asked for."""

    def __missing__(self, token: str) -> int:
        self[token] = made = xxhash.xxh64_intdigest(token.lower().encode())
        return made


class Grams:
    """The feature numbers of texts, with a bounded memory of tokens."""

    def __init__(self) -> None:
        self.known = _Known()

    def __call__(self, text: str) -> np.ndarray:
        """Sorted, each once."""
        if len(self.known) > MEMORY:
            self.known.clear()
        tokens = TOKEN.findall(text)
        h = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        found = [_bucket(h, 1), _bucket(h[:-1] * _MIX[2] + h[1:], 2)]
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        for a in range(0, len(letters), PART):
            part = letters[a : a + PART + LETTERS - 1]
            x = np.zeros(len(part), dtype=np.uint64)
            for n in range(1, LETTERS + 1):
                x = x[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :] if len(part) >= n else x[:0]
                found.append(np.unique(_bucket(x, 2 + n)))
        return np.unique(np.concatenate(found))


@dataclass
class Model:
    weights: np.ndarray  # by feature: log-count ratio times the linear weight
    bias: float
    scale: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (margin + self.bias) + self.shift, -30, 30)))


def dual_descent(rows: list[np.ndarray], x: np.ndarray, y: np.ndarray, cost: np.ndarray, *, passes: int = 20, seed: int = 7) -> np.ndarray:
    """Hinge-loss weights: rows hold feature numbers (the last one is the constant), ``x`` the features' values."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(len(x)), np.zeros(len(rows))
    norm = np.array([float(x[r] @ x[r]) for r in rows])
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            r = rows[i]
            v = x[r]
            gradient = y[i] * float(w[r] @ v) - 1
            new = min(max(alpha[i] - gradient / max(norm[i], 1e-12), 0.0), cost[i])
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * y[i] * v
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-4:
            break
    return w


def train(sample: list[tuple[str, int]], *, cost: float = 0.003, calibration: int = 4, share: float | None = None) -> Model:
    """Fit on the sample; every ``calibration``-th document only calibrates.

    ``share`` of label 1 among all labelled documents weighs the classes of the
    calibration (default: as sampled).  With one class the score is its smoothed share.
    """
    total = Counter(y for _, y in sample)
    if not total[0] or not total[1]:
        share = (total[1] + 1) / (len(sample) + 2) if sample else 0.0
        return Model(np.zeros(0), 0.0, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    y = np.array([c for _, c in sample])
    # every n-th document of each class is kept for the calibration
    rank = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))
    held = rank % calibration == 0
    if not (y[~held] == 0).any() or not (y[~held] == 1).any() or not held.any():
        held = np.zeros(len(y), dtype=bool)
    n = [int(((y == c) & ~held).sum()) for c in (0, 1)]
    grams = Grams()
    rows = [grams(t) for t, _ in sample]
    seen = np.zeros((2, 1 << BITS))
    for r, c, h in zip(rows, y, held, strict=True):
        if not h:
            seen[c, r] += 1
    ratio = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
    # the last feature is the constant; one that the fitted documents don't hold says nothing
    x = np.append(np.where(seen.sum(axis=0) > 0, ratio, 0.0), 1.0)
    rows = [np.append(r, len(x) - 1) for r in rows]
    balance = np.where(y == 1, len(y) / (2 * total[1]), len(y) / (2 * total[0])) * cost
    fitted = np.flatnonzero(~held)
    w = dual_descent([rows[i] for i in fitted], x, np.where(y[fitted] == 1, 1.0, -1.0), balance[fitted])
    margin = np.array([float(w[r] @ x[r]) for r in rows])
    on = held if held.any() else np.ones(len(y), dtype=bool)
    scale, shift = _logistic(margin[on], y[on], share if share else total[1] / len(y))
    return Model((w * x)[:-1], float(w[-1]), scale, shift)


def _logistic(margin: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Platt's fit, with the classes weighed by their shares so that it doesn't depend on how the sample was drawn."""
    t = np.where(y == 1, (np.sum(y == 1) + 1) / (np.sum(y == 1) + 2), 1 / (np.sum(y == 0) + 2))
    weight = np.where(y == 1, share / max(1, np.sum(y == 1)), (1 - share) / max(1, np.sum(y == 0))) * len(y)
    x, w = np.stack([margin, np.ones(len(margin))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (t - p)) - 1e-3 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0.0)), float(w[1])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` to every row of ``docs``.

    Null and empty texts have no n-grams and get the score of the constant alone.
    Other columns pass through (an own ``score`` is replaced); repeated rows repeat; an
    empty table stays empty.
    """
    names = [c for c in docs.columns if c != "score"]
    plain = plainly_named(docs)
    places = [p for p, c in zip(plain.columns, docs.columns, strict=True) if c in names]
    plain = plain.select(*places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, weights = Grams(), model.weights
        for batch in batches:
            margins = [float(weights[grams(t)].sum()) if len(weights) else 0.0 for _, texts in text_chunks(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in places), pa.array(model.probability(np.array(margins, dtype=float)))], names=[*places, "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return in_small_batches(plain).mapInArrow(run, f"{types}, score double").toDF(*names, "score")


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> Model:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    usable = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    share = usable.agg(F.avg("quality")).first()[0]
    return train(labelled_sample(docs, labels, "quality", folds=folds, held_out=held_out, per_class=per_class), share=share)
