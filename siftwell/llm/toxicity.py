"""Toxic spans by a linear-chain conditional random field (operator 4).

The training tokens are labelled from their documents: in a toxic document a word is
toxic if one of its forms (the word or a prefix) is over-represented in toxic documents
by a log odds ratio of ``SURE`` standard errors or more; words of clean documents are
clean.  A two-state chain with word and prefix features is trained on them by the
gradient of its log likelihood.  Forward-backward marginals of the words give the
offending spans; a document's score is a logistic function of their maximum and sum,
fitted on the same sample.  A chain is a sentence, of whatever length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._labelled import labelled_sample
from siftwell.llm._shared import in_small_batches, plainly_named
from siftwell.llm.packing import text_chunks

#: Words, and the marks that end a sentence.
WORD = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"[^\W_]+|[.!?\u2026\n\u3002]")
#: Standard errors by which a form has to lean to toxic documents, and to either side to be a feature.
SURE, SOME = 3.5, 3.0
#: Most labelled documents of either class that training looks at.
PER_CLASS = 1500
#: Prefix lengths that are features beside the whole word.
PREFIXES = range(3, 9)
#: Words whose emission a worker remembers.
MEMORY = 300_000


def forms(word: str) -> list[str]:
    """The features of a word: itself, and its prefixes marked by a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if n < len(word))]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    moves: tuple[float, float, float, float]  # log potentials 00, 01, 10, 11
    head: tuple[float, float, float]  # document: constant, logit of the largest marginal, log of 1 + their sum

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in forms(word))


def _steps(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all chains step by step, the longest chain first, and where each step starts.

    The chains that still run at a step are the first ones of the step before.
    """
    order = np.argsort(-sizes, kind="stable")
    size, begin = sizes[order], (np.cumsum(sizes) - sizes)[order]
    running = np.searchsorted(-size, -np.arange(size[0]), side="left")
    cuts = np.append(0, np.cumsum(running))
    step = np.repeat(np.arange(len(running)), running)
    return begin[np.arange(cuts[-1]) - cuts[step]] + step, cuts


def forward_backward(e: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Chains laid end to end: P(state 1) of each word, expected moves (2 x 2, all chains), and the log partition sum.

    ``e`` has the log odds of state 1; ``moves`` the log potentials of neighbouring states.
    Messages are kept as the share of state 1.
    """
    if not len(e):
        return e, np.zeros((2, 2)), 0.0
    (t00, t01), (t10, t11) = t = np.exp(moves)
    words, cuts = _steps(sizes)
    odds = np.exp(np.clip(e, -30, 30))[words]
    norm = 1 + odds
    ahead = odds / norm
    for a, b, z in zip(cuts[:-2].tolist(), cuts[1:-1].tolist(), cuts[2:].tolist(), strict=True):
        before = ahead[a : a + z - b]
        one = (t01 + (t11 - t01) * before) * odds[b:z]
        norm[b:z] = one + t00 + (t10 - t00) * before
        ahead[b:z] = one / norm[b:z]
    behind = np.full(len(e), 0.5)
    for a, b, z in zip(cuts[-3::-1].tolist(), cuts[-2:0:-1].tolist(), cuts[:1:-1].tolist(), strict=True):
        one = behind[b:z] * odds[b:z]
        none = 1 - behind[b:z]
        stays = t10 * none + t11 * one
        behind[a : a + z - b] = stays / (stays + t00 * none + t01 * one)
    both = ahead * behind
    out = np.empty(len(e))
    out[words] = both / (both + (1 - ahead) * (1 - behind))
    later = np.arange(cuts[1], cuts[-1])
    before = ahead[later - np.repeat(np.diff(cuts[:-1]), np.diff(cuts[1:]))]
    after = np.stack([1 - behind[later], behind[later] * odds[later]])
    joint = np.stack([1 - before, before])[:, None] * t[:, :, None] * after[None]
    return out, (joint / joint.sum(axis=(0, 1))).sum(axis=2), float(np.log(norm).sum())


def log_likelihood(gold: np.ndarray, e: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of 0/1 labels: its value, its gradient in ``e`` (a word each) and in ``moves``."""
    p, hoped, log_z = forward_backward(e, sizes, moves)
    inside = np.ones(len(gold), dtype=bool)
    inside[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    after = np.flatnonzero(inside)
    real = np.bincount(2 * gold[after - 1].astype(int) + gold[after].astype(int), minlength=4).reshape(2, 2).astype(float)
    return float((gold * e).sum() + (real * moves).sum() - log_z), gold - p, real - hoped


def sentences(text: str) -> tuple[list[str], list[int]]:
    """The words of a text and the sizes of its sentences."""
    words: list[str] = []
    sizes, last = [], 0
    for t in TOKEN.findall(text):
        if t[0].isalnum():
            words.append(t)
        elif len(words) > last:
            sizes.append(len(words) - last)
            last = len(words)
    if len(words) > last:
        sizes.append(len(words) - last)
    return words, sizes


def leaning(with_toxic: np.ndarray, with_clean: np.ndarray, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds ratios of forms by the documents that hold them (half a document added), and how many standard errors that is."""
    a, b = with_toxic + 0.5, with_clean + 0.5
    c, d = toxic - with_toxic + 0.5, clean - with_clean + 0.5
    ratio = np.log(a * d) - np.log(b * c)
    return ratio, ratio / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def train(sample: list[tuple[str, int]], *, rounds: int = 30, rate: float = 0.8, ridge: float = 1e-2, sure: float = SURE) -> Model:
    """Fit the field and the document head; with one class only, every score is the smoothed share of that class."""
    total = Counter(y for _, y in sample)
    if not total[0] or not total[1]:
        share = (total[1] + 1) / (len(sample) + 2) if sample else 0.0
        return Model({}, 0.0, (0.0,) * 4, (float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), 0.0, 0.0))
    y = np.array([c for _, c in sample])
    split = [sentences(t.lower()) for t, _ in sample]
    words = sorted({w for own, _ in split for w in own})
    number = {w: k for k, w in enumerate(words)}
    known = {f: k for k, f in enumerate(sorted({f for w in words for f in forms(w)}))}
    of_word = np.repeat(np.arange(len(words)), [len(forms(w)) for w in words])
    of_form = np.array([known[f] for w in words for f in forms(w)], dtype=np.int64)
    begin = np.searchsorted(of_word, np.arange(len(words) + 1))
    seen = np.zeros((2, len(known)))
    docs = [np.array([number[w] for w in own], dtype=np.int64) for own, _ in split]
    for own, c in zip(docs, y, strict=True):
        held = np.unique(own)
        if len(held):
            seen[c, np.unique(np.concatenate([of_form[begin[k] : begin[k + 1]] for k in held.tolist()]))] += 1
    _, certain = leaning(seen[1], seen[0], total[1], total[0])
    marked = np.zeros(len(words))
    marked[of_word[(certain >= sure)[of_form]]] = 1.0
    useful = np.abs(certain) >= min(SOME, sure)
    features = {f: n for n, f in enumerate(f for f, k in known.items() if useful[k])}
    place = np.cumsum(useful) - 1
    of_word, of_feature = of_word[useful[of_form]], place[of_form[useful[of_form]]]
    ids = np.concatenate([np.zeros(0, np.int64), *docs])
    gold = marked[ids] * np.repeat(y, [len(d) for d in docs])
    sizes = np.array([n for _, own in split for n in own], dtype=np.int64)
    theta, bias, moves = np.zeros(len(features)), -3.0, np.zeros((2, 2))
    g_theta, g_bias, g_moves = np.full(len(features), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(rounds):
        score = bias + np.bincount(of_word, theta[of_feature], len(words))
        _, gap, d_moves = log_likelihood(gold, score[ids], sizes, moves)
        by_word = np.bincount(ids, gap, len(words))
        d_theta = np.bincount(of_feature, by_word[of_word], len(features)) - ridge * theta
        d_bias, d_moves = gap.sum(), d_moves - ridge * moves
        g_theta += d_theta**2
        g_bias += d_bias**2
        g_moves += d_moves**2
        theta += rate * d_theta / np.sqrt(g_theta)
        bias += rate * d_bias / np.sqrt(g_bias)
        moves += 0.2 * rate * d_moves / np.sqrt(g_moves)
    # a word's emission adds up its forms, most of which hardly weigh
    weights = {f: float(theta[k]) for f, k in features.items() if abs(theta[k]) > 1e-2}
    model = Model(weights, float(bias), tuple(float(v) for v in moves.ravel()), (0.0, 1.0, 0.0))
    own = np.array([model.emission(w) for w in words])
    p = forward_backward(own[ids], sizes, moves)[0] if len(ids) else np.zeros(0)
    x = _document_features(p, np.array([len(d) for d in docs], dtype=np.int64))
    w = np.zeros(3)
    w[1] = 1.0
    for _ in range(30):  # Newton steps of a ridge logistic regression
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (s * (1 - s))[:, None]).T @ x + np.diag([1e-2, 0.5, 0.5])
        w += np.linalg.solve(h, x.T @ (y - s) - np.array([1e-2, 0.5, 0.5]) * w)
    model.head = tuple(float(v) for v in w)
    return model


def _document_features(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Constant, scaled logit of the largest marginal, log of 1 + the sum of the marginals above a half."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    top = np.full(len(sizes), 1e-4)
    np.maximum.at(top, owner, np.clip(p, 1e-4, 1 - 1e-4))
    mass = np.bincount(owner, np.where(p >= 0.5, p, 0.0), len(sizes))
    return np.stack([np.ones(len(sizes)), np.log(top / (1 - top)) / 4, np.log1p(mass)], axis=1)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` and ``spans array<struct<start,end,score>>`` (code points) to every row of ``docs``.

    Null and empty texts have no words and the score of a document without evidence.
    Other columns pass through (own ones called ``score`` or ``spans`` are replaced);
    repeated rows repeat; an empty table stays empty.
    """
    shape = pa.schema([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])
    names = [c for c in docs.columns if c not in ("score", "spans")]
    plain = plainly_named(docs)
    places = [p for p, c in zip(plain.columns, docs.columns, strict=True) if c in names]
    plain = plain.select(*places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            scores: list[float] = []
            spans: list[list] = []
            for _, texts in text_chunks(batch, "text"):
                if len(known) > MEMORY:
                    known.clear()
                split = [sentences(t) for t in texts]
                words = [own for own, _ in split]
                for w in {w for ws in words for w in ws if w not in known}:
                    known[w] = model.emission(w.lower())
                get = known.__getitem__
                e = np.array([get(w) for ws in words for w in ws], dtype=float)
                sizes = np.array([len(ws) for ws in words], dtype=np.int64)
                p = forward_backward(e, np.array([n for _, own in split for n in own], dtype=np.int64), np.array(model.moves).reshape(2, 2))[0]
                z = _document_features(p, sizes) @ np.array(model.head)
                scores.extend((1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist())
                at = 0
                for t, size in zip(texts, sizes.tolist(), strict=True):
                    own, found = p[at : at + size], []
                    if size and own.max() >= 0.5:
                        found_words = list(WORD.finditer(t))
                        for k in np.flatnonzero(own >= 0.5).tolist():
                            a, b, v = found_words[k].start(), found_words[k].end(), float(own[k])
                            if found and found[-1][3] == k - 1:
                                found[-1][1:] = [b, max(v, found[-1][2]), k]
                            else:
                                found.append([a, b, v, k])
                    spans.append([{"start": a, "end": b, "score": v} for a, b, v, _ in found])
                    at += size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in places), pa.array(scores, shape[0].type), pa.array(spans, shape[1].type)], names=[*places, "score", "spans"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    scored = in_small_batches(plain).mapInArrow(run, f"{kinds}, score double, spans array<struct<start:bigint,end:bigint,score:double>>")
    return scored.toDF(*names, "score", "spans")


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> Model:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    return train(labelled_sample(docs, labels, "toxic", folds=folds, held_out=held_out, per_class=per_class))


def without_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``least``; columns are untouched, also those named like the operator's own."""
    kept = score_documents(plainly_named(docs), model).where(F.col("score") < least)
    return kept.drop("score", "spans").toDF(*docs.columns)
