"""Quality classifier: Naive Bayes support vectors.

Indicators of byte n-grams, words, word pairs and word runs are scaled by the classes'
log-count ratios; a linear hinge-loss model is fitted to the scaled, normalised vectors
by dual coordinate descent; margins become scores by a logistic curve fitted to
out-of-fold margins. Fitting takes a bounded sample of labelled rows; scoring reads
every whole text once, without a shuffle, with the model (below 2 MB) sent along.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm import ngrams
from varloom.llm.common import with_columns
from varloom.llm.labelled import fitted, held_out, sample

#: Labelled rows to fit on at most.
TRAIN_ROWS = 6000
#: Features kept at most, and documents a feature needs.
FEATURES, MIN_DOCS = 1 << 15, 4
HOW = {"orders": (2, 3, 4), "pairs": True, "lower": False}
#: Bound of a row's dual variable and quantile of the rows' lengths below which a row stays short: of (1, 10) and
#: (0.5, 0.25, 0.1) those with the least out-of-fold log loss on training rows.
C, FLOOR, EPOCHS, FOLDS = 10.0, 0.25, 20, 3
ACCEPT = 0.7


def log_ratios(yes: np.ndarray, no: np.ndarray, n_yes: int, n_no: int) -> np.ndarray:
    """log of (share of documents with the feature among the first, over that among the second), smoothed by one."""
    return np.log((yes + 1) / (n_yes + 2)) - np.log((no + 1) / (n_no + 2))


def descend(offsets, places, values, y, c, epochs: int, n: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; ``c`` bounds each row's dual variable. The bias is a constant feature."""
    w, bias, alpha = np.zeros(n), 0.0, np.zeros(len(y))
    norms = np.add.reduceat(np.append(values**2, 0.0), np.minimum(offsets[:-1], len(values))) * (np.diff(offsets) > 0) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, v = places[offsets[i] : offsets[i + 1]], values[offsets[i] : offsets[i + 1]]
            grad = y[i] * (w[f] @ v + bias) - 1.0
            new = min(max(alpha[i] - grad / norms[i], 0.0), c[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton's method on smoothed targets."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin**2).sum(), (s * margin).sum()], [(s * margin).sum(), s.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        size = max(1.0, float(np.abs(step).max()) / 2)
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def _scaled(row: np.ndarray, r: np.ndarray, n: int, floor: float) -> np.ndarray:
    """Values r of the rows' features, scaled to length one; rows below ``floor`` stay shorter, as they tell little."""
    norm = np.sqrt(np.bincount(row, r**2, n))
    return r / np.maximum(norm, floor)[row]


def _weighed(counts: tuple[np.ndarray, np.ndarray], n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, log-count ratios) of those features that tell classes apart best, from counts by class."""
    yes, no = counts
    r = log_ratios(yes, no, n1, n0)
    # rank by how much better than chance a feature's documents are told apart
    worth = np.where(yes + no >= MIN_DOCS, np.abs(r) * np.sqrt(np.minimum(yes + no, n0 + n1 - yes - no)), 0.0)
    best = np.argsort(-worth, kind="stable")[:FEATURES]
    features = np.sort(best[worth[best] > 0]).astype(np.int32)
    return features, r[features]


def _learnt(texts: list, y: np.ndarray, counts: tuple[np.ndarray, np.ndarray], c: float) -> dict:
    """Features, ratios and weights of texts with labels, from their counts by class; nothing else is known of them."""
    features, r = _weighed(counts, int(y.sum()), int((~y).sum()))
    offsets, places = ngrams.rows(texts, ngrams.table(features), **HOW)
    row = np.repeat(np.arange(len(y)), np.diff(offsets))
    floor = max(float(np.quantile(np.sqrt(np.bincount(row, r[places] ** 2, len(y))), FLOOR)), 1e-12)
    values = _scaled(row, r[places], len(y), floor)
    # every row counts alike: weighing classes would push the bias, and with it short texts, to the rarer class
    w, bias = descend(offsets, places, values, np.where(y, 1.0, -1.0), np.full(len(y), c), EPOCHS, len(r))
    return {"features": features, "r": r, "w": w, "bias": bias, "floor": floor}


def _margins(model: dict, texts: list, keep: np.ndarray) -> np.ndarray:
    d, f = ngrams.indicators(texts, keep=keep, **HOW)
    values = _scaled(d, model["r"][f], len(texts), model["floor"])
    return np.bincount(d, model["w"][f] * values, len(texts)) + model["bias"]


def out_of_fold(texts: list, y: np.ndarray, c: float = C) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(margins, counts by class): each row's margin is of a model whose ratios, features and weights come from other folds' rows alone."""
    fold = np.arange(len(y)) % FOLDS
    some = [[t for t, f in zip(texts, fold, strict=True) if f == k] for k in range(FOLDS)]
    own = [ngrams.document_counts(some[k], y[fold == k], **HOW) for k in range(FOLDS)]
    # counts of all rows, and of all but a fold's, are sums of the folds'
    total = tuple(sum(o[i] for o in own) for i in (0, 1))
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        ins = fold != k
        if not some[k] or not 0 < int(y[ins].sum()) < int(ins.sum()):
            continue
        m = _learnt([t for t, i in zip(texts, ins, strict=True) if i], y[ins], tuple(total[i] - own[k][i] for i in (0, 1)), c)
        margin[fold == k] = _margins(m, some[k], ngrams.table(m["features"]))
    return margin, total


def fit(rows: pd.DataFrame, c: float = C) -> dict:
    """Model of rows (doc_id, text, quality). Without rows of both classes, all scores are the smoothed share of class 1."""
    y = rows["quality"].to_numpy(dtype=float) > 0
    n1, n0 = int(y.sum()), int((~y).sum())
    none = {"features": np.zeros(0, np.int32), "r": np.zeros(0), "w": np.zeros(0), "bias": 0.0, "floor": 1.0}
    if not n1 or not n0:
        return none | {"a": 0.0, "b": float(np.log((n1 + 1) / (n0 + 1)))}
    texts = rows["text"].tolist()
    margin, counts = out_of_fold(texts, y, c)
    a, b = logistic_curve(margin, np.where(y, 1.0, -1.0))
    return _learnt(texts, y, counts, c) | {"a": a, "b": b}


def predict(model: dict, texts: list[str | None], keep: np.ndarray) -> np.ndarray:
    margin = _margins(model, texts, keep)
    return 1 / (1 + np.exp(-np.clip(model["a"] * margin + model["b"], -30, 30)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row: null and blank texts get the score of no features; repeated rows score alike."""

    table = []

    def make(texts: list) -> list:
        if not table:
            table.append(ngrams.table(model["features"]))
        return [predict(model, texts, table[0])]

    return with_columns(docs, "text", ["doc_id"], [("score", T.DoubleType())], make)


def classify(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Labels come only from rows that are not held out, at most ``bound`` of them; language,
    source and id never enter a score. An empty table gives an empty result; without
    labels all scores are 0.5; other columns are ignored.
    """
    model = fitted(sample(docs, labels, bound), fit)
    scored = score(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"),
    )
