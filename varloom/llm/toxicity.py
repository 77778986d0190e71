"""Toxicity by a classifier chain.

Categories are predicted in turn by linear models over hashed indicators (words and byte
n-grams of lower-case text); each model also sees the log-odds that the models before it
give. In fitting, those come from models that have not seen the row (out of fold). The
labels table marks two properties; the chain is form (low quality), then toxicity, then
toxicity in documents of low form.
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
TRAIN_ROWS = 9000
FEATURES, MIN_DOCS, FOLDS = 6000, 3, 3
HOW = {"orders": (4, 5, 6), "pairs": False, "lower": True}
CHAIN = ("low_form", "toxic", "toxic_low_form")
THRESHOLD = 0.5
EPOCHS, BATCH, RATE, DECAY = 24, 128, 0.3, 2e-6


def _targets(rows: pd.DataFrame) -> np.ndarray:
    low = rows["quality"].to_numpy(dtype=float) <= 0
    toxic = rows["toxic"].to_numpy(dtype=float) > 0
    return np.stack([low, toxic, low & toxic], axis=1)


def _chosen(yes: np.ndarray, no: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Features whose documents depart most from the class's share, by signed chi-square; mostly marks of the class."""
    total = yes + no
    expected = total * n1 / max(n1 + n0, 1)
    chi = np.where((total >= MIN_DOCS) & (yes > expected), (yes - expected) ** 2 / np.maximum(expected, 1e-9), 0.0)
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    return best[chi[best] > 4.0]


def _z(w, bias, v, offsets, places, before) -> np.ndarray:
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(row, w[places], n) + bias + before @ v


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(offsets, places, before, y, n: int, seed: int = 3) -> tuple[np.ndarray, float, np.ndarray]:
    """Logistic regression by adaptive mini-batch gradients: weights, bias, weights of the earlier log-odds."""
    k = before.shape[1]
    p0 = (y.sum() + 1) / (len(y) + 2)
    w, bias, v = np.zeros(n), float(np.log(p0 / (1 - p0))), np.zeros(k)
    gw, gb, gv = np.full(n, 1e-2), 1e-2, np.full(k, 1e-2)
    rng = np.random.default_rng(seed)
    size = np.diff(offsets)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            ins = order[at : at + BATCH]
            o = np.concatenate(([0], np.cumsum(size[ins])))
            f = places[np.repeat(offsets[ins] - o[:-1], size[ins]) + np.arange(o[-1])]
            row = np.repeat(np.arange(len(ins)), size[ins])
            err = _sigmoid(np.bincount(row, w[f], len(ins)) + bias + before[ins] @ v) - y[ins]
            hit, back = np.unique(f, return_inverse=True)
            g = np.bincount(back, err[row], len(hit)) / BATCH + DECAY * w[hit]
            gw[hit] += g**2
            w[hit] -= RATE * g / np.sqrt(gw[hit])
            b = err.mean()
            gb += b**2
            bias -= RATE * b / np.sqrt(gb)
            if k:
                gk = before[ins].T @ err / BATCH
                gv += gk**2
                v -= RATE * gk / np.sqrt(gv)
    return w, bias, v


def _chosen_of_all(counts: list, y: np.ndarray) -> np.ndarray:
    """Features of all categories, from each category's counts over the rows with targets ``y``."""
    chosen = [np.zeros(0, np.int64)]
    for c in range(len(CHAIN)):
        n1 = int(y[:, c].sum())
        if 0 < n1 < len(y):
            chosen.append(_chosen(*counts[c], n1, len(y) - n1))
    return np.unique(np.concatenate(chosen)).astype(np.int32)


def _picked(offsets: np.ndarray, places: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and places of some rows."""
    size = np.diff(offsets)[which]
    o = np.concatenate(([0], np.cumsum(size)))
    return o, places[np.repeat(offsets[which] - o[:-1], size) + np.arange(o[-1])]


def out_of_fold(texts: list, y: np.ndarray) -> tuple[np.ndarray, list]:
    """(log-odds by category, counts): those of each row by a chain that has learnt, features included, from other folds alone.

    Inside the folds that teach, later links are taught with log-odds that are out of
    fold there as well, where those folds take turns.
    """
    fold = np.arange(len(y)) % FOLDS
    own = []
    for k in range(FOLDS):
        some = [t for t, f in zip(texts, fold, strict=True) if f == k]
        own.append([ngrams.document_counts(some, y[fold == k, c], **HOW) for c in range(len(CHAIN))])
    total = [tuple(sum(o[c][i] for o in own) for i in (0, 1)) for c in range(len(CHAIN))]
    before = np.zeros((len(y), len(CHAIN)))
    for k in range(FOLDS if len(y) >= FOLDS else 0):
        features = _chosen_of_all([tuple(total[c][i] - own[k][c][i] for i in (0, 1)) for c in range(len(CHAIN))], y[fold != k])
        offsets, places = ngrams.rows(texts, ngrams.table(features), **HOW)
        others, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        inner = np.zeros((len(y), 0))
        for c in range(len(CHAIN)):
            t, out = y[:, c].astype(float), np.zeros(len(y))
            for j in (x for x in range(FOLDS) if x != k):
                ins = np.flatnonzero((fold != k) & (fold != j))
                m = logistic(*_picked(offsets, places, ins), inner[ins], t[ins], len(features))
                out = np.where(fold == j, _z(*m, offsets, places, inner), out)
            m = logistic(*_picked(offsets, places, others), inner[others], t[others], len(features))
            out[held] = _z(*m, *_picked(offsets, places, held), inner[held])
            inner = np.column_stack([inner, np.clip(out, -8, 8)])
        before[held] = inner[held]
    return before, total


def fit(rows: pd.DataFrame) -> dict:
    """Chain of models of rows (doc_id, text, quality, toxic); a category without both classes gets its smoothed share.

    A link learns from all rows, and sees for each the earlier categories' log-odds that are out of fold.
    """
    y = _targets(rows)
    texts = rows["text"].tolist()
    before, counts = out_of_fold(texts, y)
    features = _chosen_of_all(counts, y)
    offsets, places = ngrams.rows(texts, ngrams.table(features), **HOW)
    links = [logistic(offsets, places, before[:, :c], y[:, c].astype(float), len(features)) for c in range(len(CHAIN))]
    return {"features": features, "links": links}


def predict(model: dict, texts: list[str | None], keep: np.ndarray) -> np.ndarray:
    """(n, categories) probabilities."""
    offsets, places = ngrams.rows(texts, keep, **HOW)
    before = np.zeros((len(texts), 0))
    for link in model["links"]:
        z = _z(*link, offsets, places, before)
        before = np.column_stack([before, np.clip(z, -8, 8)])
    return _sigmoid(before)


def model_of(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> dict:
    return fitted(sample(docs, labels, bound), fit)


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` with a column p_<category> for each category and toxic (0 or 1).

    Null and blank texts have no features and get the chain's base rates; repeated rows
    score alike; an empty table gives an empty result; columns of these names are replaced.
    """
    names = [f"p_{c}" for c in CHAIN]
    rest = [c for c in docs.columns if c not in (*names, "toxic")]
    table = []

    def make(texts: list) -> list:
        if not table:
            table.append(ngrams.table(model["features"]))
        return list(predict(model, texts, table[0]).T)

    out = with_columns(docs, "text", rest, [(c, T.DoubleType()) for c in names], make)
    return out.withColumn("toxic", F.when(F.col("p_toxic") >= THRESHOLD, 1).otherwise(0))


def judge(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, p_<category>..., toxic) of every row of ``docs``."""
    s = scored(docs.select("doc_id", "text"), model_of(docs, labels, bound)).drop("text")
    return s.withColumn("held_out", held_out(F.col("doc_id")))
