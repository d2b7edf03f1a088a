"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models. Each later model also gets the probabilities of the
categories before it; in training these are out-of-fold predictions, so it sees them as uncertain as they will be.
Training texts are a bounded sample of the labelled rows (MAX_ROWS, taken by a hash of the id); scoring is a map over
all texts, without a shuffle.

Categories, in the chain's order: plain (toxic, and written in the most frequent language of the labelled rows), other
(toxic, in any other language), toxic (the label itself).

Defined results: a null or empty text has no feature and gets the models' base rates. Rows with a null id or label
aren't trained on, but are scored. Repeated rows each get a row. With no labelled row all probabilities are 0. Ties in the
sample go by the hash of the id. An empty table gives an empty table. A text of any length is scored whole. Columns of the
input that have a new column's name, case aside, are replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .kit import map_texts, slices, text_array

CATEGORIES = ("plain", "other", "toxic")
#: Labelled rows to train on at most.
MAX_ROWS = 3000
#: Features that a model uses at most, and documents that a feature must occur in.
MAX_FEATURES, MIN_DOCS = 1500, 3
#: Standard errors by which a feature's frequencies in the two classes have to differ.
MIN_SCORE = 4.0
FOLDS, STEPS, RATE, RIDGE = 3, 300, 0.8, 1e-3
THRESHOLD = 0.5
#: Words that a worker remembers.
MEMO = 400_000
#: Letters of the word beginnings that count as features beside whole words.
PREFIXES = (4, 5, 6, 7)


def forms(word: bytes) -> list[str]:
    """The features of a word: its letters, and its beginnings."""
    w = "".join(c for c in word.decode("utf-8", "replace").lower() if c.isalpha())
    if not w:
        return []
    return ["=" + w, *(w[:k] for k in PREFIXES if len(w) > k)]


def count_features(texts: pa.Array, features_of: Callable[[bytes], Sequence[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the features that features_of gives for a word."""
    raw, _, starts, ends, first = words.of(texts)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    code = words.codes(raw, starts, ends)
    n = int(code.max()) + 1
    where = np.zeros(n, np.int64)
    where[code[::-1]] = np.arange(len(code))[::-1]
    ids: list[int] = []
    size = np.zeros(n, np.int64)
    for k, (a, b) in enumerate(zip(starts[where].tolist(), ends[where].tolist(), strict=True)):
        if own := features_of(bytes(raw[a:b])):
            ids += own
            size[k] = len(own)
    bounds = np.concatenate([[0], np.cumsum(size)])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hit = np.flatnonzero(size[code])
    each, at = code[hit], size[code[hit]]
    flat = np.repeat(bounds[each] - (np.cumsum(at) - at), at) + np.arange(int(at.sum()))
    feature = np.array(ids, np.int64)[flat]
    if not len(feature):
        return (np.zeros(0, np.int64),) * 3
    width = int(feature.max()) + 1
    pair, count = np.unique(np.repeat(text[hit], at) * width + feature, return_counts=True)
    return pair // width, pair % width, count


@dataclass
class Linear:
    """A logistic model over log counts of some features, and over earlier probabilities."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    chain: np.ndarray

    def predict(self, x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return _sigmoid(x[:, self.features] @ self.weights + earlier @ self.chain + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def select(rows: np.ndarray, features: np.ndarray, y: np.ndarray, keep: np.ndarray, width: int) -> np.ndarray:
    """The features whose document frequencies differ most between the classes, among the rows of keep."""
    use = keep[rows]
    hot, cold = (np.bincount(features[use & (y[rows] == v)], minlength=width).astype(float) for v in (1, 0))
    n1, n0 = max(1.0, float(y[keep].sum())), max(1.0, float((1 - y[keep]).sum()))
    p = (hot + cold) / (n1 + n0)
    score = np.abs(hot / n1 - cold / n0) / np.sqrt(p * (1 - p) / n1 + p * (1 - p) / n0 + 1e-9)
    score[(hot + cold < MIN_DOCS) | (score < MIN_SCORE)] = 0
    best = np.argsort(-score, kind="stable")[:MAX_FEATURES]
    return np.sort(best[score[best] > 0])


def fit(x: np.ndarray, features: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Full-batch AdaGrad on the log loss with a ridge."""
    a = np.hstack([x[:, features], earlier]).astype(np.float32)
    w, g2 = np.zeros(a.shape[1], np.float32), np.full(a.shape[1], 1e-6, np.float32)
    rate = float(y.mean()) if len(y) else 0.0
    bias = float(np.log((rate + 1e-4) / (1 - rate + 1e-4)))
    for _ in range(STEPS):
        r = (_sigmoid(a @ w + bias) - y).astype(np.float32) / len(y)
        g = a.T @ r + RIDGE * w / len(y)
        g2 += g * g
        w -= RATE * g / np.sqrt(g2)
        bias -= RATE * float(r.sum())
    k = len(features)
    return Linear(features, w[:k].astype(float), bias, w[k:].astype(float))


@lru_cache(maxsize=1)
def _memo(key: int) -> dict[bytes, tuple[int, ...]]:
    return {}


@dataclass
class Chain:
    """The fitted models over the columns of `index`."""

    index: dict[str, int]
    models: list[Linear]
    key: int = 0

    def features_of(self, word: bytes) -> Sequence[int]:
        """Remembered by the worker, for words come again in other slices and tasks."""
        memo = _memo(self.key)
        if (known := memo.get(word)) is None:
            if len(memo) > MEMO:
                memo.clear()
            known = memo[word] = tuple(self.index[f] for f in forms(word) if f in self.index)
        return known

    def predict(self, texts: pa.Array) -> np.ndarray:
        """Probabilities (texts by categories)."""
        out = np.zeros((len(texts), len(CATEGORIES)))
        if not self.models:
            return out
        text, feature, count = count_features(texts, self.features_of)
        for at in range(0, len(texts), 2000):
            use = (text >= at) & (text < at + 2000)
            x = np.zeros((min(2000, len(texts) - at), len(self.index)))
            x[text[use] - at, feature[use]] = np.log1p(count[use])
            for k, m in enumerate(self.models):
                out[at : at + len(x), k] = m.predict(x, out[at : at + len(x), :k])
        return out


def train(texts: pa.Array, labels: np.ndarray) -> Chain:
    """labels: rows by CATEGORIES, 0 or 1."""
    n = len(texts)
    if not n:
        return Chain({}, [])
    vocabulary: dict[str, int] = {}
    parts = []
    for at, to in slices(texts):
        r, f, c = count_features(texts.slice(at, to - at), lambda w: [vocabulary.setdefault(x, len(vocabulary)) for x in forms(w)])
        parts.append((r + at, f, c))
    rows, features, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    fold = np.arange(n) % FOLDS
    chosen, pieces = [], []
    for k in range(len(CATEGORIES)):
        y = labels[:, k]
        sets = [select(rows, features, y, fold != f, len(vocabulary)) for f in range(FOLDS)] + [select(rows, features, y, np.ones(n, bool), len(vocabulary))]
        chosen.append(sets)
        pieces += sets
    used = np.unique(np.concatenate(pieces))
    x = np.zeros((n, len(used)), np.float32)
    column = np.full(len(vocabulary), -1)
    column[used] = np.arange(len(used))
    hit = column[features] >= 0
    x[rows[hit], column[features[hit]]] = np.log1p(counts[hit])
    earlier, models = np.zeros((n, 0)), []
    for k, sets in enumerate(chosen):
        y, out = labels[:, k].astype(float), np.zeros(n)
        for f in range(FOLDS):
            train_on, held = fold != f, fold == f
            if train_on.any() and held.any():
                out[held] = fit(x[train_on], column[sets[f]], earlier[train_on], y[train_on]).predict(x[held], earlier[held])
        models.append(fit(x, column[sets[-1]], earlier, y))
        earlier = np.hstack([earlier, out[:, None]])
    # Only the features of the final models go on.
    final = np.unique(np.concatenate([m.features for m in models])).astype(np.int64)
    place = {int(c): i for i, c in enumerate(final)}
    for m in models:
        m.features = np.array([place[int(c)] for c in m.features], np.int64)
    kept = used[final]
    names = list(vocabulary)
    index = {names[c]: i for i, c in enumerate(kept.tolist())}
    return Chain(index, models, xxhash.xxh64_intdigest("\n".join(index)))


def sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS) -> tuple[pa.Array, np.ndarray]:
    """Texts and categories of at most `limit` labelled rows. Only their ids are sent to the documents' scan."""
    named = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    few = named.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(limit)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    table = own.join(F.broadcast(few), "doc_id").orderBy("doc_id", "text").limit(limit).toArrow()
    texts, toxic, langs = text_array(table.column("text")), table.column("toxic").to_numpy().astype(np.int64), table.column("lang").to_pylist()
    common = max(sorted({x for x in langs if x}), key=langs.count, default=None)
    plain = np.array([x == common for x in langs], bool)
    return texts, np.stack([toxic * plain, toxic * ~plain, toxic], axis=1) if len(texts) else np.zeros((0, len(CATEGORIES)), np.int64)


def score(docs: DataFrame, chain: Chain, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds p_<category> for each category, and toxic: whether the last one reaches THRESHOLD."""

    def each(texts: pa.Array) -> list[pa.Array]:
        p = chain.predict(texts)
        return [*(pa.array(np.round(p[:, k], 6)) for k in range(len(CATEGORIES))), pa.array(p[:, -1] >= THRESHOLD)]

    return map_texts(docs, text, each, [*((f"p_{c}", T.DoubleType()) for c in CATEGORIES), ("toxic", T.BooleanType())], keep)
