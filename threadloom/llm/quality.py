"""A quality classifier by co-training.

Two views of a document: its content (hashed byte bigrams and word shapes) and its page's metadata (source,
language, size). Each view has a logistic regression of its own. In each round either classifier labels
the documents of an unlabelled pool that it is surest of, for the other to learn from. Both are then
calibrated on labelled documents held back, and every document is scored by the calibrated views together.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import bound_batches, bounded_sample, fresh, unit_hash

#: Labelled documents, and documents of the unlabelled pool, that the classifiers are fitted on at most.
LABELLED, POOL = 4000, 2000
ROUNDS = 4
#: Documents that a view labels in a round, as a share of the pool; and how sure it must be.
SHARE, SURE = 0.1, 0.9
#: A document is kept from this combined probability of good quality on.
KEEP = 0.2
GRAMS, META = 1024, 64
SHAPES = 14
_SLICE = 1 << 20


def content(text: str | None) -> np.ndarray:
    """Hashed byte bigrams (unit length) and shares of kinds of characters, over the whole text."""
    data = np.frombuffer(("" if text is None else text).encode("utf-8", "replace"), dtype=np.uint8)
    grams, single = np.zeros(GRAMS), np.zeros(256)
    for s in range(0, len(data), _SLICE):
        d = data[s : s + _SLICE + 1].astype(np.uint32)
        grams += np.bincount((((d[:-1] << 8 | d[1:]) * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int64), minlength=GRAMS)
        single += np.bincount(d[:_SLICE], minlength=256)
    n = max(1.0, single.sum())
    norm = np.linalg.norm(grams)
    upper, lower, digits = single[65:91].sum(), single[97:123].sum(), single[48:58].sum()
    marks = single[[35, 36, 37, 38, 42, 64, 94, 126]].sum()
    words = (text or "").split()
    again = sum(map(operator.eq, words, words[1:])) / max(1, len(words))
    shapes = [again, len(set(words)) / max(1, len(words)), upper / n, lower / n, digits / n, marks / n, single[33] / n, single[124] / n, single[32] / n, single[10] / n, single[[44, 46]].sum() / n, single[128:].sum() / n, upper / max(1.0, upper + lower), min(1.0, np.log1p(n) / 16)]
    return np.concatenate([grams / norm if norm else grams, np.array(shapes) * 3]).astype(np.float32)


def metadata(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """One-hot hashed source and language, and the size by powers of two."""
    x = np.zeros(META, dtype=np.float32)
    x[zlib.crc32(repr(source).encode()) % 32] = 1
    x[32 + zlib.crc32(repr(lang).encode()) % 8] = 1
    x[40 + (23 if n_chars is None or n_chars != n_chars else min(22, int(np.log2(1 + max(0.0, n_chars)))))] = 1
    return x


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Weights and the bias last, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1))])  # in doubles, as the weights are: else every product converts it again
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / weight.sum()
    step = 1.0 / (0.25 * float((np.square(x).sum(1) * weight).sum()) + l2)
    w = v = np.zeros(x.shape[1])
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - step * (x.T @ (weight * (p - y)) + l2 * v)
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def margin(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


@dataclass
class Model:
    """Weights of both views, their calibrations (slope, intercept), the log odds of good quality before any view."""

    content: np.ndarray | None = None
    metadata: np.ndarray | None = None
    calibration: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    prior: float = 0.0

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: both views, content, metadata."""
        if self.content is None:
            half = np.full(len(text), 0.5)
            return half, half, half
        (a, b), (c, d) = self.calibration
        t, m = a * margin(self.content, text) + b, c * margin(self.metadata, meta) + d
        return sigmoid(np.clip(t + m - self.prior, -30, 30)), sigmoid(t), sigmoid(m)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (none below 0) and intercept of the log odds, with Platt's smoothed targets."""
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(1.0, float(np.abs(z).max()))
    w = logistic((z / scale).reshape(-1, 1).astype(np.float32), target, l2=1e-5, rounds=500)
    if w[0] < 0:
        return 0.0, float(np.log((good + 1) / (bad + 1)))
    return float(w[0] / scale), float(w[1])


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """From the features of documents and their labels (1, 0; -1: of the unlabelled pool)."""
    known = np.flatnonzero(y >= 0)
    if len(known) < 8 or len(set(y[known].tolist())) < 2:
        return Model()
    back = known[np.arange(len(known)) % 4 == 3]
    if len(set(y[back].tolist())) < 2:
        back = known
    own = np.setdiff1d(known, back) if len(back) < len(known) else known
    if len(set(y[own].tolist())) < 2:
        own = known
    pool = np.flatnonzero(y < 0)
    views = (text, meta)
    taught: tuple[dict[int, int], dict[int, int]] = ({}, {})
    good = float(y[own].mean())

    def learn(view: int) -> np.ndarray:
        extra = np.array(sorted(taught[view]), dtype=int)
        rows, labels = np.concatenate([own, extra]), np.concatenate([y[own], [taught[view][i] for i in extra]])
        n = np.bincount(labels.astype(int), minlength=2)
        return logistic(views[view][rows], labels, np.where(labels == 1, 0.5 / max(1, n[1]), 0.5 / max(1, n[0])))

    weights = [learn(0), learn(1)]
    for _ in range(rounds if len(pool) else 0):
        for view in (0, 1):
            p = sigmoid(margin(weights[view], views[view][pool]))
            sure = max(1, int(SHARE * len(pool)))
            for i in pool[np.argsort(-p, kind="stable")[: max(1, int(sure * good))]]:
                if sigmoid(margin(weights[view], views[view][i : i + 1]))[0] >= SURE:
                    taught[1 - view][int(i)] = 1
            for i in pool[np.argsort(p, kind="stable")[: max(1, int(sure * (1 - good)))]]:
                if sigmoid(margin(weights[view], views[view][i : i + 1]))[0] <= 1 - SURE:
                    taught[1 - view][int(i)] = 0
        weights = [learn(0), learn(1)]
    n = np.bincount(y[back].astype(int), minlength=2)
    return Model(weights[0], weights[1], (platt(margin(weights[0], text[back]), y[back]), platt(margin(weights[1], meta[back]), y[back])), float(np.log((n[1] + 1) / (n[0] + 1))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted on at most LABELLED labelled documents and a pool of at most POOL others, those with the smallest hashes.

    Both are fitted in one task on an executor; the driver gets the weights. Labels other than 0 and 1 are
    left out; a document with several labels takes the smallest; copies count once.
    """
    docs = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    labels = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    n_labels, n_docs = labels.count(), docs.count()
    if not n_labels or not n_docs:
        return Model()
    few = lambda name, n, total: unit_hash(F.col("doc_id").cast("string"), name) < min(1.0, 3 * n / total)
    labelled = docs.join(labels.filter(few("labelled", LABELLED, n_labels)), "doc_id")
    pool = docs.join(labels.select("doc_id"), "doc_id", "left_anti").withColumn("quality", F.lit(-1))
    rows = bounded_sample(labelled, LABELLED, 1, "labelled").unionByName(bounded_sample(pool, POOL, n_docs, "pool"))

    def train(batches):
        order, quality, text, meta = [], [], [], []
        for b in batches:
            order += [(zlib.crc32(str(int(i)).encode()), int(i)) for i in b["doc_id"].fillna(-1)]
            quality += b["quality"].tolist()
            text += [content(t) for t in b["text"]]
            meta += [metadata(*r) for r in zip(b["source"], b["lang"], b["n_chars"], strict=True)]
        if order:
            at = sorted(range(len(order)), key=order.__getitem__)
            m = cotrain(np.stack(text)[at], np.stack(meta)[at], np.array(quality)[at])
            if m.content is not None:
                yield pd.DataFrame({"content": [m.content], "metadata": [m.metadata], "calibration": [np.array(m.calibration).ravel()], "prior": [m.prior]})

    got = rows.coalesce(1).mapInPandas(train, "content array<double>, metadata array<double>, calibration array<double>, prior double").first()
    if got is None:
        return Model()
    a, b, c, d = got["calibration"]
    return Model(np.array(got["content"]), np.array(got["metadata"]), ((a, b), (c, d)), got["prior"])


def quality_column(model: Model, text: Column, source: Column, lang: Column, n_chars: Column) -> Column:
    """struct<score, content_score, metadata_score double>."""

    @F.pandas_udf("score double, content_score double, metadata_score double")
    def score(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        if not len(text):
            return pd.DataFrame({"score": [], "content_score": [], "metadata_score": []}, dtype="float64")
        both, t, m = model.score(np.stack([content(x) for x in text]), np.stack([metadata(*r) for r in zip(source, lang, n_chars, strict=True)]))
        return pd.DataFrame({"score": both, "content_score": t, "metadata_score": m})

    return score.asNondeterministic()(text, source, lang, n_chars.cast("double"))


def score_quality(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, score, content_score, metadata_score, keep: one row a row of ``docs``.

    Null columns are features of their own (a null text is an empty one). Without labels of both kinds
    every score is 0.5 and every document is kept. Extra columns are not read; repeated rows give repeated rows.
    """
    bound_batches(docs.sparkSession)
    model = model or fit(docs, labels)
    out = docs.select("doc_id", quality_column(model, *map(F.col, ("text", "source", "lang", "n_chars"))).alias("__q")).select("doc_id", "__q.*")
    return out.withColumn("keep", F.col("score") >= KEEP)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept.

    Nulls, empty texts, missing labels and repeats as in ``score_quality``; very long texts are read whole, an empty table gives an
    empty one, and other columns, whatever their names, are carried along.
    """
    bound_batches(docs.sparkSession)
    model = fit(docs, labels)
    own = fresh(docs, "__quality")
    return docs.withColumn(own, quality_column(model, *map(F.col, ("text", "source", "lang", "n_chars")))).filter(F.col(f"{own}.score") >= KEEP).drop(own)
