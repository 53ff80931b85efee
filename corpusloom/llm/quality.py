"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, temperature-calibrated probabilities."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, held_out, table
from .toxicity import thin

TOKEN = re.compile(r"\w+|[^\w\s]")
DIM, SEEDS, HIDDEN = 64, 4, 24
CLASSES = ("UPPER", "Capital", "lower", "digit", "mark")
STATS = 7


@dataclass
class QualityModel:
    """Bounded by the size of the vocabulary, a parameter of train()."""

    ids: dict[str, int]
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float


def shape(token: str) -> int:
    if not (token[0].isalnum() or token[0] == "_"):
        return 4
    if token.isdigit():
        return 3
    return 0 if len(token) > 1 and token.isupper() else 1 if token[0].isupper() else 2


def index_vector(word: str) -> np.ndarray:
    """Sparse and ternary, from the word's hash alone: any executor makes the same one."""
    v = np.zeros(DIM, np.float32)
    for k in range(SEEDS):
        h = zlib.crc32(f"{k}:{word}".encode())
        v[h % DIM] += 1 if h >> 16 & 1 else -1
    return v


class Ids(dict):
    """Token to row of the vectors; a word outside the vocabulary has its shape's row."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = value = self.known.get(token, shape(token))
        return value


def learn_vectors(docs: Callable[[], Iterable[list[str]]], size: int) -> tuple[dict[str, int], np.ndarray]:
    """A word's vector: its own index vector and those of the two words on either side of each occurrence, scaled to length one."""
    seen = Counter()
    for d in docs():
        seen.update(set(d))
    words = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n >= 3][:size]
    ids = {w: k + len(CLASSES) for k, w in enumerate(words)}
    base = np.stack([index_vector(f"<{c}>") for c in CLASSES] + [index_vector(w) for w in words])
    context = np.zeros_like(base)
    known = Ids()
    known.known = ids
    for d in docs():
        row = np.fromiter((known[t] for t in d), np.int64, len(d))
        for k in (1, 2):
            for a, b in ((row[k:], row[:-k]), (row[:-k], row[k:])):
                np.add.at(context, a, base[b])
    rest = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = base + context / np.maximum(rest, 1e-6)
    return ids, (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def pooled(texts: list, known: Ids, vectors: np.ndarray) -> np.ndarray:
    """Per document: the mean of its words' vectors, and statistics of the pool. Zeros for an empty text."""
    out = np.zeros((len(texts), vectors.shape[1] + STATS), np.float32)
    for k, text in enumerate(texts):
        tokens = TOKEN.findall(text) if text else ()
        n = len(tokens)
        if not n:
            continue
        ids = np.array([known[t] for t in tokens])
        rows, counts = np.unique(ids, return_counts=True)
        out[k, :DIM] = counts @ vectors[rows] / n
        marks = sum(map(tokens.count, ("!", "|", "%", "&", "#", "*", "$"))) if n < 50 else sum(text.count(c) for c in "!|%&#*$")
        out[k, DIM:] = (np.log1p(n), len(set(tokens)) / n ** 0.8, sum(map(str.__eq__, tokens[1:], tokens)) / n, marks / n, sum(map(str.isupper, tokens)) / n, text.count("\n") / n, len(text) / n / 10)
    return out


def forward(x: np.ndarray, layers: tuple) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, rounds: int = 400, l2: float = 1e-4) -> tuple:
    """Full-batch Adam, with a fixed start; classes weigh the same."""
    rng = np.random.default_rng(7)
    theta = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    share = max(y.mean(), 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-3)) / len(y)
    for k in range(1, rounds + 1):
        hidden, z = forward(x, theta)
        d = weight * (sigmoid(z) - y)
        back = np.outer(d, theta[2]) * (1 - hidden**2)
        grads = [x.T @ back + l2 * theta[0], back.sum(0), hidden.T @ d + l2 * theta[2], d.sum()]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            theta[i] = theta[i] - 0.02 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return tuple(theta)


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that the network wasn't fitted on."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [-np.mean(np.log(np.clip(np.where(y > 0, sigmoid(z / t), sigmoid(-z / t)), 1e-9, 1))) for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(rows: list, vocabulary: int = 3_000) -> QualityModel:
    """From (doc_id, text, label) rows on the driver, a bounded number; one in five sets the temperature."""
    rows = sorted(rows, key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))
    texts, y = [r["text"] or "" for r in rows], np.array([float(r["label"]) for r in rows])
    ids, vectors = learn_vectors(lambda: map(TOKEN.findall, texts), vocabulary)
    known = Ids()
    known.known = ids
    x = pooled(texts, known, vectors)
    shift, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    x = np.clip((x - shift) / scale, -6, 6)
    if len(set(y.tolist())) < 2:
        prior = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(ids, vectors, shift, scale, (np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.log(prior / (1 - prior))), 1.0)
    aside = np.arange(len(y)) % 5 == 0
    layers = fit_network(x[~aside], y[~aside])
    return QualityModel(ids, vectors, shift, scale, layers, fit_temperature(forward(x[aside], layers)[1], y[aside]))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 up).

    Null and empty texts have an empty pool and the score that the network gives it; repeated rows score
    alike; equal scores stay equal; columns of the output's names are replaced; an empty table gives none. Row
    by row, without a shuffle; texts are taken in slices of some megabytes, a longer one by itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value
        known = Ids()
        known.known = model.ids

        def apply(texts):
            x = np.clip((pooled(texts, known, model.vectors) - model.shift) / model.scale, -6, 6)
            s = sigmoid(forward(x, model.layers)[1] / model.temperature).tolist()
            return [s, [int(v >= 0.5) for v in s]]

        return apply

    return append_columns(docs, [text_col], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], start)


def op8_quality(spark: SparkSession, sf_dir: str, sample: int = 2_000) -> DataFrame:
    """Every document's quality, learned from at most about ``sample`` labelled documents a class."""
    model = train(thin(spark, sf_dir, "quality", 3, 1, sample).collect())
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
