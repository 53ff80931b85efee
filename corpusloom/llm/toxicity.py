"""Toxicity: a linear-chain conditional random field tags toxic spans; forward-backward marginals give document scores and offsets."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bounded_sample, held_out, table

WORD = re.compile(r"\w+")
BUCKETS = 1 << 14
CACHE = 200_000


@dataclass
class ToxicityModel:
    """Bounded: a lexicon of at most lexicon_size words, hashed word weights, a 2 x 2 transition table, a calibration."""

    lexicon: dict[str, float]
    words: np.ndarray
    emission: np.ndarray
    transition: np.ndarray
    start: float
    calibration: np.ndarray


class Emissions(dict):
    """Log-odds of the toxic state by token, computed when a token is first met."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        x = features(token, self.model.lexicon)
        value = float(np.clip(self.model.words[bucket(token)] + self.model.emission @ x, -25, 25))
        self[token] = value
        return value


def bucket(token: str) -> int:
    return zlib.crc32(token.lower().encode()) % BUCKETS


def features(token: str, lexicon: dict[str, float]) -> np.ndarray:
    lo = lexicon.get(token.lower(), 0.0)
    return np.array([1.0, lo, float(lo > 2), float(len(token) > 3 and token.isupper()), float(token.isdigit())])


def packed(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains run in lockstep, longest first: where each token goes, by document; where each step starts; how many chains each step has."""
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    top = int(lengths.max(initial=0))
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(top), side="right")
    starts = np.concatenate(([0], np.cumsum(active)))
    step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return starts[step] + np.repeat(rank, lengths), starts, active


def forward_backward(e: np.ndarray, starts: np.ndarray, active: np.ndarray, transition: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray]:
    """Ratios of state 1 to state 0, of forward and backward messages. e: emission odds in lockstep order."""
    (t00, t01), (t10, t11) = transition
    a, b = np.empty_like(e), np.ones_like(e)
    for t in range(len(active)):
        n, at = active[t], starts[t]
        if t == 0:
            a[:n] = e[:n] * first
        else:
            p = a[starts[t - 1] : starts[t - 1] + n]
            a[at : at + n] = e[at : at + n] * (t01 + p * t11) / (t00 + p * t10)
    for t in range(len(active) - 2, -1, -1):
        n, at = active[t + 1], starts[t + 1]
        q = e[at : at + n] * b[at : at + n]
        b[starts[t] : starts[t] + n] = (t10 + t11 * q) / (t00 + t01 * q)
    return a, b


def marginals(u: np.ndarray, lengths: np.ndarray, model: ToxicityModel) -> np.ndarray:
    """Probability that each token is toxic, documents one after another."""
    at, starts, active = packed(lengths)
    e = np.empty(len(u))
    e[at] = np.exp(u)
    a, b = forward_backward(e, starts, active, np.exp(model.transition), np.exp(model.start))
    odds = a * b
    return (odds / (1 + odds))[at]


def summaries(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: bias, log-odds of its most toxic token, log of the expected number of toxic tokens, their density."""
    ends = np.cumsum(lengths)
    has = lengths > 0
    top, total = np.zeros(len(lengths)), np.zeros(len(lengths))
    if has.any():
        at = (ends - lengths)[has]
        top[has], total[has] = np.maximum.reduceat(p, at), np.add.reduceat(p, at)
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(top)), np.log(top / (1 - top)) / 4, np.log1p(total), np.sqrt(total / np.maximum(lengths, 1))], 1)


def fit_crf(docs: list[np.ndarray], words: list[str], tags: list[np.ndarray], lexicon: dict[str, float], rounds: int = 60, l2: float = 1e-3) -> ToxicityModel:
    """Maximum likelihood of token tags by gradient ascent with adaptive steps. docs: positions in words of their tokens."""
    lengths = np.array([len(d) for d in docs], np.int64)
    y = np.concatenate(tags) if tags else np.zeros(0)
    ids = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    x = np.array([features(t, lexicon) for t in words]).reshape(len(words), 5)
    h = np.fromiter((bucket(t) for t in words), np.int64, len(words))
    model = ToxicityModel(lexicon, np.zeros(BUCKETS), np.array([-3.0, 0.5, 0, 0, 0]), np.zeros((2, 2)), 0.0, np.array([-1.0, 1, 1, 0]))
    if not len(ids):
        return model
    at, starts, active = packed(lengths)
    inside = np.ones(len(ids), bool)
    inside[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    seen = np.bincount((y[:-1] * 2 + y[1:]).astype(int)[inside[1:]], minlength=4).reshape(2, 2)
    g_words, g_x, g_t = np.full(BUCKETS, 1e-6), np.full(5, 1e-6), np.full((2, 2), 1e-6)
    n = len(ids)
    for _ in range(rounds):
        u = np.clip(model.words[h] + x @ model.emission, -25, 25)
        e = np.empty(n)
        e[at] = np.exp(u)[ids]
        tr = np.exp(model.transition)
        a, b = forward_backward(e, starts, active, tr, np.exp(model.start))
        p = (a * b / (1 + a * b))[at]
        now, after = a[at][:-1][inside[1:]], (e * b)[at][1:][inside[1:]]
        w = np.stack([np.full_like(now, tr[0, 0]), tr[0, 1] * after, tr[1, 0] * now, tr[1, 1] * now * after])
        expected = (w / w.sum(0)).sum(1).reshape(2, 2)
        rest = np.bincount(ids, weights=y - p, minlength=len(words)) / n
        d_words = np.bincount(h, weights=rest, minlength=BUCKETS) - l2 * model.words / 100
        d_x, d_t = x.T @ rest - l2 * model.emission / 100, (seen - expected) / n - l2 * model.transition / 100
        for g, d, theta in ((g_words, d_words, model.words), (g_x, d_x, model.emission), (g_t, d_t, model.transition)):
            g += d * d
            theta += 0.5 * d / np.sqrt(g) * (np.abs(d) > 1e-12)
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps; y may be of one class only."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (y - p) - l2 * w)
        w += step / max(1.0, float(np.abs(step).max()) / 2)
    return w


def learn_lexicon(labelled: DataFrame, size: int) -> dict[str, float]:
    """Smoothed log odds of words whose presence sets toxic documents off, chosen by likelihood ratio over distinct documents; near copies of one text count once.

    labelled: text, label. A copy is known by the eight least hashes among its long words; texts with fewer
    long words are copies only where they are equal.
    """
    tokens = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))
    docs = labelled.select("label", "text", tokens.alias("t"))
    least = F.slice(F.array_sort(F.transform(F.filter("t", lambda w: F.length(w) >= 8), lambda w: F.xxhash64(w))), 1, 8)
    docs = docs.withColumn("sig", F.when(F.size(least) == 8, F.xxhash64(least)).otherwise(F.xxhash64("text"))).drop("text")
    docs = docs.dropDuplicates(["label", "sig"])
    counts = docs.select("label", F.explode("t").alias("w")).where("w <> ''").groupBy("w").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b")).where("a + b >= 4")
    sizes = docs.agg(F.sum("label").alias("x"), F.count("*").alias("n")).first()
    toxic = float(sizes["x"] or 0)
    clean = float(sizes["n"] or 0) - toxic
    a, b = F.col("a"), F.col("b")
    lo = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    of = lambda k, rate: part(k, (a + b) * max(rate, 1e-9))
    share = toxic / max(toxic + clean, 1.0)
    ratio = 2 * (of(a, share) + of(b, 1 - share))
    rows = counts.select("w", lo.alias("lo"), ratio.alias("g")).where((F.col("g") > 20) & ((F.col("lo") > 2) | (F.col("lo") < -1))).orderBy(F.desc("g"), "w").limit(size).collect()
    return {r["w"]: float(r["lo"]) for r in rows}


def train(labelled: DataFrame, sample: int = 12_000, chain_docs: int = 500, lexicon_size: int = 5_000) -> ToxicityModel:
    """Fit on labelled rows (doc_id, text, label): the lexicon on a bounded sample (``sample`` rows a class), the chain on ``chain_docs`` a class.

    Token labels come from the documents': a word of the lexicon that marks toxic documents is toxic in
    them. With no labelled rows the model is a prior that finds nothing.
    """
    labelled = labelled.where("label in (0, 1)").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    some = bounded_sample(labelled, "doc_id", sample, "label", "lexicon")
    lexicon = learn_lexicon(some, lexicon_size)
    sampled = bounded_sample(some, "doc_id", chain_docs, "label", "chain").select("text", "label").toLocalIterator()
    known: dict[str, int] = {}
    kept, y = [], []
    for r in sampled:  # one partition at a time; of a text, positions of its tokens stay
        kept.append(np.array([known.setdefault(t, len(known)) for t in WORD.findall(r["text"] or "")], np.int32))
        y.append(r["label"])
    words = list(known)
    marks = np.array([lexicon.get(w.lower(), 0) > 2 for w in words], bool)
    tags = [marks[d].astype(float) * label for d, label in zip(kept, y)]
    # a toxic document without a word of the lexicon teaches the chain nothing
    use = [k for k, label in enumerate(y) if not label or tags[k].any()]
    model = fit_crf([kept[k] for k in use], words, [tags[k] for k in use], lexicon)
    if y:
        emissions = Emissions(model)
        u = np.array([emissions[w] for w in words])
        lengths = np.array([len(d) for d in kept], np.int64)
        p = marginals(u[np.concatenate(kept)], lengths, model)
        model.calibration = fit_logistic(summaries(p, lengths), np.array(y, float))
    return model


def token_marginals(texts: list, model: ToxicityModel, emissions: Emissions) -> tuple[np.ndarray, np.ndarray]:
    found = [WORD.findall(t) if t else [] for t in texts]
    lengths = np.array([len(f) for f in found], np.int64)
    u = np.empty(int(lengths.sum()))
    at = 0
    for f in found:
        if len(emissions) > CACHE:
            emissions.clear()
        u[at : at + len(f)] = [emissions[t] for t in f]
        at += len(f)
    return marginals(u, lengths, model), lengths


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", span_at: float = 0.5) -> DataFrame:
    """docs with ``score`` (0 to 1), ``predicted`` (1 from 0.5 up) and ``toxic_spans`` array<struct<start, end, p>>.

    Spans are runs of tokens that are toxic with probability span_at or more, in code points. Null and
    empty texts get the score of a text without toxic tokens; repeated rows score alike; equal scores stay
    equal; columns of the output's names are replaced; an empty table gives none. Row by row, without a shuffle;
    texts are taken in slices of some megabytes, a longer one by itself; the model's size is bounded.
    """
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_spans", T.ArrayType(span))]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value
        emissions = Emissions(model)

        def spans(text, p):
            out = []
            for k, m in enumerate(WORD.finditer(text)):
                if p[k] >= span_at:
                    if out and out[-1][3] == k - 1:
                        out[-1][1:] = [m.end(), max(out[-1][2], float(p[k])), k]
                    else:
                        out.append([m.start(), m.end(), float(p[k]), k])
            return [{"start": s, "end": e, "p": q} for s, e, q, _ in out]

        def apply(texts):
            scores, found = [], []
            for low in range(0, len(texts), 2000):
                part = texts[low : low + 2000]
                p, lengths = token_marginals(part, model, emissions)
                s = 1 / (1 + np.exp(-np.clip(summaries(p, lengths) @ model.calibration, -30, 30)))
                ends = np.cumsum(lengths)
                for k, t in enumerate(part):
                    own = p[ends[k] - lengths[k] : ends[k]]
                    found.append(spans(t, own) if len(own) and own.max() >= span_at else [])
                scores += s.tolist()
            return [scores, [int(s >= 0.5) for s in scores], found]

        return apply

    return append_columns(docs, [text_col], fields, start)


def thin(spark: SparkSession, sf_dir: str, label: str, modulus: int, remainder: int, bound: int) -> DataFrame:
    """(doc_id, text, label) of labelled documents that aren't held out, thinned to ``bound`` a class before texts are read for them; ids that are labelled both ways, or neither 0 nor 1, teach nothing."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), modulus, remainder)).select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    agreed = labels.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    few = bounded_sample(agreed, "doc_id", bound, "label")
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most about bound rows a class


def trained(spark: SparkSession, sf_dir: str, sample: int = 6_000) -> ToxicityModel:
    return train(thin(spark, sf_dir, "toxic", 5, 0, sample), sample)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, trained(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", F.size("toxic_spans").alias("n_spans"), "toxic_spans")
