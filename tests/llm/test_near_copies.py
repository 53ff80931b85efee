import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from corpusloom.llm import near_copies as nc


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """The first of each group, by comparing all pairs of 5-word shingle sets."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y) - 1e-9):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d for d in ids if find(d) == d}


def test_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in cp.drop_near_duplicates(spark, docs, sf).collect()}
    assert kept == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("sizes", [(4096, 256, 4096), (5, 3, 4)])
def test_edits_and_edges(spark, monkeypatch, sizes):
    """Groups of edited copies, passages that many texts share, null and short texts; also with buckets, blocks and parts of a few rows."""
    for name, n in zip(("BUCKET", "BLOCK", "PART"), sizes):
        monkeypatch.setattr(nc, name, n)
    rng = random.Random(4)
    base = [[f"w{rng.randrange(900)}" for _ in range(n)] for n in (12, 40, 90, 250)]
    texts = []
    for w in base:
        for k in range(20):
            x = list(w)
            for _ in range(k % 6):
                x[rng.randrange(len(x))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(x))
    # a passage that many different texts hold
    texts += [" ".join(base[2]) + " " + " ".join(f"u{k}x{j}" for j in range(200 + k)) for k in range(15)]
    docs = list(enumerate([*texts, "", None, "one two", "ONE two"]))
    df = spark.createDataFrame([*docs, (None, "one two")], "doc_id long, text string")
    kept = nc.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*brute(docs), None], key=str)
    assert nc.near_copies(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    """Different texts of one id stay both; of rows that repeat id and text one stays, the same at each run; columns keep their names."""
    rows = [(1, "a b c d e f", "x", {"k": 2}), (1, "other words are here today", "x", None), (1, "a b c d e f", "w", {"k": 1}), (2, "a b c d e f", "v", None), (None, "a b c d e f", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, t map<string,int>")
    kept = nc.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text, r.digest or "") for r in kept.collect()) == [(0, "a b c d e f", ""), (1, "a b c d e f", "w"), (1, "other words are here today", "x")]


def test_recall_of_candidates():
    """Of random texts with a Jaccard coefficient of 0.8 to 0.9, more than nine in ten share a key and lie within the radius."""
    rng = random.Random(9)
    tables, errors = nc.syndromes(), nc.error_table()
    met = total = 0
    for n in [60, 120, 300] * 60:
        w = [f"w{rng.randrange(5000)}" for _ in range(n)]
        x = list(w)
        for k in rng.sample(range(n), max(1, n // 50)):
            x[k] = f"e{rng.randrange(10**6)}"
        a, b = shingles(" ".join(w)), shingles(" ".join(x))
        if not 0.8 <= len(a & b) / len(a | b) < 1:
            continue
        total += 1
        prints = np.array([nc.word_print(nc.word_hashes(" ".join(y))) for y in (w, x)], np.int64).view(np.uint64)
        key, row = nc.meeting_keys(prints[:, 0].copy(), prints[:, 1].copy(), tables, errors)
        near = sum(int(v).bit_count() for v in prints[0] ^ prints[1]) <= nc.RADIUS
        met += near and bool(set(key[row == 0]) & set(key[row == 1]))
    assert total > 100 and met >= 0.9 * total


def test_streamed_buckets(monkeypatch):
    """Buckets above the bound are linked whole; below it, members within the radius are."""
    monkeypatch.setattr(nc, "BUCKET", 20)
    key = np.repeat(np.arange(5), [3, 50, 10, 1, 30])
    ids = np.arange(len(key))
    far = np.random.default_rng(1).integers(0, 1 << 62, len(key))
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 7]) for c in (key, ids, far, far)], names=["key", "id", "f0", "f1"]) for k in range(0, len(key), 7)]
    links = {(a, b) for x in nc.cluster_buckets(iter(batches)) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}
    assert links == {(3, k) for k in range(4, 53)} | {(64, k) for k in range(65, 94)}
