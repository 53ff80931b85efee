import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import suffix_dedup as sd

N = sd.LENGTH


def brute(texts):
    """Kept bytes and removed runs of each text, by counting all windows."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + N] for r in raws for k in range(len(r) - N + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int8)
        for k in range(len(r) - N + 1):
            if seen[r[k : k + N]] > 1:
                gone[k : k + N] = 1
        starts = int(((gone[1:] == 1) & (gone[:-1] == 0)).sum() + gone[0])
        out.append((bytes(b for b, g in zip(r, gone) if not g), starts))
    return out


def corpus(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long = prose(90), prose(900)
    texts = [prose(200) for _ in range(6)] + [long, long, long[:-1], prose(20) + shared + prose(30), shared + prose(50), prose(10) + shared, shared[:-1], shared[5:] + "x"]
    for _ in range(25):
        cut = rng.randint(0, len(long) - 2)
        texts.append(long[:cut] + rng.choice("xyz") + long[cut + 1 :])
    texts += ["a" * 1500, "b" * 400, "b" * 401, "c" * 399, "c" * 399, "ab" * 450, "", None, "é" * 300, "x" + "é" * 300, shared + " " + shared]
    return texts


@pytest.mark.parametrize("hot", [5_000, 3])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    rows = {r.doc_id: r for r in sd.remove_repeats(docs).collect()}
    for k, (kept, spans) in enumerate(brute(texts)):
        assert bytes(rows[k].kept) == kept, k
        assert len(rows[k].removed_spans) == spans, k


def test_pieces_of_one_anchor_are_merged(monkeypatch):
    monkeypatch.setattr(sd, "SHARD", 6_000)
    monkeypatch.setattr(sd, "PIECE", 2_500)
    rng = random.Random(2)
    base = bytes(rng.randrange(97, 123) for _ in range(700))
    rows = []
    for c in range(40):
        data = bytearray(base)
        data[rng.randrange(0, 700)] = 65 + c % 20
        rows.append((1 if c < 30 else 2, c, bytes(data[: rng.randint(N, 700)])))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 9]], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["h", "c", "context"]) for i in range(0, 40, 9)]
    got = {}
    for b in sd.compare(iter(batches)):
        for c, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            got[c] = {k for s in spans for k in range(s["a"], s["b"])}
    for h in (1, 2):
        own = [r for r in rows if r[0] == h]
        seen = Counter(r[2][k : k + N] for r in own for k in range(len(r[2]) - N + 1))
        for r in own:
            assert got.get(r[1], set()) == {k for k in range(len(r[2]) - N + 1) if seen[r[2][k : k + N]] > 1}


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 3, 600, np.uint8)
    order, _ = sd.refine(text, 50)
    keys = [bytes(text[k : k + 50]) for k in order]
    assert keys == sorted(keys) and sorted(order) == list(range(600))


def test_edges(spark, sf):
    same = "m" * 5 + " ".join(str(k) for k in range(400))
    docs = spark.createDataFrame([(None, same, 1), (None, same, 1), (1, same, 1), (1, same, 1), (2, "z", 1)], "doc_id long, text string, spans int")
    rows = sd.remove_repeats(docs).collect()
    assert sorted(bytes(r.kept) for r in rows) == [b""] * 4 + [b"z"]
    assert sd.remove_repeats(docs.limit(0)).count() == 0
    assert all(r.kept_sha256 and r.n_bytes >= r.n_removed for r in sd.op10_suffix_dedup(spark, sf).collect())
    assert hashlib.sha256(b"").hexdigest()
