import random
import re

import numpy as np
import pytest
import xxhash

from corpusloom.llm import simhash_dedup as sh


def fingerprint(text):
    """By the definition, word by word and bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs):
    """(doc_id, fingerprint, component) by comparing all fingerprints."""
    fps = {d: fingerprint(t) for d, t in docs}
    root = {f: f for f in fps.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = list(root)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps.items():
        least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f"{f:016x}", least[find(f)]) for d, f in fps.items()}


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in sh.op2_simhash(spark, sf).collect()}
    assert got == brute(docs)


@pytest.mark.parametrize("text", ["", None, "one", "Two WORDS", "a b c d", "a b c d e", "a\x0bb\x0cc\x1cd e  f", "Ünï CÖDE Äöü ß x y z", "same " * 700])
def test_fingerprint(text):
    assert sh.fingerprint(text) == fingerprint(text)


def test_keys_meet_within_the_radius():
    rng = random.Random(3)
    tables, errors = sh.syndromes(), sh.error_table()
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        key, row = sh.pair_keys(np.array([a, b], np.uint64), tables, errors)
        assert set(key[row == 0]) & set(key[row == 1])


def test_large_buckets_are_linked_through_hubs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(12)})
    df = spark.createDataFrame([(sh.signed(f),) for f in fps], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in sh.hub_links(df).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)

    def groups(pairs):
        root = {f: f for f in fps}
        for a, b in pairs:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        return {f: top(f) for f in fps}

    assert groups(links) == groups([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])


def test_streamed_buckets(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sh, "BUCKET", 20)
    key = np.repeat(np.arange(5), [3, 50, 10, 1, 30])
    fp = np.arange(len(key), dtype=np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[k : k + 7]), pa.array(fp[k : k + 7])], names=["key", "fp"]) for k in range(0, len(key), 7)]
    large = {a for b in sh.link_buckets(iter(batches)) for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if c is None}
    assert large == set(range(3, 53)) | set(range(64, 94))


def test_edges(spark):
    docs = spark.createDataFrame([(1, "", "x"), (2, None, "x"), (3, "a b c d e", "x"), (3, "a b c d e", "x"), (None, "a b c d e", "x"), (9, "a b c d e", "x"), (10, "word " * 100_000, "x")], "doc_id long, text string, component_id string")
    got = [(r.doc_id, r.component_id) for r in sh.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, 3), (9, 3), (10, 10)], key=str)
    assert sh.near_duplicates(docs.limit(0)).count() == 0
