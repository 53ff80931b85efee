"""What larger tables and odd rows have shown: results against SQL, and steps whose work must not grow faster than the input."""

import shutil
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from corpusloom.operators import dedup, similarity
from corpusloom.plans import catalogue

SQL = catalogue.oracle_sql()


def same_as_sql(spark, oracle, name, sf):
    df = catalogue.queries()[name](spark, str(sf))
    got = rows_of(df.columns, df.collect())
    columns, rows = oracle(str(sf), SQL[name])
    assert sorted(columns) == sorted(df.columns) and rows_of(columns, rows) == got


def documents(spark, path, texts, files=1):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(files).write.parquet(f"{path}/documents.parquet")
    # the oracle reads files
    for k, f in enumerate(sorted(Path(f"{path}/documents.parquet").glob("part-*"))):
        shutil.copy(f, f"{path}/part{k}.parquet")


def oracle_of_documents(oracle, path, sql):
    n = len(list(Path(path).glob("part*.parquet")))
    return oracle(str(path), f"WITH RECURSIVE documents AS ({' UNION ALL '.join(f'SELECT * FROM part{k}' for k in range(n))}), {sql.removeprefix('WITH RECURSIVE ').removeprefix('WITH ')}" if sql.startswith("WITH") else f"WITH documents AS ({' UNION ALL '.join(f'SELECT * FROM part{k}' for k in range(n))}) {sql}")


def same_over_documents(spark, oracle, name, path, texts, files=1):
    documents(spark, path, texts, files)
    (Path(path) / "documents.parquet").rename(Path(path) / "kept")
    columns, rows = oracle_of_documents(oracle, path, SQL[name])
    (Path(path) / "kept").rename(Path(path) / "documents.parquet")
    df = catalogue.queries()[name](spark, str(path))
    assert sorted(columns) == sorted(df.columns) and rows_of(columns, rows) == rows_of(df.columns, df.collect())


LONG = "plain words that stand for a text of more than fifty characters and ten words"


def test_blank_texts_are_reported_as_sql_has_them(spark, oracle, tmp_path):
    same_over_documents(spark, oracle, "curation_report", tmp_path, [LONG, " ", "\n\n", None, "", LONG + " ", "short"])


def test_blanks_at_the_ends_of_texts_come_back_from_csv(spark, oracle, tmp_path):
    same_over_documents(spark, oracle, "read_csv_files", tmp_path, [LONG, " ", "\n" + LONG, LONG + "\t", 'a "quoted", \\" word\r\n', None, ""])


def test_every_list_comes_back_from_json(spark, oracle, tmp_path):
    """Lists that several tasks wrote met in one file, of which the first was read."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same_over_documents(spark, oracle, "read_json_files", tmp_path, [f"{LONG} {k}\n" for k in range(200)], 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_reach_without_edges(spark, oracle, sf, tmp_path):
    """No pair of nations trades more than twice the mean: lines are shared out evenly."""
    for name in ("nation", "supplier", "customer", "orders", "lineitem"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    (tmp_path / "lineitem.parquet").unlink()
    spark.read.parquet(f"{sf}/lineitem.parquet").where("false").coalesce(1).write.parquet(str(tmp_path / "lines"))
    shutil.move(str(next((tmp_path / "lines").glob("part-*"))), tmp_path / "lineitem.parquet")
    same_as_sql(spark, oracle, "multi_hop_connectivity", tmp_path)


def random_sets():
    import random

    at = random.Random(3)
    made = []
    for _ in range(300):
        s = set(at.choice(made)) if made and at.random() < 0.6 else {f"w{at.randint(0, 400)}" for _ in range(at.choice([0, 1, 2, 3, 6, 7, 10, 30, 100, 300]))}
        for _ in range(at.choice([0, 1, 1, 2, 5, len(s) // 20])):
            s = s - {min(s)} if s and at.random() < 0.5 else s | {f"w{at.randint(0, 400)}"}
        made.append(s)
    return made


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("block", [None, ["type"]])
def test_parts_and_sketches_lose_no_pair(spark, monkeypatch, few, block):
    monkeypatch.setattr(similarity, "parts_are_few", lambda *a: few)
    sets = random_sets()
    rows = [(7 * k, sorted(s), "xy"[k % 5 == 0]) for k, s in enumerate(sets)]
    first = {}
    for i, s, t in rows:
        first.setdefault((tuple(s), t if block else ""), i)
    items = [(i, set(s), t) for (s, t), i in first.items() if s]
    want = {(i, j) for i, s, t in items for j, u, v in items if i < j and t == v and len(s & u) / len(s | u) >= 0.85 - 1e-12}
    members, pairs = similarity.set_similarity(spark.createDataFrame(rows, "id long, tokens array<string>, type string"), 0.85, block=block)
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 50 and members.count() == 300


def test_sets_of_a_small_vocabulary_meet_few_others(spark):
    """Sixty of 4,096 tokens each, none near another: under single tokens each set met most others, and several times."""
    import random

    at = random.Random(5)
    rows = spark.createDataFrame([(k, 0, at.sample(range(4_096), 60)) for k in range(1_500)], "key long, of long, set array<int>")
    sets = rows.withColumn("set", F.transform("set", lambda t: F.xxhash64(t)))
    assert similarity.parts_are_few(sets, 0.85) and similarity.by_parts(sets, 0.85).count() < 1_500
    assert similarity.by_sketches(sets, 0.85).count() < 1_500


def test_cosine_pairs_of_blocks_that_stream(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(260, 8)).astype(np.float32)
    v[200:] = v[:60] + 0.1 * rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(3 * k, x.tolist()) for k, x in enumerate(v)], "id long, v array<float>")
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    want = {(3 * int(a), 3 * int(b)) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.7, 1)))}
    for size in (40, 1_000):
        got = similarity.cosine_pairs(rows, 0.7, rows=size)
        assert [(r.a, r.b) for r in got.orderBy("a", "b").collect()] == sorted(want)
    # a row of what the tasks get is one vector, not a block of them
    plan = similarity.cosine_pairs(rows, 0.7)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan


def test_simhash_keeps_the_digests_of_runs(spark, monkeypatch):
    """As run by run, for all kinds of characters; a run that came before isn't digested again."""
    import hashlib

    def plain(text):
        grams = [text[k : k + 4] for k in range(max(1, len(text) - 3))]
        hashes = [int.from_bytes(hashlib.md5(g.encode()).digest()[8:], "big") for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    monkeypatch.setattr(dedup, "KNOWN_RUNS", 60)
    texts = ["", "a", "abc", "abcd", "naïve words, naïve words", "\U0001f600 and \U0001f468x" * 3, "\ue000\uffff\u0301é" * 4, "the quick brown fox jumps over lazy dogs again and again and again"]
    assert [c % (1 << 64) for c in dedup.simhash_md5.func(pd.Series(texts))] == [plain(t) for t in texts]
    monkeypatch.setattr(dedup, "KNOWN_RUNS", 1_000)
    seen = []
    monkeypatch.setattr(dedup, "run_bits", lambda r, f=dedup.run_bits: seen.append(r) or f(r))
    dedup.simhash_md5.func(pd.Series([texts[-1][1:] + "!"] * 50))
    assert len(seen) < 100
