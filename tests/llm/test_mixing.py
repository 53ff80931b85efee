import math

import numpy as np
import pytest

from corpusloom.llm import mixing as mx


def test_rates_meet_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labelled = mx.labelled_domains(spark, sf)
    domains = sorted(mx.TARGETS)
    p = mx.posteriors(docs, mx.learn_classifier(labelled, domains), domains).toPandas()
    assert p["copies"].sum() == docs.count() and (p["copies"] == 1).all()
    post, tokens = np.array(p["p"].tolist()), p["tokens"].to_numpy(float)
    assert np.allclose(post.sum(1), 1, atol=1e-6)
    rates = mx.op9_mixing(spark, sf).toPandas()
    assert len(rates) == docs.count() and (rates["rate"] >= 0).all()
    assert (np.abs(rates["copies"] - rates["rate"]) < 1 + 1e-6).all()
    # the same rows in the same order
    key = ["doc_id", "tokens"]
    p, rates = p.sort_values(key), rates.sort_values(key)
    post, tokens = np.array(p["p"].tolist()), p["tokens"].to_numpy(float)
    got = (post * (tokens * rates["rate"].to_numpy())[:, None]).sum(0)
    goal = tokens.sum() * np.array([mx.TARGETS[d] for d in domains])
    assert np.abs(got / goal - 1).max() < 0.03


def test_rates_are_the_optimum(spark):
    """The rates satisfy the conditions of the least-squares problem, whatever steps led there; and no random feasible move is better."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3] * 3, 200)
    t, n = rng.integers(1, 500, 200), rng.integers(1, 3, 200)
    members = spark.createDataFrame([(k, int(a), [float(x) for x in b], int(c)) for k, (a, b, c) in enumerate(zip(t, p, n))], "k long, tokens long, p array<double>, copies long")
    r = np.array([x.rate for x in mx.fit_rates(members, [5.0, 1.0, 1.0], 0.01).orderBy("k").collect()])
    w = t * n
    size = (p * w[:, None]).sum(0)
    goal = w.sum() * np.array([5, 1, 1]) / 7
    cost = lambda r: (((p * (w * r)[:, None]).sum(0) - goal) ** 2 / (2 * size)).sum() + 0.005 * (w * (r - 1) ** 2).sum()
    slope = p @ (((p * (w * r)[:, None]).sum(0) - goal) / size) + 0.01 * (r - 1)
    assert (r >= 0).all() and (r == 0).any()
    assert np.abs(slope[r > 0]).max() < 2e-3 and slope[r == 0].min() > -2e-3
    for _ in range(300):
        assert cost(np.maximum(0, r + rng.normal(0, 0.1, 200))) > cost(r)


def test_rounds_that_run_out_are_an_error(spark):
    members = spark.createDataFrame([(10, [0.9, 0.1], 1), (20, [0.2, 0.8], 1)], "tokens long, p array<double>, copies long")
    with pytest.raises(RuntimeError):
        mx.fit_rates(members, [9.0, 1.0], max_rounds=2)


def test_posteriors_against_brute_force(spark):
    """Naive Bayes by hand: counts of documents with a word, equal priors, evidence scaled down beyond 30 known words."""
    labelled = [(1, "aa bb cc aa", "x"), (2, "aa dd", "x"), (3, "dd ee ff", "y"), (4, "ee", "y")]
    docs = [(1, "aa dd zz"), (2, "ee " * 45), (3, "aa"), (4, "")]
    seen = {d: [set(t.split()) for _, t, dd in labelled if dd == d] for d in "xy"}
    vocabulary = {w for ts in seen.values() for s in ts for w in s}
    l = {w: [math.log((sum(w in s for s in seen[d]) + 0.5) / (len(seen[d]) + 1)) for d in "xy"] for w in vocabulary}
    model = mx.learn_classifier(spark.createDataFrame(labelled, "doc_id long, text string, domain string"), ["x", "y"])
    rows = mx.posteriors(spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, source string"), model, ["x", "y"]).collect()
    for r in rows:
        known = [w for w in dict(docs)[r.doc_id].split() if w in l]
        z = [sum(l[w][k] for w in known) * min(1, 30 / max(1, len(known))) for k in (0, 1)]
        e = [math.exp(x - max(z)) for x in z]
        assert np.allclose(r.p, [x / sum(e) for x in e], atol=1e-8), r


def test_domains_are_found(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mx.op9_mixing(spark, sf).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 300").collect()
    assert np.mean([r.domain == r.lang for r in rows]) > 0.95


def test_edges(spark):
    labelled = spark.createDataFrame([(1, "aa bb cc", "x"), (2, "dd ee ff", "y"), (3, None, "x"), (4, "zz", None)], "doc_id long, text string, domain string")
    docs = spark.createDataFrame([(1, None, "s", 1), (2, "", "s", 1), (3, "aa bb " * 50_000, None, 1), (3, "aa bb " * 50_000, None, 1), (None, "dd", "s", 1)], "doc_id long, text string, source string, rate int")
    mixed = mx.mix(docs, labelled, {"x": 1.0, "y": 1.0})
    assert mixed.columns == ["doc_id", "text", "source", "rate_in", *mx.ADDED]
    rows = mixed.collect()
    assert len(rows) == 5 and all(r.rate_in == 1 for r in rows) and sorted(r.tokens for r in rows) == [0, 0, 1, 100_000, 100_000]
    assert {r.rate for r in rows if r.doc_id == 3}.__len__() == 1
    assert all(r.posterior == 0.5 for r in rows if r.tokens == 0)
    assert mx.mix(docs.limit(0), labelled, {"x": 1.0, "y": 1.0}).count() == 0
    assert mx.mix(docs, labelled.limit(0), {"x": 1.0, "y": 1.0}).count() == 5


def test_rates_settle_where_targets_are_out_of_reach(spark):
    """A domain that hardly any text holds, with a high target: rounds are few (plain steps take 580), and the rates the optimum's."""
    rng = np.random.default_rng(31)
    p = np.round(rng.dirichlet([0.2, 0.02, 8, 2.3], 12), 9)
    t, w = 2.0 * rng.integers(50, 5_000, 12), np.array([0.2, 0.4, 0.2, 0.2])  # each stands twice
    size, r = np.maximum((p * t[:, None]).sum(0), 1), np.ones(12)
    for _ in range(20_000):
        r = np.maximum(0, r - 0.9 * (p @ ((p.T @ (t * r) - t.sum() * w) / size) + 0.01 * (r - 1)))
    members = spark.createDataFrame([(k, int(t[k]) // 2, p[k].tolist(), 1) for k in range(12) for _ in (0, 1)], "k long, tokens long, p array<double>, copies long")
    got = mx.fit_rates(members, w.tolist(), max_rounds=120).collect()
    assert len(got) == 24 and max(abs(x.rate - r[x.k]) for x in got) < 1e-3 * r.max()


def test_columns_called_like_those_of_the_stage(spark):
    docs = spark.createDataFrame([(1, "aa", "s", 1, 2, 3, 4, 5)], "doc_id long, text string, source string, rate int, rate_in int, Tokens int, __text int, __id int")
    labelled = spark.createDataFrame([(1, "aa", "x"), (2, "bb", "y")], "doc_id long, text string, domain string")
    mixed = mx.mix(docs, labelled, {"x": 1.0, "y": 1.0})
    assert mixed.columns == ["doc_id", "text", "source", "rate_in_in", "rate_in", "Tokens_in", "__text", "__id", *mx.ADDED]
    assert tuple(mixed.first())[3:8] == (1, 2, 3, 4, 5)
