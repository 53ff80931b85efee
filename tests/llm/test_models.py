import itertools

import numpy as np
import pytest

from corpusloom.llm import quality as ql
from corpusloom.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


def test_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    model = tx.ToxicityModel({}, np.zeros(tx.BUCKETS), np.zeros(5), rng.normal(0, 1, (2, 2)), 0.4, np.zeros(4))
    lengths = np.array([4, 0, 1, 6])
    u = rng.normal(0, 1, lengths.sum())
    got = tx.marginals(u, lengths, model)
    at = 0
    for n in lengths:
        weight = np.zeros(n)
        total = 0.0
        for y in itertools.product((0, 1), repeat=int(n)):
            s = sum(u[at + k] * v for k, v in enumerate(y)) + (model.start * y[0] if n else 0) + sum(model.transition[a, b] for a, b in zip(y, y[1:]))
            total += np.exp(s)
            weight += np.exp(s) * np.array(y)
        assert np.allclose(got[at : at + n], weight / total)
        at += n


def scores(spark, run, label, table="labels"):
    labels = spark.read.parquet(f"{SF}/{table}.parquet")
    rows = run(spark, SF).join(labels, "doc_id").select("held_out", "score", "predicted", label).collect()
    return [r for r in rows if r.held_out], rows


@pytest.mark.parametrize(("run", "label", "least"), [(tx.op3_toxicity, "toxic", 0.97), (ql.op8_quality, "quality", 0.85)])
def test_held_out_accuracy(spark, run, label, least):
    held, rows = scores(spark, run, label)
    assert held and len(held) < len(rows)
    assert np.mean([r.predicted == r[label] for r in held]) >= least
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxic_recall_by_language(spark):
    """What a label of toxicity catches, by language, on held-out rows of the larger table; and how few clean documents it takes along. A twentieth of the toxic documents hold no toxic word."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = [r for r in tx.op3_toxicity(spark, sf).join(docs, "doc_id").where("held_out").collect()]
    for lang in sorted({r.lang for r in rows}):
        toxic = [r for r in rows if r.lang == lang and r.toxic]
        assert len(toxic) >= 3 and np.mean([r.predicted for r in toxic]) >= (0.85 if len(toxic) >= 20 else 0.5), (lang, len(toxic), sum(r.predicted for r in toxic))
    assert np.mean([r.predicted for r in rows if r.toxic]) >= 0.9
    assert np.mean([r.predicted for r in rows if not r.toxic]) <= 0.02


def test_labels_that_disagree_teach_nothing(spark, tmp_path):
    spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 7), (None, 1), (4, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(k, f"text {k}") for k in range(1, 5)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((r.doc_id, r.label) for r in tx.thin(spark, str(tmp_path), "toxic", 5, 9, 100).collect()) == [(2, 1), (4, 0)]


def test_quality_scores_against_plain_python(spark):
    """Scores of the operator from its model, by the definition, word by word."""
    model = ql.train(ql.thin(spark, SF, "quality", 3, 1, 300).collect(), vocabulary=500)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 29 = 0")
    for r in ql.score_quality(docs, model).collect():
        tokens = ql.TOKEN.findall(r.text or "")
        n = max(1, len(tokens))
        x = np.zeros(ql.DIM + ql.STATS)
        for t in tokens:
            x[: ql.DIM] += model.vectors[model.ids.get(t, ql.shape(t))] / n
        if tokens:
            marks = sum(t in "!|%&#*$" for t in tokens) if n < 50 else sum(c in "!|%&#*$" for c in r.text)
            x[ql.DIM :] = (np.log(1 + n), len(set(tokens)) / n**0.8, sum(a == b for a, b in zip(tokens, tokens[1:])) / n, marks / n, sum(t.isupper() for t in tokens) / n, r.text.count("\n") / n, len(r.text) / n / 10)
        x = np.clip((x - model.shift) / model.scale, -6, 6)
        w1, b1, w2, b2 = model.layers
        z = sum(float(np.tanh(x @ w1[:, k] + b1[k])) * w2[k] for k in range(ql.HIDDEN)) + b2
        assert abs(r.score - 1 / (1 + np.exp(-z / model.temperature))) < 1e-4


def test_every_document_is_scored_and_split_by_hash(spark):
    import zlib

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = tx.op3_toxicity(spark, SF).select("doc_id", "held_out").collect()
    assert len(rows) == n and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    rows = ql.op8_quality(spark, SF).select("doc_id", "held_out").collect()
    assert len(rows) == n and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_spans_point_at_words_of_the_text(spark):
    model = tx.trained(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1"), "doc_id")
    rows = [r for r in tx.score_toxicity(docs, model).collect() if r.toxic_spans]
    assert rows
    for r in rows:
        for s in r.toxic_spans:
            assert r.text[s.start : s.end].strip() == r.text[s.start : s.end] and s.end > s.start and 0.5 <= s.p <= 1


def test_edges_of_toxicity(spark):
    few = spark.createDataFrame([(1, "bad bad words here", 1), (2, "good words here", 0), (3, None, 0), (4, "", 1)], "doc_id long, text string, label int")
    for labelled in (few, few.where("label = 0"), few.limit(0)):
        model = tx.train(labelled)
        docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (3, "w " * 100_000, 0.1), (3, "w " * 100_000, 0.1), (None, "İ ß ퟿", 0.1)], "doc_id long, text string, score double")
        rows = tx.score_toxicity(docs, model).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score and rows[2].score == rows[3].score
        assert tx.score_toxicity(docs.limit(0), model).count() == 0


def test_edges_of_quality(spark):
    from pyspark.sql import Row

    few = [Row(doc_id=k, text=t, label=k % 2) for k, t in enumerate(["a b c", "d e f", None, "", "a b", "!!! ###"])]
    for rows in (few, few[::2], []):
        model = ql.train(rows)
        docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "w ! " * 100_000, 1), (None, "x", 1)], "doc_id long, text string, predicted int")
        got = ql.score_quality(docs, model).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
        assert ql.score_quality(docs.limit(0), model).count() == 0


def test_temperature_lowers_loss():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 1, 4000)
    y = (rng.random(4000) < ql.sigmoid(z)).astype(float)
    assert abs(np.log(ql.fit_temperature(4 * z, y) / 4)) < 0.2
