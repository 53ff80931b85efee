"""Writers, logs, tables of stages, and dedup cases that have bitten."""

import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import with_char_grams, with_word_shingles
from corpusloom.operators import archive, chunk, curate, dedup
from corpusloom.operators.writer import TableGraphWriter
from corpusloom.plans import pipelines
from corpusloom.sources import readers, writers
from corpusloom.streaming import ingest


def test_twins_of_a_follower_follow(spark, monkeypatch):
    """Codes 0, 7, 7 at distance 3: the second follows the first, and so does its twin."""
    monkeypatch.setattr(dedup, "simhash_md5", lambda c: F.col(c).cast("long"))
    docs = spark.createDataFrame([(1, "0"), (2, "7"), (3, "7"), (4, "255"), (5, "255")], "doc_id long, content string")
    assert sorted(r.doc_id for r in dedup.simhash_dedup(docs).collect()) == [1, 4]


def test_exact_keeps_the_first(spark):
    docs = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "b")], "doc_id long, content string")
    assert sorted(r.doc_id for r in dedup.exact(docs).collect()) == [1, 2, 5]


@pytest.mark.parametrize("make", [lambda d: with_word_shingles(d, "s", F.col("text")), lambda d: with_char_grams(d, "s", F.col("text"), 5)])
def test_shingling_time_follows_length(spark, make):
    """Eight times the text takes far less than the sixty-four times the time that a quadratic plan would."""
    took = []
    for n in (4_000, 4_000, 32_000):
        docs = spark.createDataFrame([(" ".join(f"w{k}" for k in range(n)),)], "text string").cache()
        docs.count()
        at = time.perf_counter()
        make(docs).select(F.size("s")).collect()
        took.append(time.perf_counter() - at)
    assert took[2] < 24 * took[1] + 1


def test_grams(spark):
    got = with_char_grams(spark.createDataFrame([("aéb c",), ("ab",), ("",), (None,)], "text string"), "s", F.col("text"), 3).collect()
    assert [r.s for r in got] == [["aéb", "éb ", "b c"], ["ab"], [""], None]


def test_table_writer(spark):
    w = TableGraphWriter(spark)
    w.merge_documents(spark.createDataFrame([("d1", "One")], "doc_id string, name string"))
    for _ in range(2):
        w.merge_chunks(spark.createDataFrame([("c1", "d1"), ("c2", "d1")], "chunk_id string, parent_doc_id string"))
    w.merge_entities(spark.createDataFrame([("e", "Old", "T", "said", ["c1"])], "id string, name string, type string, description string, source_chunk_ids array<string>"))
    w.merge_entities(spark.createDataFrame([("e", "New", None, None, ["c2"])], "id string, name string, type string, description string, source_chunk_ids array<string>"))
    for p in ("p", "q"):
        w.merge_edges(spark.createDataFrame([("e", p, "f", "c1")], "subject string, predicate string, object string, source_chunk_id string"))
    nodes = {r.id: r for r in w.nodes.collect()}
    assert (nodes["e"].name, nodes["e"].type, nodes["e"].description, nodes["e"].source_chunk_ids) == ("New", "T", "said", ["c1", "c2"])
    edges = {(r.subject, r.object): r for r in w.edges.collect()}
    assert edges["e", "f"].predicates == ["p", "q"] and edges["e", "f"].weight == 2 and edges["c1", "d1"].weight == 1
    assert {(r.kind, r.label): r.n for r in w.stats().collect()} == {("node", "Document"): 1, ("node", "Chunk"): 2, ("node", "T"): 1, ("edge", "part_of"): 2, ("edge", "p"): 1, ("edge", "q"): 1}


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 'A & "B"', "T"), ("b", "<b>", "U")], "id string, name string, type string")
    edges = spark.createDataFrame([("a", "b", ["p", "q"], 2)], "subject string, object string, predicates array<string>, weight int")
    writers.export(nodes, edges, nodes, str(tmp_path), ["graphml"])
    n, e = readers.read_graphml(spark, str(tmp_path / "graphml"))
    assert sorted(tuple(r) for r in n.collect()) == sorted(tuple(r) for r in nodes.collect())
    assert [tuple(r) for r in e.collect()] == [("a", "b", ["p", "q"], 2)]


def test_languages_of_stages(spark, tmp_path):
    for f in ("clean/en", "clean/de", "chunk/en", "chunk/common", "load/x"):
        (tmp_path / f).mkdir(parents=True)
    found = [pipelines.stage_languages(spark, str(tmp_path / s)) for s in ("clean", "chunk", "load", "none")]
    assert found == [{"en", "de"}, {"en"}, {"*"}, {"*"}]
    assert pipelines.pipeline_languages(*found) == {"en"} and pipelines.pipeline_languages({"*"}) == set()


def test_stage_table(spark):
    scores = spark.createDataFrame([("b", 0.5, 3), ("a", 0.75, None)], "variant string, f1 double, n int")
    assert pipelines.best_variant(scores, "f1").first().variant == "a"
    text = pipelines.stage_table(scores, "Title", "f1")
    assert text.splitlines()[0] == "Title" and "0.7500*" in text and "0.5000*" not in text
    assert "no results" in pipelines.stage_table(scores.limit(0), "T", "f1")


def test_run_log(spark):
    runs = archive.start_run(archive.start_run(spark.createDataFrame([], archive.RUN), "one"), "two", '{"k": 1}')
    done = {r.run_id: r for r in archive.complete_run(runs, "one", {"new": 3}).collect()}
    assert done["one"].status == "completed" and done["one"].stats == {"new": 3} and done["one"].completed_at is not None
    assert done["two"].status == "running" and done["two"].stats is None


def test_upsert_is_a_log(spark, tmp_path):
    """Repeats in a batch leave one row; a batch that is tried again changes nothing; later batches win."""
    path = str(tmp_path / "log")
    write = ingest.upsert(path, "k", "at")
    df = lambda *rows: spark.createDataFrame(rows, "k string, v string, at long")
    for _ in range(2):
        write(df(("a", "old", 1), ("a", "new", 2), ("b", "x", 1)), 0)
    for _ in range(2):
        write(df(("b", "y", 0)), 1)
    assert {r.k: r.v for r in ingest.newest(spark, path, "k").collect()} == {"a": "new", "b": "y"}
    ingest.compact(spark, path, "k", str(tmp_path / "small"))
    assert ingest.newest(spark, str(tmp_path / "small"), "k").count() == 2


def test_curation_artifacts(spark, tmp_path):
    text = "Words enough to pass the filter of quality stand in this sentence, surely. And in the next one too."
    docs = spark.createDataFrame([(1, text, "s"), (2, text, "s"), (3, "short", "t")], "doc_id long, text string, source string")
    audit, records = curate.curate(docs)
    assert {r.doc_id: r.output_record_count for r in curate.record_counts(audit, records).collect()} == {1: 1, 2: 0, 3: 0}
    curate.write_artifacts(audit, records, str(tmp_path))
    assert spark.read.json(str(tmp_path / "curated")).count() == 1 and spark.read.csv(str(tmp_path / "audit"), header=True).count() == 3
    assert spark.read.csv(str(tmp_path / "duplicates"), header=True).count() == 1


def test_chunk_counts(spark):
    def plain(text, size=20, overlap=5, sep="\n"):
        if len(text) <= size:
            return 1
        n, cur = 0, ""
        for part in text.split(sep):
            if len(cur) + len(part) <= size:
                cur = (cur + sep + part).strip(sep)
            else:
                n += bool(cur.strip())
                cur = part
                while len(cur) > size:
                    n += 1
                    cur = cur[size - overlap :]
        return max(n + bool(cur.strip()), 1)

    texts = ["", "short", "a" * 100, "one\ntwo\nthree\nfour\nfive\nsix", "\n\n" * 30, "x" * 21 + "\n" + "y" * 36, "line " * 3 + "\n" + "z" * 19 + "\n" + "w" * 2]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(chunk.chunk_count(F.col("t"), 20, 5, "\n").alias("n")).collect()
    assert [r.n for r in rows] == [plain(t) for t in texts]


def test_indexed_neighbours_against_exact_ones(spark):
    """Recall of 0.9 and more on clustered vectors from an eighth of the cells; probing all cells is exact."""
    import numpy as np

    from corpusloom.operators.similarity import knn, knn_indexed

    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (30, 16))
    rows = [(k, [float(x) for x in middle[k % 30] + rng.normal(0, 0.35, 16)]) for k in range(1500)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    ask = df.where("id % 50 = 0")
    pairs = lambda found: {(r.id, r.neighbour) for r in found.collect()}
    exact = pairs(knn(df, ask, 5))
    assert len(exact & pairs(knn_indexed(df, ask, 5, centres=32, probes=4))) >= 0.9 * len(exact)
    assert pairs(knn_indexed(df, ask, 5, centres=8, probes=8)) == exact
    assert knn_indexed(df.limit(0), ask.limit(0), 5).count() == 0
