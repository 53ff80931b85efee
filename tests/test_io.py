"""Readers, writers, streams and pipelines."""

import datetime
import json
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph
from corpusloom.plans import pipelines
from corpusloom.sources import readers, writers
from corpusloom.streaming import ingest


@pytest.fixture
def files(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("whole\nfile")
    (tmp_path / "sub/b.jsonl").write_text('{"id": "j1", "text": "one", "extra": 5}\n\n{"id": "j2", "content": "two", "lang": "fr"}\n')
    (tmp_path / "c.json").write_text(json.dumps([{"url": "http://u", "text": "three", "title": "T"}]))
    (tmp_path / "d.csv").write_text('id,text\nc1,"four, quoted\nline"\n')
    (tmp_path / "e.bin").write_text("x")
    return str(tmp_path)


def test_documents_of_all_kinds(spark, files):
    got = {r.doc_id: r for r in readers.read_documents(spark, files).collect()}
    assert got["j1"].content == "one" and got["j1"].metadata["extra"] == "5" and got["j2"].language == "fr" and got["http://u"].title == "T" and got["c1"].content == "four, quoted\nline"
    assert len(got) == 5 and any(r.content == "whole\nfile" for r in got.values())
    assert readers.read_documents(spark, files + "/none").count() == 0


def test_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1", "text": "ok"}\nbroken\n')
    assert [r.doc_id for r in readers.read_lines_leniently(spark, str(tmp_path / "x.jsonl")).collect()] == ["1"]
    with pytest.raises(Exception):
        readers.read_files(spark, str(tmp_path), "jsonl").collect()


def test_graph_json(spark, tmp_path):
    g = {"graph": {"nodes": [{"id": "a", "type": "T"}], "links": [{"source": "a", "target": "a"}]}, "triples": [{"subject": "a", "predicate": "p", "object": "a"}, {"subject": "a", "predicate": "NEXT", "object": "a"}]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    n, e, t = readers.read_graph_json(spark, str(tmp_path / "g.json"))
    assert n.count() == 1 and e.first().target == "a" and t.count() == 1


def test_growing_by_links(spark):
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (3, 4), (4, 5)], "src int, dst int")
    got = readers.grow_by_links(links, spark.createDataFrame([(1,), (2,)], "id int"), 1.0, 1, 10)
    assert {r.id for r in got.collect()} == {1, 2, 3}


def test_gold(spark):
    pairs = spark.createDataFrame([(k, 100 + k) for k in range(300)], "a int, b int")
    got = readers.matching_gold(pairs, pairs, pairs).collect()
    assert sum(r.label == "duplicate" for r in got) == 300 and not {(r.a, r.b) for r in got if r.label != "duplicate"} & {(k, 100 + k) for k in range(300)}
    topics = spark.createDataFrame([("A", "q1", ["x", "y", "x"]), ("B", "q2", ["zz"]), ("C", "q3", [])], "title string, qid string, topics array<string>")
    assert [(r.title, r.topics) for r in readers.topic_labels(topics, ["x", "y"]).collect()] == [("A", ["x", "y"])]


@pytest.fixture
def small_graph(spark):
    triples = spark.createDataFrame([(1, "a", "likes", "b", 'says "x" & <y>', "k1", None), (2, "a", "knows", "b", None, "k2", "d"), (3, "b", "likes", "c", "e", "k1", None)], "ord int, subject string, predicate string, object string, evidence_sentence string, source_chunk_id string, description string")
    entities = spark.createDataFrame([(0, "a", "A & <B>", "T", None), (0, "b", "B", "Chunk", None)], "ord int, id string, name string, type string, description string")
    return graph.build_nodes(entities, triples), graph.build_edges(triples), triples


def test_exports(spark, small_graph, tmp_path):
    nodes, edges, triples = small_graph
    writers.export(nodes, edges, triples, str(tmp_path), ["graphml", "rdf", "cytoscape", "json", "bulk_csv"])
    doc = xml.dom.minidom.parseString("\n".join(r.value for r in spark.read.text(str(tmp_path / "graphml")).collect()))
    assert len(doc.getElementsByTagName("node")) == 3 and len(doc.getElementsByTagName("edge")) == 2
    assert spark.read.text(str(tmp_path / "rdf")).count() == 3 and spark.read.csv(str(tmp_path / "bulk_csv/relationships"), header=True).count() == 3
    assert all(json.loads(r.value)["data"] for r in spark.read.text(str(tmp_path / "cytoscape")).collect())
    assert {r.part: r["count"] for r in spark.read.text(str(tmp_path / "json")).groupBy("part").count().collect()} == {"node": 3, "edge": 2, "triple": 3}
    assert {r[":LABEL"] for r in writers.node_rows(nodes).collect()} == {"Entity", "Chunk"}
    with pytest.raises(ValueError):
        writers.export(nodes, edges, triples, str(tmp_path), ["other"])


def test_canonical_nodes(spark, small_graph):
    nodes, _, _ = small_graph
    e = spark.createDataFrame([("a", "Better", None, "d"), ("z", "Z", "T", None)], "id string, name string, type string, description string")
    got = {r.id: (r.name, r.type, r.importance) for r in writers.canonical_nodes(e, nodes.withColumn("importance", F.lit(0.5))).collect()}
    assert got["a"] == ("Better", "T", 0.5) and got["z"] == ("Z", "T", None) and got["c"] == ("c", "ENTITY", 0.5)


def test_stream_of_documents(spark, tmp_path):
    text = "A sentence with enough words to pass the filter of quality, surely. Another one follows it here."
    for k in range(3):
        spark.createDataFrame([(k, f"{text} Number {k}."), (10 + k, f"{text} Number {k}."), (20 + k, "short")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(stream, ingest.upsert(str(tmp_path / "out"), "chunk_id"), str(tmp_path / "check")).awaitTermination()
    got = ingest.newest(spark, str(tmp_path / "out"), "chunk_id")
    assert got.count() == 3 and got.select("parent_doc_id").distinct().count() == 3


def test_event_streams(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    events = [(k, at(m), k % 2, "t", 1.0) for k, m in enumerate([0, 5, 20, 70, 80, 500])] + [(0, at(1), 0, "t", 1.0)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(str(tmp_path / "ev"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert sorted(r.n for r in run(ingest.tumbling(stream), "tumbling_out", "complete").collect()) == [1, 2, 4]
    assert run(ingest.first_seen(stream, ["event_id"]), "first_out", "append").count() == 6
    assert run(ingest.sliding(stream), "sliding_out", "complete").count() > 3
    assert run(ingest.sessions(stream), "sessions_out", "append").count() >= 1


def test_pipeline(spark, tmp_path):
    body = "Ada Lovelace works with Analytical Engines in London today. Charles Babbage met Ada Lovelace in London. " * 4
    docs = spark.createDataFrame([("d1", body + "First ending.", "en", "One", ""), ("d2", body + "First ending.", "en", "Two", ""), ("d3", "Charles Babbage built things in London, which Ada Lovelace described at length. " * 6, "en", "Three", ""), ("d4", body, "fr", "", ""), ("d5", "short", "en", "", "")], "doc_id string, content string, language string, title string, url string")
    names = spark.createDataFrame([("ada", "Ada Lovelace", "PERSON"), ("bab", "Charles Babbage", "PERSON"), ("lon", "London", "GPE")], "id string, name string, type string")
    ontology = {"relationship_types": {"part_of": {"kind": "structural", "domain": "Chunk", "range": "Document"}, "lives_in": {"domain": "PERSON", "range": "GPE"}, "knows": {"domain": "PERSON", "range": "PERSON", "symmetric": True}, "odd": {"domain": "PERSON"}}}
    r = pipelines.build_graph(docs, names, pipelines.rules_table(spark, ontology), pipelines.GraphConfig(chunk_words=30, chunk_overlap=5))
    assert {x.doc_id: x.stage for x in r.skipped.collect()} == {"d2": "duplicate", "d4": "language", "d5": "quality"}
    found = {(x.subject, x.predicate, x.object) for x in r.triples.collect()}
    assert {("ada", "lives_in", "lon"), ("ada", "knows", "bab"), ("bab", "lives_in", "lon")} <= found
    kinds = {x.type: x["count"] for x in r.nodes.groupBy("type").count().collect()}
    assert kinds["Document"] == 2 and kinds["PERSON"] == 2 and kinds["GPE"] == 1 and kinds["Chunk"] == r.chunks.count()
    assert r.nodes.where("importance is null").count() == 0
    scores = pipelines.compare({"a": lambda: pipelines.evaluate(r), "b": lambda: pipelines.evaluate(r)})
    assert scores.count() == 2 and scores.first().consistency == 1.0
    assert len(pipelines.matrix(x=[1, 2], y="ab")) == 4 and pipelines.config_hash({"b": 1, "a": 2}) == pipelines.config_hash({"a": 2, "b": 1})
    out = pipelines.next_run(spark, str(tmp_path))
    pipelines.write_manifest(spark, out, {"chunks": {"n": 3}}, pipelines.GraphConfig())
    assert out.endswith("run_1") and pipelines.next_run(spark, str(tmp_path)).endswith("run_2") and spark.read.json(f"{out}/manifest").count() == 1


def test_articles(spark):
    rows = spark.createDataFrame([(1, "Ada Lovelace", "long enough", None, None), (2, "List of x", "long enough", None, None), (3, "C/D", "no", None, None)], "id int, title string, text string, url string, categories array<string>")
    got = readers.article_records(rows, min_chars=5).collect()
    assert [(r.id, r.url, r.categories) for r in got] == [("wikipedia:en:1", "https://en.wikipedia.org/wiki/Ada_Lovelace", [])]
    u = spark.createDataFrame([("https://fr.wikipedia.org/wiki/%C3%89cole_x#a",), ("https://example.org/wiki/Z",), (None,)], "url string")
    assert [tuple(r.p) for r in u.select(readers.url_parts(F.col("url")).alias("p")).collect()] == [("fr", "École x"), (None, None), (None, None)]
    assert readers.wanted_pages(u, spark.createDataFrame([("HTTPS://example.org/wiki/Z/",)], "url string")).count() == 1
    linked = readers.add_links(readers.article_records(rows), spark.createDataFrame([("1", "B c"), ("1", "A/b")], "page_id string, target string"))
    assert {r.page_id: r.links for r in linked.collect()} == {"1": ["https://en.wikipedia.org/wiki/A/b", "https://en.wikipedia.org/wiki/B_c"], "3": []}
