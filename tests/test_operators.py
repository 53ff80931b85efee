"""Operators that the registered queries don't cover, against plain Python."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.udfs import canonical, html_prose, nfc
from corpusloom.operators import archive, audit, chunk, curate, dedup, documents, evidence, extract, graph, leader, metrics, qa, relations, resolve, scoring, similarity
from corpusloom.operators.components import connected_components


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- texts ---


@pytest.mark.parametrize(("text", "flags"), [("aaaaaaaaaa b", "repeated_chars"), ("x\nx\nx\ny", "repeated_lines"), ("!!!! ??", "excessive_symbols"), ("a b c d long", "many_short_tokens"), ("plain words only here", "")])
def test_review_flags(spark, text, flags):
    df = spark.createDataFrame([(text,)], "t string").select(tx.quality_profile(F.col("t")).alias("p"))
    assert flags in ",".join(df.first().p.review_flags) if flags else df.first().p.review_flags == []


def test_unicode_forms(spark):
    df = spark.createDataFrame([("é Straße",), (None,), (" İ  x ",)], "t string")
    assert [r[0] for r in df.select(nfc("t")).collect()] == ["é Straße", None, " İ  x "]
    assert [r[0] for r in df.select(canonical("t")).collect()] == ["é strasse", None, "i̇ x"]


def test_stable_id_is_blind_to_case_and_blanks(spark):
    df = spark.createDataFrame([(" Ada  Lovelace ",), ("ada lovelace",), ("ada",)], "t string")
    a, b, c = (r[0] for r in df.select(tx.stable_id("Entity", F.col("t"))).collect())
    assert a == b != c and re.fullmatch("entity:[0-9a-f]{20}", a)


def test_relation_names(spark):
    df = spark.createDataFrame([("works at",), ("",), ("1st",), ("__",)], "t string")
    assert [r[0] for r in df.select(tx.relation_type(F.col("t"))).collect()] == ["WORKS_AT", "RELATION", "REL_1ST", "RELATION"]


def test_wilson(spark):
    low, high = tx.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(8, 10), (0, 0)], "k int, n int").select(F.round(low, 4), F.round(high, 4)).collect()
    assert tuple(got[0]) == (0.4902, 0.9433) and tuple(got[1]) == (0.0, 0.0)


def test_html(spark):
    page = '<html><nav><a href="/n">nav</a></nav><p>One <a href="/x">two  words</a><br>three<sup>1</sup></p><table><p>cell</p></table><h2>Head</h2><script>x</script><a href="/out">out</a>'
    r = spark.createDataFrame([(page,), (None,), ("<p>open",)], "h string").select(html_prose("h").alias("p")).collect()
    assert r[0].p.text == "One two wordsthree\nHead" and [tuple(x) for x in r[0].p.links] == [("two words", "/x"), ("out", "/out")]
    assert r[1].p.text == "" and r[2].p.text == "open"


# --- chunks ---


def fixed(text, size, overlap, sep):
    if len(text) <= size:
        return [text]
    out, cur = [], ""
    for s in (s for s in text.split(sep) if s.strip(" ")):
        if len(cur) + len(s) <= size or not cur:
            cur = f"{cur}{sep}{s}" if cur else s
        else:
            out.append(cur)
            tail = cur[-overlap:].lstrip(" ")
            cur = f"{tail}{sep}{s}" if tail else s
    out += [cur] if cur else []
    step = size - overlap
    return [p for c in out for p in ([c] if len(c) <= size else [c[k : k + size] for k in range(0, len(c) - overlap, step)])]


def by_sentence(text, target, overlap):
    sents = []
    for s in (s.strip(" ") for s in re.split(r"(?<=[.!?…])\s+|[\r\n]+", text)):
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", s) if x]
        sents += [s] if s and len(w) <= target else [" ".join(w[k : k + target]) for k in range(0, len(w), target)]
    count = lambda s: len(s.split())
    out, cur, n = [], [], 0
    for s in sents:
        if cur and n + count(s) > target:
            out.append(" ".join(cur))
            keep, k = [], 0
            for p in reversed(cur):
                if k + count(p) > overlap:
                    break
                keep, k = [p, *keep], k + count(p)
            cur, n = (keep, k) if k + count(s) <= target else ([], 0)
        cur, n = [*cur, s], n + count(s)
    return out + ([" ".join(cur)] if cur else [])


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8)))
    return ["", "one", "no end here " * 30, *("".join(word() + rng.choice([" ", " ", " ", ". ", "! ", "\n", "\n\n"]) for _ in range(rng.randint(1, 220))) for _ in range(60))]


def test_sentence_chunks(spark, prose):
    df = spark.createDataFrame(list(enumerate(prose)), "doc_id int, text string").select("text", chunk.sentence_chunks(F.col("text"), 25, 8).alias("c"))
    for r in df.collect():
        assert r.c == by_sentence(r.text, 25, 8)


def test_fixed_chunks(spark, prose):
    df = spark.createDataFrame(list(enumerate(prose)), "doc_id int, text string").select("text", chunk.fixed_chunks(F.col("text"), 120, 30, "\n\n").alias("c"))
    for r in df.collect():
        assert r.c == fixed(r.text, 120, 30, "\n\n")


def test_chunk_ids_and_neighbours(spark):
    df = spark.createDataFrame([("u" * 100, "a. b. c."), ("v", "x.")], "doc_id string, content string")
    got = chunk.chunk_documents(df, chunk.sentence_chunks(F.col("content"), 1, 0)).orderBy("parent_doc_id", "chunk_index").collect()
    assert [r.content for r in got] == ["a.", "b.", "c.", "x."] and got[0].next_chunk_id == got[1].chunk_id and got[2].next_chunk_id is None
    assert len(got[0].chunk_id) <= 80 + len(":chunk0") and got[3].chunk_id == "v:chunk0"


def test_semantic_boundaries(spark):
    s = [(1, k, f"s{k}", 10, v) for k, v in enumerate([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0], [0.0, 1.0]])]
    got = chunk.semantic_boundaries(spark.createDataFrame(s, "doc_id int, pos int, s string, n int, v array<double>"), target=25, threshold=0.55).orderBy("pos").collect()
    assert [r.chunk_index for r in got] == [0, 0, 1, 1, 2]


def test_lossless_split(spark, prose):
    df = spark.createDataFrame(list(enumerate(prose)), "doc_id int, text string")
    parts = {}
    for r in evidence.split_to_limit(df, 7).orderBy("doc_id", "part").collect():
        parts.setdefault(r.doc_id, []).append(r.content)
        assert len(r.content.split()) <= 7
    assert all("".join(parts.get(k, [])) == t for k, t in enumerate(prose))


# --- similarity and clusters ---


def random_sets(n=70, seed=4):
    rng = random.Random(seed)
    base = [{rng.randrange(40) for _ in range(rng.randint(1, 14))} for _ in range(n // 3)]
    out = [(k, sorted(map(str, b ^ {rng.randrange(40) for _ in range(rng.randint(0, 2))}))) for k, b in enumerate(itertools.islice(itertools.cycle(base), n))]
    return [*out, (n, []), (n + 1, []), (n + 2, None)]


@pytest.mark.parametrize("t", [0.3, 0.6, 0.85, 1.0])
def test_set_similarity_misses_nothing(spark, t):
    sets = random_sets()
    members, pairs = similarity.set_similarity(spark.createDataFrame(sets, "id int, tokens array<string>"), t)
    first = {}
    for k, s in sets:
        first.setdefault(frozenset(s or ()), k)
    assert dict(rows(members)) == {k: first[frozenset(s or ())] for k, s in sets}
    want = {(a, b) for (x, a), (y, b) in itertools.combinations(sorted(first.items(), key=lambda i: i[1]), 2) if x | y and len(x & y) / len(x | y) >= t - 1e-12}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_lsh_finds_a_part_of_it(spark):
    sets = spark.createDataFrame([(k, s) for k, s in random_sets() if s], "id int, tokens array<string>")
    exact = {(r.a, r.b) for r in similarity.minhash_lsh_pairs(sets, 0.9, bands=16, rows=2).collect()}
    assert exact and all(a < b for a, b in exact)


def test_hamming(spark):
    rng = random.Random(6)
    codes = [rng.getrandbits(63) for _ in range(30)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(63), 3)) for c in codes[:15]] + codes[:4]
    got = similarity.hamming_pairs(spark.createDataFrame(list(enumerate(codes)), "id int, code long"), 3).collect()
    linked = {(r.a, r.b) for r in got}
    assert all((codes[a] ^ codes[b]).bit_count() == r.hamming for r, (a, b) in ((r, (r.a, r.b)) for r in got))
    first = {c: k for k, c in reversed(list(enumerate(codes)))}
    assert linked == {(min(first[x], first[y]), max(first[x], first[y])) for x, y in itertools.combinations(first, 2) if (x ^ y).bit_count() <= 3} | {(first[c], k) for k, c in enumerate(codes) if first[c] != k}


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 140)] + [(None, 3), (5, 5)]
    root = {x: x for p in links for x in p if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = dict(rows(connected_components(spark.createDataFrame(links, "a int, b int"))))
    assert got == {x: find(x) for x in root if x in {y for a, b in links if None not in (a, b) and a != b for y in (a, b)}}


def test_leader_is_the_walk(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pairs = [tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)]
        led = {}
        for x in range(40):
            led[x] = next((y for y in sorted(led) if led[y] == y and (y, x) in pairs), x)
        df = spark.createDataFrame(pairs, "a int, b int")
        assert dict(rows(leader.greedy_leader(spark.range(40).select(F.col("id").cast("int").alias("id")), df))) == led


def test_cosine_blocks(spark):
    rng = random.Random(2)
    vs = [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(60)] + [(60, [0.0, 0.0, 0.0])]
    norm = lambda v: max(sum(x * x for x in v) ** 0.5, 1e-12)
    want = {(a, b) for (a, u), (b, v) in itertools.combinations(vs, 2) if sum(x * y for x, y in zip(u, v)) / norm(u) / norm(v) >= 0.9}
    df = spark.createDataFrame(vs, "id int, v array<double>")
    for size in (7, 1000):
        assert {(r.a, r.b) for r in similarity.cosine_pairs(df, 0.9, rows=size).collect()} == want


def test_layers(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (10, "alpha beta gamma delta!"), (3, "something else entirely"), (4, "words of a fourth text")], "doc_id int, content string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (10, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.05, 1.0])], "id int, v array<double>")
    left = lambda *a, **k: {r.doc_id for r in dedup.remove_duplicates(docs, *a, **k).collect()}
    assert left("exact") == {1, 10, 3, 4} and left("minhash") == {1, 3, 4} and left("ngram") == {1, 3, 4} and left("none") == {1, 2, 3, 4, 10}
    assert left("layered", vectors=vectors) == {1, 3} and left("semantic", vectors=vectors) == {1, 3}
    with pytest.raises(ValueError):
        left("other")
    with pytest.raises(ValueError):
        left("layered")


def test_evidence_of_matches(spark):
    pairs = spark.createDataFrame([(1, 2, "minhash", 0.9), (1, 3, "exact", 1.0), (2, 3, "exact", 0.9)], "a int, b int, method string, similarity double")
    assert rows(dedup.match_evidence(pairs)) == [(1, 3, "exact", 1.0), (2, 3, "exact", 0.9), (3, 1, "exact", 1.0)]


# --- extraction and relations ---


def test_pattern_entities(spark):
    df = spark.createDataFrame([(1, "Mail Ada Lovelace at ada@example.org or ADA@example.org, see https://example.org/x. Ada Lovelace"), (2, None)], "doc_id int, text string")
    assert {(r.name, r.type) for r in extract.pattern_entities(df).collect()} == {("ada@example.org", "CONTACT"), ("https://example.org/x.", "URL"), ("Mail Ada Lovelace", "NAMED_ENTITY"), ("Ada Lovelace", "NAMED_ENTITY")}


def test_replies(spark):
    reply = '("entity"<|>"Ada"<|>"person"<|>"a pioneer")##("entity"<|>"Rock"<|>"stone"<|>"x")##("entity"<|>"Paris"<|>"place"<|>"city")##("relationship"<|>"Ada"<|>"Paris"<|>"lived")##("relationship"<|>"Ada"<|>"Rock"<|>"no")<|COMPLETE|>'
    e, r = extract.read_records(spark.createDataFrame([(1, reply)], "doc_id int, reply string"), ["person", "place"])
    assert rows(e) == [(1, "Ada", "PERSON", "a pioneer"), (1, "Paris", "PLACE", "city")] and rows(r) == [(1, "Ada", "RELATION", "Paris", "lived")]
    js = '```json\n[{"subject":"a","predicate":"p","object":"b","evidence":"in text"},{"subject":"a","predicate":"q","object":"b","evidence":"in text"},{"subject":"a","predicate":"p","object":"c","evidence":"absent"}]\n```'
    rules = spark.createDataFrame([("p",)], "predicate string")
    assert rows(extract.grounded_json(spark.createDataFrame([(1, "all in text", js), (2, "x", "not json")], "doc_id int, text string, reply string"), rules)) == [(1, "a", "p", "b", "in text")]


def test_citations(spark):
    docs = [(1, "see 10.1000/xyz1 and (Doe, 2020)", "A first title", "10.1000/abc", "Roe", "2019"), (2, "reads A first title here", "Other", "10.1000/XYZ1", "Doe", "2020"), (3, "self 10.1000/self", "Short", "10.1000/self", None, None)]
    got = rows(relations.citations(spark.createDataFrame(docs, "id int, content string, title string, doi string, first_author string, year string")))
    assert [r[:3] for r in got] == [(1, "cites", 2), (2, "cites", 1)]


def test_series(spark):
    s = [(1, "A ", None, "2020-01-02"), (2, "a", None, "2020-01-01"), (3, "b", 2, None), (4, "B", 1, None), (5, "c", None, None), (6, "c", None, None), (7, "c", None, None), (8, "d", 1, None)]
    got = rows(relations.series_edges(spark.createDataFrame(s, "id int, series string, series_index int, date string")))
    assert {(a, b) for a, _, b, _ in got} == {(2, 1), (4, 3), (5, 6), (5, 7), (6, 7)}


def test_document_stages(spark):
    docs = spark.createDataFrame([("d1", " a \r\n\r\n\r\n b ", "en", "T", "", {"links": "http://b.c, http://a.b"}), ("d2", "see http://x.y/z.", "fr", "", "http://u", {}), ("d3", " ", "en", "", "", {})], "doc_id string, content string, language string, title string, url string, metadata map<string,string>")
    clean = documents.clean_documents(docs)
    assert rows(clean.select("doc_id", "content")) == [("d1", "a\n\nb"), ("d2", "see http://x.y/z.")]
    kept, skipped = documents.language_gate(clean, ["en"])
    assert rows(documents.skipped_report({"gate": skipped})) == [("gate", "fr", 1)] and kept.count() == 1
    links = clean.select("doc_id", documents.normal_links(F.col("metadata"), F.col("content")).alias("l"))
    assert rows(links) == [("d1", ["http://a.b", "http://b.c"]), ("d2", ["http://x.y/z."])]
    assert rows(documents.document_nodes(docs)) == [("d1", "T", "Document"), ("d2", "http://u", "Document"), ("d3", "d3", "Document")]


def test_membership_and_projection(spark):
    chunks = chunk.chunk_documents(spark.createDataFrame([("d", "a. b.")], "doc_id string, content string"), chunk.sentence_chunks(F.col("content"), 1, 0))
    entities = spark.createDataFrame([("e", "X", ["d:chunk0", "d:chunk0", "gone"]), ("c", "Chunk", ["d:chunk1"])], "id string, type string, source_chunk_ids array<string>")
    assert rows(documents.chunk_membership(entities, chunks)) == [("e", "appears_in", "d:chunk0")]
    assert rows(documents.chunk_edges(chunks)) == [("d:chunk0", "next", "d:chunk1"), ("d:chunk0", "part_of", "d"), ("d:chunk1", "part_of", "d")]
    assert documents.stamp_provenance(entities, F.lit("new")).where("id = 'e'").first().source_chunk_ids == ["d:chunk0", "gone", "new"]
    n, e = documents.project_graph(entities, documents.chunk_edges(chunks).union(documents.chunk_membership(entities, chunks)), ["X"], ["appears_in"])
    assert n.count() == 1 and e.count() == 0


# --- graphs ---


@pytest.fixture(scope="module")
def tiny(spark):
    nodes = [(k, f"n{k}", "T") for k in range(9)]
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5), (6, 7)]
    return spark.createDataFrame(nodes, "id int, name string, type string"), spark.createDataFrame([(a, b, 1, ["p"]) for a, b in edges], "subject int, object int, weight int, predicates array<string>")


def test_components_of_graphs(tiny):
    assert dict(rows(graph.strong_components(*tiny))) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8}
    assert dict(rows(graph.weak_components(*tiny))) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6, 7: 6, 8: 8}


def test_rank_sums_to_one(tiny):
    got = dict(rows(graph.pagerank(*tiny, tolerance=1e-9)))
    assert abs(sum(got.values()) - 1) < 1e-4 and got[3] > got[2] and got[8] == min(got.values())


def test_reads(tiny):
    s = graph.GraphStore(*tiny)
    assert rows(s.successors(2).select("id")) == [(0,), (3,)] and rows(s.predecessors(3)) == [(2,), (4,)] and rows(s.neighbors(5)) == [(5,)]
    assert s.get_node(1).count() == 1 and s.get_edge(0, 1).count() == 1 and s.get_edge(1, 0).count() == 0 and rows(s.search("N8").select("id")) == [(8,)]
    assert {(r.metric, r.label): r.value for r in s.stats().collect()}["relation", "p"] == 8.0


def test_audit_of_orphans(tiny):
    r = audit.orphans(*tiny).first()
    assert (r.nodes, r.orphans) == (9, 1)
    assert audit.band(85) == "good" and audit.band(10) == "poor"


def test_merge_and_replace(spark):
    node = "id string, type string, description string"
    old_n, new_n = spark.createDataFrame([("a", "T", "old"), ("b", "T", "keep")], node), spark.createDataFrame([("a", "U", None), ("c", "T", "new")], node)
    edge = "subject string, object string, predicates array<string>, source_texts array<string>, source_chunk_ids array<string>, description string"
    old_e, new_e = spark.createDataFrame([("a", "b", ["p"], ["x"], ["k1"], "d1")], edge), spark.createDataFrame([("a", "b", ["q", "p"], None, ["k2"], "d2"), ("a", "c", ["p"], [], [], None)], edge)
    n, e = graph.merge_graphs(old_n, new_n, old_e, new_e)
    assert rows(n) == [("a", "U", "old"), ("b", "T", "keep"), ("c", "T", "new")]
    assert rows(e.select("subject", "object", "predicates", "source_chunk_ids", "description", "weight"))[0] == ("a", "b", ["p", "q"], ["k1", "k2"], "d1", 2)
    nodes = spark.createDataFrame([("d1", "Document", None), ("d2", "Document", None), ("k1", "Chunk", "d1"), ("k2", "Chunk", "d2"), ("e1", "X", None), ("e2", "X", None)], "id string, type string, parent_doc_id string")
    edges = spark.createDataFrame([("e1", "appears_in", "k1"), ("e2", "appears_in", "k2"), ("k1", "part_of", "d1"), ("k2", "part_of", "d2")], "subject string, predicate string, object string")
    rel = spark.createDataFrame([("e1", "p", "e2", ["k1", "k2"]), ("e2", "p", "e1", ["k1"])], "subject string, predicate string, object string, chunk_ids array<string>")
    n, e, r = graph.replace_documents(nodes, edges, rel, spark.createDataFrame([("d1",)], "doc_id string"))
    assert [x[0] for x in rows(n.select("id"))] == ["d2", "e2", "k2"] and e.count() == 2 and rows(r) == [("e1", "p", "e2", ["k2"])]


def test_hetero_parts(spark):
    e = spark.createDataFrame([("a", "writes", "p", 1, 2)], "src_type string, rel string, dst_type string, src int, dst int")
    assert rows(graph.reversed_edges(e)) == [("a", "writes", "p", 1, 2), ("p", "rev_writes", "a", 2, 1)]
    assert rows(graph.dense_index(spark.createDataFrame([("t", "b"), ("t", "a"), ("u", "z"), ("t", "a")], "type string, id string"))) == [("t", "a", 0), ("t", "b", 1), ("u", "z", 0)]


# --- evidence, scores, training sets ---


def test_linked_mentions(spark):
    m = spark.createDataFrame([(1, 0, 5, "Paris", "GPE"), (1, 9, 12, "Ada", "PERSON")], "doc_id int, start int, end int, surface string, type string")
    l = spark.createDataFrame([(1, 0, 5, "Paris", "Q90"), (1, 10, 12, "da", "Q1")], "doc_id int, start int, end int, surface string, target string")
    assert rows(evidence.linked_mentions(m, l).select("surface", "target")) == [("Ada", None), ("Paris", "Q90")]
    outer = spark.createDataFrame([(1, 0, 10, 7)], "doc_id int, start int, end int, chunk int")
    assert rows(evidence.contained(m, outer).select("surface", "chunk_b")) == [("Paris", 7)]


def test_evidence_graph(spark):
    o = spark.createDataFrame([(1, "B"), (1, "A"), (1, "B"), (2, "Z"), (2, "Y")], "id int, type string")
    assert rows(evidence.primary_type(o)) == [(1, "B"), (2, "Y")]
    n = spark.createDataFrame([("m1", "Mention"), ("m2", "Mention"), ("m3", "Mention"), ("x", "E")], "id string, type string")
    e = spark.createDataFrame([("m1", "refers_to", "x", "s"), ("m3", "refers_to", "x", "s"), ("m3", "refers_to", "y", "t"), ("m1", "refers_to", "x", "u")][:3], "subject string, predicate string, object string, evidence string")
    assert rows(evidence.unresolved_mentions(n, e)) == [("m2", 0), ("m3", 2)]
    assert rows(evidence.merge_duplicate_edges(e.union(e)).select("subject", "object", "weight"))[0] == ("m1", "x", 2)
    assert (None, 4) in [r[1:] for r in rows(evidence.summary(n, e))]
    a = spark.createDataFrame([(1, "A", ["B", "A", "none"]), (2, "B", ["A"])], "id int, title string, links array<string>")
    assert rows(evidence.article_links(a)) == [(1, "links_to", 2), (2, "links_to", 1)]
    labels = spark.createDataFrame([(1, ["x", "y"])], "article_id int, topic_ids array<string>")
    assert evidence.attach_labels(a, labels).count() == 1 and evidence.attach_labels(a, labels, False).count() == 2
    assert rows(evidence.unknown_topics(labels, spark.createDataFrame([("x",)], "topic string"))) == [("y", 1)]


def test_topic_cover_is_the_walk(spark):
    rng = random.Random(3)
    records = [(k, [f"t{rng.randrange(9)}" for _ in range(rng.randint(0, 3))]) for k in range(80)]
    count, want = {}, []
    for k, topics in records:
        if any(count.get(t, 0) < 2 for t in topics):
            want.append(k)
            for t in set(topics):
                count[t] = count.get(t, 0) + 1
    assert [r[0] for r in rows(evidence.topic_cover(spark.createDataFrame(records, "ord int, topics array<string>"), 2).select("ord"))] == sorted(want, key=lambda k: repr((k,)))


def test_trim_is_the_walk(spark):
    rng = random.Random(5)
    items = [(k, rng.randint(1, 60)) for k in range(60)]
    room, want = 500, []
    for k, n in items:
        if n <= room:
            room -= n
            want.append(k)
    assert sorted(r.ord for r in evidence.trim_to_budget(spark.createDataFrame(items, "ord int, tokens int"), 500, "ord").collect()) == want


def test_batches(spark):
    df = spark.createDataFrame([(k, k % 17 + 1) for k in range(200)], "id int, tokens int")
    got = {}
    for r in evidence.token_batches(df, 30, most=5, groups=3).collect():
        got.setdefault(r.batch, []).append(r.tokens)
    assert sum(map(len, got.values())) == 200 and all(len(b) <= 5 and (sum(b) <= 30 or len(b) == 1) for b in got.values())
    assert evidence.pending(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "content_hash string, id int"), spark.createDataFrame([("b",)], "content_hash string")).count() == 1


def test_names_and_boundaries(spark):
    texts = spark.createDataFrame([(1, "Ada met Ada. Bob (x) came.")], "doc_id int, text string")
    names = spark.createDataFrame([(1, "Ada", "P"), (1, "(x)", "Q"), (1, "Eve", "P")], "doc_id int, name string, type string")
    gold = spark.createDataFrame([(1, 8, 11)], "doc_id int, start int, end int")
    assert rows(evidence.locate_names(names, texts, gold)) == [(1, "(x)", "Q", 17, 20), (1, "Ada", "P", 8, 11)]
    chunks = spark.createDataFrame([(1, 0, "Ada met Ada."), (1, 1, "Bob (x) came.")], "doc_id int, chunk_index int, content string")
    assert rows(evidence.chunk_boundaries(texts, chunks)) == [(1, 12)]


def test_resolution(spark):
    e = spark.createDataFrame([(1, "e1", "International Business Machines", "ORG", ["Big Blue"], 0.5, "d", ["k1"]), (2, "e2", "IBM", "ORG", [], 0.9, "longer", ["k2"]), (3, "e3", "IBM", "PERSON", [], 0.9, None, ["k2"]), (4, "e4", "Other", "ORG", [], 0.1, None, [])], "ord int, id string, name string, type string, aliases array<string>, confidence double, description string, source_chunk_ids array<string>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.05]), (3, [1.0, 0.0]), (4, [1.0, 0.01])], "ord int, v array<double>")
    merged, mapping = resolve.resolve_embedding(e, v)
    assert dict(rows(mapping)) == {"e1": "e1", "e2": "e1", "e3": "e3", "e4": "e4"}
    m = merged.where("id = 'e1'").first()
    assert (m.aliases, m.confidence, m.description, m.source_chunk_ids, m.members) == (["Big Blue", "IBM", "International Business Machines"], 0.9, "longer", ["k1", "k2"], 2)
    assert {r.name: r.id for r in resolve.alias_map(merged).where("type = 'ORG'").collect()}["big blue"] == "e1"
    linked = resolve.link_entities(e, spark.createDataFrame([("ibm", "Q37156")], "name string, kb_id string"))
    assert linked.where("kb_id is not null").count() == 2
    best = resolve.containment_candidates(spark.createDataFrame([("Business Machines", "ORG")], "name string, type string"), e.select("id", "name", "type"))
    assert best.first().id == "e1"
    t = resolve.remap_triples(spark.createDataFrame([("e2", "p", "zz")], "subject string, predicate string, object string"), mapping)
    assert rows(t.select("subject", "object")) == [("e1", "zz")]


def test_scores(spark):
    r = scoring.multilabel_scores(spark.createDataFrame([(1, "a", True, 2.0), (1, "b", False, 1.0), (2, "a", True, -1.0), (2, "b", False, -3.0)], "id int, label string, truth boolean, logit double")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.f1) == (1, 1, 1, 1, 0.5)
    hits = spark.createDataFrame([(1, 5), (1, 6)], "query_id int, doc_id int")
    assert tuple(scoring.recall_at_k(hits, spark.createDataFrame([(1, 6), (2, 7)], "query_id int, doc_id int")).first()) == (0.5, 0.5)
    t = spark.createDataFrame([("a b c", "x A B C y"), ("a b c", "a b d"), ("", "z")], "a string, b string")
    assert [x[0] for x in t.select(scoring.texts_match(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_negatives_are_false(spark):
    t = spark.createDataFrame([(f"s{k}", "p" if k % 2 else "q", f"o{k % 5}") for k in range(20)], "subject string, predicate string, object string")
    known = set(rows(t))
    neg = rows(metrics.negatives(t))
    assert neg and not known & set(neg) and {n[1] for n in neg} == {"p", "q"}
    assert metrics.sample_facts(t, 5).count() == 5


def test_questions(spark):
    docs = spark.createDataFrame([(1, "The Loom is a machine for cloth. Ada Lovelace was born in 1815. nothing here"), (2, None)], "doc_id int, text string")
    got = rows(qa.text_questions(docs).select("question", "answer"))
    assert got == [("In which year: Ada Lovelace was born?", "1815"), ("What is The Loom?", "a machine for cloth")]
    q = spark.createDataFrame([("Q?", "a", "x", "s"), ("q?", "b", "y", "s"), ("r?", "", "x", "s")], "question string, answer string, kind string, source string")
    assert rows(qa.finish(q).select("question", "answer")) == [("Q?", "a")]
    e = spark.createDataFrame([(k, f"Name{k // 2}") for k in range(40)], "id int, name string")
    pairs = qa.entity_pairs(e).collect()
    assert len([p for p in pairs if p.label == 1]) == 20 and all(p.a < p.b for p in pairs)
    many = spark.createDataFrame([(f"q {k}", "a b") for k in range(50)], "question string, answer string")
    assert 0 < qa.balance_volume(many, 60).count() <= 15
    types = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "id int, type string")
    edges = spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "subject int, object int")
    assert rows(qa.comparisons(edges, types)) == [(1, 2, 1)]


def test_archive(spark):
    a = spark.createDataFrame([("d", 1, "h1", 1)], "doc_id string, version int, content_hash string, last_upload int")
    one = archive.store(a, spark.createDataFrame([("d", "h1", 5), ("e", "h1", 5)], "doc_id string, content_hash string, at int"))
    assert rows(one) == [("d", 1, "h1", 5), ("e", 1, "h1", 5)]
    two = archive.store(one, spark.createDataFrame([("d", "h2", 7)], "doc_id string, content_hash string, at int"))
    assert ("d", 2, "h2", 7) in rows(two) and ("d", 1, "h1", 5) in rows(two)
    old = archive.archive_chunks(spark.createDataFrame([("d", "k", "x" * 900)], "parent_doc_id string, chunk_id string, content string"), spark.createDataFrame([("d", 2)], "doc_id string, version int"))
    assert len(old.first().content) == 500 and old.first().replaced_by_version == 2


def test_curation_keeps_everything_accounted_for(spark):
    text = " ".join(f"word{k} goes here." for k in range(40))
    docs = spark.createDataFrame([(1, text, "s"), (2, text + " More.", "s"), (3, "short", "s"), (4, None, "t"), (5, "Another text entirely with enough different words to be kept, and some more of them.", "t")], "doc_id int, text string, source string")
    audit_, records = curate.curate(docs)
    assert {r.doc_id: (r.decision, r.reasons) for r in audit_.collect()} == {1: ("accepted", []), 2: ("rejected", ["near_duplicate"]), 3: ("rejected", ["too_short_characters", "too_short_words"]), 4: ("rejected", ["empty_content", "too_short_characters", "too_short_words"]), 5: ("accepted", [])}
    assert {r.doc_id for r in records.collect()} == {1, 5}
    assert (None, 5, 2, 3) in [r[:4] for r in rows(curate.report(audit_))]
    assert ("near_duplicate", 1) in rows(curate.reason_histogram(audit_))
    near = spark.createDataFrame([(1, 2, 0.95), (2, 1, 0.95), (1, 3, 0.5)], "id int, neighbour int, similarity double")
    assert rows(curate.review_pairs(near)) == [(1, 2, 0.95)]
