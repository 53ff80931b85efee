"""Queries over the stages between documents and graphs: nodes and edges of documents, links, records, archives, merges, samples, questions, readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import surface_compatible, token_estimate, wilson
from ..operators import archive, chunk, curate, dedup, documents, evidence, extract, graph, metrics, qa, relations, resolve, scoring
from ..operators.components import shared_folder
from ..sources import readers, writers
from .graph_queries import REG as GRAPH_REG
from .graph_queries import vectors
from .registry import Registry, table
from .text_queries import CLEAN, SENTENCES, components_sql, leaders_sql

REG = Registry()


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("lang").alias("language"), "source")


# --- documents ---


@REG.query(f"SELECT doc_id, {CLEAN} AS content FROM documents WHERE text IS NOT NULL AND trim({CLEAN}) <> ''")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.clean_documents(content(spark, sf_dir)).select("doc_id", "content")


@REG.query("SELECT lang AS language, coalesce(lang IN ('en'), false) AS kept, count(*) AS n FROM documents GROUP BY ALL")
def language_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, skipped = documents.language_gate(content(spark, sf_dir), ["en"])
    both = kept.withColumn("kept", F.lit(True)).union(skipped.withColumn("kept", F.lit(False)))
    return both.groupBy("language", "kept").agg(F.count("*").alias("n"))


@REG.query("SELECT 'extract' AS stage, lang AS language, count(*) AS n FROM documents WHERE NOT coalesce(lang IN ('en', 'de'), false) GROUP BY lang UNION ALL SELECT 'link', lang, count(*) FROM documents WHERE NOT coalesce(lang IN ('en'), false) GROUP BY lang")
def skipped_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = content(spark, sf_dir)
    return documents.skipped_report({stage: documents.language_gate(docs, list(known))[1] for stage, known in (("extract", ("en", "de")), ("link", ("en",)))})


@REG.query(r"""WITH s AS (SELECT doc_id, text, list_sort(list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '[,\s]+'), lambda u: starts_with(u, 'http')))) AS stated FROM documents)
    SELECT doc_id, array_to_string(CASE WHEN len(stated) > 0 THEN stated ELSE list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), 'https?://[^\s<>\"'')\]]+'))) END, ' ') AS links FROM s""")
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as lists of references: what is parted by blanks and starts as an address, else addresses within words."""
    docs = content(spark, sf_dir).select("doc_id", F.coalesce("content", F.lit("")).alias("content"))
    return docs.select("doc_id", F.array_join(documents.normal_links(F.create_map(F.lit("references"), F.col("content")), F.col("content")), " ").alias("links"))


TITLE = "<title>([^<]*)</title>"


@REG.query(f"SELECT page_id::VARCHAR AS id, coalesce(nullif(regexp_extract(html, '{TITLE}', 1), ''), nullif(url, ''), page_id::VARCHAR) AS name, 'Document' AS type FROM pages")
def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.document_nodes(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", TITLE, 1).alias("title"), "url"))


# --- conversations as documents, turns as chunks ---
CHUNKS = "ch AS (SELECT 'c' || conv_id || ':' || turn AS chunk_id, 'c' || conv_id AS parent_doc_id, turn AS chunk_index, role, text AS content, lead('c' || conv_id || ':' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_chunk_id FROM conversations)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda k: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(":"), k.cast("string"))
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("more"))
    return c.join(after, ["conv_id", "turn"], "left").select(name(F.col("turn")).alias("chunk_id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("parent_doc_id"), F.col("turn").alias("chunk_index"), "role", F.col("text").alias("content"), F.when(F.col("more"), name(F.col("turn") + 1)).alias("next_chunk_id"))


@REG.query(f"WITH {CHUNKS} SELECT chunk_id AS id, chunk_id AS name, 'Chunk' AS type, parent_doc_id FROM ch")
def chunk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunk_nodes(turns(spark, sf_dir))


@REG.query(f"WITH {CHUNKS} SELECT chunk_id AS subject, 'part_of' AS predicate, parent_doc_id AS object FROM ch UNION ALL SELECT chunk_id, 'next', next_chunk_id FROM ch WHERE next_chunk_id IS NOT NULL")
def chunk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunk_edges(turns(spark, sf_dir))


@REG.query(f"WITH {CHUNKS} SELECT chunk_id, parent_doc_id || ':0' || CASE WHEN chunk_id <> parent_doc_id || ':0' THEN ',' || chunk_id ELSE '' END AS chunks FROM ch")
def stamped_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles as mentions that are known from the first turn, stamped with their own."""
    m = turns(spark, sf_dir).withColumn("source_chunk_ids", F.array(F.concat("parent_doc_id", F.lit(":0"))))
    return documents.stamp_provenance(m, F.col("chunk_id")).select("chunk_id", F.array_join("source_chunk_ids", ",").alias("chunks"))


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles as entities that name the turn after each of theirs, whether there is one or not; and a document, which has no membership."""
    after = F.concat("parent_doc_id", F.lit(":"), (F.col("chunk_index") + 1).cast("string"))
    roles = turns(spark, sf_dir).groupBy(F.col("role").alias("id")).agg(F.collect_set(after).alias("source_chunk_ids")).select("id", F.col("id").alias("name"), F.lit("ROLE").alias("type"), "source_chunk_ids")
    return roles.union(roles.select(F.concat(F.lit("d:"), "id"), "name", F.lit("Document"), "source_chunk_ids"))


@REG.query(f"WITH {CHUNKS} SELECT DISTINCT a.role AS subject, 'appears_in' AS predicate, b.chunk_id AS object FROM ch a JOIN ch b ON b.parent_doc_id = a.parent_doc_id AND b.chunk_index = a.chunk_index + 1")
def chunk_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunk_membership(speakers(spark, sf_dir), turns(spark, sf_dir))


# --- customers, nations and regions as a graph ---
PLACES = """pn AS (SELECT 'c' || c_custkey AS id, c_name AS name, 'Customer' AS type FROM customer UNION ALL SELECT 'n' || n_nationkey, n_name, 'Nation' FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 'Region' FROM region),
    pt AS (SELECT 'c' || c_custkey AS subject, 'lives_in' AS predicate, 'n' || c_nationkey AS object FROM customer UNION ALL SELECT 'n' || n_nationkey, 'lies_in', 'r' || n_regionkey FROM nation)"""


def key(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def place_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, p, k, n, kind: table(spark, sf_dir, t).select(key(p, k).alias("id"), F.col(n).alias("name"), F.lit(kind).alias("type"))
    return one("customer", "c", "c_custkey", "c_name", "Customer").union(one("nation", "n", "n_nationkey", "n_name", "Nation")).union(one("region", "r", "r_regionkey", "r_name", "Region"))


def place_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lives = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("subject"), F.lit("lives_in").alias("predicate"), key("n", "c_nationkey").alias("object"))
    return lives.union(table(spark, sf_dir, "nation").select(key("n", "n_nationkey"), F.lit("lies_in"), key("r", "n_regionkey")))


@REG.query(f"WITH {PLACES}, m AS (SELECT 'c' || c_custkey AS old_id, 'n' || c_nationkey AS canonical_id FROM customer) SELECT 'o' || o_orderkey AS subject, 'placed_by' AS predicate, canonical_id AS object FROM orders JOIN m ON old_id = 'c' || o_custkey")
def remapped_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their customers' nations."""
    t = table(spark, sf_dir, "orders").select(key("o", "o_orderkey").alias("subject"), F.lit("placed_by").alias("predicate"), key("c", "o_custkey").alias("object"))
    return resolve.remap_triples(t, table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("old_id"), key("n", "c_nationkey").alias("canonical_id"))).select("subject", "predicate", "object")


@REG.query(f"WITH {CHUNKS}, {PLACES} SELECT 'entity' AS kind, type AS label, count(*) AS n FROM pn GROUP BY type UNION ALL SELECT 'triple', predicate, count(*) FROM pt GROUP BY predicate")
def semantic_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of places and turns without the turns."""
    chunks = turns(spark, sf_dir)
    entities, triples = documents.semantic_part(place_nodes(spark, sf_dir).union(documents.chunk_nodes(chunks).select("id", "name", "type")), place_triples(spark, sf_dir).union(documents.chunk_edges(chunks)))
    return entities.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("entity").alias("kind"), "label", "n").union(triples.groupBy("predicate").agg(F.count("*").alias("n")).select(F.lit("triple"), "predicate", "n"))


@REG.query(f"WITH {PLACES} SELECT 'node' AS kind, id AS a, type AS p, name AS b FROM pn WHERE type IN ('Nation', 'Customer') UNION ALL SELECT 'edge', subject, predicate, object FROM pt WHERE predicate = 'lives_in'")
def gnn_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lies_in edges go since regions do."""
    nodes, edges = documents.project_graph(place_nodes(spark, sf_dir), place_triples(spark, sf_dir), ["Nation", "Customer"], ["lives_in", "lies_in"])
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type").alias("p"), F.col("name").alias("b")).union(edges.select(F.lit("edge"), "subject", "predicate", "object"))


@REG.query("SELECT p_brand AS brand, string_agg(t, ' ' ORDER BY t) AS description, cast(count(*) AS INT) AS n_descriptions FROM (SELECT DISTINCT p_brand, p_type AS t FROM part WHERE p_type <> '') GROUP BY p_brand")
def joined_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.aggregate_descriptions(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("description")), ["brand"])


# --- relations between documents ---
CITED = r"""cd AS (SELECT 'b' || item_id AS id, '' AS content, text AS title, '10.1234/B' || item_id AS doi, 'Smith' || item_id AS first_author, '2001' AS year FROM benchmark
        UNION ALL SELECT 'd' || doc_id, coalesce(text, '') || ' See 10.1234/b' || (doc_id % 60) || ' and (Smith' || (doc_id % 60 + 1) || ', 2001).', '', '10.9999/D' || doc_id, 'Jones', '1999' FROM documents),
    hits AS (SELECT a.id AS subject, b.id AS object, 0 AS how, lower(b.doi) AS e FROM cd a JOIN cd b ON list_contains(list_transform(regexp_extract_all(a.content, '10\.\d{4,9}/[^\s\"<>]*[A-Za-z0-9]'), lambda x: lower(x)), lower(b.doi))
        UNION ALL SELECT a.id, b.id, 1, b.title FROM cd a JOIN cd b ON length(b.title) > 5 AND contains(lower(a.content), lower(b.title))
        UNION ALL SELECT a.id, b.id, 2, '(' || b.first_author || ', ' || b.year || ')' FROM cd a JOIN cd b ON contains(a.content, '(' || b.first_author || ', ' || b.year || ')'))"""


@REG.query(f"WITH {CITED} SELECT subject, 'cites' AS predicate, object, min_by(e, how) AS evidence_sentence FROM hits WHERE subject <> object GROUP BY subject, object")
def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as cited documents: by their text as a title, by DOI and by author and year, which the documents get."""
    docs = table(spark, sf_dir, "documents")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" See 10.1234/b"), (F.col("doc_id") % 60).cast("string"), F.lit(" and (Smith"), (F.col("doc_id") % 60 + 1).cast("string"), F.lit(", 2001)."))
    citing = docs.select(key("d", "doc_id").alias("id"), said.alias("content"), F.lit("").alias("title"), key("10.9999/D", "doc_id").alias("doi"), F.lit("Jones").alias("first_author"), F.lit("1999").alias("year"))
    cited = table(spark, sf_dir, "benchmark").select(key("b", "item_id").alias("id"), F.lit("").alias("content"), F.col("text").alias("title"), key("10.1234/B", "item_id").alias("doi"), key("Smith", "item_id").alias("first_author"), F.lit("2001").alias("year"))
    return relations.citations(cited.union(citing))


@REG.query("""WITH u AS (SELECT s_nationkey AS subject, 'trades_with' AS predicate, s_suppkey % 7 AS object, s_name AS evidence_sentence, 0 AS k FROM supplier UNION ALL SELECT c_nationkey, 'trades_with', c_custkey % 9, c_name, 1 FROM customer)
    SELECT subject, predicate, object, min_by(evidence_sentence, (k, evidence_sentence)) AS evidence_sentence FROM u GROUP BY subject, predicate, object""")
def composite_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' relations come first, customers' add what is new."""
    one = lambda t, n, k, m, name: table(spark, sf_dir, t).select(F.col(n).alias("subject"), F.lit("trades_with").alias("predicate"), (F.col(k) % m).alias("object"), F.col(name).alias("evidence_sentence"))
    return relations.first_of_each(one("supplier", "s_nationkey", "s_suppkey", 7, "s_name"), one("customer", "c_nationkey", "c_custkey", 9, "c_name"))


# --- spans: from a line item's day of shipping as many days as its quantity, within its order ---
SPANS = "sp AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS e, 'M' || (l_partkey % 7) AS surface, l_returnflag AS type, l_partkey AS target FROM lineitem)"


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"), F.concat(F.lit("M"), (F.col("l_partkey") % 7).cast("string")).alias("surface"), F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("target"))


@REG.query(f"WITH {SPANS} SELECT a.doc_id, a.line, b.line AS line_b FROM sp a JOIN sp b ON a.doc_id = b.doc_id AND a.s < b.e AND b.s < a.e WHERE a.line < b.line")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ways(spark, sf_dir).select("doc_id", "line", "start", "end")
    return evidence.overlapping(w, w).where("line < line_b").select("doc_id", "line", "line_b")


@REG.query(f"WITH {SPANS} SELECT a.doc_id, a.line, b.line AS line_b FROM sp a JOIN sp b ON a.doc_id = b.doc_id AND a.s < b.e AND b.s < a.e AND b.s <= a.s AND a.e <= b.e WHERE a.line <> b.line")
def contained_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ways(spark, sf_dir).select("doc_id", "line", "start", "end")
    return evidence.contained(w, w).where("line <> line_b").select("doc_id", "line", "line_b")


@REG.query(f"""WITH {SPANS}, h AS (SELECT a.doc_id, a.s, a.e, a.surface, min_by(b.target, (b.s, b.target)) AS target FROM sp a JOIN sp b ON a.doc_id = b.doc_id AND a.surface = b.surface AND a.s < b.e AND b.s < a.e WHERE b.target % 3 = 0 GROUP BY ALL)
    SELECT sp.doc_id, sp.line, h.target FROM sp LEFT JOIN h USING (doc_id, s, e, surface)""")
def linked_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways as mentions, those of every third part as links; their modes are surfaces."""
    w = ways(spark, sf_dir)
    return evidence.linked_mentions(w.drop("target"), w.where("target % 3 = 0")).select("doc_id", "line", "target")


@REG.query("SELECT l_partkey AS id, min_by(l_returnflag, (-n, l_returnflag)) AS type FROM (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_partkey")
def primary_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.primary_type(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("type")))


@REG.query("SELECT o_orderkey AS id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) <> 1")
def unresolved_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mentions, which should refer to one line item."""
    return evidence.unresolved_mentions(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("Mention").alias("type")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), F.lit("refers_to").alias("predicate")))


@REG.query("WITH l AS (SELECT s_suppkey AS subject, unnest([s_suppkey, s_suppkey + 1, s_suppkey * 2, s_suppkey + 1]) AS k FROM supplier) SELECT DISTINCT subject, 'links_to' AS predicate, s_suppkey AS object FROM l JOIN supplier ON s_suppkey = k WHERE subject <> s_suppkey")
def article_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as articles that link to themselves, the next one (twice) and the one of twice their number."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("S"), c.cast("string"))
    return evidence.article_links(s.select(k.alias("id"), name(k).alias("title"), F.array(name(k), name(k + 1), name(k * 2), name(k + 1)).alias("links")))


TOPICS = "tl AS (SELECT doc_id AS article_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, 'any'], lambda x: x IS NOT NULL) AS topic_ids FROM labels)"


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.lit("any"))).alias("topic_ids"))


@REG.query(f"WITH {TOPICS} SELECT doc_id AS id, coalesce(array_to_string(topic_ids, ','), '') AS topics FROM documents LEFT JOIN tl ON article_id = doc_id")
def labelled_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return evidence.attach_labels(docs, topics(spark, sf_dir), require=False).select("id", F.array_join("topic_ids", ",").alias("topics"))


@REG.query(f"WITH {TOPICS} SELECT topic, count(*) AS n FROM (SELECT unnest(topic_ids) AS topic FROM tl) WHERE topic <> 'good' GROUP BY topic")
def unknown_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.unknown_topics(topics(spark, sf_dir), spark.createDataFrame([("good",), ("other",)], "topic string"))


@REG.query("""WITH t AS (SELECT doc_id, unnest(list_distinct([lang, source])) AS topic FROM documents), k AS (SELECT doc_id, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS k FROM t) SELECT DISTINCT doc_id FROM k WHERE k <= 5""")
def topic_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each language and source; the count a topic takes is the feature's limit."""
    return evidence.topic_cover(table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("topics")), 5, "doc_id").select("doc_id")


@REG.query("SELECT l_suppkey AS subject, l_linestatus AS predicate, l_returnflag AS object, count(*) AS weight, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR) AS evidence FROM lineitem GROUP BY ALL")
def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_linestatus").alias("predicate"), F.col("l_returnflag").alias("object"), F.col("l_orderkey").cast("string").alias("evidence"))
    return evidence.merge_duplicate_edges(e).select("subject", "predicate", "object", "weight", F.array_join("evidence", ",").alias("evidence"))


@REG.query(f"WITH {PLACES} SELECT 'node' AS kind, type AS label, count(*) AS n FROM pn GROUP BY ROLLUP (type) UNION ALL SELECT 'edge', predicate, count(*) FROM pt GROUP BY ROLLUP (predicate)")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.summary(place_nodes(spark, sf_dir), place_triples(spark, sf_dir))


@REG.query("""WITH p AS (SELECT doc_id, string_split(text, 'the') AS ps FROM documents WHERE text IS NOT NULL), a AS (SELECT doc_id, length(ps[1]) AS one, length(ps[1]) + 3 + length(ps[2]) AS two, len(ps) AS n FROM p WHERE len(ps) > 1)
    SELECT doc_id, 'the' AS name, 'WORD' AS type, cast(CASE WHEN n > 2 THEN two ELSE one END AS INT) AS start, cast(CASE WHEN n > 2 THEN two ELSE one END + 3 AS INT) AS "end" FROM a""")
def located_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word in every text that has it: at its second place, which is gold, if there is one, else at its first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = docs.select("doc_id", F.lit("the").alias("name"), F.lit("WORD").alias("type"))
    ps = F.split("text", "the", -1)
    second = docs.where(F.size(ps) > 2).select("doc_id", (F.length(ps[0]) + 3 + F.length(ps[1])).alias("start")).withColumn("end", F.col("start") + 3)
    return evidence.locate_names(names, docs, second)


@REG.query("""WITH RECURSIVE r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS k FROM documents), w AS (SELECT 0::BIGINT AS k, 0::BIGINT AS held, false AS took, NULL::BIGINT AS doc_id
        UNION ALL SELECT r.k, CASE WHEN held + n_chars <= 100000 THEN held + n_chars ELSE held END, held + n_chars <= 100000, r.doc_id FROM w JOIN r ON r.k = w.k + 1) SELECT doc_id FROM w WHERE took""")
def trimmed_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.trim_to_budget(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("tokens")), 100_000, "doc_id").select("doc_id")


@REG.query("SELECT DISTINCT sha256(coalesce(text, '')) AS content_hash FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE lang = 'en')")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts are in the cache."""
    rows = table(spark, sf_dir, "documents").select("lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return evidence.pending(rows, rows.where("lang = 'en'").select("content_hash").distinct()).select("content_hash")


# --- writers ---


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.struct(F.col("predicate"), F.col("subject").alias("evidence_sentence"), F.col("object").alias("source_chunk_id"))
    return place_triples(spark, sf_dir).select("subject", "object", F.array("predicate").alias("predicates"), F.lit(1).alias("weight"), F.array(r).alias("relations"))


@REG.query(f"""WITH {PLACES}, n AS (SELECT id, name, type FROM pn UNION ALL SELECT 'k' || id, name, 'Chunk' FROM pn WHERE type = 'Region') SELECT id AS "id:ID", name, type, CASE WHEN type = 'Chunk' THEN 'Chunk' ELSE 'Entity' END AS ":LABEL" FROM n""")
def bulk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = place_nodes(spark, sf_dir)
    return writers.node_rows(n.union(n.where("type = 'Region'").select(F.concat(F.lit("k"), "id"), "name", F.lit("Chunk"))))


@REG.query(f"""WITH {PLACES} SELECT subject AS ":START_ID", object AS ":END_ID", upper(predicate) AS ":TYPE", subject AS evidence, object AS chunk_id FROM pt""")
def bulk_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.relationship_rows(place_edges(spark, sf_dir))


@REG.query(f"""WITH {PLACES} SELECT 0 AS ord, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="name" for="node" attr.name="name" attr.type="string"/><key id="type" for="node" attr.name="type" attr.type="string"/><key id="predicates" for="edge" attr.name="predicates" attr.type="string"/><key id="weight" for="edge" attr.name="weight" attr.type="string"/><graph edgedefault="directed">' AS value
    UNION ALL SELECT 1, '<node id="' || id || '"><data key="name">' || name || '</data><data key="type">' || type || '</data></node>' FROM pn
    UNION ALL SELECT 2, '<edge source="' || subject || '" target="' || object || '"><data key="predicates">[&quot;' || predicate || '&quot;]</data><data key="weight">1</data></edge>' FROM pt UNION ALL SELECT 3, '</graph></graphml>'""")
def graphml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.graphml_lines(place_nodes(spark, sf_dir), place_edges(spark, sf_dir))


@REG.query(f"""WITH {PLACES} SELECT '{{"data":{{"id":"' || id || '","label":"' || name || '","type":"' || type || '"}}}}' AS value FROM pn UNION ALL SELECT '{{"data":{{"source":"' || subject || '","target":"' || object || '","label":"' || predicate || '"}}}}' FROM pt""")
def cytoscape_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.cytoscape_elements(place_nodes(spark, sf_dir), place_edges(spark, sf_dir))


@REG.query(f"""WITH {PLACES}, t AS (SELECT '{{"subject":"' || subject || '","predicate":"' || predicate || '","object":"' || object || '"}}' AS v FROM pt)
    SELECT 'node' AS part, '{{"id":"' || id || '","name":"' || name || '","type":"' || type || '"}}' AS value FROM pn UNION ALL SELECT 'edge', v FROM t UNION ALL SELECT 'triple', v FROM t""")
def graph_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = place_triples(spark, sf_dir)
    return writers.graph_records(place_nodes(spark, sf_dir), t, t)


@REG.query("""WITH e AS (SELECT 'n' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'Nation' END AS type, CASE WHEN n_nationkey % 3 = 0 THEN 'd' || n_nationkey END AS description FROM nation),
    n AS (SELECT 'n' || c_nationkey AS id, 'graph' AS name, 'ENTITY' AS type, 'from the graph' AS description, count(*) AS importance FROM customer GROUP BY c_nationkey UNION ALL SELECT 'x', 'only', 'ENTITY', NULL, 1)
    SELECT coalesce(e.id, n.id) AS id, coalesce(e.name, n.name) AS name, coalesce(e.type, n.type) AS type, coalesce(e.description, n.description) AS description, n.importance FROM e FULL JOIN n ON e.id = n.id""")
def canonical_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    e = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(k % 2 == 0, "Nation").alias("type"), F.when(k % 3 == 0, key("d", "n_nationkey")).alias("description"))
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("importance")).select(key("n", "c_nationkey").alias("id"), F.lit("graph").alias("name"), F.lit("ENTITY").alias("type"), F.lit("from the graph").alias("description"), "importance")
    return writers.canonical_nodes(e, n.union(spark.createDataFrame([("x", "only", "ENTITY", None, 1)], "id string, name string, type string, description string, importance long")))


# --- readers: documents written by Spark into the shared folder and read back ---


#: About how many documents a JSON file lists.
LIST_ROWS = 2_000


def written(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("language"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("origin"))
    if kind == "jsonl":
        docs.write.json(path)
    elif kind == "csv":
        docs.write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif kind == "json":
        # a file holds one list; a folder for each keeps two from meeting in one file, and lists don't grow with the table
        lists = max(8, docs.count() // LIST_ROWS)
        parts = docs.groupBy(F.pmod(F.xxhash64("id"), F.lit(lists)).alias("g")).agg(F.to_json(F.collect_list(F.struct("id", "text", "language", "title", "origin"))).alias("value"))
        parts.write.partitionBy("g").text(path)
    else:
        docs.select(F.concat_ws("\t", "id", "language").alias("value")).write.text(path)
    for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").collect():  # as many as partitions wrote; readers go by suffix
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f["path"])
        fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(old, False) if not f["length"] else fs.rename(old, old.suffix(f".{kind}"))
    return readers.read_files(spark, path, kind)


READ = "SELECT doc_id::VARCHAR AS doc_id, coalesce(text, '') AS content, lang AS language, 't' || doc_id AS title, 'doc://' || doc_id AS url, source AS origin FROM documents"


def read_back(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "content", "language", "title", "url", F.col("metadata")["origin"].alias("origin"))


@REG.query(READ)
def read_jsonl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(written(spark, sf_dir, "jsonl"))


@REG.query(READ)
def read_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(written(spark, sf_dir, "csv"))


@REG.query(READ)
def read_json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(written(spark, sf_dir, "json"))


@REG.query("SELECT doc_id || chr(9) || lang AS line FROM documents")
def read_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as documents; their lines."""
    lines = written(spark, sf_dir, "txt").select(F.explode(F.split("content", "\n")).alias("line"))
    return lines.where("line <> ''")


@REG.query("""SELECT p_partkey AS id, 'https://en.wikipedia.org/wiki/' || replace(p_name, ' ', '_') AS url, 'en' AS language, p_name AS title FROM part""")
def article_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as titles, to addresses and back."""
    u = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), readers.title_url(F.col("p_name")).alias("url"))
    return u.select("id", "url", readers.url_parts(F.col("url")).alias("p")).select("id", "url", "p.language", "p.title")


@REG.query("SELECT page_id FROM pages WHERE rtrim(regexp_replace(url, '#.*', ''), '/') IN (SELECT rtrim(regexp_replace(url, '#.*', ''), '/') FROM pages WHERE page_id % 3 = 0)")
def wanted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page's address, with a fragment and its scheme in capitals, as the list of what is wanted."""
    pages = table(spark, sf_dir, "pages")
    wanted = pages.where("page_id % 3 = 0").select(F.concat(F.upper(F.substring("url", 1, 5)), F.expr("substring(regexp_replace(url, '#.*', ''), 6)"), F.lit("#top")).alias("url"))
    return readers.wanted_pages(pages.select("page_id", "url"), wanted).select("page_id")


@REG.query(f"""WITH r AS (SELECT page_id, html, url, regexp_extract(html, '{TITLE}', 1) AS title FROM pages) SELECT 'wikipedia:en:' || page_id AS id, html AS text, title, url, 'wikipedia' AS source, 'en' AS language, page_id::VARCHAR AS page_id FROM r WHERE length(html) >= 3000""")
def article_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", TITLE, 1).alias("title"), F.col("html").alias("text"), "url", F.lit(None).cast("array<string>").alias("categories"))
    return readers.article_records(pages, min_chars=3000).drop("categories")


@REG.query("""SELECT s_suppkey AS page_id, coalesce((SELECT string_agg(u, ' ' ORDER BY u) FROM (SELECT DISTINCT 'https://en.wikipedia.org/wiki/' || replace(p_name, ' ', '_') AS u FROM part WHERE p_partkey % 150 = s_suppkey)), '') AS links FROM supplier""")
def linked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as records, the parts of a remainder as their links."""
    links = table(spark, sf_dir, "part").select((F.col("p_partkey") % 150).alias("page_id"), F.col("p_name").alias("target"))
    return readers.add_links(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id")), links).select("page_id", F.array_join("links", " ").alias("links"))


@REG.query(f"""WITH {TOPICS}, r AS (SELECT 'a' || article_id AS title, 'Q' || article_id AS qid, topic_ids FROM tl) SELECT title, qid, array_to_string(list_sort(list_distinct(topic_ids)), ',') AS topics, CASE WHEN b < 9000 THEN 'train' WHEN b < 9200 THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT *, ('0x' || substr(sha256(qid), 1, 16))::UBIGINT % 10000 AS b FROM r) WHERE NOT list_contains(topic_ids, 'toxic')""")
def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topics(spark, sf_dir).select(key("a", "article_id").alias("title"), key("Q", "article_id").alias("qid"), F.col("topic_ids").alias("topics"))
    return readers.topic_labels(rows, ["good", "any"]).select("title", "qid", F.array_join("topics", ",").alias("topics"), "split")


# --- archive ---
VERSIONS = "vh AS (SELECT source, doc_id, sha256(text) AS h, sha256(text) IS DISTINCT FROM lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) AS is_new FROM documents)"


@REG.query(f"WITH {VERSIONS} SELECT source, cast(count_if(is_new) AS BIGINT) AS version, arg_max_null(h, doc_id) AS content_hash, count(*) AS uploads FROM vh GROUP BY source")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.latest(archive.versions(table(spark, sf_dir, "documents"), "source", F.col("doc_id")), "source", F.col("doc_id"))


@REG.query("""WITH a AS (SELECT o_custkey AS doc_id, o_orderkey AS ts, o_orderstatus AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    old AS (SELECT doc_id, k AS version, h AS content_hash, ts AS last_upload FROM a WHERE k < n), last AS (SELECT doc_id, max(version) AS version, arg_max(content_hash, version) AS content_hash FROM old GROUP BY 1), u AS (SELECT doc_id, h AS content_hash, ts FROM a WHERE k = n)
    SELECT old.doc_id, old.version, old.content_hash, CASE WHEN last.version = old.version AND u.content_hash = old.content_hash THEN u.ts ELSE old.last_upload END AS last_upload FROM old JOIN last USING (doc_id) JOIN u USING (doc_id)
    UNION ALL SELECT u.doc_id, coalesce(last.version, 0) + 1, u.content_hash, u.ts FROM u LEFT JOIN last USING (doc_id) WHERE u.content_hash IS DISTINCT FROM last.content_hash""")
def stored_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, orders as uploads whose states are contents: the last order of each is stored into the archive of the others."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("content_hash"), F.col("o_orderkey").alias("at"), F.row_number().over(w.orderBy("o_orderkey")).cast("long").alias("k"), F.count("*").over(w).alias("n"))
    old = a.where("k < n").select("doc_id", F.col("k").alias("version"), "content_hash", F.col("at").alias("last_upload"))
    return archive.store(old, a.where("k = n").select("doc_id", "content_hash", "at"))


@REG.query(f"WITH {CHUNKS} SELECT chunk_id, substr(content, 1, 500) AS content, chunk_index AS replaced_by_version FROM ch WHERE false UNION ALL SELECT chunk_id, substr(content, 1, 500), 2 FROM ch WHERE parent_doc_id IN (SELECT parent_doc_id FROM ch GROUP BY 1 HAVING count(*) > 3)")
def archived_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of more than three turns as replaced documents."""
    c = turns(spark, sf_dir)
    gone = c.groupBy(F.col("parent_doc_id").alias("doc_id")).count().where("count > 3").select("doc_id", F.lit(2).cast("long").alias("version"))
    return archive.archive_chunks(c, gone).select("chunk_id", "content", "replaced_by_version")


# --- merging and replacing graphs ---


@REG.query("""WITH o AS (SELECT l_suppkey AS s, l_partkey % 50 AS t, list_sort(list(DISTINCT l_returnflag)) AS p FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), n AS (SELECT l_suppkey AS s, l_partkey % 50 AS t, list_sort(list(DISTINCT l_returnflag)) AS p FROM lineitem WHERE l_linenumber = 2 GROUP BY ALL)
    SELECT coalesce(o.s, n.s) AS subject, coalesce(o.t, n.t) AS object, array_to_string(list_concat(coalesce(o.p, []), list_filter(coalesce(n.p, []), lambda x: NOT list_contains(coalesce(o.p, []), x))), ',') AS predicates,
        coalesce(CASE WHEN o.s IS NOT NULL THEN 'old' END, 'new') AS description, cast(len(list_distinct(list_concat(coalesce(o.p, []), coalesce(n.p, [])))) AS INT) AS weight FROM o FULL JOIN n ON o.s = n.s AND o.t = n.t""")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of orders as the old graph's edges, second lines as the new one's."""
    line = table(spark, sf_dir, "lineitem")

    def edges(n: int, name: str) -> DataFrame:
        e = line.where(F.col("l_linenumber") == n).groupBy(F.col("l_suppkey").alias("subject"), (F.col("l_partkey") % 50).alias("object")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("predicates"))
        none = F.array().cast("array<string>")
        return e.select("subject", "object", "predicates", none.alias("source_texts"), none.alias("source_chunk_ids"), F.lit(name).alias("description"))

    nodes = line.select(F.col("l_suppkey").alias("id"), F.lit("x").alias("name")).distinct()
    merged = graph.merge_graphs(nodes, nodes, edges(1, "old"), edges(2, "new"))[1]
    return merged.select("subject", "object", F.array_join("predicates", ",").alias("predicates"), "description", "weight")


@REG.query("""WITH o AS (SELECT n_nationkey AS id, n_name AS name, 'old' AS type FROM nation WHERE n_nationkey < 20), n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'new' END AS name, 'new' AS type FROM nation WHERE n_nationkey > 5)
    SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.type, o.type) AS type FROM o FULL JOIN n ON o.id = n.id""")
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    t = table(spark, sf_dir, "nation")
    edges = spark.createDataFrame([], "subject int, object int, predicates array<string>, source_texts array<string>, source_chunk_ids array<string>, description string")
    old = t.where(k < 20).select(k.alias("id"), F.col("n_name").alias("name"), F.lit("old").alias("type"))
    return graph.merge_graphs(old, t.where(k > 5).select(k.alias("id"), F.when(k % 2 == 0, "new").alias("name"), F.lit("new").alias("type")), edges, edges)[0]


REPLACED = f"""{CHUNKS}, gone AS (SELECT DISTINCT parent_doc_id AS d FROM ch WHERE parent_doc_id LIKE '%1'), app AS (SELECT DISTINCT role AS subject, chunk_id AS object, parent_doc_id AS d FROM ch)"""


@REG.query(f"""WITH {REPLACED} SELECT 'node' AS kind, chunk_id AS a, 'Chunk' AS p, '' AS b FROM ch WHERE parent_doc_id NOT IN (FROM gone) UNION ALL SELECT DISTINCT 'node', parent_doc_id, 'Document', '' FROM ch WHERE parent_doc_id NOT IN (FROM gone) UNION ALL SELECT DISTINCT 'node', subject, 'ROLE', '' FROM app WHERE d NOT IN (FROM gone)
    UNION ALL SELECT 'edge', subject, 'appears_in', object FROM app WHERE d NOT IN (FROM gone) UNION ALL SELECT 'relation', subject, 'speaks', string_agg(object, ',' ORDER BY object) FROM app WHERE d NOT IN (FROM gone) GROUP BY subject""")
def replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose number ends in 1 are taken out of the graph of turns and roles."""
    c = turns(spark, sf_dir)
    nodes = c.select(F.col("chunk_id").alias("id"), F.lit("Chunk").alias("type"), "parent_doc_id").union(c.select("parent_doc_id", F.lit("Document"), F.lit(None).cast("string")).distinct())
    nodes = nodes.union(c.select("role", F.lit("ROLE"), F.lit(None).cast("string")).distinct())
    edges = c.select(F.col("role").alias("subject"), F.lit("appears_in").alias("predicate"), F.col("chunk_id").alias("object")).distinct()
    rel = c.groupBy(F.col("role").alias("subject")).agg(F.collect_list("chunk_id").alias("chunk_ids")).select("subject", F.lit("speaks").alias("predicate"), F.lit("x").alias("object"), "chunk_ids")
    n, e, r = graph.replace_documents(nodes, edges, rel, c.where("parent_doc_id like '%1'").select(F.col("parent_doc_id").alias("doc_id")).distinct())
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type").alias("p"), F.lit("").alias("b")).union(e.select(F.lit("edge"), "subject", "predicate", "object")).union(r.select(F.lit("relation"), "subject", "predicate", F.array_join("chunk_ids", ",")))


@REG.query(f"""WITH {PLACES}, nb AS (SELECT object AS id FROM pt WHERE subject = 'n3' UNION SELECT subject FROM pt WHERE object = 'n3'), n AS (SELECT count(*) AS n FROM pn), e AS (SELECT count(*) AS e FROM pt)
    SELECT 'neighbour' AS what, id AS label, 1.0::DOUBLE AS value FROM nb UNION ALL SELECT 'found', id, 1.0 FROM (SELECT id FROM pn WHERE contains(lower(id), 'an') OR contains(lower(name), 'an') ORDER BY id LIMIT 50)
    UNION ALL SELECT 'nodes', '', n::DOUBLE FROM n UNION ALL SELECT 'edges', '', e::DOUBLE FROM e UNION ALL SELECT 'density', '', e / (n * (n - 1)) FROM n, e UNION ALL SELECT 'average_degree', '', 2 * e / n FROM n, e
    UNION ALL SELECT 'label', type, count(*)::DOUBLE FROM pn GROUP BY type UNION ALL SELECT 'relation', predicate, count(*)::DOUBLE FROM pt GROUP BY predicate""")
def graph_store_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node's neighbours, a search (whose limit of 50 is the feature), statistics."""
    store = graph.GraphStore(place_nodes(spark, sf_dir), place_edges(spark, sf_dir))
    one = lambda what, df: df.select(F.lit(what).alias("what"), F.col("id").alias("label"), F.lit(1.0).alias("value"))
    return one("neighbour", store.neighbors("n3")).union(one("found", store.search("an"))).union(store.stats())


@REG.query(f"""WITH {PLACES}, e AS (SELECT 'Nation' AS src_type, predicate AS rel, 'Region' AS dst_type, subject AS src, object AS dst FROM pt WHERE predicate = 'lies_in' UNION ALL SELECT 'Customer', predicate, 'Nation', subject, object FROM pt WHERE predicate = 'lives_in') SELECT * FROM e UNION ALL SELECT dst_type, 'rev_' || rel, src_type, dst, src FROM e""")
def reversed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = place_triples(spark, sf_dir)
    lies = F.col("predicate") == "lies_in"
    return graph.reversed_edges(t.select(F.when(lies, "Nation").otherwise("Customer").alias("src_type"), F.col("predicate").alias("rel"), F.when(lies, "Region").otherwise("Nation").alias("dst_type"), F.col("subject").alias("src"), F.col("object").alias("dst")))


@REG.query(f"WITH {PLACES} SELECT type, id, cast(row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS INT) AS index FROM pn")
def dense_node_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dense_index(place_nodes(spark, sf_dir))


# --- questions ---


@REG.query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, count(*) AS shared FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY 1, 2")
def comparison_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    edges = s.select(F.col("s_suppkey").alias("subject"), (F.lit(-1) - F.col("s_nationkey")).alias("object"))
    return qa.comparisons(edges, s.select(F.col("s_suppkey").alias("id"), F.lit("Supplier").alias("type")))


@REG.query(rf"""WITH {SENTENCES}, c AS (SELECT doc_id, regexp_extract(s, '^((?:The |An? )?\p{{Lu}}[\p{{L}} -]{{1,60}}?) (?:is|was|are|were) ((?:a|an|the) [^.!?]{{3,120}})', 1) AS x, regexp_extract(s, '^((?:The |An? )?\p{{Lu}}[\p{{L}} -]{{1,60}}?) (?:is|was|are|were) ((?:a|an|the) [^.!?]{{3,120}})', 2) AS y FROM sent),
    d AS (SELECT doc_id, regexp_extract(s, '^(\p{{Lu}}[^.!?]{{3,100}}?) in (1[0-9]{{3}}|20[0-9]{{2}})\b', 1) AS x, regexp_extract(s, '^(\p{{Lu}}[^.!?]{{3,100}}?) in (1[0-9]{{3}}|20[0-9]{{2}})\b', 2) AS y FROM sent)
    SELECT 'What is ' || x || '?' AS question, y AS answer, 'copula' AS kind, doc_id AS source FROM c WHERE x <> '' UNION ALL SELECT 'In which year: ' || x || '?', y, 'year', doc_id FROM d WHERE x <> ''""")
def text_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.text_questions(table(spark, sf_dir, "documents").where("text is not null"))


@REG.query("""WITH q AS (SELECT 'Which ' || CASE WHEN l_linenumber % 2 = 0 THEN upper(l_returnflag) ELSE lower(l_returnflag) END || ' of ' || l_partkey || '?' AS question, l_linestatus AS answer, 'k' AS kind, l_suppkey AS source FROM lineitem)
    SELECT question, answer, kind, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(question) ORDER BY kind, answer, source, question) AS r FROM q) WHERE r = 1""")
def unique_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the questions that differ in case only; no cap."""
    mode = F.when(F.col("l_linenumber") % 2 == 0, F.upper("l_returnflag")).otherwise(F.lower("l_returnflag"))
    q = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Which "), mode, F.lit(" of "), F.col("l_partkey").cast("string"), F.lit("?")).alias("question"), F.col("l_linestatus").alias("answer"), F.lit("k").alias("kind"), F.col("l_suppkey").alias("source"))
    return qa.finish(q, cap=None)


TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\s\p{{Z}}]'))"


@REG.query(f"SELECT doc_id, cast({TOKENS.format('text')} AS INT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", token_estimate(F.col("text")).cast("int").alias("tokens"))


@REG.query(f"""WITH q AS (SELECT 'Document ' || doc_id AS question, coalesce(text, '') AS answer FROM documents), t AS (SELECT *, {TOKENS.format("question || ' ' || answer")} AS tokens FROM q)
    SELECT question, answer, tokens FROM (SELECT *, sum(tokens) OVER (ORDER BY sha256(question), question) AS held FROM t) WHERE held <= 20000""")
def balanced_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a budget of 20,000 tokens, the feature's limit, holds."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("question"), F.coalesce("text", F.lit("")).alias("answer"))
    return qa.balance_volume(d, 20_000)


# --- extraction from replies of a model: nations' replies in both forms ---


@REG.query("""SELECT 'entity' AS kind, n_nationkey AS doc_id, n_name AS a, 'NATION' AS p, 'a nation' AS b FROM nation UNION ALL SELECT 'entity', n_nationkey, r_name, 'REGION', 'a region' FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'relation', n_nationkey, n_name, 'RELATION', r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def reply_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation, its region, a thing of no known type; a relation between the first two, one to nothing known, one to itself."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    item = lambda *f: F.concat(F.lit("("), F.concat_ws("<|>", *(F.concat(F.lit('"'), F.lit(x) if isinstance(x, str) else x, F.lit('"')) for x in f)), F.lit(")"))
    N, R = F.col("n_name"), F.col("r_name")
    reply = F.concat(F.concat_ws("##", item("entity", N, "Nation", "a nation"), item("entity", R, "region", "a region"), item("entity", "Thing", "other", "x"), item("relationship", N, R, "lies in"), item("relationship", N, "Nowhere", "x"), item("relationship", N, F.lower(N), "x")), F.lit("<|COMPLETE|>"))
    e, r = extract.read_records(n.select(F.col("n_nationkey").alias("doc_id"), reply.alias("reply")), ["nation", "region"])
    return e.select(F.lit("entity").alias("kind"), "doc_id", F.col("name").alias("a"), F.col("type").alias("p"), F.col("description").alias("b")).union(r.select(F.lit("relation"), "doc_id", "subject", "predicate", "object"))


@REG.query("SELECT n_nationkey AS doc_id, n_name AS subject, 'lies_in' AS predicate, n_regionkey::VARCHAR AS object, n_name AS evidence_sentence FROM nation")
def grounded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a nation's replies one is grounded, one repeats it, one's evidence isn't in the text, one's predicate isn't known."""
    t = table(spark, sf_dir, "nation")
    N = F.col("n_name")
    one = lambda p, e: F.struct(N.alias("subject"), F.lit(p).alias("predicate"), F.col("n_regionkey").cast("string").alias("object"), e.alias("evidence"))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.array(one("lies_in", N), one("lies_in", F.concat(N, F.lit(" is"))), one("lies_in", F.lit("not said")), one("owns", N))), F.lit("\n```"))
    replies = t.select(F.col("n_nationkey").alias("doc_id"), F.concat(N, F.lit(" is a nation.")).alias("text"), reply.alias("reply"))
    return extract.grounded_json(replies, spark.createDataFrame([("lies_in",)], "predicate string"))


# --- resolution ---


@REG.query(f"WITH {PLACES} SELECT id, name, kb_id, CASE WHEN kb_id IS NOT NULL THEN 'table' END AS kb_source FROM pn LEFT JOIN (SELECT lower(n_name) AS k, min('K' || n_nationkey) AS kb_id FROM nation GROUP BY 1) ON k = lower(name)")
def linked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.link_entities(place_nodes(spark, sf_dir).select("id", "name"), table(spark, sf_dir, "nation").select(F.initcap("n_name").alias("name"), key("K", "n_nationkey").alias("kb_id")))


@REG.query("""WITH s AS (SELECT p_partkey AS id, p_name AS stored, string_split(p_name, ' ') AS sw FROM part), n AS (SELECT DISTINCT string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[2] AS name FROM part), c AS (SELECT n.name, s.id, s.sw, row_number() OVER (PARTITION BY n.name ORDER BY s.id) AS k FROM n JOIN s ON contains(s.stored, n.name) OR contains(n.name, s.stored)),
    j AS (SELECT name, id, len(list_intersect(list_distinct(string_split(name, ' ')), list_distinct(sw))) / len(list_distinct(list_concat(string_split(name, ' '), sw))) AS similarity FROM c WHERE k <= 10)
    SELECT name, 'Part' AS type, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, id) AS r FROM j) WHERE r = 1""")
def containment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the first two words of part names; the first ten candidates are the feature's limit."""
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    new = p.select(F.concat(w[0], F.lit(" "), w[1]).alias("name"), F.lit("Part").alias("type")).distinct()
    return resolve.containment_candidates(new, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("Part").alias("type")))


@REG.query(r"""WITH n AS (SELECT n_nationkey AS k, n_name AS n FROM nation UNION ALL SELECT 100 + n_nationkey, array_to_string(regexp_extract_all(n_name || ' of the ' || lower(n_name) || ' trade', '\b(\w)', 1), '') FROM nation UNION ALL SELECT 200 + n_nationkey, n_name || ' of the ' || lower(n_name) || ' trade' FROM nation),
    f AS (SELECT k, n, string_split_regex(lower(trim(n)), '\s+') AS w, upper(array_to_string(regexp_extract_all(n, '\b(\w)', 1), '')) AS a, upper(regexp_replace(n, '\W', '', 'g')) AS q FROM n)
    SELECT x.k AS a, y.k AS b, lower(x.n) = lower(y.n) OR list_has_any(x.w, y.w) OR x.a = y.q OR y.a = x.q AS compatible FROM f x JOIN f y ON x.k < y.k""")
def surface_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of nations' names, phrases about them and the phrases' initials: a fixed table of 75 names."""
    t = table(spark, sf_dir, "nation")
    k, long = F.col("n_nationkey").cast("long"), F.concat("n_name", F.lit(" of the "), F.lower("n_name"), F.lit(" trade"))
    initials = F.array_join(F.regexp_extract_all(long, F.lit(r"\b(\w)"), F.lit(1)), "")
    n = t.select(k.alias("a"), F.col("n_name").alias("n")).union(t.select(k + 100, initials)).union(t.select(k + 200, long))
    other = n.select(F.col("a").alias("b"), F.col("n").alias("m"))
    return n.join(other, F.col("a") < F.col("b")).select("a", "b", surface_compatible(F.col("n"), F.col("m")).alias("compatible"))


# --- scores ---


@REG.query("""WITH t AS (SELECT DISTINCT s_suppkey AS subject, 'sells_in' AS predicate, s_nationkey AS object FROM supplier), m AS (SELECT *, lead(object) OVER (PARTITION BY predicate ORDER BY sha256('42|' || subject || '|' || object), subject, object) AS fake FROM t)
    SELECT DISTINCT subject, predicate, fake AS object FROM m WHERE fake IS NOT NULL AND fake <> object AND NOT EXISTS (SELECT 1 FROM t WHERE t.subject = m.subject AND t.object = m.fake)""")
def negative_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.negatives(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject"), F.lit("sells_in").alias("predicate"), F.col("s_nationkey").alias("object")))


@REG.query(f"WITH {PLACES} SELECT * FROM pt ORDER BY sha256('42|' || subject || '|' || predicate || '|' || object) LIMIT 50")
def sampled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty triples for a judge: a sampling operator."""
    return metrics.sample_facts(place_triples(spark, sf_dir))


@REG.query("""WITH c AS (SELECT l_suppkey AS id, count_if(l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT id, k / n AS p, n, 1 + 1.96 * 1.96 / n AS z, k / n + 1.96 * 1.96 / (2 * n) AS c, 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) AS h FROM c)
    SELECT id, round(greatest(0, (c - h) / z), 6) AS low, round(least(1, (c + h) / z), 6) AS high FROM w""")
def score_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' shares of returned items."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return c.select("id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@REG.query("""WITH r AS (SELECT quality = 1 AS truth, (doc_id % 7) - 3 >= 0 AS said FROM labels UNION ALL SELECT toxic = 1, (doc_id % 5) - 3 >= 0 FROM labels), c AS (SELECT count_if(truth AND said) AS tp, count_if(NOT truth AND said) AS fp, count_if(truth AND NOT said) AS fn, count_if(NOT truth AND NOT said) AS tn FROM r),
    d AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM c)
    SELECT cast(tp AS BIGINT) AS tp, cast(fp AS BIGINT) AS fp, cast(fn AS BIGINT) AS fn, cast(tn AS BIGINT) AS tn, round(p, 4) AS "precision", round(q, 4) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 4) AS f1, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy FROM d""")
def multilabel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    one = lambda c, m: l.select(F.col("doc_id").alias("id"), F.lit(c).alias("label"), (F.col(c) == 1).alias("truth"), (F.col("doc_id") % m - 3).cast("double").alias("logit"))
    return scoring.multilabel_scores(one("quality", 7).union(one("toxic", 5)))


@REG.query(f"SELECT least(id, neighbour) AS a, greatest(id, neighbour) AS b, max(similarity) AS similarity FROM ({GRAPH_REG.sql['knn_topk']}) WHERE similarity >= 0.2 GROUP BY 1, 2")
def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = GRAPH_REG.queries["knn_topk"](spark, sf_dir)
    return curate.review_pairs(near, 0.2)


@REG.query(f"""WITH {PLACES}, f AS (SELECT 'c' || c_custkey AS subject, 'segment' AS predicate, c_mktsegment AS object FROM customer UNION ALL SELECT 'n' || n_nationkey, 'segment', unnest(['a', 'b']) FROM nation WHERE n_nationkey < 3), ft AS (SELECT * FROM pt UNION ALL SELECT * FROM f),
    n AS (SELECT count(*) AS n FROM pn), e AS (SELECT count(*) AS e FROM pt), lone AS (SELECT count(*) AS o FROM pn WHERE id NOT IN (SELECT subject FROM pt UNION SELECT object FROM pt)),
    w AS (SELECT sum((predicate = 'lies_in')::INT * coalesce((b.type <> 'Nation')::INT, 0)) AS w, count(*) AS n FROM ft LEFT JOIN pn b ON b.id = object), c AS (SELECT count(*) AS c FROM (SELECT subject FROM ft WHERE predicate = 'segment' GROUP BY 1 HAVING count(DISTINCT object) > 1)),
    src AS (SELECT id FROM pn ORDER BY id LIMIT 200), r2 AS (SELECT DISTINCT src.id, x.object FROM src JOIN pt x ON x.subject = src.id UNION SELECT src.id, y.object FROM src JOIN pt x ON x.subject = src.id JOIN pt y ON y.subject = x.object), s AS (SELECT count(*) AS s FROM src),
    sc AS (SELECT round(greatest(0, 100 - 300 * round(o / n.n, 6)), 1) AS orphans, round(CASE WHEN round(e / (n.n * (n.n - 1)), 6) < 0.005 THEN round(e / (n.n * (n.n - 1)), 6) / 0.005 * 100 ELSE 100 END, 1) AS density, round(100 * (1 - w / w.n), 1) AS "schema", greatest(0, 100 - 10 * c)::DOUBLE AS constraints, 100.0::DOUBLE AS duplicates,
        round(least(100, 100 * (2 * round((SELECT count(*) FROM r2) / (s * (s - 1)), 6))), 1) AS reach FROM n, e, lone, w, c, s)
    SELECT *, round((orphans + density + "schema" + constraints + duplicates + reach) / 6, 1) AS overall, CASE WHEN overall >= 80 THEN 'good' WHEN overall >= 60 THEN 'fair' WHEN overall >= 40 THEN 'weak' ELSE 'poor' END AS verdict FROM sc""")
def graph_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places: lies_in is said to end at nations, three nations have two segments; numbers stand for names, none of which is near another."""
    from ..operators import audit

    nodes, edges = place_nodes(spark, sf_dir), place_triples(spark, sf_dir)
    segments = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("subject"), F.lit("segment").alias("predicate"), F.col("c_mktsegment").alias("object"))
    segments = segments.union(table(spark, sf_dir, "nation").where("n_nationkey < 3").select(key("n", "n_nationkey"), F.lit("segment"), F.explode(F.array(F.lit("a"), F.lit("b")))))
    names = nodes.select("id", F.sha2("id", 256).alias("name"))
    rules = spark.createDataFrame([("lies_in", "Nation", "Nation")], "predicate string, domain string, range string")
    return audit.health_report(nodes, edges, edges.union(segments), names, rules, ["segment"])


@REG.query(r"""WITH s AS (SELECT doc_id, text, list_prepend({'cur': '', 'n': 0}, list_transform(string_split(text, chr(10)), lambda x: {'cur': x, 'n': 0})) AS ss FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, text, list_reduce(ss, lambda a, x: CASE WHEN length(a.cur) + length(x.cur) <= 500 THEN {'cur': trim(a.cur || chr(10) || x.cur, chr(10)), 'n': a.n}
        ELSE {'cur': substr(x.cur, (greatest(ceil((length(x.cur) - 500) / 400), 0) * 400 + 1)::INT), 'n': (a.n + regexp_matches(a.cur, '\S')::INT + greatest(ceil((length(x.cur) - 500) / 400), 0))::INT} END) AS e FROM s)
    SELECT doc_id, CASE WHEN length(text) <= 500 THEN 1 ELSE greatest(e.n + regexp_matches(e.cur, '\S')::INT, 1) END AS n FROM r""".replace("\\\\", "\\"))
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", chunk.chunk_count(F.col("text"), 500, 100, "\n").alias("n"))


@REG.query(f"""WITH {CHUNKS}, {PLACES}, n AS (SELECT id, name, type FROM pn UNION ALL SELECT chunk_id, chunk_id, 'Chunk' FROM ch UNION ALL SELECT DISTINCT parent_doc_id, parent_doc_id, 'Document' FROM ch)
    SELECT CASE WHEN type IN ('Chunk', 'Document') THEN type ELSE 'Entity' END AS label, id, CASE type WHEN 'Chunk' THEN '{{"id":"' || id || '","type":"Chunk"}}' ELSE '{{"id":"' || id || '","name":"' || name || '","type":"' || type || '"}}' END AS record FROM n""")
def categorized_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = turns(spark, sf_dir)
    docs = c.select(F.col("parent_doc_id").alias("id"), F.col("parent_doc_id").alias("name"), F.lit("Document").alias("type")).distinct()
    return writers.categorized_nodes(place_nodes(spark, sf_dir).union(documents.chunk_nodes(c).select("id", "name", "type")).union(docs))


@REG.query(f"""WITH {CHUNKS}, a AS (SELECT DISTINCT parent_doc_id AS doc_id, v AS version FROM ch, (SELECT unnest([1, 2]) AS v))
    SELECT doc_id, version, CASE WHEN version = 2 THEN (SELECT string_agg(chunk_id, ',' ORDER BY chunk_id) FROM ch WHERE parent_doc_id = doc_id) END AS kg_chunk_ids, CASE WHEN version = 2 THEN (SELECT 2 * count(*) FROM ch WHERE parent_doc_id = doc_id AND role = 'user') END AS kg_triple_count FROM a""")
def archived_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of each conversation; two triples of each of its users' turns."""
    c = turns(spark, sf_dir)
    versions = c.select(F.col("parent_doc_id").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"))
    triples = c.where("role = 'user'").select(F.col("chunk_id").alias("source_chunk_id"))
    return archive.link_chunks(versions, c, triples.union(triples)).select("doc_id", "version", F.array_join("kg_chunk_ids", ",").alias("kg_chunk_ids"), "kg_triple_count")


# --- duplicates ---
TRIGRAMS = """gs AS (SELECT DISTINCT doc_id, substr(text, cast(k AS INT), 3) AS t FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 2, 1) + 1)) AS k FROM documents WHERE text IS NOT NULL)),
    gn AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM gs),
    gp AS (SELECT a.doc_id AS a, b.doc_id AS b FROM gn a JOIN gn b ON a.t = b.t AND a.doc_id < b.doc_id AND b.n >= 0.85 * a.n - 1e-9 AND a.n >= 0.85 * b.n - 1e-9 GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.85 - 1e-12)"""
KEPT = f"""{TRIGRAMS}, {components_sql("SELECT a, b FROM gp", "SELECT doc_id AS id FROM documents WHERE text IS NOT NULL")}"""


@REG.query(f"WITH RECURSIVE {KEPT} SELECT DISTINCT root AS doc_id FROM comp")
def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("content"))
    return dedup.remove_duplicates(docs, "minhash").select("doc_id")




@REG.query(f"WITH RECURSIVE {KEPT}, k AS (SELECT DISTINCT root AS doc_id FROM comp) SELECT doc_id FROM k WHERE NOT (doc_id % 10 = 1 AND doc_id - 1 IN (FROM k) AND doc_id IN (SELECT vec_id + 1 FROM embeddings))")
def layered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies by character runs go, then those whose vectors are close: each id that ends in 1 has the vector of the one before it."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("content"))
    v = vectors(spark, sf_dir)
    twins = v.where("id % 10 = 0").select((F.col("id") + 1).alias("id"), "v")
    return dedup.remove_duplicates(docs, "layered", vectors=v.where("id % 10 <> 1").union(twins)).select("doc_id")


@REG.query(f"""WITH RECURSIVE ve AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, 'N' || (label % 3) AS name, 'T' || (label % 2) AS type FROM embeddings),
    {leaders_sql("SELECT a.id AS a, b.id AS b FROM ve a JOIN ve b ON a.id < b.id AND a.name = b.name AND a.type = b.type AND list_cosine_similarity(a.v, b.v) >= 0.3", "SELECT id FROM ve")}
    SELECT leader AS id, any_value(name) AS name, any_value(type) AS type, count(*) AS members FROM led JOIN ve USING (id) GROUP BY leader""")
def resolution_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as entities, named and typed by their labels."""
    e = table(spark, sf_dir, "embeddings")
    none = F.array().cast("array<string>")
    entities = e.select(F.col("vec_id").alias("ord"), F.col("vec_id").alias("id"), F.concat(F.lit("N"), (F.col("label") % 3).cast("string")).alias("name"), F.concat(F.lit("T"), (F.col("label") % 2).cast("string")).alias("type"), none.alias("aliases"), F.lit(1.0).alias("confidence"), F.lit("").alias("description"), none.alias("source_chunk_ids"))
    merged, _ = resolve.resolve_embedding(entities, e.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("v")), 0.3)
    return merged.select("id", "name", "type", "members")


ALIASED = "al AS (SELECT s_suppkey AS ord, s_name AS name, 'S' || (s_nationkey % 4) AS type, ['alias ' || (s_suppkey % 20)] AS aliases FROM supplier)"


@REG.query(f"WITH {ALIASED}, n AS (SELECT type, ord, unnest(list_distinct(list_prepend(name, aliases))) AS n FROM al) SELECT type, lower(n) AS name, max(ord) AS id FROM n GROUP BY type, lower(n)")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with aliases that several of a type share: the last one has it."""
    s = table(spark, sf_dir, "supplier")
    merged = s.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("leader"), F.col("s_name").alias("name"), F.concat(F.lit("S"), (F.col("s_nationkey") % 4).cast("string")).alias("type"), F.array(F.concat(F.lit("alias "), (F.col("s_suppkey") % 20).cast("string"))).alias("aliases"))
    return resolve.alias_map(merged)


# --- samples, gold, batches, exports, comparisons ---


@REG.query("""WITH l AS (SELECT s_suppkey AS src, s_suppkey * 3 % 97 AS dst FROM supplier UNION ALL SELECT s_suppkey, s_suppkey * 5 % 89 FROM supplier), g AS (SELECT dst AS id, count(*) AS n FROM l WHERE src IN (1, 2, 3, 4) AND dst NOT IN (1, 2, 3, 4) GROUP BY dst ORDER BY n DESC, dst LIMIT 5)
    SELECT id FROM g UNION ALL SELECT unnest([1, 2, 3, 4])::BIGINT""")
def grown_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four suppliers and the five most linked to from them: a sampling operator, one round."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    links = s.select(k.alias("src"), (k * 3 % 97).alias("dst")).union(s.select(k, k * 5 % 89))
    return readers.grow_by_links(links, spark.range(1, 5), 100.0, 5, 9)


@REG.query("""WITH p AS (SELECT s_suppkey AS a, 1000 + s_suppkey AS b FROM supplier), ring AS (SELECT b, lead(b) OVER (PARTITION BY ('0x' || substr(sha256(b::VARCHAR), 1, 4))::INT % 256 ORDER BY sha256('42|' || b), b) AS nb FROM p)
    SELECT a, b, 'duplicate' AS label FROM p UNION ALL SELECT a, nb, 'not_duplicate' FROM p JOIN ring USING (b) WHERE nb IS NOT NULL""")
def matching_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), (F.lit(1000) + F.col("s_suppkey")).alias("b"))
    return readers.matching_gold(p, p.select("a"), p.select("b"))


@REG.query("""WITH e AS (SELECT p_partkey AS id, lower(p_name) AS k, ('0x' || substr(sha256(p_partkey::VARCHAR), 1, 4))::INT % 1024 AS g, sha256(p_partkey::VARCHAR) AS h FROM part),
    n AS (SELECT id, k, unnest([lead(id) OVER w, lead(id, 2) OVER w, lead(id, 3) OVER w]) AS b, unnest([lead(k) OVER w, lead(k, 2) OVER w, lead(k, 3) OVER w]) AS kb FROM e WINDOW w AS (PARTITION BY g ORDER BY h, id))
    SELECT x.id AS a, y.id AS b, 1 AS label FROM e x JOIN e y ON x.k = y.k AND x.id < y.id UNION ALL SELECT least(id, b), greatest(id, b), 0 FROM n WHERE b IS NOT NULL AND k <> kb""")
def entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.entity_pairs(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@REG.query("""WITH RECURSIVE o AS (SELECT doc_id AS id, n_chars AS tokens, g, row_number() OVER (PARTITION BY g ORDER BY n_chars DESC, doc_id) AS r FROM (SELECT *, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 4))::INT % 64 AS g FROM documents)),
    f AS (SELECT g, r, id, tokens, tokens AS held, 1 AS n, 0 AS k FROM o WHERE r = 1 UNION ALL SELECT o.g, o.r, o.id, o.tokens, CASE WHEN f.n >= 4 OR f.held + o.tokens > 6000 THEN o.tokens ELSE f.held + o.tokens END, CASE WHEN f.n >= 4 OR f.held + o.tokens > 6000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 4 OR f.held + o.tokens > 6000 THEN f.k + 1 ELSE f.k END FROM f JOIN o ON o.g = f.g AND o.r = f.r + 1)
    SELECT id, tokens, lpad(g::VARCHAR, 3, '0') || '-' || lpad(k::VARCHAR, 5, '0') AS batch FROM f""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by length, four a batch at most and 6,000 characters."""
    return evidence.token_batches(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("tokens")), 6_000, 4)


@REG.query(f"WITH {PLACES} SELECT 'node' AS kind, id AS a, name AS p, type AS b FROM pn UNION ALL SELECT 'relationship', subject, upper(predicate), object FROM pt")
def exported_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bulk export, written to the shared folder and read back."""
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/export-{uuid.uuid4().hex}"
    t = place_triples(spark, sf_dir)
    writers.export(place_nodes(spark, sf_dir), place_edges(spark, sf_dir), t, path, ["bulk_csv"])
    nodes, relationships = (spark.read.csv(f"{path}/bulk_csv/{k}", header=True) for k in ("nodes", "relationships"))
    return nodes.select(F.lit("node").alias("kind"), F.col("`id:ID`").alias("a"), F.col("name").alias("p"), F.col("type").alias("b")).union(relationships.select(F.lit("relationship"), "`:START_ID`", "`:TYPE`", "`:END_ID`"))


@REG.query(f"WITH {PLACES} SELECT 'node' AS kind, id AS a, name AS p, type AS b FROM pn UNION ALL SELECT 'edge', subject, predicate, object FROM pt UNION ALL SELECT 'triple', subject, predicate, object FROM pt WHERE predicate = 'lies_in'")
def read_graph_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as one node-link file, read back; triples of a structural predicate are left out."""
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/graph-{uuid.uuid4().hex}"
    t = place_triples(spark, sf_dir)
    nodes = place_nodes(spark, sf_dir).agg(F.collect_list(F.struct("id", "name", "type")).alias("nodes"))  # one file holds all of a graph
    edges = t.agg(F.collect_list(F.struct("subject", "predicate", "object")).alias("edges"))
    triples = t.withColumn("predicate", F.when(F.col("predicate") == "lives_in", "PART_OF").otherwise(F.col("predicate"))).agg(F.collect_list(F.struct("subject", "predicate", "object")).alias("triples"))
    nodes.join(edges, F.lit(True)).join(triples, F.lit(True)).select(F.to_json(F.struct(F.struct("nodes", "edges").alias("graph"), "triples")).alias("value")).coalesce(1).write.text(path)
    n, e, k = readers.read_graph_json(spark, path)
    one = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.col("subject").alias("a"), F.col("predicate").alias("p"), F.col("object").alias("b"))
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("name").alias("p"), F.col("type").alias("b")).union(one("edge", e)).union(one("triple", k))


@REG.query(f"SELECT 'all' AS variant, * FROM ({GRAPH_REG.sql['quality_metrics_report']}) UNION ALL SELECT 'again', * FROM ({GRAPH_REG.sql['quality_metrics_report']})")
def compared_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pipelines import compare

    report = GRAPH_REG.queries["quality_metrics_report"]
    return compare({name: lambda: report(spark, sf_dir) for name in ("all", "again")})
