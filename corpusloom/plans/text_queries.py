"""Queries over texts: loading, cleaning, quality, duplicates, chunks, extraction, relations between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bind, clean_text, curation_text, deterministic_split, normal_url, quality_profile, sentences, urls_in, with_word_shingles
from ..functions.udfs import html_prose, nfc
from ..operators import archive, chunk, curate, dedup, extract, relations, scoring
from ..operators.similarity import set_similarity
from ..sources.readers import bio_spans, documents_from, reservoir
from .pipelines import GraphConfig, build_graph
from .registry import Registry, table

REG = Registry()

CLEAN = r"""regexp_replace(replace(replace(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text),
    '^\s+|\s+$', '', 'g'), '\r\n?', chr(10), 'g'), '[\t\f\x0b ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
    '‘’“”–', '''''""-'), '—', '--'), '…', '...'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g')"""
CURATED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')),
    '\r\n?', chr(10), 'g'), '[\t\f\x0b ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
    '[\x00-\x08\x0b-\x1f\x7f-\x{9f}]', '', 'g'), '^\s+|\s+$', '', 'g')"""


def profile_sql(source: str) -> str:
    """CTEs ending in prof: doc_id, text, n, words, sym, rep, short, reasons, flags, score."""
    return rf"""{source}, lines AS (
        SELECT *, length(text) AS n, len(regexp_extract_all(text, '\S+')) AS words,
            (length(text) - length(regexp_replace(text, '[^\p{{L}}\p{{N}}\s\p{{Z}}]', '', 'g'))) / greatest(length(text), 1) AS sym,
            string_split(text, chr(10)) AS ls, list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_full_match(w, '\p{{L}}+')) AS alpha FROM src
    ), reps AS (
        SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, trim(l) AS l, count(*) AS c FROM (SELECT doc_id, unnest(ls) AS l FROM lines) GROUP BY ALL) WHERE l <> '' GROUP BY doc_id
    ), ratios AS (
        SELECT lines.*, CASE WHEN len(ls) <= 1 THEN 0.0 ELSE coalesce(longest, 0) / len(ls) END AS rep,
            CASE WHEN len(alpha) > 0 THEN len(list_filter(alpha, lambda w: length(w) <= 2)) / len(alpha) END AS short FROM lines LEFT JOIN reps USING (doc_id)
    ), prof AS (
        SELECT *, concat_ws(',', CASE WHEN trim(text) = '' THEN 'empty_content' END, CASE WHEN contains(text, chr(65533)) THEN 'invalid_unicode_replacement' END,
                CASE WHEN n < 50 THEN 'too_short_characters' END, CASE WHEN words < 10 THEN 'too_short_words' END) AS reasons,
            concat_ws(',', CASE WHEN sym > 0.4 THEN 'excessive_symbols' END, CASE WHEN rep > 0.3 THEN 'repeated_lines' END,
                CASE WHEN len(list_filter(list_distinct(string_split(text, '')), lambda c: c NOT IN (chr(10), chr(13)) AND contains(text, repeat(c, 10)))) > 0 THEN 'repeated_chars' END,
                CASE WHEN short > 0.6 THEN 'many_short_tokens' END) AS flags,
            least(1.0, (1 - sym) * (1 - rep) * least(n, 50) / 50) AS score FROM ratios
    )"""


@REG.query("SELECT cast(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS content, coalesce(nullif(lang, ''), 'en') AS language, cast(doc_id AS VARCHAR) AS title, 'doc://' || doc_id AS url, source AS origin FROM documents")
def doc_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_from(table(spark, sf_dir, "documents"), {"doc_id": "id"})
    return docs.select("doc_id", "content", "language", "title", "url", F.col("metadata")["source"].alias("origin"))


@REG.query(f"SELECT doc_id, {CLEAN} AS text FROM documents")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", clean_text(nfc(F.col("text"))).alias("text"))


@REG.query("WITH " + profile_sql("src AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)") + "SELECT doc_id, round(score, 4) AS score, n AS char_count, words AS word_count, round(sym, 6) AS symbol_ratio, round(rep, 6) AS repeated_line_ratio, round(short, 6) AS short_token_ratio, reasons, flags FROM prof")
def quality_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", quality_profile(F.col("text")).alias("p"))
    return p.select("doc_id", *(f"p.{c}" for c in ("score", "char_count", "word_count", "symbol_ratio", "repeated_line_ratio", "short_token_ratio")), F.array_join("p.rejection_reasons", ",").alias("reasons"), F.array_join("p.review_flags", ",").alias("flags"))


@REG.query("WITH " + profile_sql("src AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)") + ", one AS (SELECT reasons = '' AS said, quality = 1 AS truth FROM prof JOIN labels USING (doc_id)), c AS (SELECT count_if(truth AND said) AS tp, count_if(NOT truth AND said) AS fp, count_if(truth AND NOT said) AS fn, count_if(NOT truth AND NOT said) AS tn FROM one) SELECT cast(tp AS BIGINT) AS tp, cast(fp AS BIGINT) AS fp, cast(fn AS BIGINT) AS fn, cast(tn AS BIGINT) AS tn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy FROM c")
def quality_vs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the filter's decision agrees with the labels."""
    rows = table(spark, sf_dir, "documents").where("text is not null").join(table(spark, sf_dir, "labels"), "doc_id")
    return scoring.label_scores(rows, F.col("quality") == 1, F.size(quality_profile(F.col("text"))["rejection_reasons"]) == 0)


@REG.query("SELECT doc_id, first_value(doc_id) OVER w AS canonical_id, count(*) OVER (PARTITION BY text) AS group_size FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text ORDER BY doc_id)")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents").where("text is not null"), text_col="text")


@REG.query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact(table(spark, sf_dir, "documents"), text_col="text").select("doc_id")


SHINGLES = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
    sh AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), chr(31)))) AS s FROM w)"""
CLASSES = f"""{SHINGLES}, cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS class, s FROM sh),
    tok AS (SELECT class, len(s) AS n, unnest(s) AS t FROM cls WHERE doc_id = class),
    pr AS (SELECT a.class AS a, b.class AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity FROM tok a JOIN tok b ON a.t = b.t AND a.class < b.class AND b.n >= 0.85 * a.n - 1e-9 AND a.n >= 0.85 * b.n - 1e-9 GROUP BY 1, 2 HAVING similarity >= 0.85 - 1e-12)"""


@REG.query(f"WITH {SHINGLES} SELECT doc_id, len(s) AS n, list_min(s) AS least, list_max(s) AS most FROM sh")
def shingle_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return with_word_shingles(docs, "s", F.col("text")).select("doc_id", F.size("s").cast("long").alias("n"), F.array_min("s").alias("least"), F.array_max("s").alias("most"))


@REG.query(f"WITH {CLASSES} SELECT a, b, round(similarity, 6) AS similarity FROM pr")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of equal shingle sets; near_dup_clusters has the membership."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    _, pairs = set_similarity(with_word_shingles(docs, "tokens", F.col("text")).select(F.col("doc_id").alias("id"), "tokens"), 0.85)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


def components_sql(links: str, nodes: str) -> str:
    """comp: id, root. links: a, b; nodes: id."""
    return f"""e AS (SELECT a, b FROM ({links}) UNION SELECT b, a FROM ({links})), reach AS (SELECT id, id AS o FROM ({nodes}) UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.o), comp AS (SELECT id, min(o) AS root FROM reach GROUP BY id)"""


@REG.query(f"WITH RECURSIVE {CLASSES}, {components_sql('SELECT a, b FROM pr', 'SELECT DISTINCT class AS id FROM cls')}, m AS (SELECT cls.doc_id AS id, comp.root FROM cls JOIN comp ON comp.id = cls.class) SELECT id, 'dup-' || min(cast(id AS VARCHAR)) OVER (PARTITION BY root) AS cluster_id, min(id) OVER (PARTITION BY root) AS canonical_id, id <> min(id) OVER (PARTITION BY root) AS is_duplicate FROM m")
def near_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.minhash_clusters(table(spark, sf_dir, "documents").where("text is not null"), 0.85, text_col="text", words=5)


SIMHASH = """g AS (SELECT doc_id, substr(text, cast(k AS INT), 4) AS g FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 3, 1) + 1)) AS k FROM documents WHERE text IS NOT NULL)),
    h AS (SELECT doc_id, ('0x' || substr(md5(g), 17, 16))::UBIGINT AS h, count(*) AS c FROM g GROUP BY 1, 2),
    v AS (SELECT doc_id, b, sum(c * (CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END)) AS v FROM h, (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY 1, 2),
    code AS (SELECT doc_id, bit_or(CASE WHEN v > 0 THEN 1::UBIGINT << b ELSE 0::UBIGINT END) AS code FROM v GROUP BY 1)"""


@REG.query(f"WITH {SIMHASH} SELECT doc_id, lower(lpad(to_hex(code), 16, '0')) AS code FROM code")
def simhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", dedup.simhash_md5("text").alias("c")).select("doc_id", F.lower(F.lpad(F.hex("c"), 16, "0")).alias("code"))


def leaders_sql(pairs: str, nodes: str) -> str:
    """led: id, leader of every node, by walking the paired items in order. pairs: a, b with a < b; nodes: id."""
    return f"""pq AS ({pairs}), it AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM (SELECT a AS id FROM pq UNION SELECT b FROM pq)),
    ea AS (SELECT it.r, it.id, coalesce(list(pq.a ORDER BY pq.a) FILTER (pq.a IS NOT NULL), []) AS before FROM it LEFT JOIN pq ON pq.b = it.id GROUP BY 1, 2),
    walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS lead UNION ALL SELECT ea.r, CASE WHEN list_has_any(walk.lead, ea.before) THEN walk.lead ELSE list_append(walk.lead, ea.id) END FROM walk JOIN ea ON ea.r = walk.r + 1),
    fin AS (SELECT unnest(lead) AS id FROM walk WHERE r = (SELECT max(r) FROM walk)),
    led AS (SELECT n.id, coalesce(min(pq.a) FILTER (n.id NOT IN (SELECT id FROM fin) AND pq.a IN (SELECT id FROM fin)), n.id) AS leader FROM ({nodes}) n LEFT JOIN pq ON pq.b = n.id GROUP BY n.id)"""


@REG.query(f"WITH RECURSIVE {SIMHASH}, {leaders_sql('SELECT x.doc_id AS a, y.doc_id AS b FROM code x JOIN code y ON x.doc_id < y.doc_id AND bit_count(xor(x.code, y.code)) <= 3', 'SELECT doc_id AS id FROM code')} SELECT id AS doc_id FROM led WHERE id = leader")
def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.simhash_dedup(table(spark, sf_dir, "documents").where("text is not null"), text_col="text").select("doc_id")


GRAMS5 = """gs AS (SELECT DISTINCT doc_id, substr(text, cast(k AS INT), 5) AS t FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 4, 1) + 1)) AS k FROM documents WHERE text IS NOT NULL)),
    gn AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM gs),
    gp AS (SELECT a.doc_id AS a, b.doc_id AS b FROM gn a JOIN gn b ON a.t = b.t AND a.doc_id < b.doc_id AND b.n >= 0.85 * a.n - 1e-9 AND a.n >= 0.85 * b.n - 1e-9 GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.85 - 1e-12)"""


@REG.query(f"WITH RECURSIVE {GRAMS5}, {leaders_sql('SELECT a, b FROM gp', 'SELECT doc_id AS id FROM documents WHERE text IS NOT NULL')} SELECT id AS doc_id FROM led WHERE id = leader")
def ngram_leader_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.ngram_dedup(table(spark, sf_dir, "documents").where("text is not null"), text_col="text").select("doc_id")


SENTENCES = r"""sn AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '[\r\n]+'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM documents WHERE text IS NOT NULL),
    sent AS (SELECT doc_id, i - 1 AS sent, ss[i] AS s FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM sn))"""


@REG.query(f"WITH {SENTENCES} SELECT doc_id, cast(sent AS INT) AS sent, s FROM sent")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sent", "s"))


def packed_sql(docs: str, target: int, overlap: int) -> str:
    """pk: doc_id, cs, the sentence chunks of docs (doc_id, text), by the same walk over sentences."""
    return rf"""ps AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?…])[\s\x0b]+', '\1' || chr(10), 'g'), '[\r\n]+'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM {docs}),
    pb AS (SELECT doc_id, flatten(list_transform(list_transform(ss, lambda s: {{'s': s, 'w': list_filter(regexp_split_to_array(s, '[\s\x0b]+'), lambda w: w <> '')}}), lambda e: CASE WHEN len(e.w) <= {target} THEN [e.s] ELSE list_transform(range(0, (len(e.w) - 1) // {target} + 1), lambda k: array_to_string(list_slice(e.w, k * {target} + 1, k * {target} + {target}), ' ')) END)) AS ss FROM ps),
    pn AS (SELECT doc_id, list_transform(ss, lambda s: {{'s': s, 'n': len(list_filter(regexp_split_to_array(s, '[\s\x0b]+'), lambda w: w <> ''))}}) AS ss FROM pb WHERE len(ss) > 0),
    pf AS (SELECT doc_id, list_reduce(list_transform(ss, lambda x: {{'cur': [x], 'n': x.n, 'out': []::VARCHAR[]}}), lambda a, x: CASE WHEN a.n + x.n <= {target} THEN {{'cur': list_concat(a.cur, x.cur), 'n': a.n + x.n, 'out': a.out}}
        ELSE {{'cur': CASE WHEN coalesce(list_sum(list_transform(list_filter(a.cur, lambda y, i: list_sum(list_transform(list_slice(a.cur, i, len(a.cur)), lambda z: z.n)) <= {overlap}), lambda z: z.n)), 0) + x.n <= {target} THEN list_concat(list_filter(a.cur, lambda y, i: list_sum(list_transform(list_slice(a.cur, i, len(a.cur)), lambda z: z.n)) <= {overlap}), x.cur) ELSE x.cur END,
            'n': (CASE WHEN coalesce(list_sum(list_transform(list_filter(a.cur, lambda y, i: list_sum(list_transform(list_slice(a.cur, i, len(a.cur)), lambda z: z.n)) <= {overlap}), lambda z: z.n)), 0) + x.n <= {target} THEN coalesce(list_sum(list_transform(list_filter(a.cur, lambda y, i: list_sum(list_transform(list_slice(a.cur, i, len(a.cur)), lambda z: z.n)) <= {overlap}), lambda z: z.n)), 0) ELSE 0 END + x.n)::BIGINT, 'out': list_append(a.out, array_to_string(list_transform(a.cur, lambda z: z.s), ' '))}} END) AS f FROM pn),
    pk AS (SELECT doc_id, list_append(f.out, array_to_string(list_transform(f.cur, lambda z: z.s), ' ')) AS cs FROM pf)"""


CHUNK_ROWS = r"""SELECT doc_id || ':chunk' || (i - 1) AS chunk_id, doc_id AS parent_doc_id, cast(i - 1 AS INT) AS chunk_index, cs[i] AS content, cast(len(list_filter(regexp_split_to_array(cs[i], '[\s\x0b]+'), lambda w: w <> '')) AS INT) AS token_count, cast(length(cs[i]) AS INT) AS char_length, CASE WHEN i < len(cs) THEN doc_id || ':chunk' || i END AS next_chunk_id FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM pk)"""


@REG.query(f"WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {packed_sql('d', 120, 20)} {CHUNK_ROWS}")
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return chunk.chunk_documents(docs, chunk.sentence_chunks(F.col("text"), 120, 20))


@REG.query(rf"""WITH s AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ss FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, text, list_reduce(list_prepend({{'cur': '', 'out': []::VARCHAR[]}}, list_transform(ss, lambda x: {{'cur': x, 'out': []::VARCHAR[]}})), lambda a, x: CASE WHEN length(a.cur) + length(x.cur) > 500 AND a.cur <> ''
        THEN {{'cur': CASE WHEN ltrim(right(a.cur, 100)) = '' THEN x.cur ELSE ltrim(right(a.cur, 100)) || chr(10) || x.cur END, 'out': list_append(a.out, a.cur)}} ELSE {{'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || chr(10) || x.cur END, 'out': a.out}} END) AS e FROM s),
    p AS (SELECT doc_id, text, CASE WHEN e.cur = '' THEN e.out ELSE list_append(e.out, e.cur) END AS cs FROM f),
    pk AS (SELECT doc_id, CASE WHEN length(text) <= 500 THEN [text] ELSE flatten(list_transform(cs, lambda c: CASE WHEN length(c) <= 500 THEN [c] ELSE list_transform(range(0, (length(c) - 101) // 400 + 1), lambda k: substr(c, (k * 400 + 1)::INT, 500)) END)) END AS cs FROM p) {CHUNK_ROWS}""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return chunk.chunk_documents(docs, chunk.fixed_chunks(F.col("text"), 500, 100, "\n"))


@REG.query(r"""WITH RECURSIVE k AS (SELECT doc_id AS id, n_chars // 4 + 1 AS tokens, sha256('curation:' || doc_id) AS k FROM documents),
    g AS (SELECT *, (('0x' || substr(k, 1, 4))::INT * 64) // 65536 AS g FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) AS r FROM g),
    f AS (SELECT g, r, id, tokens, tokens AS filled, 0 AS s FROM o WHERE r = 1 UNION ALL SELECT o.g, o.r, o.id, o.tokens, CASE WHEN f.filled + o.tokens > 5000 THEN o.tokens ELSE f.filled + o.tokens END, CASE WHEN f.filled + o.tokens > 5000 THEN f.s + 1 ELSE f.s END FROM f JOIN o ON o.g = f.g AND o.r = f.r + 1)
    SELECT id, tokens, lpad(g::VARCHAR, 3, '0') || '-' || lpad(s::VARCHAR, 5, '0') AS shard FROM f""")
def token_budget_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("n_chars div 4 + 1").alias("tokens"))
    return chunk.budget_shards(docs, 5000, "doc_id", "tokens")


@REG.query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^([^:]+)://', 1) AS sc, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)
    SELECT page_id, lower(sc) || '://' || lower(host) || rtrim(path, '/') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM u""")
def normal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", normal_url(F.col("url")).alias("url"))


@REG.query(r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'https?://[^\s<>\"'')\]]+'))), ' ') AS urls FROM pages")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls_in(F.col("html")), " ").alias("urls"))


@REG.query(r"""SELECT page_id, h AS href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages) GROUP BY ALL""")
def page_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@REG.query()
def page_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and links of pages by an HTML parser."""
    return table(spark, sf_dir, "pages").select("page_id", html_prose("html").alias("p")).select("page_id", "p.text", "p.links")


@REG.query(r"""WITH d AS (SELECT page_id AS id, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) AS root FROM pages), t AS (SELECT root, max(id) AS target FROM d GROUP BY root)
    SELECT id AS subject, 'hyperlinks_to' AS predicate, target AS object, root || '/#top' AS evidence_sentence FROM d JOIN t USING (root) WHERE id <> target""")
def hyperlink_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each page to the last page of its site, through the site's address."""
    root = F.regexp_extract("url", r"^([^:]+://[^/?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), root.alias("root"))
    return relations.hyperlinks(pages.select("id", F.concat("root", F.lit("/#top")).alias("url")), pages.select("id", F.col("root").alias("url"), F.col("id").alias("ord")))


# a boundary is where a letter, digit or underscore ends; marks between names are doubled, so that each name has its own on both sides
ENTITIES = r"""dt AS (SELECT doc_id, ' ' || regexp_replace(text, '([^\p{L}\p{N}_\p{M}])', '\1\1', 'g') || ' ' AS d, text FROM documents WHERE text IS NOT NULL),
    found AS (
        SELECT doc_id, 0 AS k, 'CONTACT' AS type, 1.0::DOUBLE AS confidence, unnest(regexp_extract_all(text, '[\p{L}\p{N}_\p{M}][\p{L}\p{N}_\p{M}.-]*@[\p{L}\p{N}_\p{M}.-]+\.[\p{L}\p{N}_\p{M}]+')) AS name FROM dt
        UNION ALL SELECT doc_id, 1, 'URL', 1.0, unnest(regexp_extract_all(text, 'https?://[^\s]+')) FROM dt
        UNION ALL SELECT doc_id, 2, 'NAMED_ENTITY', 0.5, unnest(regexp_extract_all(d, '[^\p{L}\p{N}_\p{M}]([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)[^\p{L}\p{N}_\p{M}]', 1)) FROM dt
    ), keyed AS (SELECT *, lower(regexp_replace(name, '\s+', ' ', 'g')) AS key FROM found)"""


@REG.query(f"WITH {ENTITIES} SELECT doc_id, key, min_by(type, k) AS type, min_by(confidence, k) AS confidence FROM keyed GROUP BY doc_id, key")
def regex_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, links and capitalised phrases."""
    e = extract.pattern_entities(table(spark, sf_dir, "documents").where("text is not null"))
    return e.groupBy("doc_id", F.lower(F.regexp_replace("name", r"\s+", " ")).alias("key")).agg(F.max("type").alias("type"), F.max("confidence").alias("confidence"))


GAZETTEER = """names AS (SELECT w AS id, w AS name, CASE WHEN length(w) % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS type FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) > 4)"""


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items as names."""
    w = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return table(spark, sf_dir, "benchmark").select(w.alias("name")).where("length(name) > 4").distinct().select(F.col("name").alias("id"), "name", F.when(F.length("name") % 2 == 0, "PERSON").otherwise("ORG").alias("type"))


@REG.query(rf"""WITH {SENTENCES}, {GAZETTEER}, ws AS (SELECT DISTINCT doc_id, sent, s, unnest(regexp_split_to_array(lower(s), '[^\p{{L}}\p{{N}}_#]+')) AS w FROM sent),
    men AS (SELECT DISTINCT doc_id, sent, id, type FROM ws JOIN names ON ws.w = names.name),
    pr AS (SELECT a.id AS a, b.id AS b, a.type AS ta, b.type AS tb FROM men a JOIN men b ON a.doc_id = b.doc_id AND a.sent = b.sent AND a.id < b.id)
    SELECT subject, predicate, object, count(*) AS n FROM (SELECT CASE WHEN ta = 'ORG' AND tb = 'PERSON' THEN b ELSE a END AS subject, CASE WHEN ta = tb THEN CASE WHEN ta = 'PERSON' THEN 'knows' ELSE 'partner_of' END ELSE 'works_at' END AS predicate, CASE WHEN ta = 'ORG' AND tb = 'PERSON' THEN a ELSE b END AS object FROM pr) GROUP BY ALL""")
def gazetteer_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(0, "works_at", "PERSON", "ORG", False), (1, "knows", "PERSON", "PERSON", True), (2, "partner_of", "ORG", "ORG", True), (3, "advises", "PERSON", "ORG", False)], "pos int, predicate string, domain string, range string, symmetric boolean")
    sents = extract.sentence_table(table(spark, sf_dir, "documents").where("text is not null"))
    found = extract.rule_relations(extract.gazetteer_mentions(sents, gazetteer(spark, sf_dir)), sents, rules)
    return found.groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"))


@REG.query("SELECT subject, predicate, object, evidence_sentence FROM (SELECT conv_id * 1000 + turn AS subject, 'same_series_as' AS predicate, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS object, 'conv-' || conv_id AS evidence_sentence FROM conversations) WHERE object IS NOT NULL")
def series_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return relations.series_edges(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("Conv-"), F.col("conv_id").cast("string")).alias("series"), F.col("turn").alias("series_index"), F.lit(None).cast("date").alias("date")))


@REG.query("SELECT subject, 'next' AS predicate, object FROM (SELECT conv_id * 1000 + turn AS subject, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS object FROM conversations) WHERE object IS NOT NULL")
def next_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return relations.next_edges(c, "conv_id", "turn", "id")


@REG.query("SELECT a.s_suppkey AS subject, 'shares_author_with' AS predicate, b.s_suppkey AS object, a.s_nationkey::VARCHAR AS evidence_sentence FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def shared_author_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents, their nations as authors."""
    return relations.shared_values(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("value")))


@REG.query("""WITH o AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS v FROM lineitem), s AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM o),
    p AS (SELECT a.id AS a, b.id AS b, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m, list(a.v::VARCHAR ORDER BY a.v::VARCHAR) AS v FROM s a JOIN s b ON a.v = b.v AND a.id < b.id AND b.n >= 0.3 * a.n AND a.n >= 0.3 * b.n GROUP BY 1, 2)
    SELECT a, b, common, round(common / (n + m - common), 6) AS jaccard, array_to_string(v[:3], ', ') || CASE WHEN common > 3 THEN ' (+' || (common - 3) || ' more)' ELSE '' END AS evidence FROM p WHERE common / (n + m - common) >= 0.3""")
def shared_reference_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, their parts as references."""
    return relations.shared_references(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("value")), 0.3)


@REG.query("SELECT doc_id, CASE WHEN b < 9000 THEN 'train' WHEN b < 9200 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT % 10000 AS b FROM documents)")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", deterministic_split(F.col("doc_id")).alias("split"))


@REG.query("""WITH h AS (SELECT source, doc_id, sha256(text) AS content_hash, lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) AS parent_hash FROM documents)
    SELECT source, doc_id, content_hash, parent_hash, content_hash IS DISTINCT FROM parent_hash AS is_new, cast(sum((content_hash IS DISTINCT FROM parent_hash)::INT) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS version FROM h""")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as uploads of one document."""
    return archive.versions(table(spark, sf_dir, "documents"), "source", F.col("doc_id")).select("source", "doc_id", "content_hash", "parent_hash", "is_new", "version")


OVERLAP = r"""q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM benchmark),
    dw AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM documents WHERE text IS NOT NULL),
    ov AS (SELECT query_id, doc_id, count(*) AS overlap FROM q JOIN dw USING (w) GROUP BY 1, 2)"""


@REG.query(f"WITH {OVERLAP} SELECT query_id, doc_id, overlap, cast(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS rank FROM ov) WHERE rank <= 10")
def token_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.overlap_topk(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, sf_dir, "documents").where("text is not null"), 10)


@REG.query(f"WITH {OVERLAP}, qn AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1), dn AS (SELECT doc_id, count(*) AS m FROM dw GROUP BY 1) SELECT query_id, doc_id, overlap FROM ov JOIN qn USING (query_id) JOIN dn USING (doc_id) WHERE overlap >= 0.7 * least(n, m)")
def contamination_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.overlap_matches(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, sf_dir, "documents").where("text is not null"), 0.7)


@REG.query("""WITH t AS (SELECT conv_id AS seq, turn AS pos, role AS token, CASE turn % 3 WHEN 0 THEN 'B-X' WHEN 1 THEN 'I-X' ELSE 'O' END AS tag FROM conversations),
    o AS (SELECT *, tag LIKE 'B-%' OR (tag LIKE 'I-%' AND coalesce(lag(tag) OVER w, 'O') = 'O') AS opens FROM t WINDOW w AS (PARTITION BY seq ORDER BY pos)),
    s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY seq ORDER BY pos) AS span FROM o WHERE tag <> 'O')
    SELECT seq, min(pos) AS start, max(pos) + 1 AS "end", 'X' AS type, string_agg(token, ' ' ORDER BY pos) AS text FROM s GROUP BY seq, span""")
def bio_tag_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as tokens: tags open at every third turn."""
    tag = F.when(F.col("turn") % 3 == 0, "B-X").when(F.col("turn") % 3 == 1, "I-X").otherwise("O")
    tokens = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), F.col("role").alias("token"), tag.alias("tag"))
    return bio_spans(tokens, "seq", "pos", "token", "tag")


@REG.query("SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 50")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)


@REG.query("WITH " + profile_sql(f"src AS (SELECT doc_id, lang, {CURATED} AS text FROM documents)") + """, dec AS (SELECT *, reasons = '' AS good, reasons = '' AND row_number() OVER (PARTITION BY reasons = '', text ORDER BY doc_id) = 1 AS kept FROM prof)
    SELECT lang, count(*) AS documents, cast(count_if(NOT good) AS BIGINT) AS rejected, cast(count_if(good AND NOT kept) AS BIGINT) AS duplicates, cast(count_if(kept) AS BIGINT) AS kept, cast(count_if(flags <> '') AS BIGINT) AS flagged, cast(coalesce(sum(words) FILTER (kept), 0) AS BIGINT) AS kept_words FROM dec GROUP BY lang""")
def curation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents survive normalising, quality profiling and exact deduplication, by language."""
    docs = bind(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "content", curation_text(nfc(F.coalesce("text", F.lit("")))))
    p = docs.select("doc_id", "lang", F.sha2("content", 256).alias("digest"), quality_profile(F.col("content")).alias("p")).select("doc_id", "lang", "digest", (F.size("p.rejection_reasons") == 0).alias("good"), (F.size("p.review_flags") > 0).alias("flagged"), F.col("p.word_count").alias("words"))
    first = p.where("good").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("kept"))
    d = p.join(first, "doc_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return d.groupBy("lang").agg(
        F.count("*").alias("documents"), F.count_if(~F.col("good")).alias("rejected"), F.count_if(F.col("good") & ~F.col("kept")).alias("duplicates"), F.count_if(F.col("kept")).alias("kept"),
        F.count_if(F.col("flagged")).alias("flagged"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("words"))), F.lit(0)).alias("kept_words"),
    )


@REG.query("WITH RECURSIVE " + profile_sql(f"src AS (SELECT doc_id, source, {CURATED} AS text FROM documents)") + rf""", acc AS (SELECT doc_id, text, round(score, 4) AS q FROM prof WHERE reasons = ''), cw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM acc),
    csh AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), chr(31)))) AS s FROM cw), cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS class, s FROM csh), tok AS (SELECT class, len(s) AS n, unnest(s) AS t FROM cls WHERE doc_id = class),
    pr AS (SELECT a.class AS a, b.class AS b FROM tok a JOIN tok b ON a.t = b.t AND a.class < b.class AND b.n >= 0.9 * a.n - 1e-9 AND a.n >= 0.9 * b.n - 1e-9 GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.9 - 1e-12), {components_sql('SELECT a, b FROM pr', 'SELECT DISTINCT class AS id FROM cls')},
    mem AS (SELECT cls.doc_id, comp.root, q FROM cls JOIN comp ON comp.id = cls.class JOIN acc ON acc.doc_id = cls.doc_id), best AS (SELECT root, min_by(doc_id, (-q, doc_id)) AS canonical FROM mem GROUP BY root), gone AS (SELECT doc_id FROM mem JOIN best USING (root) WHERE doc_id <> canonical),
    dec AS (SELECT source, flags, round(score, 4) AS score, reasons = '' AND doc_id NOT IN (FROM gone) AS kept FROM prof)
    SELECT source, count(*) AS documents, count_if(kept)::BIGINT AS accepted, count_if(NOT kept)::BIGINT AS rejected, count_if(flags <> '')::BIGINT AS flagged, round(avg(score), 9) AS mean_score FROM dec GROUP BY ROLLUP (source)""")
def curation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audited corpus's report by source: near duplicates count as rejected."""
    audit, _ = curate.curate(table(spark, sf_dir, "documents"))
    return curate.report(audit)


@REG.query("WITH RECURSIVE " + profile_sql(f"src AS (SELECT doc_id, {CLEAN} AS text FROM documents WHERE text IS NOT NULL AND lang = 'en')") + rf""", good AS (SELECT min(doc_id::VARCHAR) AS doc_id, text FROM prof WHERE trim(text) <> '' AND NOT contains(text, chr(65533)) AND n >= 200 AND words >= 40 GROUP BY text), {packed_sql('good', 450, 60)}, kc AS ({CHUNK_ROWS}), {GAZETTEER},
    ks AS (SELECT chunk_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(content, '([.!?])\s+', '\1' || chr(10), 'g'), '[\r\n]+'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM kc), kw AS (SELECT chunk_id, i, unnest(list_distinct(regexp_split_to_array(lower(ss[i]), '[^\p{{L}}\p{{N}}_#]+'))) AS w FROM (SELECT chunk_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM ks)),
    men AS (SELECT DISTINCT chunk_id, i, id, type FROM kw JOIN names ON w = name), pr AS (SELECT DISTINCT a.id AS a, b.id AS b, a.type AS ta, b.type AS tb FROM men a JOIN men b ON a.chunk_id = b.chunk_id AND a.i = b.i AND a.id < b.id),
    e AS (SELECT CASE WHEN ta = tb THEN CASE WHEN ta = 'PERSON' THEN 'knows' ELSE 'partner_of' END ELSE 'works_at' END AS label FROM pr UNION ALL SELECT 'part_of' FROM kc UNION ALL SELECT 'next' FROM kc WHERE next_chunk_id IS NOT NULL UNION ALL SELECT 'appears_in' FROM (SELECT DISTINCT id, chunk_id FROM men))
    SELECT 'node' AS kind, type AS label, count(*) AS n FROM (SELECT DISTINCT id, type FROM men) GROUP BY type UNION ALL SELECT 'node', 'Document', count(*) FROM good UNION ALL SELECT 'node', 'Chunk', count(*) FROM kc UNION ALL SELECT 'edge', label, count(*) FROM e GROUP BY label""")
def knowledge_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to a graph, end to end: (kind, label, n) of its nodes and edges."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), F.col("lang").alias("language"), F.lit("").alias("title"), F.lit("").alias("url")).where("content is not null")
    rules = spark.createDataFrame([(0, "works_at", "PERSON", "ORG", False), (1, "knows", "PERSON", "PERSON", True), (2, "partner_of", "ORG", "ORG", True)], "pos int, predicate string, domain string, range string, symmetric boolean")
    built = build_graph(docs, gazetteer(spark, sf_dir), rules, GraphConfig(dedup="exact"))
    nodes = built.nodes.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "label", "n")
    return nodes.union(built.edges.select(F.explode("predicates").alias("p")).groupBy("p").agg(F.count("*").alias("n")).select(F.lit("edge"), "p", "n"))
