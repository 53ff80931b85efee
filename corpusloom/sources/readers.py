"""Readers: text, JSON, JSONL and CSV to documents; graph files; samples; gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT = "doc_id string, content string, source string, language string, title string, url string, metadata map<string,string>"
SUFFIXES = ("txt", "json", "csv", "jsonl")


def documents_from(rows: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rows of any columns to documents. mapping renames columns first.

    content is text, else content; doc_id is url, else id, else path#position; language is language, else lang, else en;
    title and url have defaults; the other columns go into metadata as strings.
    """
    for old, new in (mapping or {}).items():
        rows = rows.withColumnRenamed(old, new)
    have = set(rows.columns)
    col = lambda *names: F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have), F.lit(None).cast("string"))
    place = F.concat_ws("#", col("__path"), col("__pos"))
    doc_id = F.coalesce(col("url", "id"), place)
    rest = [c for c in rows.columns if c not in ("text", "content", "id", "url", "title", "language", "lang", "__path", "__pos")]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    return rows.select(
        doc_id.alias("doc_id"), F.coalesce(col("text", "content"), F.lit("")).alias("content"), F.coalesce(col("__path"), F.lit("")).alias("source"),
        F.coalesce(col("language", "lang"), F.lit("en")).alias("language"), F.coalesce(col("title"), doc_id).alias("title"), F.coalesce(col("url"), F.concat(F.lit("doc://"), doc_id)).alias("url"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def read_files(spark: SparkSession, path: str, kind: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Documents from all files of a kind under path. JSON files hold a list or an object each, JSONL lines one object; a bad line fails the read."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}")
    where = F.col("_metadata.file_path")
    if kind == "txt":
        return documents_from(files.text(path, wholetext=True).select(F.col("value").alias("text"), where.alias("__path"), where.alias("id")))
    if kind == "csv":
        rows = files.csv(path, header=True, multiLine=True, escape='"')
    else:
        rows = files.json(path, multiLine=kind == "json", mode="FAILFAST")
    return documents_from(rows.select("*", where.alias("__path")).withColumn("__pos", F.monotonically_increasing_id()), mapping)


def read_documents(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """All kinds under path, in the order txt, json, csv, jsonl (column ord)."""
    out = None
    for k, kind in enumerate(SUFFIXES):
        try:
            one = read_files(spark, path, kind, mapping).withColumn("kind", F.lit(k))
        except Exception as e:
            if "UNABLE_TO_INFER_SCHEMA" in str(e) or "PATH_NOT_FOUND" in str(e):
                continue
            raise
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], DOCUMENT + ", kind int")
    return out


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, triples) of a node-link file; edges may be called edges or links. Triples of structural predicates are left out."""
    g = spark.read.json(path, multiLine=True)
    inner = g.schema["graph"].dataType.names
    nodes = g.select(F.explode("graph.nodes").alias("n")).select("n.*")
    edges = g.select(F.explode(f"graph.{'edges' if 'edges' in inner else 'links'}").alias("e")).select("e.*")
    triples = g.select(F.explode("triples").alias("t")).select("t.*").where(~F.upper("predicate").isin("NEXT", "PART_OF", "MENTIONS"))
    return nodes, edges, triples


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML, as writers.graphml_lines() makes it: id, name, type; subject, object, predicates, weight."""
    data = "data array<struct<_key: string, _VALUE: string>>"
    value = lambda k: F.get(F.transform(F.filter("data", lambda d: d["_key"] == k), lambda d: d["_VALUE"]), F.lit(0))
    xml = spark.read.format("xml").option("attributePrefix", "_").option("valueTag", "_VALUE")
    nodes = xml.option("rowTag", "node").schema(f"_id string, {data}").load(path)
    edges = xml.option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    e = edges.select(F.col("_source").alias("subject"), F.col("_target").alias("object"), F.from_json(value("predicates"), "array<string>").alias("predicates"), value("weight").cast("int").alias("weight"))
    return nodes.select(F.col("_id").alias("id"), value("name").alias("name"), value("type").alias("type")), e


def read_lines_leniently(spark: SparkSession, path: str) -> DataFrame:
    """JSONL whose malformed lines are skipped."""
    return documents_from(spark.read.json(path, mode="DROPMALFORMED"))


def reservoir(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, each as likely as any other and the same at each run."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")), 256), key).limit(n)


def grow_by_links(links: DataFrame, start: DataFrame, target_degree: float, batch: int, limit: int, max_rounds: int = 20) -> DataFrame:
    """Ids grown from start until the mean number of links (src, dst) within the set reaches the target, by the ids most linked to; ties by id."""
    from ..operators.components import cut

    chosen = cut(start.select("id").distinct())
    for _ in range(max_rounds):
        n = chosen.count()
        within = links.join(chosen.select(F.col("id").alias("src")), "src", "left_semi")
        inside = within.join(chosen.select(F.col("id").alias("dst")), "dst", "left_semi").count()
        if n >= limit or (n and inside / n >= target_degree):
            break
        more = within.join(chosen.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy(F.col("dst").alias("id")).count().orderBy(F.desc("count"), "id").limit(min(batch, limit - n)).select("id")
        grown = cut(chosen.union(more))
        if grown.count() == n:
            break
        chosen = grown
    return chosen


def bio_spans(tokens: DataFrame, seq: str, pos: str, token: str, tag: str) -> DataFrame:
    """(seq, start, end, type, text) of tagged runs: B- opens, I- of the same type goes on, an I- without one opens too."""
    by = Window.partitionBy(seq).orderBy(pos)
    kind = F.regexp_replace(tag, "^[BI]-", "")
    before = F.lag(tag).over(by)
    opens = F.col(tag).startswith("B-") | (F.col(tag).startswith("I-") & (before.isNull() | (before == "O") | (F.regexp_replace(before, "^[BI]-", "") != kind)))
    marked = tokens.withColumn("__open", opens.cast("int")).where(F.col(tag) != "O")
    spans = marked.withColumn("__span", F.sum("__open").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(seq, "__span").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.first(kind).alias("type"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(token).alias("t")))), lambda x: x["t"]), " ").alias("text")).drop("__span")


def matching_gold(pairs: DataFrame, left: DataFrame, right: DataFrame, seed: str = "42") -> DataFrame:
    """(a, b, label): the mapped pairs (a, b) as duplicates, and as many others: each left id with a right id that follows its own in hashed order."""
    pos = pairs.select("a", "b").distinct()
    from ..functions.text import hash_group

    bucket = hash_group(F.col("b"), 256)
    ring = right.select(F.col("b")).distinct().withColumn("nb", F.lead("b").over(Window.partitionBy(bucket).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col("b").cast("string")), 256), "b"))).where("nb is not null")
    neg = pos.join(ring, "b").select("a", F.col("nb").alias("b")).join(pos, ["a", "b"], "left_anti")
    return pos.withColumn("label", F.lit("duplicate")).union(neg.withColumn("label", F.lit("not_duplicate")))


def topic_labels(rows: DataFrame, known: list[str]) -> DataFrame:
    """(title, qid, topics, split) of rows that have topics, all of them known."""
    from ..functions.text import deterministic_split

    ok = (F.size("topics") > 0) & (F.size(F.array_except("topics", F.array(*map(F.lit, known)))) == 0)
    return rows.where(ok).select("title", "qid", F.array_sort(F.array_distinct("topics")).alias("topics"), deterministic_split(F.col("qid")).alias("split"))


#: Datasets by name: a function of (spark, path) that reads a local or shared copy. Nothing is downloaded.
DATASETS = {"documents": read_documents, "graph": read_graph_json, "jsonl": read_lines_leniently}


EXCLUDED_TITLES = ("List of ", "Lists of ", "Category:", "Template:", "Portal:", "File:", "Wikipedia:", "Help:")


def title_url(title: Column, language: str = "en") -> Column:
    """The address of an encyclopedia article."""
    return F.concat(F.lit(f"https://{language}.wikipedia.org/wiki/"), F.replace(F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("%2F"), F.lit("/")))


def url_parts(url: Column) -> Column:
    """struct<language, title> of such an address; nulls of any other."""
    take = lambda k: F.nullif(F.regexp_extract(url, r"^https?://([a-z-]+)\.(?:m\.)?wikipedia\.org/wiki/([^?#]+)", k), F.lit(""))
    return F.struct(take(1).alias("language"), F.replace(F.try_url_decode(take(2)), F.lit("_"), F.lit(" ")).alias("title"))


def wanted_pages(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Pages (url) that a list of urls names, in their normal form."""
    from ..functions.text import normal_url

    keys = urls.select(normal_url(F.col("url")).alias("__key")).distinct()
    return pages.withColumn("__key", normal_url(F.col("url"))).join(keys, "__key", "left_semi").drop("__key")


def article_records(rows: DataFrame, language: str = "en", min_chars: int = 0) -> DataFrame:
    """Records of raw articles (id, title, text, url, categories): those long enough whose titles aren't lists or of other namespaces."""
    keep = (F.length("text") >= min_chars) & ~F.coalesce(F.col("title").rlike("^(" + "|".join(EXCLUDED_TITLES) + ")"), F.lit(False))
    return rows.where(keep).select(
        F.concat(F.lit(f"wikipedia:{language}:"), F.col("id").cast("string")).alias("id"), "text", "title", F.coalesce("url", title_url(F.col("title"), language)).alias("url"),
        F.lit("wikipedia").alias("source"), F.lit(language).alias("language"), F.col("id").cast("string").alias("page_id"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
    )


def add_links(records: DataFrame, links: DataFrame) -> DataFrame:
    """Records with ``links``, sorted addresses from a link table (page_id, target); records without any get an empty list."""
    own = links.groupBy("page_id").agg(F.array_sort(F.collect_set(title_url(F.col("target")))).alias("links"))
    return records.join(own, "page_id", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))
