"""Evidence graphs of articles: mentions against links and chunks, topics, covers, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import hash_group
from .components import cut


def overlapping(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of a and b (key, start, end, ...) whose half-open spans overlap; b's columns other than the key get the suffix _b."""
    other = b.select(key, *(F.col(c).alias(f"{c}_b") for c in b.columns if c != key))
    return a.join(other, key).where((F.col("start") < F.col("end_b")) & (F.col("start_b") < F.col("end")))


def contained(inner: DataFrame, outer: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs where the inner span lies within the outer one."""
    return overlapping(inner, outer, key).where((F.col("start_b") <= F.col("start")) & (F.col("end") <= F.col("end_b")))


def linked_mentions(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """mentions (doc_id, start, end, surface, type) with the target of the link that overlaps them with the same surface, the first by place; null where there is none."""
    hits = overlapping(mentions, links.select("doc_id", "start", "end", "surface", "target")).where("surface = surface_b")
    first = hits.groupBy("doc_id", "start", "end", "surface").agg(F.min_by("target_b", F.struct("start_b", "target_b")).alias("target"))
    return mentions.join(first, ["doc_id", "start", "end", "surface"], "left")


def primary_type(observed: DataFrame) -> DataFrame:
    """(id, type): an entity's most frequent type, the first by name among equals. observed: (id, type)."""
    n = observed.groupBy("id", "type").agg(F.count("*").alias("n"))
    return n.groupBy("id").agg(F.min_by("type", F.struct((-F.col("n")).alias("n"), "type")).alias("type"))


def unresolved_mentions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n): mention nodes that don't have exactly one refers_to edge."""
    n = edges.where("predicate = 'refers_to'").groupBy(F.col("subject").alias("id")).agg(F.count("*").alias("n"))
    return nodes.where("type = 'Mention'").select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n")).where("n <> 1")


def article_links(articles: DataFrame) -> DataFrame:
    """links_to edges of articles (id, title, links array<string>) to articles of the set, not to themselves."""
    titles = articles.groupBy(F.col("title").alias("link")).agg(F.min("id").alias("object"))
    e = articles.select(F.col("id").alias("subject"), F.explode("links").alias("link")).join(titles, "link").where("subject <> object")
    return e.select("subject", F.lit("links_to").alias("predicate"), "object").distinct()


def attach_labels(articles: DataFrame, labels: DataFrame, require: bool = True) -> DataFrame:
    """Articles (id) with topics (article_id, topic_ids); without ``require``, those that have none get an empty list."""
    l = labels.select(F.col("article_id").alias("id"), "topic_ids")
    return articles.join(l, "id") if require else articles.join(l, "id", "left").withColumn("topic_ids", F.coalesce("topic_ids", F.array().cast("array<string>")))


def unknown_topics(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(topic, n) of labels' topics that the taxonomy (topic) hasn't."""
    t = labels.select(F.explode("topic_ids").alias("topic"))
    return t.join(taxonomy.select("topic"), "topic", "left_anti").groupBy("topic").agg(F.count("*").alias("n"))


def topic_cover(records: DataFrame, per_topic: int, order: str = "ord") -> DataFrame:
    """Records (ord, topics) that, walked in order, add a topic that fewer than per_topic taken ones have.

    The first per_topic records of a topic are always taken, and after them the topic is full, so a record
    is taken just if it is among the first of one of its topics: ranks by topic say so, without a walk.
    """
    listed = records.select(order, F.explode(F.array_distinct("topics")).alias("topic"))
    first = listed.withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy(order))).where(F.col("k") <= per_topic).select(order).distinct()
    return records.join(first, order, "left_semi")


def merge_duplicate_edges(edges: DataFrame) -> DataFrame:
    """(subject, predicate, object, weight, evidence): equal edges as one, weighed by their number."""
    return edges.groupBy("subject", "predicate", "object").agg(F.count("*").cast("long").alias("weight"), F.array_sort(F.collect_list("evidence")).alias("evidence"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, n): nodes by type, edges by predicate, and all of each (null)."""
    n = nodes.rollup("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("type").alias("label"), "n")
    return n.union(edges.rollup("predicate").agg(F.count("*").alias("n")).select(F.lit("edge"), "predicate", "n"))


def positions(text: Column, name: Column) -> Column:
    """Starts (from 0) of a name's occurrences, none overlapping."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), name, F.lit(r"\E")), -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(p) + F.length(name)).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(p)).alias("out"))
    return F.when(F.length(name) > 0, F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<int>"))


def locate_names(names: DataFrame, texts: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, name, type, start, end): where each extracted name (doc_id, name, type) stands in its text, at a gold span (doc_id, start, end) if it stands at one, else at its first place. Names that aren't in the text are left out."""
    at = names.distinct().join(texts.select("doc_id", "text"), "doc_id").select("doc_id", "name", "type", F.explode(positions(F.col("text"), F.col("name"))).alias("start"))
    at = at.withColumn("end", F.col("start") + F.length("name"))
    marked = at.join(gold.select("doc_id", "start", "end").distinct().withColumn("gold", F.lit(0)), ["doc_id", "start", "end"], "left")
    best = marked.groupBy("doc_id", "name", "type").agg(F.min(F.struct(F.coalesce("gold", F.lit(1)).alias("g"), "start", "end")).alias("m"))
    return best.select("doc_id", "name", "type", "m.start", "m.end")


def chunk_boundaries(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, at): ends of all but a text's last chunk; chunks (doc_id, chunk_index, content) are looked for from the start of the one before."""
    own = chunks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]).alias("cs"))
    fold = F.expr("aggregate(slice(cs, 1, size(cs) - 1), named_struct('at', 1, 'out', cast(array() as array<int>)), (acc, c) -> named_struct('at', greatest(acc.at, locate(c, text, acc.at)), 'out', if(locate(c, text, acc.at) > 0, array_append(acc.out, locate(c, text, acc.at) + length(c) - 1), acc.out)), acc -> acc.out)")
    return texts.join(own, "doc_id").select("doc_id", F.explode(fold).alias("at"))


def trim_to_budget(rows: DataFrame, budget: int, order: str, tokens: str = "tokens", max_rounds: int = 1000) -> DataFrame:
    """Rows that a walk in order takes while they fit: what would pass the budget is skipped, and later, smaller rows may still fit.

    A round takes all rows before the first that doesn't fit, then drops those that can't fit any more, so
    it has as many rounds as there are skips that leave something to take.
    """
    left, room, taken = cut(rows.where(F.col(tokens) <= budget)), budget, None
    for _ in range(max_rounds):
        sums = running_sum(left, order, tokens)
        over = sums.where(F.col("__sum") > room).agg(F.min(order).alias("o")).first()["o"]
        now = left if over is None else left.where(F.col(order) < over)
        now = cut(now)
        taken = now if taken is None else taken.unionByName(now)
        if over is None:
            return taken
        room -= now.agg(F.sum(tokens)).first()[0] or 0
        left = cut(left.where((F.col(order) > over) & (F.col(tokens) <= room)))
        if not left.limit(1).count():
            return taken
    raise RuntimeError(f"rows are still left after {max_rounds} rounds")


def running_sum(rows: DataFrame, order: str, tokens: str, parts: int = 64) -> DataFrame:
    """rows with __sum, the running sum in order: within ranges of the order, then over the ranges before, so that no task sorts all rows."""
    ranged = cut(rows.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum(tokens).alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum(tokens).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__within", within).join(F.broadcast(sums.select("__part", "before")), "__part").withColumn("__sum", F.col("__within") + F.col("before")).drop("__part", "__within", "before")  # at most ``parts`` rows


def split_to_limit(texts: DataFrame, limit: int, count=None, text_col: str = "text") -> DataFrame:
    """(doc_id, part, content): sentences packed up to ``limit`` tokens; the parts of a text join to it exactly.

    A sentence over the limit is cut at the last blank that keeps a part within it, else at the last
    character. count: text to tokens, words by default; it runs on the executors.
    """
    import re

    end = re.compile(r"(?<=[.!?…])\s+")
    count = count or (lambda s: len(s.split()))

    def longest(s: str) -> int:
        low, high = 1, len(s)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if count(s[:mid]) <= limit else (low, mid - 1)
        if low == len(s):
            return low
        blank = max(s.rfind(b, 1, low) for b in " \n\t")
        return blank + 1 if blank > 0 else low

    def split(text: str) -> list[str]:
        ends = [m.end() for m in end.finditer(text)] + [len(text)]
        out, at, held = [], 0, 0
        for e in ends:
            if count(text[at:e]) <= limit:
                held = e
                continue
            if held > at:
                out.append(text[at:held])
                at = held
            while count(text[at:e]) > limit:
                n = longest(text[at:e])
                out.append(text[at : at + n])
                at += n
            held = e
        if held > at:
            out.append(text[at:held])
        return out

    schema = T.StructType([texts.schema["doc_id"], T.StructField("part", T.IntegerType()), T.StructField("content", T.StringType())])

    def run(batches):
        import pandas as pd

        for b in batches:
            for doc, text in zip(b["doc_id"], b[text_col]):
                parts = split(text) if text else []
                if parts:
                    yield pd.DataFrame({"doc_id": [doc] * len(parts), "part": range(len(parts)), "content": parts})

    return texts.select("doc_id", text_col).mapInPandas(run, schema)


def token_batches(rows: DataFrame, budget: int, most: int = 32, id_col: str = "id", tokens_col: str = "tokens", groups: int = 64) -> DataFrame:
    """(id, tokens, batch): the longest first, a batch holds up to ``most`` rows within the budget (or one row beyond it); filled side by side in ``groups`` hashed parts."""
    key = hash_group(F.col(id_col), groups)
    dealt = rows.select(key.alias("g"), F.col(id_col).alias("id"), F.col(tokens_col).cast("long").alias("tokens")).repartition("g").sortWithinPartitions("g", F.desc("tokens"), "id")

    def fill(batches):
        import pandas as pd

        group, k, n, held = None, 0, 0, 0
        for b in batches:
            out = []
            for g, t in zip(b["g"], b["tokens"]):
                if g != group:
                    group, k, n, held = g, 0, 0, 0
                elif n and (n >= most or held + t > budget):
                    k, n, held = k + 1, 0, 0
                n, held = n + 1, held + t
                out.append(f"{g:03d}-{k:05d}")
            yield pd.DataFrame({"id": b["id"], "tokens": b["tokens"], "batch": out})

    return dealt.mapInPandas(fill, dealt.select("id", "tokens").schema.add("batch", "string"))


def pending(rows: DataFrame, cache: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows whose key a cache of embeddings hasn't, each key once."""
    return rows.join(cache.select(key), key, "left_anti").dropDuplicates([key])
