"""Benchmark scorers: predictions against gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import confusion


def pair_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pairwise precision, recall, F1 of a clustering: gold (id, cluster) against predicted (id, cluster), from sizes of clusters and of their overlaps, so that no pair is made."""
    both = gold.select("id", F.col("cluster").alias("g")).join(predicted.select("id", F.col("cluster").alias("p")), "id")
    pairs = lambda df: df.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("x"))
    tp = pairs(both.groupBy("g", "p").agg(F.count("*").alias("n"))).withColumnRenamed("x", "tp")
    pos = pairs(both.groupBy("g").agg(F.count("*").alias("n"))).withColumnRenamed("x", "gold_pairs")
    said = pairs(both.groupBy("p").agg(F.count("*").alias("n"))).withColumnRenamed("x", "said_pairs")
    one = tp.join(pos, F.lit(True)).join(said, F.lit(True))
    p, r = F.coalesce(F.try_divide("tp", "said_pairs"), F.lit(1.0)), F.coalesce(F.try_divide("tp", "gold_pairs"), F.lit(1.0))
    return one.select(F.col("tp").cast("long").alias("tp"), F.col("gold_pairs").cast("long").alias("gold_pairs"), F.col("said_pairs").cast("long").alias("said_pairs"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4).alias("f1"))


def cluster_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Size-weighted precision and recall of clusters by their best overlaps."""
    both = gold.select("id", F.col("cluster").alias("g")).join(predicted.select("id", F.col("cluster").alias("p")), "id")
    overlap = both.groupBy("g", "p").agg(F.count("*").alias("n"))
    best = lambda c: overlap.groupBy(c).agg(F.max("n").alias("m"), F.sum("n").alias("s")).agg(F.round(F.sum("m") / F.sum("s"), 4))
    return best("p").toDF("precision").join(best("g").toDF("recall"), F.lit(True))


def boundary_scores(boundaries: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunk boundaries (doc_id, at) against gold spans (doc_id, start, end): precision is the share not strictly inside a span, recall the share of spans not cut; 1 where there are none."""
    inside = boundaries.join(spans, "doc_id").where("at > start and at < end")
    bad = inside.select("doc_id", "at").distinct().agg(F.count("*").alias("bad"))
    cut = inside.select("doc_id", "start", "end").distinct().agg(F.count("*").alias("cut"))
    one = boundaries.agg(F.count("*").alias("n")).join(spans.agg(F.count("*").alias("m")), F.lit(True)).join(bad, F.lit(True)).join(cut, F.lit(True))
    return one.select(F.round(F.coalesce(1 - F.try_divide("bad", "n"), F.lit(1.0)), 4).alias("precision"), F.round(F.coalesce(1 - F.try_divide("cut", "m"), F.lit(1.0)), 4).alias("recall"))


def span_scores(gold: DataFrame, said: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end, type): precision, recall and F1 of exact spans, and the share of those found with the right type."""
    both = gold.select("doc_id", "start", "end", F.col("type").alias("g")).distinct().join(said.select("doc_id", "start", "end", F.col("type").alias("s")).distinct(), ["doc_id", "start", "end"], "full")
    c = both.agg(F.count_if(F.col("g").isNotNull() & F.col("s").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("s").isNull()).alias("fn"), F.count_if(F.col("g") == F.col("s")).alias("typed"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(div(2 * p * r, p + r), 4).alias("f1"), F.round(div(F.col("typed"), F.col("tp")), 4).alias("type_accuracy"))


def overlap_topk(queries: DataFrame, texts: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, overlap, rank): texts (doc_id, text) by the number of distinct words they share with a query (query_id, text); ties by doc_id.

    A word in over a tenth of all texts joins many rows, so partial counts by (query, text) form before the shuffle.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""))
    q = queries.select("query_id", F.explode(words("text")).alias("w"))
    d = texts.select("doc_id", F.explode(words("text")).alias("w"))
    n = d.join(q, "w").groupBy("query_id", "doc_id").agg(F.count("*").alias("overlap"))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "doc_id")
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def overlap_matches(queries: DataFrame, texts: DataFrame, share: float = 0.7) -> DataFrame:
    """(query_id, doc_id, overlap): texts that share this part of the smaller side's distinct words with a query; counted through a join on words, no pair is compared that shares none."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""))
    q = queries.select("query_id", words("text").alias("ws")).select("query_id", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    d = texts.select("doc_id", words("text").alias("ws")).select("doc_id", F.size("ws").alias("m"), F.explode("ws").alias("w"))
    met = d.join(q, "w").groupBy("query_id", "doc_id").agg(F.count("*").alias("overlap"), F.first("n").alias("n"), F.first("m").alias("m"))
    return met.where(F.col("overlap") >= share * F.least("n", "m")).select("query_id", "doc_id", "overlap")


def recall_at_k(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of gold (query_id, doc_id) among hits, and of hits that are gold."""
    right = hits.join(gold, ["query_id", "doc_id"], "left_semi").agg(F.count("*").alias("right"))
    one = right.join(hits.agg(F.count("*").alias("n")), F.lit(True)).join(gold.agg(F.count("*").alias("m")), F.lit(True))
    return one.select(F.round(F.coalesce(F.try_divide("right", "m"), F.lit(0.0)), 4).alias("recall"), F.round(F.coalesce(F.try_divide("right", "n"), F.lit(0.0)), 4).alias("precision"))


def texts_match(a: Column, b: Column) -> Column:
    """One holds the other, or they share seven tenths of the smaller one's words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""))
    common = F.size(F.array_intersect(words(a), words(b)))
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a)) | (common >= 0.7 * F.greatest(F.least(F.size(words(a)), F.size(words(b))), F.lit(1)))


def label_scores(rows: DataFrame, truth: Column, said: Column) -> DataFrame:
    return confusion(rows.select(truth.alias("truth"), said.alias("said")))


def multilabel_scores(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Micro scores of (id, label, truth boolean, logit)."""
    return label_scores(rows, F.col("truth"), 1 / (1 + F.exp(-F.col("logit"))) >= threshold)
