"""Versions of documents: change detection over uploads, archives of replaced chunks, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(uploads: DataFrame, key: str, order: Column, text: str = "text") -> DataFrame:
    """uploads with content_hash, version, parent_hash and is_new: a version is a change against the upload before; an unchanged one keeps its version."""
    by = Window.partitionBy(key).orderBy(order)
    h = uploads.withColumn("content_hash", F.sha2(text, 256))
    h = h.withColumn("parent_hash", F.lag("content_hash").over(by))
    h = h.withColumn("is_new", ~F.col("content_hash").eqNullSafe(F.col("parent_hash")))
    return h.withColumn("version", F.sum(F.col("is_new").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def latest(versioned: DataFrame, key: str, order: Column) -> DataFrame:
    """(key, version, content_hash, uploads) of each document as it is now."""
    return versioned.groupBy(key).agg(F.max("version").alias("version"), F.max_by("content_hash", order).alias("content_hash"), F.count("*").alias("uploads"))


def store(archive: DataFrame, uploads: DataFrame, key: str = "doc_id") -> DataFrame:
    """The archive (doc_id, version, content_hash, last_upload) after one upload a document (doc_id, content_hash, at): an unchanged document moves its date, a changed one gets the next version."""
    last = archive.groupBy(key).agg(F.max("version").alias("version"), F.max_by("content_hash", "version").alias("content_hash"))
    u = uploads.alias("u").join(last.alias("l"), key, "left")
    same = u.where(F.col("u.content_hash") == F.col("l.content_hash")).select(key, "version", F.col("at").alias("touched"))
    moved = archive.join(same, [key, "version"], "left").select(key, "version", "content_hash", F.coalesce("touched", "last_upload").alias("last_upload"))
    new = u.where(~F.col("u.content_hash").eqNullSafe(F.col("l.content_hash"))).select(key, (F.coalesce("version", F.lit(0)) + 1).alias("version"), F.col("u.content_hash").alias("content_hash"), F.col("at").alias("last_upload"))
    return moved.unionByName(new)


def archive_chunks(chunks: DataFrame, replaced: DataFrame, length: int = 500) -> DataFrame:
    """Copies of chunks (parent_doc_id, chunk_id, content) of replaced documents (doc_id, version), texts cut to ``length``."""
    r = replaced.select(F.col("doc_id").alias("parent_doc_id"), F.col("version").alias("replaced_by_version"))
    return chunks.join(r, "parent_doc_id").withColumn("content", F.substring("content", 1, length))


def link_chunks(archive: DataFrame, chunks: DataFrame, triples: DataFrame, key: str = "doc_id") -> DataFrame:
    """The archive (doc_id, version, ...) whose latest versions say which chunks (parent_doc_id, chunk_id) and how many triples (source_chunk_id) a graph has of them."""
    n = triples.groupBy(F.col("source_chunk_id").alias("chunk_id")).agg(F.count("*").alias("n"))
    own = chunks.join(n, "chunk_id", "left").groupBy(F.col("parent_doc_id").alias(key)).agg(F.array_sort(F.collect_set("chunk_id")).alias("kg_chunk_ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("kg_triple_count"))
    last = archive.groupBy(key).agg(F.max("version").alias("version"))
    return archive.join(last.join(own, key), [key, "version"], "left")


RUN = "run_id string, config string, status string, started_at timestamp, completed_at timestamp, stats map<string,long>"


def start_run(runs: DataFrame, run_id: str, config: str = "{}") -> DataFrame:
    """The log of runs (RUN) with a new one that is running."""
    one = runs.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.lit(config).alias("config"), F.lit("running").alias("status"), F.current_timestamp().alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("map<string,bigint>").alias("stats"))
    return runs.unionByName(one)


def complete_run(runs: DataFrame, run_id: str, stats: dict[str, int]) -> DataFrame:
    """The log with a run completed and its counts."""
    own = F.col("run_id") == run_id
    pairs = F.create_map(*(F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for kv in sorted(stats.items()) for x in kv)) if stats else F.create_map().cast("map<string,bigint>")
    return runs.withColumn("status", F.when(own, "completed").otherwise(F.col("status"))).withColumn("completed_at", F.when(own, F.current_timestamp()).otherwise(F.col("completed_at"))).withColumn("stats", F.when(own, pairs).otherwise(F.col("stats")))
