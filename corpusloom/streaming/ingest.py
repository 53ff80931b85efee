"""Structured Streaming: batched ingest with deduplication across batches, keyed upserts, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, quality_profile
from ..operators.chunk import chunk_documents, sentence_chunks


def ingest(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, target: int = 450, overlap: int = 60, min_chars: int = 50, min_words: int = 10):
    """Starts a query over documents (doc_id, text): cleaned, filtered, chunked, handed to sink batch by batch.

    A batch drops exact repeats within itself; the sink's upsert by chunk id makes a repeated batch harmless.
    """

    def batch(df: DataFrame, n: int) -> None:
        clean = df.select("doc_id", clean_text(F.col("text")).alias("text")).dropDuplicates(["text"])
        good = clean.where(F.size(quality_profile(F.col("text"), min_chars, min_words)["rejection_reasons"]) == 0)
        chunks = chunk_documents(good, sentence_chunks(F.col("text"), target, overlap))
        sink(chunks.dropDuplicates(["content"]), n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(path: str, key: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the last row of each key in Parquet, as a log: a batch writes its own folder and nothing else.

    Of rows of a batch that repeat a key the last by ``order`` stays (the last as JSON without it). A batch that
    is tried again overwrites its own folder, which no write reads, so a crash loses nothing; newest() reads the log.
    """

    def write(df: DataFrame, n: int) -> None:
        row = F.struct(*df.columns)
        one = df.groupBy(key).agg(F.max_by(row, F.col(order) if order else F.to_json(row)).alias("row")).select("row.*")
        one.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def newest(spark, path: str, key: str) -> DataFrame:
    """The last row of each key over all batches."""
    log = spark.read.parquet(path)
    row = F.struct(*(c for c in log.columns if c != "batch"))
    return log.groupBy(key).agg(F.max_by(row, "batch").alias("row")).select("row.*")


def compact(spark, path: str, key: str, into: str) -> None:
    """The log's newest rows as the first batch of another log."""
    newest(spark, path, key).write.mode("overwrite").parquet(f"{into}/batch=0")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): works on streams and on tables."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with less than the gap between them."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without repeats of the keys within the watermark; state is dropped behind it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
