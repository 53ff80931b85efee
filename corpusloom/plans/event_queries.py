"""Queries over events: the streaming operators' windows on a table, cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import ingest
from .registry import Registry, table

REG = Registry()


@REG.query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.tumbling(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@REG.query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start, count(*) AS n FROM events, range(0, 4) t(k) GROUP BY 1")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sliding(table(spark, sf_dir, "events"))


@REG.query("""WITH f AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, opens DESC) AS k FROM f)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(table(spark, sf_dir, "events"))


@REG.query("SELECT event_type, user_id % 10 AS cohort, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY CUBE (event_type, user_id % 10)")
def cube_rollup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("cohort"), "value")
    return e.cube("event_type", "cohort").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
