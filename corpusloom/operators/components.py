"""Connected components over a table of links."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder that spark.checkpoint.dir names. Without it, a local master takes a temporary folder; a cluster, whose machines don't share one, is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master or ""):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusloom-"))


def cut(df: DataFrame) -> DataFrame:
    """df, written to the session's shared checkpoint folder; loops build on the written rows, not on a growing plan."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(id, component) of every id in a link; component is the least id that can be reached.

    Each round takes the least label among an id's neighbours, then the label of that label: a chain of
    n ids ends in about log n rounds. Labels live in a table, never on the driver; ids are deduplicated
    links, so a hub costs its degree. Rows with a null end and self links are left out.
    """
    one = links.select(F.col(a).alias("id"), F.col(b).alias("other")).where("id is not null and other is not null and id <> other")
    both = cut(one.union(one.select("other", "id")).distinct())
    labels = cut(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("label"))
        roots = labels.select(F.col("id").alias("label"), F.col("component").alias("root"))
        new = cut(step.join(roots, "label").select("id", F.least("label", "root").alias("component"), (F.least("label", "root") < F.col("before")).alias("changed")))
        changed = new.where("changed").limit(1).count()
        labels = new.drop("changed")
        if not changed:
            return labels
    raise RuntimeError(f"components still change after {max_rounds} rounds")
