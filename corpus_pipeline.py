"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, benchmark items and secrets are taken out, rates are set.

Every stage takes what the one before it kept, with any extra columns, whatever they are called, and keeps their
values. Null and empty texts, null ids and repeated rows are allowed everywhere; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, mixing, near_copies, secrets, toxicity
from corpusloom.llm.common import cut_lineage, keeping_columns, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose score is under 0.5. Rows are judged one by one: null and empty texts stay, repeated rows go or stay alike, a null id is of no account."""
    model = toxicity.trained(spark, sf_dir)
    return keeping_columns(docs, ("score", "predicted", "toxic_spans"), lambda d: toxicity.score_toxicity(d, model).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group of texts whose 5-word shingle sets are similar by 0.8 or more. Rows without an id stay; see near_copies.keep_first for rows that share one."""
    return near_copies.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without a benchmark item in their text. Null and empty texts stay; rows that share an id, or have none, are judged each by its own text."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*(F.col(f"`{c}`") for c in docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets masked in the text; n_chars, where there is one, follows. Every row stays; null texts stay null."""
    masked = keeping_columns(docs, ("secret_spans",), lambda d: secrets.scan_secrets(d, redact=True))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def set_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, texts included, with tokens, domain, posterior, rate and copies; see mixing.mix for columns with these names. Every row stays."""
    return mixing.mix(docs, mixing.labelled_domains(spark, sf_dir))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", set_rates),
]

#: Classifiers and components can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
