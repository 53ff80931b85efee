"""Scores of a graph's data: entities (id, name, type, aliases, description) and triples (subject, predicate, object). Each scorer is one aggregate that gives one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import weak_components

GENERIC = ("ENTITY", "UNKNOWN", "NAMED_ENTITY", "CONCEPT")


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def no_list(c: str) -> Column:
    return F.col(c).isNull() | (F.size(c) == 0)


def share(condition: Column) -> Column:
    """Share of rows; null over no rows."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def completeness(entities: DataFrame) -> DataFrame:
    """Mean share of names, types and aliases that are there; 0 without entities."""
    return entities.agg(F.round(F.coalesce((share(~blank("name")) + share(~blank("type")) + share(~no_list("aliases"))) / 3, F.lit(0.0)), 6).alias("completeness"))


def missing_information(entities: DataFrame) -> DataFrame:
    return entities.agg(F.round(F.coalesce(share(blank("type") | no_list("aliases") | (F.col("type") == "UNKNOWN")), F.lit(1.0)), 6).alias("missing_information"))


def labeling_quality(entities: DataFrame) -> DataFrame:
    return entities.agg(F.round(F.coalesce(share(~blank("type") & ~F.upper("type").isin(*GENERIC)), F.lit(0.0)), 6).alias("labeling_quality"))


def format_errors(triples: DataFrame) -> DataFrame:
    return triples.agg(F.round(F.coalesce(share(blank("subject") | blank("predicate") | blank("object")), F.lit(0.0)), 6).alias("format_errors"))


def consistency(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Mean of the shares of triples with known ends and of entities with a type; 1 without triples."""
    ids = entities.select("id").distinct()
    s, o = ids.select(F.col("id").alias("subject"), F.lit(1).alias("s")), ids.select(F.col("id").alias("object"), F.lit(1).alias("o"))
    ends = triples.join(s, "subject", "left").join(o, "object", "left").agg(share(F.col("s").isNotNull() & F.col("o").isNotNull()).alias("x"))
    types = entities.agg(share(~(blank("type") | (F.col("type") == "UNKNOWN"))).alias("y"))
    return ends.join(types, F.lit(True)).select(F.round(F.when(F.col("x").isNull(), 1.0).otherwise((F.col("x") + F.coalesce("y", F.lit(1.0))) / 2), 6).alias("consistency"))


def duplication_level(entities: DataFrame, triples: DataFrame) -> DataFrame:
    e = entities.groupBy(F.lower("name").alias("k")).agg(F.count("*").alias("n")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).select((1 - F.col("kinds") / F.col("n")).alias("entity_duplication"))
    t = triples.groupBy("subject", "predicate", "object").agg(F.count("*").alias("n")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).select((1 - F.col("kinds") / F.col("n")).alias("triple_duplication"))
    return e.join(t, F.lit(True)).select(*(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("entity_duplication", "triple_duplication")), F.round(F.coalesce((F.col("entity_duplication") + F.col("triple_duplication")) / 2, F.lit(0.0)), 6).alias("duplication_level"))


def reusability(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """A fifth each for having nodes, having edges, the largest weak component's share, specific types, descriptions."""
    comp = weak_components(entities, triples).groupBy("component").count().agg(F.max("count").alias("most"))
    e = entities.agg(F.count("*").alias("n"), share(~F.coalesce("type", F.lit("UNKNOWN")).isin("ENTITY", "UNKNOWN", "Chunk", "Document")).alias("typed"), share(~blank("description")).alias("described"))
    m = triples.agg(F.count("*").alias("m"))
    one = e.join(m, F.lit(True)).join(comp, F.lit(True))
    parts = (F.col("n") > 0).cast("int") + (F.col("m") > 0).cast("int") + F.coalesce(F.col("most") / F.col("n"), F.lit(0.0)) + F.coalesce("typed", F.lit(0.0)) + F.coalesce("described", F.lit(0.0))
    return one.select(F.round(0.2 * parts, 6).alias("reusability"))


def schema_completeness(entities: DataFrame, triples: DataFrame, types: list[str], predicates: list[str]) -> DataFrame:
    """(kind, label, present) of the schema's types and predicates."""
    spark = entities.sparkSession
    schema = spark.createDataFrame([("type", t) for t in types] + [("predicate", p) for p in predicates], "kind string, label string")
    found = entities.select(F.lit("type").alias("kind"), F.upper("type").alias("key")).union(triples.select(F.lit("predicate"), F.upper("predicate"))).distinct().withColumn("present", F.lit(True))
    return schema.withColumn("key", F.upper("label")).join(found, ["kind", "key"], "left").select("kind", "label", F.coalesce("present", F.lit(False)).alias("present"))


def syntactic_accuracy(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Names of plain characters and predicates in snake case, as a share of both."""
    e = entities.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("name").rlike(r"^[a-zA-Z0-9_\-.]+$"), F.lit(False))).alias("bad_ids"))
    t = triples.agg(F.count("*").alias("m"), F.count_if(~F.coalesce(F.col("predicate").rlike(r"^[a-z][a-z0-9_]*$"), F.lit(False))).alias("bad_predicates"))
    return e.join(t, F.lit(True)).select("bad_ids", "bad_predicates", F.round(1 - (F.col("bad_ids") + F.col("bad_predicates")) / F.greatest(F.col("n") + F.col("m"), F.lit(1)), 6).alias("syntactic_accuracy"))


def overall(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """All scores and the mean of the seven that count."""
    one = completeness(entities)
    for df in (consistency(entities, triples), labeling_quality(entities), reusability(entities, triples), duplication_level(entities, triples), format_errors(triples), missing_information(entities)):
        one = one.join(df, F.lit(True))
    good = F.col("completeness") + F.col("consistency") + F.col("labeling_quality") + F.col("reusability")
    bad = F.col("duplication_level") + F.col("format_errors") + F.col("missing_information")
    return one.withColumn("overall_score", F.round((good + 3 - bad) / 7, 6))


def sample_facts(triples: DataFrame, n: int = 50, seed: str = "42") -> DataFrame:
    """n triples for a judge, the same at each run."""
    return triples.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "subject", "predicate", "object"), 256)).limit(n)


def negatives(triples: DataFrame, seed: str = "42") -> DataFrame:
    """A false triple for each true one: the object of the next triple, in hashed order, of the predicate, where that makes no known triple."""
    from pyspark.sql import Window

    t = triples.select("subject", "predicate", "object").distinct()
    by = Window.partitionBy("predicate").orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "subject", "object"), 256), "subject", "object")
    moved = t.withColumn("fake", F.lead("object").over(by)).where("fake is not null and fake <> object").select("subject", "predicate", F.col("fake").alias("object"))
    return moved.join(t, ["subject", "predicate", "object"], "left_anti").distinct()


def confusion(judged: DataFrame, truth: str = "truth", said: str = "said") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy of two boolean columns; ratios of nothing are 0."""
    t, s = F.col(truth), F.col(said)
    c = judged.agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(div(2 * p * r, p + r), 4).alias("f1"), F.round(div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 4).alias("accuracy"))
