"""Writers of graphs and corpora; each is a projection to strings or records, written in parallel by Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import relation_type


def xml(c) -> F.Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rdf_lines(triples: DataFrame) -> DataFrame:
    """One Turtle line a triple; blanks to underscores, quotes dropped."""
    name = lambda c: F.translate(c, ' "\'', "_")
    return triples.select(F.concat(F.lit("ent:"), name("subject"), F.lit("\tkg:"), name("predicate"), F.lit("\tent:"), name("object"), F.lit(" .")).alias("value"))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, value): the elements of a GraphML file; ord puts head, nodes, edges and tail in order."""
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), xml(c), F.lit("</data>"))
    n = nodes.select(F.lit(1).alias("ord"), F.concat(F.lit('<node id="'), xml(F.col("id")), F.lit('">'), data("name", F.col("name")), data("type", F.col("type")), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2), F.concat(F.lit('<edge source="'), xml(F.col("subject")), F.lit('" target="'), xml(F.col("object")), F.lit('">'), data("predicates", F.to_json("predicates")), data("weight", F.col("weight")), F.lit("</edge>")))
    keys = "".join(f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="string"/>' for k, f in (("name", "node"), ("type", "node"), ("predicates", "edge"), ("weight", "edge")))
    ends = nodes.sparkSession.createDataFrame([(0, f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (3, "</graph></graphml>")], "ord int, value string")
    return ends.unionByName(n).union(e)


def node_rows(nodes: DataFrame) -> DataFrame:
    """Nodes for bulk import, labelled by kind."""
    return nodes.select(F.col("id").alias("id:ID"), "name", "type", F.when(F.col("type").isin("Chunk", "Document"), F.col("type")).otherwise("Entity").alias(":LABEL"))


def categorized_nodes(nodes: DataFrame) -> DataFrame:
    """(label, id, record): nodes for upload in three kinds, Chunk, Document and Entity, each as JSON with the fields of its kind that nodes have."""
    fields = {"Chunk": ("id", "source", "text", "token_count", "chunk_index", "type"), "Document": ("id", "name", "type", "description", "source", "chunk_count"), "Entity": ("id", "name", "type", "aliases", "description", "importance", "confidence")}
    label = F.when(F.col("type").isin("Chunk", "Document"), F.col("type")).otherwise("Entity")
    record = None
    for kind, names in fields.items():
        one = F.to_json(F.struct(*(c for c in names if c in nodes.columns)))
        record = F.when(F.col("label") == kind, one) if record is None else record.when(F.col("label") == kind, one)
    return nodes.withColumn("label", label).select("label", "id", record.alias("record"))


def relationship_rows(edges: DataFrame) -> DataFrame:
    """A row for each relation record of each edge."""
    r = edges.select("subject", "object", F.explode("relations").alias("r"))
    return r.select(F.col("subject").alias(":START_ID"), F.col("object").alias(":END_ID"), relation_type(F.col("r.predicate")).alias(":TYPE"), F.col("r.evidence_sentence").alias("evidence"), F.col("r.source_chunk_id").alias("chunk_id"))


def canonical_nodes(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entity records with the graph's importance, and nodes that only the graph has; the record's fields win."""
    e, n = entities.alias("e"), nodes.alias("n")
    pick = [F.coalesce(f"e.{c}", f"n.{c}").alias(c) for c in ("id", "name", "type", "description")]
    return e.join(n, F.col("e.id") == F.col("n.id"), "full").select(*pick, "n.importance")


def relationship_buckets(triples: DataFrame) -> DataFrame:
    """(subject, object, rel_type, evidence, chunk_ids, description): triples by ends and safe type, with sorted distinct evidence and chunks and the least description."""
    return triples.groupBy("subject", "object", relation_type(F.col("predicate")).alias("rel_type")).agg(F.array_sort(F.collect_set("evidence_sentence")).alias("evidence"), F.array_sort(F.collect_set("source_chunk_id")).alias("chunk_ids"), F.min("description").alias("description"))


def cytoscape_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.to_json(F.struct(F.struct("id", F.col("name").alias("label"), "type").alias("data"))).alias("value"))
    e = edges.select(F.to_json(F.struct(F.struct(F.col("subject").alias("source"), F.col("object").alias("target"), F.get("predicates", F.lit(0)).alias("label")).alias("data"))))
    return n.union(e)


def graph_records(nodes: DataFrame, edges: DataFrame, triples: DataFrame) -> DataFrame:
    """(part, value): nodes, edges and triples as JSON lines."""
    part = lambda k, df: df.select(F.lit(k).alias("part"), F.to_json(F.struct("*")).alias("value"))
    return part("node", nodes).union(part("edge", edges)).union(part("triple", triples))


def missing_ends(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples with an end that no node is."""
    ids = nodes.select("id").distinct()
    a = triples.join(ids.withColumnRenamed("id", "subject"), "subject", "left_anti")
    b = triples.join(ids.withColumnRenamed("id", "object"), "object", "left_anti")
    return a.unionByName(b).distinct()


FORMATS: dict[str, Callable] = {"rdf": lambda n, e, t: rdf_lines(t), "graphml": lambda n, e, t: graphml_lines(n, e).repartitionByRange(1, "ord").sortWithinPartitions("ord").select("value"), "cytoscape": lambda n, e, t: cytoscape_elements(n, e), "json": graph_records}


def export(nodes: DataFrame, edges: DataFrame, triples: DataFrame, path: str, formats: list[str]) -> None:
    """One folder a format under path. bulk_csv makes nodes and relationships."""
    for f in formats:
        if f == "bulk_csv":
            node_rows(nodes).write.mode("overwrite").csv(f"{path}/bulk_csv/nodes", header=True)
            relationship_rows(edges).write.mode("overwrite").csv(f"{path}/bulk_csv/relationships", header=True)
        elif f == "json":
            graph_records(nodes, edges, triples).write.mode("overwrite").partitionBy("part").text(f"{path}/json")
        elif f in FORMATS:
            FORMATS[f](nodes, edges, triples).write.mode("overwrite").text(f"{path}/{f}")
        else:
            raise ValueError(f"unknown format {f!r}; known: {', '.join([*FORMATS, 'bulk_csv'])}")
