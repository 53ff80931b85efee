"""Graph writers: one interface of five merge verbs, for graphs that are built piece by piece; tables here, other stores by subclass."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import cut

NODE = "id string, name string, type string, description string, source_chunk_ids array<string>"
EDGE = "subject string, object string, predicates array<string>, weight long, source_chunk_ids array<string>"


class GraphWriter(ABC):
    """What a build writes to. Each verb takes a table, merges it by key and may be called again with the same rows without harm, but for the weights of edges."""

    @abstractmethod
    def merge_documents(self, docs: DataFrame) -> None:
        """docs: doc_id, name."""

    @abstractmethod
    def merge_chunks(self, chunks: DataFrame) -> None:
        """chunks: chunk_id, parent_doc_id; a part_of edge for each."""

    @abstractmethod
    def merge_entities(self, entities: DataFrame) -> None:
        """entities: id, name, type, description, source_chunk_ids. Later names, types and descriptions override where they aren't null; chunks are united."""

    @abstractmethod
    def merge_edges(self, triples: DataFrame) -> None:
        """triples: subject, predicate, object, source_chunk_id. Predicates and chunks are united, weights added."""

    @abstractmethod
    def merge_structural_edges(self, triples: DataFrame) -> None:
        """triples: subject, predicate, object; they have weight one, however often they come."""

    @abstractmethod
    def stats(self) -> DataFrame:
        """(kind, label, n): nodes by type, edges by predicate."""


class TableGraphWriter(GraphWriter):
    """A graph held as two tables, written to the shared checkpoint folder after each merge."""

    def __init__(self, spark: SparkSession):
        self.nodes, self.edges = spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE)

    def _nodes(self, new: DataFrame) -> None:
        both = self.nodes.withColumn("o", F.lit(0)).unionByName(new.withColumn("o", F.lit(1)))
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("o", c))).alias(c)
        chunks = F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_chunk_ids")))).alias("source_chunk_ids")
        self.nodes = cut(both.groupBy("id").agg(last("name"), last("type"), last("description"), chunks))

    def _edges(self, new: DataFrame, add: bool) -> None:
        both = self.edges.unionByName(new)
        weight = (F.sum("weight") if add else F.max("weight")).alias("weight")
        unite = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
        self.edges = cut(both.groupBy("subject", "object").agg(unite("predicates"), weight, unite("source_chunk_ids")))

    def merge_documents(self, docs: DataFrame) -> None:
        self._nodes(docs.select(F.col("doc_id").cast("string").alias("id"), "name", F.lit("Document").alias("type"), F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("source_chunk_ids")))

    def merge_chunks(self, chunks: DataFrame) -> None:
        self._nodes(chunks.select(F.col("chunk_id").alias("id"), F.col("chunk_id").alias("name"), F.lit("Chunk").alias("type"), F.lit(None).cast("string").alias("description"), F.array("chunk_id").alias("source_chunk_ids")))
        self.merge_structural_edges(chunks.select(F.col("chunk_id").alias("subject"), F.lit("part_of").alias("predicate"), F.col("parent_doc_id").cast("string").alias("object")))

    def merge_entities(self, entities: DataFrame) -> None:
        self._nodes(entities.select("id", "name", "type", "description", F.coalesce("source_chunk_ids", F.array().cast("array<string>")).alias("source_chunk_ids")))

    def merge_edges(self, triples: DataFrame) -> None:
        chunk = F.array_compact(F.array("source_chunk_id"))
        self._edges(triples.groupBy("subject", "object").agg(F.collect_set("predicate").alias("predicates"), F.count("*").alias("weight"), F.array_distinct(F.flatten(F.collect_set(chunk))).alias("source_chunk_ids")), True)

    def merge_structural_edges(self, triples: DataFrame) -> None:
        self._edges(triples.select("subject", "object", F.array("predicate").alias("predicates"), F.lit(1).cast("long").alias("weight"), F.array().cast("array<string>").alias("source_chunk_ids")), False)

    def stats(self) -> DataFrame:
        n = self.nodes.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "label", "n")
        return n.union(self.edges.select(F.explode("predicates").alias("p")).groupBy("p").agg(F.count("*").alias("n")).select(F.lit("edge"), "p", "n"))
