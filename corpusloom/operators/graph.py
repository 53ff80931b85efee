"""Property graphs as tables of nodes and edges: building, merging, reading, analysing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, cut

STRUCTURAL = ("part_of", "next", "mentions", "appears_in")


def build_nodes(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """The last entity of each id (by ord), and nodes of type ENTITY for ends of triples that no entity has."""
    last = entities.groupBy("id").agg(F.max_by(F.struct("name", "type", "description"), "ord").alias("e")).select("id", "e.*")
    ends = triples.select(F.col("subject").alias("id")).union(triples.select("object")).where("id is not null").distinct().join(last.select("id"), "id", "left_anti")
    return last.unionByName(ends.select("id", F.col("id").alias("name"), F.lit("ENTITY").alias("type"), F.lit(None).cast("string").alias("description")))


def build_edges(triples: DataFrame) -> DataFrame:
    """One edge for each (subject, object): distinct predicates in order of ord, their number as weight, evidence, chunks and relation records."""
    one = F.struct("ord", "predicate", "evidence_sentence", "source_chunk_id", "description")
    grouped = triples.groupBy("subject", "object").agg(F.array_sort(F.collect_list(one)).alias("r"))
    get = lambda field: F.array_distinct(F.array_compact(F.transform("r", lambda x: x[field])))
    return grouped.select("subject", "object", get("predicate").alias("predicates"), F.size(get("predicate")).alias("weight"), get("evidence_sentence").alias("source_texts"), get("source_chunk_id").alias("source_chunk_ids"), F.transform("r", lambda x: x.dropFields("ord")).alias("relations"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform("r", lambda x: x["description"]), lambda d: d.isNotNull() & (d != ""))), -1).alias("description"))


def structural_violations(triples: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Triples of structural predicates (rules: predicate, domain, range) with missing ends or ends of other types; the type Entity stands for all but Chunk and Document."""
    t = triples.join(rules, "predicate")  # a schema's predicates: broadcast by their size, if it is small
    for end, want in (("subject", "domain"), ("object", "range")):
        types = nodes.select(F.col("id").alias(end), F.col("type").alias(f"{end}_type"))
        t = t.join(types, end, "left")
    bad = lambda have, want: F.when(F.col(have).isNull(), "missing").when(F.col(want) == "Entity", F.when(F.col(have).isin("Chunk", "Document"), "type")).when(F.col(have) != F.col(want), "type")
    return t.withColumn("subject_fault", bad("subject_type", "domain")).withColumn("object_fault", bad("object_type", "range")).where("subject_fault is not null or object_fault is not null").select("subject", "predicate", "object", "subject_fault", "object_fault")


def schema_misses(nodes: DataFrame, triples: DataFrame, types: list[str], predicates: list[str]) -> DataFrame:
    """(kind, label, n): node types (letters' case aside) and predicates that the schema hasn't."""
    known = [t.upper() for t in types] + ["DOCUMENT", "CHUNK"]
    a = nodes.where(~F.upper("type").isin(known)).groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), "label", "n")
    b = triples.where(~F.col("predicate").isin(predicates)).groupBy(F.col("predicate").alias("label")).agg(F.count("*").alias("n")).select(F.lit("predicate"), "label", "n")
    return a.union(b)


def merge_graphs(old_nodes: DataFrame, new_nodes: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New attributes override where they aren't null; edges' lists are united, old first; an old description stays."""
    cols = [c for c in old_nodes.columns if c != "id"]
    o, n = old_nodes.alias("o"), new_nodes.alias("n")
    nodes = o.join(n, F.col("o.id") == F.col("n.id"), "full").select(F.coalesce("n.id", "o.id").alias("id"), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in cols))
    o, n = old_edges.alias("o"), new_edges.alias("n")
    on = (F.col("o.subject") == F.col("n.subject")) & (F.col("o.object") == F.col("n.object"))
    unite = lambda c: F.array_union(F.coalesce(f"o.{c}", F.array().cast("array<string>")), F.coalesce(f"n.{c}", F.array().cast("array<string>"))).alias(c)
    edges = o.join(n, on, "full").select(F.coalesce("o.subject", "n.subject").alias("subject"), F.coalesce("o.object", "n.object").alias("object"), unite("predicates"), unite("source_texts"), unite("source_chunk_ids"), F.coalesce("o.description", "n.description").alias("description"))
    return nodes, edges.withColumn("weight", F.size("predicates"))


def replace_documents(nodes: DataFrame, edges: DataFrame, relations: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph without documents (doc_id): their chunks go, relations (subject, predicate, object, chunk_ids) lose those chunks and go if none is left, entities go that no chunk mentions any more.

    nodes: id, type, parent_doc_id (of chunks). edges: subject, predicate, object.
    """
    gone_chunks = nodes.where("type = 'Chunk'").join(doc_ids.select(F.col("doc_id").alias("parent_doc_id")), "parent_doc_id", "left_semi").select("id")
    gone = gone_chunks.union(doc_ids.select(F.col("doc_id").alias("id"))).distinct()
    kept = relations.withColumn("c", F.explode("chunk_ids")).join(gone_chunks.select(F.col("id").alias("c")), "c", "left_anti").groupBy("subject", "predicate", "object").agg(F.array_sort(F.collect_set("c")).alias("chunk_ids"))
    e = edges.join(gone.select(F.col("id").alias("subject")), "subject", "left_anti").join(gone.select(F.col("id").alias("object")), "object", "left_anti")
    mentioned = e.where("predicate = 'appears_in'").select(F.col("subject").alias("id")).distinct()
    left = nodes.join(gone, "id", "left_anti")
    return left.where("type in ('Chunk', 'Document')").unionByName(left.where("type not in ('Chunk', 'Document')").join(mentioned, "id", "left_semi")), e, kept


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every node, isolated ones included."""
    out = edges.groupBy(F.col("subject").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("object").alias("id")).agg(F.count("*").alias("in_degree"))
    return nodes.select("id").join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = connected_components(edges, "subject", "object")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, max_rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """(id, importance): weighted PageRank, rounded at the end; what nodes without edges out hold is spread evenly. A round is one join and one aggregate."""
    nodes = cut(nodes.select("id").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("importance", F.lit(0.0))
    total = edges.groupBy("subject").agg(F.sum("weight").alias("total"))
    links = cut(edges.join(total, "subject").select("subject", "object", (F.col("weight") / F.col("total")).alias("share")))
    ends = cut(nodes.join(total.select(F.col("subject").alias("id")), "id", "left_anti"))
    rank = nodes.withColumn("r", F.lit(1.0 / n))
    for _ in range(max_rounds):
        lost = rank.join(ends, "id", "left_semi").agg(F.sum("r")).first()[0] or 0.0
        moved = links.join(rank.withColumnRenamed("id", "subject"), "subject").groupBy("object").agg(F.sum(F.col("r") * F.col("share")).alias("m"))
        base = (1 - damping) / n + damping * lost / n
        new = cut(rank.join(moved.withColumnRenamed("object", "id"), "id", "left").select("id", (F.lit(base) + damping * F.coalesce("m", F.lit(0.0))).alias("r"), F.col("r").alias("old")))
        error = new.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0]
        rank = new.drop("old")
        if error < n * tolerance:
            break
    return rank.select("id", F.round("r", 6).alias("importance"))


def strong_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component): nodes without an edge in or out among those left are their own; the rest are coloured forward by the first node in hashed order that reaches them, and what reaches a colour's root within the colour is a component, named by its least id.

    A colour yields one component a round; in hashed order a chain of components ends in about as many rounds as its length has digits in base 2, whatever their ids.
    """
    left = cut(nodes.select("id").distinct())
    links = cut(edges.select("subject", "object").where("subject <> object").distinct())
    done = None
    for _ in range(max_rounds):
        while True:
            inner = links.select(F.col("object").alias("id")).intersect(links.select(F.col("subject").alias("id")))
            single = cut(left.join(inner, "id", "left_anti"))
            if not single.limit(1).count():
                break
            done = single.select("id", F.col("id").alias("component")) if done is None else done.union(single.select("id", "id"))
            left = cut(left.join(single, "id", "left_anti"))
            links = cut(links.join(left.select(F.col("id").alias("subject")), "subject", "left_semi").join(left.select(F.col("id").alias("object")), "object", "left_semi"))
        if not left.limit(1).count():
            return done if done is not None else nodes.select("id", F.col("id").alias("component"))
        color = spread(left.select("id", F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("root")).alias("color")), links, "subject", "object")
        c1, c2 = color.select(F.col("id").alias("subject"), F.col("color").alias("x")), color.select(F.col("id").alias("object"), F.col("color").alias("y"))
        same = cut(links.join(c1, "subject").join(c2, "object").where("x = y").select("subject", "object"))
        back = reach(color.where("id = color.root").select("id"), same, "object", "subject")
        held = color.join(back, "id", "left_semi").select("id", F.col("color.root").alias("root"))
        found = cut(held.join(held.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component"))
        done = found if done is None else done.union(found)
        left = cut(left.join(found, "id", "left_anti"))
        links = cut(links.join(left.select(F.col("id").alias("subject")), "subject", "left_semi").join(left.select(F.col("id").alias("object")), "object", "left_semi"))
    if left.limit(1).count():
        raise RuntimeError(f"strong components are still left after {max_rounds} rounds")
    return done


def spread(color: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """Least colours along links until nothing changes."""
    color = cut(color)
    while True:
        near = links.join(color.select(F.col("id").alias(a), F.col("color").alias("c")), a).groupBy(F.col(b).alias("id")).agg(F.min("c").alias("c"))
        new = cut(color.join(near, "id", "left").select("id", F.least("color", "c").alias("color"), (F.col("c") < F.col("color")).alias("changed")))
        color = new.drop("changed")
        if not new.where("changed").limit(1).count():
            return color


def reach(roots: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    seen = front = cut(roots)
    while True:
        front = cut(links.join(front.select(F.col("id").alias(a)), a, "left_semi").select(F.col(b).alias("id")).distinct().join(seen, "id", "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = cut(seen.union(front))


def k_hop(sources: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(source, id, hops): nodes within ``hops`` steps along edges, themselves left out, at their least distance."""
    links = edges.select("subject", "object").distinct()
    front = sources.select(F.col("id").alias("source"), "id")
    seen = front.withColumn("hops", F.lit(0))
    for h in range(1, hops + 1):
        step = front.join(links, front["id"] == links["subject"]).select("source", F.col("object").alias("id")).distinct()
        front = cut(step.join(seen.select("source", "id"), ["source", "id"], "left_anti"))
        seen = seen.union(front.withColumn("hops", F.lit(h)))
    return seen.where("hops > 0")


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, coefficient) of a directed graph: directed triangles through a node over the possible ones, 2 (t (t - 1) - 2 r) for total degree t and r edges both ways."""
    e = edges.select("subject", "object").where("subject <> object").distinct()
    both = e.union(e.select(F.col("object").alias("subject"), F.col("subject").alias("object")))
    pair = both.groupBy(F.col("subject").alias("u"), F.col("object").alias("v")).agg(F.count("*").alias("w"))
    deg = pair.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("t"), F.sum((F.col("w") == 2).cast("long")).alias("r"), F.count("*").alias("d"))
    # each triangle once, from its node of the least degree
    d = deg.select("id", "d")
    up = pair.join(d.select(F.col("id").alias("u"), F.col("d").alias("du")), "u").join(d.select(F.col("id").alias("v"), F.col("d").alias("dv")), "v").where("du < dv or (du = dv and u < v)").select("u", "v", "w")
    two = up.join(up.select("u", F.col("v").alias("x"), F.col("w").alias("wx")), "u").where("v <> x")
    tri = two.join(pair.select(F.col("u").alias("v"), F.col("v").alias("x"), F.col("w").alias("wvx")), ["v", "x"]).where("v < x").withColumn("m", F.col("w") * F.col("wx") * F.col("wvx"))
    per = tri.select(F.explode(F.array("u", "v", "x")).alias("id"), "m").groupBy("id").agg(F.sum("m").alias("m"))
    possible = 2 * (F.col("t") * (F.col("t") - 1) - 2 * F.col("r"))
    both = nodes.select("id").join(deg, "id", "left").join(per, "id", "left")
    return both.select("id", F.when(possible > 0, 2.0 * F.coalesce("m", F.lit(0)) / possible).otherwise(0.0).alias("coefficient"))


class GraphStore:
    """Lookups in a graph held as tables; each returns a DataFrame."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def get_node(self, node_id) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def get_edge(self, subject, object_) -> DataFrame:
        return self.edges.where((F.col("subject") == subject) & (F.col("object") == object_))

    def successors(self, node_id) -> DataFrame:
        return self.edges.where(F.col("subject") == node_id).select(F.col("object").alias("id")).distinct()

    def predecessors(self, node_id) -> DataFrame:
        return self.edges.where(F.col("object") == node_id).select(F.col("subject").alias("id")).distinct()

    def neighbors(self, node_id) -> DataFrame:
        return self.successors(node_id).union(self.predecessors(node_id)).distinct()

    def search(self, text: str, limit: int = 50) -> DataFrame:
        """Nodes whose id or name holds the text, letters' case aside; the first by id."""
        has = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
        return self.nodes.where(has("id") | has("name")).orderBy("id").limit(limit)

    def stats(self) -> DataFrame:
        """(metric, label, value)."""
        n, e = self.nodes.agg(F.count("*").alias("n")), self.edges.agg(F.count("*").alias("e"))
        one = n.join(e, F.lit(True)).select(F.expr("stack(4, 'nodes', cast(n as double), 'edges', cast(e as double), 'density', e / greatest(n * (n - 1), 1), 'average_degree', 2 * e / greatest(n, 1)) as (metric, value)")).select("metric", F.lit("").alias("label"), "value")
        labels = self.nodes.groupBy("type").count().select(F.lit("label"), "type", F.col("count").cast("double"))
        relations = self.edges.select(F.explode("predicates").alias("p")).groupBy("p").count().select(F.lit("relation"), "p", F.col("count").cast("double"))
        return one.union(labels).union(relations)


def reversed_edges(edges: DataFrame, kinds: Column | None = None) -> DataFrame:
    """Typed edges (src_type, rel, dst_type, src, dst) with their reverses, named rev_<rel>."""
    back = edges.select(F.col("dst_type").alias("src_type"), F.concat(F.lit("rev_"), "rel").alias("rel"), F.col("src_type").alias("dst_type"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.unionByName(back)


def dense_index(ids: DataFrame) -> DataFrame:
    """(type, id, index): positions from 0 in order of id within a type."""
    return ids.select("type", "id").distinct().withColumn("index", F.row_number().over(Window.partitionBy("type").orderBy("id")) - 1)


def label_graph(labels: DataFrame) -> DataFrame:
    """(src, rel, dst) of dotted labels: child_of each parent, in_domain of the first part."""
    parts = labels.select(F.split("label", r"\.").alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    name = lambda k: F.array_join(F.slice("p", 1, k), ".")
    child = parts.where("k > 1").select(name(F.col("k")).alias("src"), F.lit("child_of").alias("rel"), name(F.col("k") - 1).alias("dst"))
    domain = parts.where("k = size(p) and k > 1").select(name(F.col("k")).alias("src"), F.lit("in_domain").alias("rel"), F.get("p", F.lit(0)).alias("dst"))
    return child.union(domain).distinct()
