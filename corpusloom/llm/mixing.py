"""Mixing sources to target weights with DataFrame functions: soft domain membership, rates by projected-gradient least squares.

A naive Bayes classifier, learned from the labelled table, gives each document posteriors p over domains.
Rates r >= 0 minimise, over all documents with t tokens each,
    sum_k (sum_d t p_k r - T_k)^2 / (2 S_k)  +  ridge / 2  sum_d t (r - 1)^2,    S_k = sum_d t p_k,
so that expected tokens of domain k come to its target T_k and rates stay near 1. In the metric t the
gradient is p . g + ridge (r - 1) with g_k = (sum_d t p_k r - T_k) / S_k; it needs one K-vector a round,
which, with three sums that tell when to end, is all that comes to the driver. A rate follows from its posteriors and
the K-vectors since rates were last written, which they are every EVERY rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, broadcast_if_small, cut_lineage, table

#: Share of expected tokens by domain.
TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}
RIDGE = 0.01
EVERY = 10


def words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")


def learn_classifier(labelled: DataFrame, domains: list[str], vocabulary: int = 2_000, sample: int = 4_000) -> DataFrame:
    """(w, l): log-likelihood of a word by domain, for the words that tell most, from a bounded sample of each domain's rows.

    labelled: doc_id, text, domain. At most ``vocabulary`` rows. Counts of a text's repeated words are
    damped by counting documents.
    """
    some = bounded_sample(labelled.where(F.col("domain").isin(domains)), "doc_id", sample, "domain", "classifier")
    tokens = some.select("domain", F.explode(F.array_distinct(words(F.col("text")))).alias("w")).where("w <> ''")
    counts = tokens.groupBy("w").agg(*(F.sum((F.col("domain") == d).cast("double")).alias(f"n{k}") for k, d in enumerate(domains)))
    sizes = some.groupBy("domain").count().collect()
    size = {r["domain"]: float(r["count"]) for r in sizes}
    l = [F.log((F.col(f"n{k}") + 0.5) / (size.get(d, 0.0) + 1.0)) for k, d in enumerate(domains)]
    total = sum((F.col(f"n{k}") for k in range(len(domains))), F.lit(0.0))
    spread = F.greatest(*l) - F.least(*l) if len(l) > 1 else F.lit(0.0)
    return counts.withColumn("gain", total * spread).orderBy(F.desc("gain"), "w").limit(vocabulary).select("w", F.array(*l).alias("l"))


def posteriors(docs: DataFrame, classifier: DataFrame, domains: list[str], sharpness: float = 30.0, text_col: str = "text") -> DataFrame:
    """(doc_id, source, text_hash, tokens, p, copies): a row for the rows of docs that agree in id, source and text, and their number.

    p are posteriors under equal priors; evidence of more than ``sharpness`` known words is scaled down
    to as many, so that long texts keep some doubt. A text without known words has equal posteriors.
    """
    k = range(len(domains))
    rows = docs.select("doc_id", "source", F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("ws"))
    # a text's first row stands for the text itself, so that texts without known words stay and repeats are counted
    each = rows.select("doc_id", "source", "text_hash", F.explode(F.concat("ws", F.array(F.lit(" ")))).alias("w"))
    listed = broadcast_if_small(classifier.select("w", *(F.col("l")[i].alias(f"l{i}") for i in k)), classifier.count() * (len(domains) + 1))
    met = each.join(listed, "w", "left")
    sums = met.groupBy("doc_id", "source", "text_hash").agg(
        F.sum((F.col("w") == " ").cast("long")).alias("copies"), F.sum(((F.col("w") != " ") & (F.col("w") != "")).cast("long")).alias("tokens"),
        F.count("l0").alias("known"), *(F.sum(f"l{i}").alias(f"s{i}") for i in k),
    )
    scale = F.least(F.lit(1.0), sharpness * F.col("copies") / F.greatest("known", F.lit(1))) / F.col("copies")
    logits = sums.select("doc_id", "source", "text_hash", "copies", (F.col("tokens") / F.col("copies")).cast("long").alias("tokens"), *((F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * scale).alias(f"z{i}") for i in k))
    top = F.greatest(*(F.col(f"z{i}") for i in k)) if len(domains) > 1 else F.col("z0")
    odds = logits.select("*", *(F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in k))
    total = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return odds.select("doc_id", "source", "text_hash", "tokens", F.array(*(F.round(F.col(f"e{i}") / total, 9) for i in k)).alias("p"), "copies")


def stepped(y: Column, g: list[Column], ridge: float, step: float) -> Column:
    """A document's rate after a step from the point y, with the gradient's K-vector g."""
    dot = sum((F.col("p")[i] * x for i, x in enumerate(g)), F.lit(0.0))
    return F.greatest(F.lit(0.0), y - step * (dot + ridge * (y - 1)))


def replayed(rounds: list[list[float]], ridge: float, step: float) -> Column:
    """(rate, y) after rounds, each a K-vector and a momentum, from the columns rate and y before them."""
    start = F.struct(F.col("rate").alias("rate"), F.col("y").alias("y"))
    if not rounds:
        return start

    def after(s: Column, r: Column) -> Column:
        new = stepped(s["y"], [r[i] for i in range(len(rounds[0]) - 1)], ridge, step)
        return F.struct(new.alias("rate"), (new + r[len(rounds[0]) - 1] * (new - s["rate"])).alias("y"))

    return F.aggregate(F.array(*(F.array(*map(F.lit, r)) for r in rounds)), start, after)


def fit_rates(members: DataFrame, weights: list[float], ridge: float = RIDGE, step: float | None = None, max_rounds: int = 1_000, tolerance: float = 1e-6) -> DataFrame:
    """members (tokens, p, copies) with their rate. Raises if rounds run out.

    Members with equal posteriors have equal rates, so rounds go over the distinct ones with their tokens, one
    aggregate a round. Steps start from a point ahead of the rates (Nesterov), which begins anew at them when a step
    turns back. The cost is convex by ridge at least, so rates are within tolerance / (step ridge) of the optimum, by
    the root of their mean square over tokens, when a step moves them by the tolerance; that is where rounds end.
    """
    k = range(len(weights))
    classes = cut_lineage(members.groupBy("p").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")))
    sizes = classes.agg(F.count("*").alias("n"), F.sum("t").alias("t"), *(F.sum(F.col("t") * F.col("p")[i]).alias(f"s{i}") for i in k)).first()
    total = float(sizes["t"] or 0)
    if not total:
        return members.withColumn("rate", F.lit(1.0))
    sums = [float(sizes[f"s{i}"]) for i in k]  # of tokens at the rates, which are 1 at first
    size = [max(s, 1.0) for s in sums]
    share = sum(weights) or 1.0
    goal = [total * w / share for w in weights]
    step = step or 1 / (1 + ridge)
    most = (1 - math.sqrt(step * ridge)) / (1 + math.sqrt(step * ridge))
    state, history, ahead, inertia, moved = classes.select("p", "t", F.lit(1.0).alias("rate"), F.lit(1.0).alias("y")), [], sums, 1.0, None
    for _ in range(max_rounds):
        g = [round((ahead[i] - goal[i]) / size[i], 9) for i in k]
        point = state.select("p", "t", replayed(history, ridge, step).alias("s")).select("p", "t", "s.*")
        new = point.withColumn("new", stepped(F.col("y"), list(map(F.lit, g)), ridge, step))
        now = new.agg(
            F.sum(F.col("t") * (F.col("y") - F.col("new")) * (F.col("new") - F.col("rate"))).alias("back"), F.sum(F.col("t") * (F.col("y") - F.col("new")) ** 2).alias("moved"), F.sum(F.col("t") * F.col("new") ** 2).alias("square"),
            *(F.sum(F.col("t") * F.col("p")[i] * F.col("new")).alias(f"a{i}") for i in k),
        ).first()
        moved = math.sqrt(now["moved"] / max(now["square"], 1e-300))
        if moved < tolerance:
            return members.join(broadcast_if_small(new.select("p", F.col("new").alias("rate")), sizes["n"] * (len(weights) + 1)), "p")
        before, inertia = 1.0 if now["back"] > 0 else inertia, (1 + math.sqrt(1 + 4 * (1.0 if now["back"] > 0 else inertia) ** 2)) / 2
        momentum = min((before - 1) / inertia, most)
        last, sums = sums, [float(now[f"a{i}"]) for i in k]
        ahead = [a + momentum * (a - b) for a, b in zip(sums, last)]
        history.append([*g, momentum])
        if len(history) == EVERY:
            state, history = cut_lineage(state.select("p", "t", replayed(history, ridge, step).alias("s")).select("p", "t", "s.*")), []
    raise RuntimeError(f"rates still change by {moved} after {max_rounds} rounds")


#: Columns that mix() adds.
ADDED = ("tokens", "domain", "posterior", "rate", "copies")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, text_col: str = "text", ridge: float = RIDGE) -> DataFrame:
    """docs with tokens, domain, posterior, rate and copies, a row for each row of docs; columns of docs with these names, in
    whatever case, get _in at the end, again if that name is taken.

    rate is the document's nonnegative weight; copies rounds it up or down by the hash of id and text, so
    that sums keep the rate. labelled has doc_id, text and domain; domains without targets aren't used. Among
    equal posteriors the domain that is first in the alphabet is named. Null and empty texts have no tokens and
    equal posteriors; rows that repeat id, source and text are weighed alike, and each counts; a null id or
    source is carried; an empty table gives an empty table. No document is held as a whole, however long.
    """
    targets = targets or TARGETS
    domains = sorted(targets)
    members = cut_lineage(posteriors(docs, cut_lineage(learn_classifier(labelled, domains)), domains, text_col=text_col))
    rated = fit_rates(members, [float(targets[d]) for d in domains], ridge).withColumn("rate", F.round("rate", 6))
    uniform = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (uniform < F.col("rate") - F.floor("rate")).cast("long")).alias("copies")
    best = F.array_max(F.col("p"))
    domain = F.element_at(F.array(*map(F.lit, domains)), F.array_position("p", best).cast("int")).alias("domain")
    taken = {c.lower() for c in (*docs.columns, *ADDED)}

    def free(name: str) -> str:
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        return name

    names = [free(c) if c.lower() in ADDED else c for c in docs.columns]
    i, s, h, own_h = map(free, ("__id", "__source", "__hash", "__text"))
    rated = rated.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("text_hash").alias(h), "tokens", domain, F.round(best, 6).alias("posterior"), "rate", copies)
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), F.xxhash64(text_col).alias(own_h))
    same = own["doc_id"].eqNullSafe(rated[i]) & own["source"].eqNullSafe(rated[s]) & (own[own_h] == rated[h])
    return own.join(rated, same).drop(i, s, h, own_h)


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the labelled table with their texts and languages, read before any other stage changed them."""
    labels = table(spark, sf_dir, "labels").select("doc_id").where("doc_id is not null").distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("domain"))
    few = bounded_sample(labels, "doc_id", 20_000)
    return docs.join(F.broadcast(few), "doc_id")  # at most about 20,000 ids


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rate for the target weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, labelled_domains(spark, sf_dir)).select("doc_id", "source", *ADDED)
