"""SimHash near-dedup by similarity: Golay keys of word fingerprints propose, sets of 5-word shingles verify.

A text's 128-bit SimHash is taken over its distinct words: an edited word changes five shingles but one word,
so texts whose shingle sets have a Jaccard coefficient of 0.8 differ in few of its bits. Four segments of
23 bits are decoded to nearby codewords of the Golay code (see simhash_dedup), one or six each; a key is a
codeword of one segment beside one of another's, so texts meet where two segments have two errors at most,
which up to eight errors in the four is certain, and likely with more. Fingerprints of a bucket within RADIUS bits
make clusters. In each cluster exact shingle sets are compared, first with the
cluster's first text, then, of texts that this hasn't joined, with the whole cluster, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .common import append_columns, broadcast_if_small, cut_lineage, slices
from .simhash_dedup import error_table, golay_keys, syndromes

WIDTH = 5
SIMILARITY = 0.8
#: Of 128 bits; texts that share no words differ in about 62.
RADIUS = 24
#: A bucket of more texts than this is one cluster without comparison: more is verified, nothing is lost.
BUCKET = 4096
#: Asked sets of a block, their shingles, and sets that one task compares a block with.
BLOCK, BLOCK_HASHES, PART = 256, 300_000, 4096


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 (seed 42) of the words of a text, in its order; A-Z count as a-z."""
    import xxhash

    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, 42) for w in words], np.uint64)


def shingle_set(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of runs of ``width`` words, sorted; fewer words are one run, no words none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    width = min(width, n)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(0xD1342543DE82EF95) + words[k : n - width + 1 + k]
    return np.unique(mixed(total).view(np.int64))


def word_print(words: np.ndarray) -> tuple[int, int]:
    """128-bit SimHash of the distinct words, as two signed halves."""
    own = np.unique(words)
    votes = np.zeros(128, np.int64)
    for at in range(0, len(own), 4096):
        part = own[at : at + 4096]
        both = np.stack([part, mixed(part + np.uint64(0x9E3779B97F4A7C15))], 1)
        votes += np.unpackbits(both.view(np.uint8).reshape(len(part), 16), axis=1).sum(0, dtype=np.int64)
    halves = np.packbits(2 * votes > len(own)).view(np.int64)
    return int(halves[0]), int(halves[1])


def sketches(docs: DataFrame, width: int, text_col: str) -> DataFrame:
    """(doc_id, t, f0, f1, digest): t hashes the text, digest the shingle set."""

    def start():
        def apply(texts: list) -> list:
            f0, f1, digests = [], [], []
            for text in texts:
                words = word_hashes(text)
                a, b = word_print(words)
                f0.append(a)
                f1.append(b)
                digests.append(hashlib.md5(shingle_set(words, width).tobytes()).digest())
            return [f0, f1, digests]

        return apply

    rows = docs.select("doc_id", F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    fields = [T.StructField("f0", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("digest", T.BinaryType())]
    return append_columns(rows, ["text"], fields, start).drop("text")


def segments(f0: np.ndarray, f1: np.ndarray) -> list[np.ndarray]:
    low = lambda f, at, n: (f >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)
    return [low(f0, 41, 23), low(f0, 18, 23), low(f1, 41, 23), low(f1, 18, 23)]


def meeting_keys(f0: np.ndarray, f1: np.ndarray, tables: list[np.ndarray], errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position) of all pairs of codewords of pairs of segments."""
    keys = [golay_keys(s, tables, errors) for s in segments(f0, f1)]
    out, rows = [], []
    for k, (x, y) in enumerate(combinations(keys, 2)):
        row, i, j = np.nonzero((x[:, :, None] >= 0) & (y[:, None, :] >= 0))
        out.append((k << 24) + (x[row, i] << 12) + y[row, j])
        rows.append(row)
    return np.concatenate(out), np.concatenate(rows)


def list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, f0, f1) to (key, id, f0, f1)."""
    tables, errors = syndromes(), error_table()
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            ids, f0, f1 = (c.to_numpy() for c in b.slice(at, 2048).columns)
            key, row = meeting_keys(f0.view(np.uint64), f1.view(np.uint64), tables, errors)
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c[row]) for c in (ids, f0, f1))], names=["key", "id", "f0", "f1"])


def close_pairs(ids: np.ndarray, f0: np.ndarray, f1: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold a bucket's members within ``radius`` bits together, fewer than it has members."""
    a, b = [], []
    while len(ids):
        front, ids, f0, f1 = [(ids[0], f0[0], f1[0])], ids[1:], f0[1:], f1[1:]
        while front and len(ids):
            x, x0, x1 = front.pop()
            near = np.bitwise_count(f0 ^ x0).astype(np.int64) + np.bitwise_count(f1 ^ x1) <= radius
            if near.any():
                a.append(np.full(int(near.sum()), x))
                b.append(ids[near])
                front += zip(ids[near], f0[near], f1[near])
                ids, f0, f1 = ids[~near], f0[~near], f1[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def cluster_buckets(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, f0, f1) sorted by key to links (a, b). At most BUCKET members are held; the rest of a larger bucket is linked as it streams by."""
    held, large = [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64)], None
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def links(key: np.ndarray, ids: np.ndarray, f0: np.ndarray, f1: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        at = np.flatnonzero(np.repeat(sizes <= 8, sizes))
        for lag in range(1, 8):
            at = at[at + lag < len(key)]
            at = at[key[at + lag] == key[at]]
            near = at[np.bitwise_count(f0[at] ^ f0[at + lag]).astype(np.int64) + np.bitwise_count(f1[at] ^ f1[at + lag]) <= radius]
            if len(near):
                yield batch(ids[near], ids[near + lag])
        for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
            own = ids[s : s + n]
            a, b = (np.full(n - 1, own[0]), own[1:]) if n > BUCKET else close_pairs(own, f0[s : s + n], f1[s : s + n], radius)
            if len(a):
                yield batch(a, b)

    for b in batches:
        columns = [c.to_numpy() for c in b.columns]
        columns[2:] = [c.view(np.uint64) for c in columns[2:]]  # bits are counted in absolute values
        if large is not None:  # (key, first id) of a bucket that is streaming by
            n = int(np.searchsorted(columns[0], large[0], side="right"))
            if n:
                yield batch(np.full(n, large[1]), columns[1][:n])
            columns = [c[n:] for c in columns]
            if not len(columns[0]):
                continue
            large = None
        columns = [np.concatenate(c) for c in zip(held, columns)]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        yield from links(*(c[:cut] for c in columns))
        held = [c[cut:] for c in columns]
        if len(held[0]) > BUCKET:
            large = (int(held[0][0]), int(held[1][0]))
            yield batch(np.full(len(held[0]) - 1, large[1]), held[1][1:])
            held = [c[:0] for c in held]
    yield from links(*held)


#: Ids that a task's links are held for at a time.
HELD = 1_000_000


def contracted(links: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) with the same components but one link an id, to the least id of its component: the many buckets that a group meets in say the same over and over."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def told() -> pa.RecordBatch:
        pairs = [(r, x) for x in root if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in links:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > HELD:
            yield told()
            root.clear()
    if root:
        yield told()


def starred(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components: each id is linked to the least that it was linked to by any task, and so are the others of these. Tasks that saw parts of one group named them after few ids, so little is left."""
    near = links.groupBy("b").agg(F.min("a").alias("m"), F.collect_set("a").alias("roots"))  # one a task at most
    return near.select(F.col("m").alias("a"), F.explode(F.concat(F.array("b"), "roots")).alias("b")).where("a <> b").distinct()


def match_blocks(batches: Iterator[pa.RecordBatch], similarity: float = SIMILARITY) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, block, part, role, id, hashes), each block's asked sets (role 0) first, to links (a, b).

    A block is held as one sorted list of shingles with their owners; the sets it is compared with stream by.
    Of a set's partners in the block all but one are linked only where the block hasn't linked them yet.
    """
    group, ids, sets, index, root = None, [], [], None, []
    a, b = [], []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    def partners(own: np.ndarray) -> np.ndarray:
        hashes, owner, sizes = index
        low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        n = high - low
        places = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
        common = np.bincount(owner[places], minlength=len(sizes))
        return np.flatnonzero(common >= similarity * (sizes + len(own) - common) - 1e-9)

    for batch in slices(batches):
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
        for k, (role, id_, own) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5))):
            if keys[k] != group:
                group, ids, sets, index, root = keys[k], [], [], None, []
            own = own.values.to_numpy()
            if not len(own):
                continue
            if role == 0:
                ids.append(id_)
                sets.append(own.copy())
                continue
            if not ids:
                continue
            if index is None:
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                hashes = np.concatenate(sets)
                order = np.argsort(hashes, kind="stable")
                index, root = (hashes[order], owner[order], np.array([len(s) for s in sets])), list(range(len(sets)))
                sets = []
            near = [x for x in partners(own).tolist() if ids[x] != id_]
            if near:
                a.append(ids[near[0]])
                b.append(id_)
                for x in near[1:]:
                    if find(x) != find(near[0]):
                        root[find(x)] = find(near[0])
                        a.append(ids[near[0]])
                        b.append(ids[x])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []


def compare(sets: DataFrame, asked: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of the asked sets with all of their clusters. sets: (cluster, id, hashes, members), asked: (id)."""
    wanted = sets.join(asked.select("id"), "id")
    blocks = wanted.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.size("hashes")) / BLOCK_HASHES)).cast("int").alias("blocks"))
    blocks = broadcast_if_small(blocks, asked.count())
    parts = F.ceil(F.col("members") / PART).cast("int")
    own = wanted.join(blocks, "cluster").select("cluster", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("role"), "id", "hashes")
    others = sets.join(blocks, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("int").alias("part"), F.lit(1).alias("role"), "id", "hashes")
    dealt = own.union(others).repartition("cluster", "block", "part").sortWithinPartitions("cluster", "block", "part", "role", "id")
    return cut_lineage(starred(dealt.mapInArrow(lambda batches: contracted(match_blocks(batches, similarity)), "a long, b long")))


def set_rows(docs: DataFrame, wanted: DataFrame, width: int, text_col: str) -> DataFrame:
    """(cluster, id, hashes, members) of the texts in wanted (cluster, id, members, doc_id, t), read again."""
    there = wanted.select("cluster", "id", "members", F.col("doc_id").alias("__id"), F.col("t").alias("__t"))
    rows = docs.select("doc_id", F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    near = rows.join(broadcast_if_small(there, wanted.count()), (F.col("t") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("cluster", "id", "members", "text")
    fields = [T.StructField("hashes", T.ArrayType(T.LongType()))]
    made = append_columns(near, ["text"], fields, lambda: lambda texts: [[shingle_set(word_hashes(t), width) for t in texts]])
    return made.drop("text").dropDuplicates(["id"])  # rows that repeat a document


def similar_links(docs: DataFrame, classes: DataFrame, width: int, similarity: float, text_col: str) -> DataFrame:
    """(a, b): links of classes (id, f0, f1, one) that join up all that are similar enough."""
    keys = classes.select("id", "f0", "f1").mapInArrow(list_keys, "key long, id long, f0 long, f1 long").repartition("key").sortWithinPartitions("key")
    found = connected_components(starred(keys.mapInArrow(lambda batches: contracted(cluster_buckets(batches)), "a long, b long")))
    clusters = found.select("id", F.col("component").alias("cluster"))
    sizes = cut_lineage(clusters.groupBy("cluster").agg(F.count("*").alias("members")))
    wanted = cut_lineage(classes.join(clusters.join(broadcast_if_small(sizes, sizes.count()), "cluster"), "id").select("cluster", "id", "members", "one.doc_id", "one.t"))
    sets = cut_lineage(set_rows(docs, wanted, width, text_col))
    # a cluster is named after its first class
    first = compare(sets, sizes.select(F.col("cluster").alias("id")), similarity)
    joined = connected_components(first)
    rest = wanted.where("members > 2").join(joined, "id", "left").where(F.coalesce("component", "id") != F.col("cluster")).select("id")
    return first.union(compare(sets, cut_lineage(rest), similarity))


def groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, named): rows (doc_id, t, digest) of docs, and (digest, first) with the least (doc_id, t) of each digest's group of near copies."""
    rows = cut_lineage(sketches(docs, width, text_col))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t"))).alias("least")
    classes = rows.groupBy("digest").agg(F.min("f0").alias("f0"), F.min("f1").alias("f1"), least, F.min(F.struct("doc_id", "t")).alias("one"))
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()))
    with_words = classes.where(F.col("digest") != F.lit(hashlib.md5(b"").digest()))
    found = connected_components(similar_links(docs, with_words.select("id", "f0", "f1", "one"), width, similarity, text_col))
    named = classes.join(found, "id", "left").select("digest", "least", F.coalesce("component", "id").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    return rows, named.join(first, "root").select("digest", "first")


def near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for each row of docs: the least doc_id among documents reached through pairs of similar shingle sets.

    Texts without words, null ones too, are copies of each other only. A null doc_id is in no competition
    for the least. Repeated rows come back as often; other columns are left aside; an empty table gives none.
    """
    rows, named = groups(docs, width, similarity, text_col)
    return rows.join(named, "digest").select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: the one with the least doc_id.

    Rows without an id stay. Rows that share an id but aren't near copies stay all; of near copies that share
    the least id, the text with the least hash stays, and of rows that repeat id and text, the first as JSON.
    All columns are kept, whatever their names.
    """
    rows, named = groups(docs, text_col=text_col)
    kept = named.select("first.*").where("doc_id is not null").distinct()
    kept = cut_lineage(rows.join(kept, ["doc_id", "t"], "left_semi").groupBy("doc_id", "t").agg(F.count("*").alias("n")))
    there = kept.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), F.col("n").alias("__n"))
    found = docs.join(there, (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__t")))
    out = found.where("__n = 1").select(*(docs[f"`{c}`"] for c in docs.columns))
    if kept.where("n > 1").limit(1).count():
        row = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
        again = found.where("__n > 1").groupBy("__id", "__t").agg(F.min_by(row, F.to_json(row)).alias("row"))
        out = out.unionByName(again.select("row.*"))
    return out.unionByName(docs.where("doc_id is null"))
