"""SimHash near-dedup: Golay-code fuzzy hashing of 64-bit fingerprints, joined on codeword indices and verified.

The (23, 12, 7) Golay code is perfect: each 23-bit word is within 3 bits of one codeword. keys(v) are
the codewords that words within 1 bit of v decode to: one where v is within 2 bits of its codeword,
else six. Words that differ in 2 bits have a word between them, and so share a key. A fingerprint is cut into segments of
23, 23 and 18 bits; of at most 4 differing bits some two segments have at most 2 together, so linked
fingerprints share a pair of keys of some pair of segments. Buckets are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .common import append_columns, cut_lineage, table

RADIUS = 4
GENERATOR = 0b101011100011
SEGMENTS = ((41, 23), (18, 23), (0, 18))
#: A bucket of more distinct fingerprints than this is linked through hubs, exactly as well.
BUCKET = 4096


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash over word shingles: bit set if it is in over half of their XXH64 (seed 42); 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 bits fit 8
        votes += np.add.reduce(np.unpackbits(hashes[at : at + 255].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), 0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def syndromes() -> list[np.ndarray]:
    """Remainders modulo the generator, by byte of the word."""
    powers = []
    for k in range(24):
        r = 1 << k
        for s in range(23, 10, -1):
            if r >> s & 1:
                r ^= GENERATOR << (s - 11)
        powers.append(r)
    tables = []
    for byte in range(3):
        t = np.zeros(256, np.int64)
        for v in range(256):
            for k in range(8):
                if v >> k & 1:
                    t[v] ^= powers[8 * byte + k]
        tables.append(t)
    return tables


def error_table() -> np.ndarray:
    """By syndrome, the errors that lead to a key's codeword: one of weight 3 at most, then the five of weight 4, or -1."""
    tables, errors = syndromes(), np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << k for k in bits)
            s = tables[0][e & 255] ^ tables[1][e >> 8 & 255] ^ tables[2][e >> 16]
            if weight < 4 or errors[s, 0].item().bit_count() == 3:
                errors[s, filled[s]] = e
                filled[s] += 1
    return errors


def golay_keys(words: np.ndarray, tables: list[np.ndarray], errors: np.ndarray) -> np.ndarray:
    """n x 6 codeword indices (12 bits) of 23-bit words, -1 where there are fewer."""
    s = tables[0][words & 255] ^ tables[1][words >> 8 & 255] ^ tables[2][words >> 16]
    e = errors[s]
    return np.where(e >= 0, (words[:, None] ^ e) >> 11, -1)


def pair_keys(fps: np.ndarray, tables: list[np.ndarray], errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position) of all pairs of keys of pairs of segments."""
    keys = [golay_keys((fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64), tables, errors) for at, n in SEGMENTS]
    out, rows = [], []
    for k, (x, y) in enumerate(combinations(keys, 2)):
        both = (k << 24) + (x[:, :, None] << 12) + y[:, None, :]
        row, i, j = np.nonzero((x[:, :, None] >= 0) & (y[:, None, :] >= 0))
        out.append(both[row, i, j])
        rows.append(row)
    return np.concatenate(out), np.concatenate(rows)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold the components of one bucket together, fewer than it has members."""
    rest, links = fps, []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = distance(rest, x) <= RADIUS
            if near.any():
                found = rest[near]
                links += [(x, y) for y in found]
                front += list(found)
                rest = rest[~near]
    return links


def link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key to links (a, b); (fp, null) for the members of buckets that are too large.

    At most BUCKET members are held of a bucket; a larger one streams on as it comes.
    """
    key_held, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    large: int | None = None

    def batch(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))], names=["a", "b"])

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        small = np.repeat(sizes <= 8, sizes)
        at = np.flatnonzero(small)
        for lag in range(1, 8):
            at = at[at + lag < len(key)]
            at = at[key[at + lag] == key[at]]
            if not len(at):
                break
            near = at[distance(fp[at], fp[at + lag]) <= RADIUS]
            if len(near):
                yield batch(fp[near], fp[near + lag])
        for s, n in zip(starts[sizes > 8], sizes[sizes > 8]):
            if n > BUCKET:
                yield batch(fp[s : s + n], None)
            elif found := spanning_links(fp[s : s + n]):
                pairs = np.array(found, np.uint64)
                yield batch(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

    for b in batches:
        key, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        if large is not None:
            n = int(np.searchsorted(key, large, side="right"))
            if n:
                yield batch(fp[:n], None)
            key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            large = None
        key, fp = np.concatenate((key_held, key)), np.concatenate((held, fp))
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        yield from links(key[:cut], fp[:cut])
        key_held, held = key[cut:], fp[cut:]
        if len(held) > BUCKET:
            yield batch(held, None)
            large, key_held, held = int(key_held[0]), key_held[:0], held[:0]
    yield from links(key_held, held)


def hub_links(large: DataFrame) -> DataFrame:
    """Links among fingerprints of large buckets: those within 4 bits have a word within 2 bits of both, and no word has more than 2,081 within 2 bits."""
    masks = [0] + [signed(1 << k) for k in range(64)] + [signed(1 << j | 1 << k) for j, k in combinations(range(64), 2)]
    hubs = large.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("hub"))
    first = F.array_min("fps")
    return hubs.groupBy("hub").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select(first.alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) that join up all that differ in RADIUS bits at most."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, errors = syndromes(), error_table()
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                key, row = pair_keys(part, tables, errors)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64))], names=["key", "fp"])

    keys = fps.select("fp").mapInArrow(keyed, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = cut_lineage(keys.mapInArrow(link_buckets, "a long, b long").distinct())
    large = found.where("b is null").select(F.col("a").alias("fp"))
    near = found.where("b is not null")
    return near.union(hub_links(large)) if large.limit(1).count() else near


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return append_columns(docs, [text_col], [T.StructField("fp", T.LongType())], lambda: lambda texts: [[signed(fingerprint(t)) for t in texts]])


def near_duplicates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id and a text column).

    component_id is the least doc_id among documents reached through fingerprints within 4 bits of each
    other. Null and empty texts have fingerprint zero and are linked like any other; repeated rows come
    back as often; a null doc_id is in no competition for the least, and its row names the component.
    Copies are one fingerprint before any join, so groups of copies cost their distinct fingerprints.
    """
    own = cut_lineage(with_fingerprint(docs.select("doc_id", F.col(text_col).alias("text"))).select("doc_id", "fp"))
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    components = connected_components(fingerprint_links(fps))
    named = fps.join(components, fps["fp"] == components["id"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return near_duplicates(table(spark, sf_dir, "documents"))
