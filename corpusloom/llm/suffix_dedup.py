"""Suffix-array dedup: removes bytes covered by a 400-byte string that also starts elsewhere in the corpus.

Each 400-byte window has an anchor, the run of 64 bytes in it with the least hash; equal windows have
equal anchors at equal places. Windows that follow each other under one anchor make a context. Contexts
are compared as wholes first: those with copies elsewhere are repeated throughout. Of the rest, only
those whose anchor other contexts have too are read: they are dealt by anchor into shards. A shard's
suffix array is sorted by Larsson-Sadakane refinement, common prefixes come from Kasai's walk, run over
all contexts in step, and an anchor's contexts that fill several shards are merged by binary search of
each shard's windows in the others. An anchor with more than HOT contexts is counted by 128-bit window
hashes over the cluster instead, with the same result.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bound_batches, broadcast_if_small, cut_lineage, slices, table

LENGTH = 400
GRAM = 64
SPAN = LENGTH - GRAM + 1
#: Windows hashed at once; shard bytes; contexts of one anchor that are compared by suffix arrays.
CHUNK = 1 << 17
SHARD = 1 << 19
PIECE = 1 << 18
HOT = 5_000
BASE = 0x9E3779B97F4A7C15
#: Windows of a piece that are copied out at a time when pieces are merged.
BLOCK = 1 << 14


class Rolling:
    """Hashes of all runs of a length, modulo 2**64, mixed."""

    def __init__(self, base: int, n: int):
        self.power = np.full(n, base, np.uint64)
        self.power[0] = 1
        self.back = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        np.multiply.accumulate(self.back, out=self.back)

    def __call__(self, data: np.ndarray, length: int) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=total[1:])
        x = (total[length:] - total[:-length]) * self.back[: len(data) - length + 1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        return x


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, rolling: Rolling) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, first window, windows, place of the anchor) of a text's contexts."""
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        part = data[at : at + CHUNK + LENGTH - 1]
        grams = rolling(part, GRAM)
        place = sliding_min((grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64), SPAN) & np.uint64(0xFFFFFF)
        starts = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        counts = np.diff(np.concatenate((starts, [len(place)])))
        where = place[starts].astype(np.int64)
        yield from zip(grams[where].view(np.int64).tolist(), (starts + at).tolist(), counts.tolist(), (where + at).tolist())


def refine(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of text by its suffixes' first ``depth`` bytes; suffixes that agree there share a rank.

    After Larsson and Sadakane: sorted by h bytes, suffixes are sorted by 2h through the ranks h ahead,
    and only groups that still hold several are sorted again. The last step looks depth - h ahead.
    """
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key, kind="stable").astype(np.int32)  # places fit 31 bits: memory is what bounds a shard
    first = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank, own = np.empty(n, np.int32), np.arange(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, own, np.int32(0)))
    del key
    h = 8
    while h < depth:
        ahead = min(h, depth - h)
        size = np.diff(np.concatenate((np.flatnonzero(first), [n])))
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            break
        suffix = order[open_]
        far = suffix + ahead
        second = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        group = rank[suffix]
        by = np.argsort((group.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), kind="stable")
        suffix, second, group = suffix[by], second[by], group[by]
        order[open_] = suffix
        first[open_] = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        rank[suffix] = np.maximum.accumulate(np.where(first, own, np.int32(0)))[open_]
        h += ahead
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """By position of a window, the length, up to depth, that its suffix shares with the one before it in the order of windows.

    Kasai's walk: if the suffix before this one's last position had j before it, j + 1 is before this
    one, and what lies between shares all but one byte; so the length is carried on, less one. order has
    windows only, sorted by depth bytes, so that is checked; else the length is counted afresh. All
    contexts walk at once, each from its own first window.
    """
    n = len(text)
    padded = np.zeros(n + depth + 16, np.uint8)
    padded[:n] = text
    words = np.lib.stride_tricks.as_strided(padded, (n + depth + 8, 8), (1, 1))
    before, place = np.full(n, -1, np.int32), np.full(n + 1, n, np.int32)
    before[order[1:]] = order[:-1]
    place[order] = np.arange(len(order), dtype=np.int32)
    out = np.zeros(n, np.int16)
    walk = np.argsort(-counts, kind="stable")
    starts, counts = starts[walk], counts[walk]
    length = np.zeros(len(starts), np.int64)
    for step in range(int(counts.max(initial=0))):
        live = int(np.searchsorted(-counts, -step, side="left"))
        at = starts[:live] + step
        other = before[at]
        run = np.zeros(live, np.int64)
        if step:
            was = before[at - 1]
            carried = (was >= 0) & (place[was + 1] < place[at])
            run[carried] = np.maximum(length[:live] - 1, 0)[carried]
        go = np.flatnonzero(other >= 0)
        while len(go):
            same = (words[at[go] + run[go]] == words[other[go] + run[go]])
            more = np.where(same.all(1), 8, np.argmin(same, axis=1))
            run[go] = np.minimum(run[go] + more, depth)
            go = go[(more == 8) & (run[go] < depth)]
        length[:live] = run
        out[at] = run
    return out


def repeated_windows(text: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of windows in order, whether each starts elsewhere in the shard too)."""
    order, _ = refine(text, LENGTH)
    window = np.zeros(len(text) + 1, np.int8)
    np.add.at(window, starts, 1)
    np.add.at(window, starts + counts, -1)
    order = order[np.cumsum(window[:-1])[order] > 0]
    prefix = common_prefixes(text, order, starts, counts, LENGTH)[order] >= LENGTH
    return order, prefix | np.concatenate((prefix[1:], [False]))


class Shard:
    """Contexts of whole anchors, or a piece of one anchor's."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[2])

    def sort(self) -> None:
        self.text = np.frombuffer(b"".join(r[2] for r in self.rows), np.uint8)
        lengths = np.array([len(r[2]) for r in self.rows], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.counts = lengths - LENGTH + 1
        self.order, twice = repeated_windows(self.text, self.starts, self.counts)
        self.marked = np.zeros(len(self.text), bool)
        self.marked[self.order[twice]] = True

    def windows(self, low: int, high: int) -> np.ndarray:
        """The windows at places low to high of the order, copied out."""
        return np.lib.stride_tricks.as_strided(self.text, (len(self.text) - LENGTH + 1, LENGTH), (1, 1))[self.order[low:high]].view(f"S{LENGTH}").ravel()

    def bounds(self, first: bytes, last: bytes) -> tuple[int, int]:
        """Places of the order between which its windows are from first to last."""
        at = lambda k: self.text[k : k + LENGTH].tobytes().rstrip(b"\0")  # as numpy compares byte strings
        return bisect.bisect_left(self.order, first, key=at), bisect.bisect_right(self.order, last, key=at)

    def merge(self, other: Shard) -> None:
        """Marks the windows that both have; this shard's are looked up in the other's order, block by block of both."""
        for at in range(0, len(other.order), BLOCK):
            theirs = other.windows(at, at + BLOCK)
            low, high = self.bounds(bytes(theirs[0]), bytes(theirs[-1]))
            for begin in range(low, high, BLOCK):
                end = min(begin + BLOCK, high)
                mine = self.windows(begin, end)
                left, right = np.searchsorted(theirs, mine, "left"), np.searchsorted(theirs, mine, "right")
                self.marked[self.order[begin:end][right > left]] = True
                edge = np.zeros(len(theirs) + 1, np.int64)
                np.add.at(edge, left, 1)
                np.add.at(edge, right, -1)
                other.marked[other.order[at : at + BLOCK][np.cumsum(edge[:-1]) > 0]] = True

    def found(self) -> list[tuple]:
        out = []
        for row, at, n in zip(self.rows, self.starts.tolist(), self.counts.tolist()):
            own = self.marked[at : at + n]
            if own.any():
                out.append((row[0], row[1], runs(own)))
        return out


def runs(marks: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edges[::2], edges[1::2])]


SPANS = "array<struct<a:int,b:int>>"
MARKS = f"h long, c long, spans {SPANS}"


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, context) sorted by h to (h, c, spans): window numbers that another context of the anchor has."""
    spans = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], spans)], names=["h", "c", "spans"])

    def close(shard: Shard, pieces: list[Shard]) -> Iterator[pa.RecordBatch]:
        if pieces:
            for k, one in enumerate(pieces):
                for other in pieces[:k]:
                    one.merge(other)
            for one in pieces:
                if rows := one.found():
                    yield out(rows)
        elif shard.rows:
            shard.sort()
            if rows := shard.found():
                yield out(rows)

    shard, group, size, last, pieces = Shard(), [], 0, None, []

    def end_group() -> Iterator[pa.RecordBatch]:
        nonlocal shard, group, size, pieces
        if pieces:
            if group:
                pieces.append(filled(group))
            yield from close(Shard(), pieces)
        else:
            for row in group:
                shard.add(row)
            if shard.size >= SHARD:
                yield from close(shard, [])
                shard = Shard()
        group, size, pieces = [], 0, []

    def filled(rows: list[tuple]) -> Shard:
        piece = Shard()
        for row in rows:
            piece.add(row)
        piece.sort()
        return piece

    for b in slices(batches):
        for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if row[0] != last:
                yield from end_group()
                last = row[0]
            group.append(row)
            size += len(row[2])
            if size >= (SHARD if not pieces else PIECE):
                for at in range(0, len(group), max(1, len(group) * PIECE // size)):
                    pieces.append(filled(group[at : at + max(1, len(group) * PIECE // size)]))
                group, size = [], 0
    yield from end_group()
    yield from close(shard, [])


def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, context) to a row for each window: its number and 128 bits of its XXH3."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    for b in slices(batches):
        for h, c, context in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            view, n = memoryview(context), len(context) - LENGTH + 1
            hashes = pa.array([digest(view[k : k + LENGTH]) for k in range(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h)), pa.array(np.full(n, c)), pa.array(np.arange(n, dtype=np.int32)), hashes], names=["h", "c", "o", "x"])


def count_windows(read: DataFrame) -> DataFrame:
    """(h, c, spans) like compare(), by counting window hashes: for anchors with very many contexts."""
    rows = cut_lineage(read.mapInArrow(hash_windows, "h long, c long, o int, x binary"))
    twice = rows.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x")
    found = rows.join(twice, "x").groupBy("h", "c").agg(F.array_sort(F.collect_set("o")).alias("os"))  # a context has SPAN windows at most
    return found.select("h", "c", joined(F.transform("os", lambda o: F.struct(o.alias("a"), (o + 1).alias("b")))).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans in order of their starts, those that overlap or touch made one."""
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, s: F.when((F.size(acc) > 0) & (s["a"] <= F.get(acc, F.size(acc) - 1)["b"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], s["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(spans, F.array().cast(SPANS), step)


def list_contexts(docs: DataFrame) -> DataFrame:
    """(doc_id, t, h, c, start, n) of each context; t hashes the text. docs: doc_id, text, t."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("t", T.LongType()), *T._parse_datatype_string("h long, c long, start int, n int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rolling = Rolling(BASE, CHUNK + LENGTH)
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            rows, found, cs = [], [], []
            for k, text in enumerate(b.column(1)):
                raw = text.as_buffer()
                if raw is None or raw.size < LENGTH:
                    continue
                view = memoryview(raw)
                for h, start, n, place in contexts(np.frombuffer(raw, np.uint8), rolling):
                    rows.append(k)
                    found.append((h, start, n))
                    # where the anchor stands is part of what a context is
                    c = digest(view[start : start + n + LENGTH - 1], place - start)
                    cs.append(c - (c >> 63 << 64))
            if rows:
                h, start, n = zip(*found)
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), pa.array(h, pa.int64()), pa.array(cs, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())], names=schema.names)

    return docs.select("doc_id", "text", "t").mapInArrow(run, schema)


def read_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, c, context, wide) of the contexts in wanted (doc_id, t, h, c, start, n, wide), read from the texts again."""
    own = wanted.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "c", "start", "n", "wide")).alias("list"))  # as many as a text has
    near = same_row(docs, broadcast_if_small(own, wanted.count())).select("text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            for text, items in zip(b.column(0), b.column(1).to_pylist()):
                view = memoryview(text.as_buffer())
                yield pa.RecordBatch.from_arrays([
                    pa.array([i["h"] for i in items], pa.int64()), pa.array([i["c"] for i in items], pa.int64()),
                    pa.array([bytes(view[i["start"] : i["start"] + i["n"] + LENGTH - 1]) for i in items], pa.binary()),
                    pa.array([i["wide"] for i in items], pa.bool_()),
                ], names=["h", "c", "context", "wide"])

    return near.mapInArrow(run, "h long, c long, context binary, wide boolean")


def same_row(docs: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """docs with what was found for its rows, by id and text; a null id equals a null id."""
    there = found.withColumnRenamed("doc_id", "__id").withColumnRenamed("t", "__t")
    return docs.join(there, (docs["t"] == there["__t"]) & docs["doc_id"].eqNullSafe(there["__id"]), how).drop("__id", "__t")


def find_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): each row of docs with the maximal byte ranges that repeated strings cover; null where there are none."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.encode(text_col, "UTF-8").alias("text")).withColumn("t", F.xxhash64("text"))
    rows = cut_lineage(list_contexts(docs))
    one = F.min(F.struct("doc_id", "t", "start", "n")).alias("one")
    classes = rows.groupBy("h", "c").agg(F.count("*").alias("copies"), one)
    # counted by partial sums: no task gets all contexts of an anchor
    shared = rows.select("h", "c").distinct().groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    classes = cut_lineage(classes.join(shared, "h", "left").select("h", "c", "copies", "one", F.coalesce("kinds", F.lit(1).cast("long")).alias("kinds")).where("copies > 1 or kinds > 1"))
    wanted = classes.where("kinds > 1").select("one.*", "h", "c", (F.col("kinds") > HOT).alias("wide"))
    read = read_contexts(docs, wanted)
    some = read.where("not wide").drop("wide").repartition("h").sortWithinPartitions("h", "c").mapInArrow(compare, MARKS)
    whole = classes.where("copies > 1").select("h", "c", F.array(F.struct(F.lit(0).alias("a"), F.col("one.n").alias("b"))).alias("spans"))
    marks = whole.unionByName(cut_lineage(some))
    if classes.where(F.col("kinds") > HOT).limit(1).count():
        marks = marks.unionByName(count_windows(read.where("wide").drop("wide")))
    at = rows.join(marks, ["h", "c"]).select("doc_id", "t", F.explode(F.transform("spans", lambda s: F.struct((F.col("start") + s["a"]).alias("a"), (F.col("start") + s["b"] + LENGTH - 1).alias("b")))).alias("s"))
    # as many as a text has windows
    covered = cut_lineage(at.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("s")).alias("spans")))
    # spans grow with the corpus: dealt out with the texts at every size
    return same_row(docs, covered, "left").select("doc_id", "text", "spans")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"]])
    return [(a, b) for a, b in out]


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, kept, removed_spans): a row for each row of docs; kept is binary, since cuts may split a character.

    Strings of 400 bytes are compared over all rows, within and across texts, as they came in. A null
    text counts as empty; texts under 400 bytes stay whole; repeated rows are each other's copies; other
    columns of docs are left aside.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField("kept", T.BinaryType()), T.StructField("removed_spans", span)]

    def start():
        def apply(texts, spans):
            cuts = [merged(s) for s in spans]
            return [[kept_bytes(t or b"", c) for t, c in zip(texts, cuts)], [[{"start": a, "end": b} for a, b in c] for c in cuts]]

        return apply

    return append_columns(find_repeats(docs, text_col), ["text", "spans"], fields, start).select("doc_id", "kept", "removed_spans")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document."""
    fields = [T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()))]

    def start():
        def row(text, spans):
            cuts, raw = merged(spans), text or b""
            return len(raw), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(kept_bytes(raw, cuts)).hexdigest()

        return lambda texts, spans: [list(c) for c in zip(*map(row, texts, spans))]

    found = find_repeats(table(spark, sf_dir, "documents"))
    return append_columns(found, ["text", "spans"], fields, start).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
