"""Benchmark decontamination with DataFrame functions: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Items are indexed by their number of words: of 8 blocks of 8 bits, fingerprints within 23 bits have one that
differs in 2 bits at most, so an item is listed under all values within 2 bits of each of its blocks. Windows of
each such size are fingerprinted and looked up there by size and blocks; only then is it known which item one may
hold. Similarity of 0.8 or more needs 8 of 9 shingles in common, so windows with fewer shingles of any item of the
size, in whatever order, are left out before that: no match is among them. Fingerprints of texts that are similar by
0.8 differ in 9.7 bits on average, with a deviation of 2.9.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table

WIDTH = 5
RADIUS = 23
BLOCKS = 8
SIMILARITY = 0.8
#: Entries (rows, or what lies in a row's arrays) that may be broadcast; beyond, joins shuffle.
BROADCAST_ENTRIES = 400_000


def small(df: DataFrame, array: str | None = None) -> DataFrame:
    """A written table, marked for broadcast if its rows and the entries of its array column, counted here, allow it."""
    df = cut_lineage(df)
    entries = df.agg(F.sum(F.size(array) + 1 if array else F.lit(1))).first()[0] or 0
    return F.broadcast(df) if entries <= BROADCAST_ENTRIES else df


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(df: DataFrame, width: int) -> Column:
    """Hashes of runs of ``width`` words of df's column hashes (of words)."""
    n = F.size("hashes")
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64 bits, each by majority over an array column of shingle hashes; repeated shingles weigh as often as they stand there."""
    bit = lambda b: F.when(2 * F.size(F.filter(hashes, lambda h: F.getbit(h, F.lit(b)) == 1)) > F.size(hashes), F.lit((1 << b) - (1 << 64) * (b == 63))).otherwise(F.lit(0).cast("bigint"))
    out = bit(0)
    for b in range(1, 64):
        out = out.bitwiseOR(bit(b))
    return out


def shingles(words: Column, width: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, width), " "))


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, item_words, n, width): items with at least one word; those of fewer than WIDTH words are one shingle."""
    return benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("item_words")).withColumn("n", F.size("item_words")).where("n > 0").distinct().withColumn("width", F.least("n", F.lit(WIDTH)))


def window_starts() -> Column:
    """Starts of all windows with enough places (column ats, sorted) of shared shingles; columns n and width are the items', size the document's.

    Of a window's shingles and the item's, a + b, at least (a + b) s / (1 + s) must be common.
    """
    own = F.least("n", "size") - F.col("width") + 1
    need = F.ceil((own + F.col("n") - F.col("width") + 1) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9).cast("int")
    last = lambda i: F.get("ats", i + need - 1)
    at = lambda i: F.get("ats", i)
    inside = lambda s: F.greatest(F.lit(0), F.least(s, F.col("size") - F.col("n")))
    opens = F.filter(F.sequence(F.lit(0), F.size("ats") - need), lambda i: last(i) - at(i) < own)
    starts = F.flatten(F.transform(opens, lambda i: F.transform(F.sequence(last(i) - own + 1, at(i)), inside)))
    return F.when(F.size("ats") >= need, F.array_distinct(starts)).otherwise(F.array().cast("array<int>"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): the best window of each document and item that match.

    Words are lower-cased runs of letters and digits; a window has as many words as its item (a shorter
    document is one window); similarity is the weighted Jaccard coefficient of 5-word shingles, weights
    being their counts; of equally similar windows the first is the best. Null and empty texts match nothing;
    items without words are left out; rows that repeat id and text give their matches once; texts that share an
    id give theirs each; a null doc_id is carried; other columns are left aside; empty tables give no rows.
    Whole texts are searched.
    """
    best = matches(docs, benchmark, text_col, item_col, item_text_col)
    return best.select("row.doc_id", "item_id", F.col("best.start").alias("start_word"), F.col("best.n").alias("n_words"), F.col("best.hamming").alias("hamming"), F.round("best.similarity", 6).alias("similarity"))


def row_key(text_col: str) -> Column:
    """A row's id and its text's hash: rows that share an id are told apart by their texts."""
    return F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(text_col).alias("t"))


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(row, item_id, best): see find_contamination; row is row_key()."""
    docs = docs.where(F.col(text_col).isNotNull()).select(row_key(text_col).alias("row"), F.col(text_col).alias("text"))
    items = cut_lineage(items_of(benchmark, item_col, item_text_col))
    widths = [r[0] for r in items.select("width").distinct().collect()]  # at most WIDTH values
    hashed = lambda df, own: df.withColumn("hashes", F.transform(own, lambda w: F.xxhash64(w)))
    seen = None
    for width in widths or [WIDTH]:
        theirs = hashed(items.where(F.col("width") == width), F.col("item_words"))
        theirs = small(theirs.select("n", F.explode(shingle_hashes(theirs, width)).alias("h")).distinct())
        own = hashed(docs.select("row", words(F.col("text")).alias("w")), F.col("w")).select("row", "hashes")
        own = own.select("row", F.size("hashes").alias("size"), F.posexplode(shingle_hashes(own, width)).alias("at", "h"))
        hits = own.join(theirs, "h").select("row", "n", "size", F.lit(width).alias("width"), "at")
        seen = hits if seen is None else seen.union(hits)
    places = seen.groupBy("row", "n", "size", "width").agg(F.array_sort(F.collect_set("at")).alias("ats"))  # as many as a document has words
    starts = places.select("row", "n", "width", F.explode(window_starts()).alias("start"))
    windows = small(starts.groupBy("row").agg(F.collect_set(F.struct("n", "width", "start")).alias("windows")), "windows")
    there = docs.join(windows, "row").select("row", words(F.col("text")).alias("w"), "windows")
    cut = there.dropDuplicates(["row"]).select("row", "w", F.explode("windows").alias("at")).select("row", "at.*", "w")
    own = cut.select("row", "n", "start", F.slice("w", F.col("start") + 1, F.col("n")).alias("words"), "width")
    own = cut_lineage(fingerprinted(own))
    theirs = small(fingerprinted(items.select("item_id", "n", "width", F.col("item_words").alias("words"))).select("item_id", "n", F.col("shingles").alias("item_shingles"), F.col("fp").alias("item_fp")), "item_shingles")
    near = looked_up(own, theirs)
    checked = own.join(near, ["row", "n", "start"]).join(theirs.drop("n", "item_fp"), "item_id")
    count = lambda array, s: F.size(F.filter(array, lambda x: x == s))
    common = F.aggregate(F.array_distinct("item_shingles"), F.lit(0), lambda acc, s: acc + F.least(count(F.col("shingles"), s), count(F.col("item_shingles"), s)))
    checked = checked.withColumn("common", common).withColumn("similarity", F.col("common") / (F.size("shingles") + F.size("item_shingles") - F.col("common")))
    best = F.max_by(F.struct("start", "n", "hamming", "similarity"), F.struct("similarity", -F.col("start"))).alias("best")
    return checked.where(F.col("similarity") >= SIMILARITY).groupBy("row", "item_id").agg(best)


def fingerprinted(rows: DataFrame) -> DataFrame:
    """rows (words, width) with shingles and their SimHash fp, without the words."""
    made = rows.withColumn("shingles", shingles(F.col("words"), F.col("width"))).drop("words", "width")
    return made.withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(s))).withColumn("fp", simhash(F.col("hashes"))).drop("hashes")


def looked_up(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(row, n, start, item_id, hamming): the items of a window's size (item_id, n, item_fp) within RADIUS bits of it (row, n, start, fp), found by blocks."""
    bits = 64 // BLOCKS
    masks = F.array(*(F.lit(m) for m in range(1 << bits) if m.bit_count() <= RADIUS // BLOCKS))
    block = lambda fp: F.array(*(F.shiftrightunsigned(fp, bits * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(BLOCKS)))
    own = windows.select("row", "n", "start", "fp", F.posexplode(block(F.col("fp"))).alias("block", "value"))
    listed = items.select("item_id", "n", "item_fp", F.posexplode(block(F.col("item_fp"))).alias("block", "b"))
    listed = small(listed.select("item_id", "n", "item_fp", "block", F.explode(masks).alias("m"), "b").select("item_id", "n", "item_fp", "block", F.col("b").bitwiseXOR(F.col("m")).alias("value")))
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("hamming")
    return own.join(listed, ["n", "block", "value"]).select("row", "n", "start", "item_id", hamming).where(F.col("hamming") <= RADIUS).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item; rows are known by id and text."""
    bad = small(matches(docs, benchmark, text_col).select(F.col("row").alias("__row")).distinct())
    return docs.join(bad, row_key(text_col) == F.col("__row"), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark; without the distance of fingerprints, which SQL can't compute."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hamming")
