import random
import re
from collections import Counter

import pytest

from corpusloom.llm import decontamination as dc


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(w, width):
    return Counter(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def similarity(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def brute(docs, items):
    """Best similarity of every window of every document, by item."""
    out = {}
    for item, text in items:
        theirs = words(text)
        if not theirs:
            continue
        width = min(5, len(theirs))
        want = grams(theirs, width)
        for doc, text in docs:
            own = words(text)
            if not own or not (grams(own, width).keys() & want.keys()):
                continue
            best = max(similarity(grams(own[s : s + len(theirs)], width), want) for s in range(max(1, len(own) - len(theirs) + 1)))
            if best >= 0.8:
                out[doc, item] = round(best, 6)
    return out


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {(r.doc_id, r.item_id): r.similarity for r in dc.op1_decontamination(spark, sf).collect()} == brute(docs, items)


ITEM = "the quick brown fox jumps over the lazy dog while seven small birds watch from a very old tree near our house"


@pytest.fixture(scope="module")
def edited(spark):
    w = ITEM.split()
    texts = [
        f"before {ITEM} after", ITEM.upper().replace(" ", ", "), " ".join(w[:8] + ["grey"] + w[8:]), " ".join(w[:11] + w[14:]), "x " * 50_000 + ITEM, ITEM, "", None, "the quick brown fox jumps over other things entirely",
    ]
    return [(k, t, "doc", 5) for k, t in enumerate(texts)] + [(None, ITEM, "doc", 5), (0, texts[0], "doc", 5)]


def test_edits_and_edges(spark, edited):
    docs = spark.createDataFrame(edited, "doc_id long, text string, item_id string, row int")
    items = spark.createDataFrame([(7, ITEM), (8, ""), (9, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in dc.find_contamination(docs, items).collect()}
    assert found == brute([r[:2] for r in edited], [(7, ITEM)])
    kept = dc.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [k for k in range(9) if (k, 7) not in found]
    assert dc.find_contamination(docs, items.limit(0)).count() == 0
    assert dc.find_contamination(docs.limit(0), items).count() == 0


def test_blocks_cover_the_radius(spark):
    """Every item within the radius is found among all items of a size, and none beyond it."""
    rng = random.Random(1)
    signed = lambda a: a - (a >> 63 << 64)
    items = [rng.getrandbits(64) for _ in range(40)]
    windows = []
    for k in range(80):
        a = items[k % 40]
        for bit in rng.sample(range(64), dc.RADIUS + k // 40):
            a ^= 1 << bit
        windows.append(a)
    own = spark.createDataFrame([(k, 5 + k % 2, 0, signed(a)) for k, a in enumerate(windows)], "row long, n int, start int, fp long")
    listed = spark.createDataFrame([(k, 5 + k % 2, signed(a), ["s"]) for k, a in enumerate(items)], "item_id long, n int, item_fp long, item_shingles array<string>")
    got = {(r.row, r.item_id): r.hamming for r in dc.looked_up(own, listed).collect()}
    assert got == {(i, j): (a ^ b).bit_count() for i, a in enumerate(windows) for j, b in enumerate(items) if i % 2 == j % 2 and (a ^ b).bit_count() <= dc.RADIUS}
    assert {(k, k) for k in range(40)} <= got.keys()


def test_radius_loses_nothing(spark, sf, monkeypatch):
    """Items with words left out, changed or repeated, similar by 0.8 to 1: as many are found within the radius as without one."""
    rng = random.Random(6)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = []
    for k in range(600):
        w = words(rng.choice(items)[1])
        for _ in range(rng.randint(0, max(1, len(w) // 30))):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["new"], [w[at], w[at]]])
        docs.append((k, " ".join(["pad"] * 20 + w + ["end"] * 20)))
    df, its = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in dc.find_contamination(df, its).collect()}
    wanted = brute(docs, items)
    assert len(wanted) > 200 and found == wanted


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, "clean words only"), (None, ITEM), (None, "clean"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in dc.decontaminate(docs, items).collect()) == [(0, "clean"), (1, "clean words only"), (2, "")]


def test_reordered_items_are_found(spark):
    """Halves, thirds and sentences in another order, inside long documents and as whole ones."""
    w = [f"w{k}" for k in range(120)]
    items, docs = [], []
    for n in (12, 40, 59, 60, 120):
        items.append((n, " ".join(w[:n])))
        own = w[:n]
        for k, x in enumerate([own[n // 2 :] + own[: n // 2], own[2 * n // 3 :] + own[n // 3 : 2 * n // 3] + own[: n // 3], own[n // 2 :] + ["new"] + own[: n // 2], own[: n - n // 12]]):
            docs += [(1000 * n + 10 * k, " ".join(["a"] * 300 + x + ["b"] * 300)), (1000 * n + 10 * k + 1, " ".join(x))]
    found = {(r.doc_id, r.item_id): r.similarity for r in dc.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == brute(docs, items)
    assert (60000, 60) in found and (40000, 40) in found
