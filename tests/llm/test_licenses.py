import random
import re
import textwrap

import pytest

from corpusloom.llm import licenses as lc


def words(text):
    return [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]


def pairs(w):
    return set(zip(w, w[1:]))


def brute(docs, templates):
    """All windows of all templates that begin with a bigram of theirs, then the walk from left to right."""
    out = []
    for doc, text in docs:
        own, found = words(text), []
        for name, ts in templates.items():
            for v, t in enumerate(ts):
                theirs = words(t)
                b = pairs(theirs)
                for s in range(len(own) - 1):
                    if (own[s], own[s + 1]) in b:
                        x = own[s : s + len(theirs)]
                        dice = 2 * len(pairs(x) & b) / (len(pairs(x)) + len(b))
                        if dice >= 0.8:
                            found.append((s, -dice, name, v, len(x)))
        last = None
        for x in sorted(found):
            if last and x[0] < last[0] + last[4]:
                last = x if x[1] < last[1] else last
                continue
            out += [(doc, *last)] if last else []
            last = x
        out += [(doc, *last)] if last else []
    return sorted(((d, s, n, k, v, round(-m, 6)) for d, s, m, k, v, n in out), key=str)


def found(df, **kw):
    return sorted(((r.doc_id, r.start_word, r.n_words, r.license, r.variant, r.dice) for r in lc.scan_licenses(df, **kw).collect()), key=str)


def test_against_brute_force(spark):
    mit, apache, cc = lc.TEMPLATES["MIT"][2], lc.TEMPLATES["Apache-2.0"][0], lc.TEMPLATES["CC-BY-4.0"][1]
    texts = [mit, f"intro\n{apache}\nend", apache.upper(), mit.replace("free of charge", "at no cost"), "", None, "license", "\n\n", "word " * 60_000 + "\n" + apache, " ".join(mit.split()[:12]), f"{apache} {apache} {cc} {mit}", cc.replace("Attribution", "Attribution-NonCommercial"), "Licensed under the MIT License. " * 40]
    docs = [(k, t, "x") for k, t in enumerate(texts)] + [(None, apache, "x"), (0, mit, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, license string")
    got = found(df)
    assert got == brute([d[:2] for d in docs], lc.TEMPLATES)
    assert len([x for x in got if x[0] == 12]) == 40
    assert lc.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [40, 79, 2_000])
def test_recall_of_wrapped_notices(spark, width):
    """Every template of eight words or more, wrapped, behind comment marks, inside other text, with one word in thirty changed: nine in ten or more are found by name."""
    rng = random.Random(width)
    docs, names = [], []
    for name, ts in lc.TEMPLATES.items():
        for t in ts:
            w = t.split()
            if len(w) < 8:
                continue
            for k in rng.sample(range(len(w)), len(w) // 30):
                w[k] = "changed"
            prose = " ".join(f"p{rng.randrange(10**6)}" for _ in range(200))
            docs.append((len(docs), "\n".join(f" * {x}" for x in textwrap.wrap(f"{prose} {' '.join(w)} {prose}", width))))
            names.append(name)
    got = lc.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    hits = {r.doc_id for r in got if r.license == names[r.doc_id]}
    assert len(hits) >= 0.9 * len(docs) and len(docs) > 30


def test_ties_take_the_first_licence(spark):
    df = spark.createDataFrame([(1, "same words here")], "doc_id long, text string")
    assert [x[3:5] for x in found(df, templates={"b": ["same words here"], "a": ["other", "same words here"]})] == [("a", 1)]
    assert lc.scan_licenses(df, {"a": ["one"]}).count() == 0
