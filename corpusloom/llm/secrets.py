"""Secret scans: Aho-Corasick keyword prefilter, anchored regular expressions at the hits, checksum validation."""

from __future__ import annotations

import hashlib
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, table

#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
#: re.A keeps the folding of case within ASCII.
ANCHORED = {
    "assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
}
HEX = re.compile(r"[0-9a-f]+")
#: A run of 32 covers two neighbours of any stride of 16.
STRIDE = 16
PAIR = re.compile(r"(?=[0-9a-f][0-9a-f])")
HEXDIGITS = frozenset("0123456789abcdef")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MASK = "[SECRET]"


def base62_crc(entropy: str) -> str:
    """The six characters that end a token: CRC-32 of what is before them, in base 62."""
    n, out = zlib.crc32(entropy.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def automaton():
    import ahocorasick

    words = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        words.add_word(word, (len(word), kind))
    words.make_automaton()
    return words


def lowered(text: str) -> str:
    """In lower case, position by position: full folding may lengthen a text, ASCII folding can't."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)


def accepted(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m.group(2)) >= 8
    if kind == "access":
        return m.end() - m.start() >= 16
    body = m.group()[4:]
    return base62_crc(body[:30]) == body[30:]


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of 32 and more hexadecimal digits, found by looking at each 16th character."""
    found, end = [], 0
    for m in PAIR.finditer(text[::STRIDE]):
        at = m.start() * STRIDE
        if at < end:
            continue
        low = at
        while low > end and text[low - 1] in HEXDIGITS:
            low -= 1
        end = HEX.match(text, low).end()
        if end - low >= 32:
            found.append((low, end))
    return found


def scan(text: str, words) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; in code points, end exclusive."""
    spans, last = [], {}
    hits = sorted({(stop - n + 1, kind) for stop, (n, kind) in words.iter(lowered(text))})
    for at, kind in hits:
        if at < last.get(kind, 0):
            continue
        m = ANCHORED[kind].match(text, at)
        if m:
            if kind in ("assign", "access"):
                last[kind] = m.end()
            if accepted(kind, m):
                spans.append((at, m.end(), kind))
    spans += [(a, b, "hex") for a, b in hex_runs(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text_col: str = "text", redact: bool = False) -> DataFrame:
    """docs with ``secret_spans`` array<struct<start, end, kind>>, and with the spans masked in the text where ``redact``.

    Row by row and without a shuffle. A null text has no spans and stays null; an empty one has no
    spans; repeated rows are scanned alike; a column called secret_spans is replaced, others are kept.
    """
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
    fields = [T.StructField("secret_spans", T.ArrayType(span))] + [T.StructField(text_col, T.StringType())] * redact

    def start():
        words = automaton()

        def apply(texts):
            found = [scan(t, words) if t else [] for t in texts]
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in f] for f in found]
            return [spans, [masked(t, f) if f else t for t, f in zip(texts, found)]][: 1 + redact]

        return apply

    return append_columns(docs, [text_col], fields, start)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts by base kind, digest of the base spans, all spans."""
    docs = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))
    said = lambda array: F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return docs.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(said(base), 256).alias("base_sha256"), said(spans).alias("spans"),
        (F.size(spans) - F.size(base)).cast("long").alias("n_checked"),
    )


def brute_force(text: str | None) -> list[tuple[int, int, str]]:
    """The base spans by plain scans; for tests."""
    text, out = text or "", []
    out += [(m.start(), m.end(), "assign") for m in ANCHORED["assign"].finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), m.end(), "access") for m in ANCHORED["access"].finditer(text) if len(m.group()) >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))
