"""SQL that gives the rows of those queries that SQL can state."""

from __future__ import annotations

from .licenses import TEMPLATES, THRESHOLD

WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def shingles(words: str, width: str) -> str:
    return f"list_transform(range(1, greatest(len({words}) - {width} + 1, 1) + 1), lambda i: array_to_string(list_slice({words}, i, i + {width} - 1), ' '))"


DECONTAMINATION = rf"""WITH it AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS width FROM (SELECT DISTINCT item_id, {WORDS.format("coalesce(text, '')")} AS w FROM benchmark) WHERE len(w) > 0),
    its AS (SELECT *, {shingles('w', 'width')} AS s FROM it), ih AS (SELECT item_id, n, width, generate_subscripts(s, 1) - 1 AS k, unnest(s) AS h FROM its),
    d AS (SELECT DISTINCT doc_id, text, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
    dh AS (SELECT doc_id, text, len(w) AS size, width, generate_subscripts(s, 1) - 1 AS k, unnest(s) AS h FROM (SELECT *, {shingles('w', 'width')} AS s FROM d, (SELECT DISTINCT width FROM it)) WHERE len(w) >= width),
    hit AS (SELECT DISTINCT doc_id, text, item_id, dh.k, size, n, width FROM dh JOIN ih USING (h, width)),
    win AS (SELECT DISTINCT doc_id, text, item_id, unnest(range(greatest(0, least(k - n + width, size - n)), greatest(0, least(k, size - n)) + 1)) AS start FROM hit),
    own AS (SELECT win.doc_id, win.text, win.item_id, start, n, its.s AS theirs, width, list_slice(d.w, start + 1, start + n) AS ow FROM win JOIN d ON d.doc_id IS NOT DISTINCT FROM win.doc_id AND d.text = win.text JOIN its USING (item_id)),
    sh AS (SELECT *, {shingles('ow', 'width')} AS ours FROM own),
    sc AS (SELECT *, list_sum(list_transform(list_distinct(theirs), lambda x: least(len(list_filter(ours, lambda y: y = x)), len(list_filter(theirs, lambda y: y = x))))) AS common FROM sh),
    sim AS (SELECT *, common / (len(ours) + len(theirs) - common) AS similarity FROM sc), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY similarity DESC, start) AS r FROM sim WHERE similarity >= 0.8)
    SELECT doc_id, item_id, cast(start AS INT) AS start_word, cast(n AS INT) AS n_words, round(similarity, 6)::DOUBLE AS similarity FROM best WHERE r = 1"""


def licenses() -> str:
    rows = ", ".join(f"({literal(k)}, {v}, {literal(t)})" for k, ts in sorted(TEMPLATES.items()) for v, t in enumerate(ts))
    bigrams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return rf"""WITH RECURSIVE tw AS (SELECT license, variant, {WORDS.format('t')} AS w FROM (VALUES {rows}) v(license, variant, t)), tb AS (SELECT license, variant, len(w) AS n, {bigrams('w')} AS b FROM tw),
    d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL), db AS (SELECT r, k, w[k] || ' ' || w[k + 1] AS g FROM (SELECT r, w, unnest(range(1, len(w))) AS k FROM d)),
    hit AS (SELECT DISTINCT r, license, variant, n, b, k FROM db JOIN (SELECT *, unnest(b) AS g FROM tb) USING (g)),
    win AS (SELECT hit.*, list_slice(w, k, k + n - 1) AS x FROM hit JOIN d USING (r)), xb AS (SELECT *, {bigrams('x')} AS o FROM win),
    sc AS (SELECT r, k - 1 AS s, license, variant, len(x) AS n, 2.0 * len(list_intersect(o, b)) / (len(o) + len(b)) AS dice FROM xb), good AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY s, dice DESC, license, variant) AS i FROM sc WHERE dice >= {THRESHOLD}),
    walk AS (SELECT r, i, s, n, dice, license, variant, 1 AS place FROM good WHERE i = 1
        UNION ALL SELECT g.r, g.i, CASE WHEN p THEN g.s ELSE w.s END, CASE WHEN p THEN g.n ELSE w.n END, CASE WHEN p THEN g.dice ELSE w.dice END, CASE WHEN p THEN g.license ELSE w.license END, CASE WHEN p THEN g.variant ELSE w.variant END, w.place + (g.s >= w.s + w.n)::INT
            FROM walk w JOIN good g ON g.r = w.r AND g.i = w.i + 1, LATERAL (SELECT g.s >= w.s + w.n OR g.dice > w.dice AS p)),
    fin AS (SELECT *, row_number() OVER (PARTITION BY r, place ORDER BY i DESC) AS z FROM walk)
    SELECT doc_id, cast(s AS INT) AS start_word, cast(n AS INT) AS n_words, license, variant, round(dice, 6)::DOUBLE AS dice FROM fin JOIN d USING (r) WHERE z = 1"""


def matches(kind: str, order: int, pattern: str, keep: str) -> str:
    """(doc_id, kind, k, s, e, m) of a pattern's matches; a match starts where the texts before it end."""
    return f"""SELECT doc_id, {literal(kind)} AS kind, {order} AS k, s, s + length(m) AS e, m FROM (
        SELECT doc_id, m, sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
            SELECT doc_id, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(list_slice(ps, 1, len(ms))) AS p FROM (SELECT doc_id, regexp_extract_all(text, {literal(pattern)}) AS ms, regexp_split_to_array(text, {literal(pattern)}) AS ps FROM d WHERE regexp_matches(text, {literal(pattern)}))
        ) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {keep}"""


def either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(?:" + "|".join(map(either, ("password", "passwd", "secret", "token"))) + f"|{either('api')}_?{either('key')}" + r""")["']?\x20*[:=]\x20*["']?"""
#: Bytes of a token's entropy folded through the table of CRC-32, then six digits in base 62.
CRC = """tab AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(0, 9), lambda a, b: CASE WHEN b = 0 THEN a WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n::BIGINT) AS c FROM range(0, 256) x(n)))"""
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def token(kind: str, order: int, head: str) -> str:
    n = "crc"
    digits = " || ".join(f"substr('{BASE62}', (({n} // {62 ** k}) % 62 + 1)::INT, 1)" for k in range(5, -1, -1))
    return f"""SELECT doc_id, kind, k, s, s + 40 AS e, m FROM (SELECT x.*, substr(text, s::INT + 5, 36) AS body, substr(text, s::INT + 41, 1) AS after FROM ({matches(kind, order, head, 'true')}) x JOIN d USING (doc_id)) y,
        LATERAL (SELECT xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, 31), lambda i: ascii(substr(body, i::INT, 1))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM tab) z
        WHERE regexp_full_match(body, '[A-Za-z0-9]{{36}}') AND NOT regexp_matches(after, '[A-Za-z0-9]') AND substr(body, 31) = {digits}"""


SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {CRC},
    base AS ({matches('assign', 0, ASSIGN + '[A-Za-z0-9+/_.=-]+', "length(m) - length(regexp_extract(m, " + literal('^' + ASSIGN) + ")) >= 8")}
        UNION ALL {matches('access', 1, 'AKIA[A-Z0-9]+', 'length(m) >= 16')} UNION ALL {matches('hex', 2, '[0-9a-f]+', 'length(m) >= 32')}),
    found AS (SELECT * FROM base UNION ALL {token('github', 3, 'gh[pousr]_')} UNION ALL {token('npm', 4, 'npm_')}),
    said AS (SELECT doc_id, count_if(k = 0) AS a, count_if(k = 1) AS b, count_if(k = 2) AS c, count_if(k > 2) AS x, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) AS spans FROM found GROUP BY doc_id)
    SELECT d.doc_id, cast(coalesce(a, 0) AS BIGINT) AS n_assign, cast(coalesce(b, 0) AS BIGINT) AS n_access, cast(coalesce(c, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, cast(coalesce(x, 0) AS BIGINT) AS n_checked FROM d LEFT JOIN said USING (doc_id)"""


def escaped(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '(<)(%*)(\||/?s>)', '\1%\2\3', 'g'), '(\[)(%*)(/?INST\])', '\1%\2\3', 'g')"


CHAT = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(0, 2) x(k)),
    p AS (SELECT *, 23 + length({escaped('role')}) + length({escaped('text')}) AS n, '<|turn|>' || {escaped('role')} || '<|body|>' || {escaped('text')} || '<|end|>' AS piece FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, piece)) AS turns_sha256, cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, piece) FILTER (role = 'assistant'), '')) AS loss_sha256, cast(sum(n) AS BIGINT) AS formatted_chars FROM p GROUP BY conv_id"""

# bytes are pairs of hexadecimal digits here
SUFFIX = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents), n AS (SELECT r, doc_id, x, length(x) // 2 AS n FROM d),
    win AS (SELECT r, k, md5(substr(x, (2 * k + 1)::INT, 800)) AS h FROM (SELECT r, x, unnest(range(0, n - 399)) AS k FROM n WHERE n >= 400)),
    hit AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
    isl AS (SELECT r, k, CASE WHEN k - lag(k) OVER (PARTITION BY r ORDER BY k) <= 400 THEN 0 ELSE 1 END AS opens FROM hit), grp AS (SELECT r, k, sum(opens) OVER (PARTITION BY r ORDER BY k) AS g FROM isl),
    sp AS (SELECT r, g, min(k) AS a, max(k) + 400 AS b FROM grp GROUP BY r, g), cut AS (SELECT r, list(a ORDER BY a) AS lo, list(b ORDER BY a) AS hi, sum(b - a) AS gone FROM sp GROUP BY r),
    pieces AS (SELECT n.*, coalesce(gone, 0) AS gone, coalesce(len(lo), 0) AS spans, list_concat([0], coalesce(hi, [])) AS froms, list_concat(coalesce(lo, []), [n]) AS tos FROM n LEFT JOIN cut USING (r))
    SELECT doc_id, n AS n_bytes, cast(gone AS BIGINT) AS n_removed, cast(spans AS BIGINT) AS n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(froms) + 1), lambda i: substr(x, (2 * froms[i] + 1)::INT, (2 * (tos[i] - froms[i]))::INT)), ''))) AS kept_sha256 FROM pieces"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": DECONTAMINATION, "op4_licenses": licenses(), "op6_secrets": SECRETS, "op7_chat": CHAT, "op10_suffix_dedup": SUFFIX}
