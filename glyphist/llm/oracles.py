"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from glyphist.llm import quality_rules
from glyphist.llm.licenses import EQUIVALENT_SPELLINGS, LICENSE_DIGESTS, LICENSE_TEXTS

# CRC-32 by half bytes: the table is made from the polynomial, low half of each byte first.
_CRC32 = """
half(j, v) AS (
    SELECT j, list_reduce([j, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    FROM range(16) r(j)
),
halves AS (SELECT list(v ORDER BY j) AS t FROM half),
checked AS (
    SELECT doc_id, body, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda p: ('0x' || p)::BIGINT)),
        lambda c, b: xor(
            xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) >> 4,
            t[(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) & 15) + 1])
    ), 4294967295) AS text_crc32
    FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents), halves
)"""

OP1 = f"""
WITH {_CRC32.strip()},
sized AS (SELECT doc_id, text_crc32, strlen(body) + 1 AS size FROM checked),
placed AS (
    SELECT *, (sum(size) OVER w - size)::BIGINT AS first_byte, sum(size) OVER ()::BIGINT AS total
    FROM sized
    WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
),
sharded AS (SELECT *, (((2 * first_byte + size) * 16) // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY first_byte) - 1 AS slot,
    NULL::INTEGER AS grown_shard, first_byte
FROM sharded
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    line = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©|all rights reserved)[^\n]*$"
    result = f"regexp_replace(lower({text}), {_quoted(line)}, '', 'g')"
    result = rf"regexp_replace({result}, '[\x00-/:-@\[-`{{-\x7f]+', ' ', 'g')"
    result = f"' ' || trim({result}, ' ') || ' '"
    for spelling, used in EQUIVALENT_SPELLINGS:
        result = f"replace({result}, {_quoted(f' {spelling} ')}, {_quoted(f' {used} ')})"
    return f"trim({result}, ' ')"


OP10 = f"""
WITH known AS (
    SELECT DISTINCT license, kind, sha256({_canonical("body")}) AS digest
    FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)}, {_quoted(c)})" for a, b, c in LICENSE_TEXTS)}) v(license, kind, body)
    UNION
    FROM (VALUES {", ".join(map(str, LICENSE_DIGESTS))}) d(license, kind, digest)
),
units AS (
    SELECT doc_id, 'document' AS unit, text AS body FROM documents WHERE text IS NOT NULL
    UNION ALL
    SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL
)
SELECT doc_id, unit, license, kind, count(*) AS n_units
FROM (SELECT doc_id, unit, {_canonical("body")} AS canonical FROM units WHERE unit = 'document' OR body <> '') u
JOIN known ON digest = sha256(canonical)
WHERE canonical <> ''
GROUP BY ALL
"""

_WORD = "[^\\x20\\x09-\\x0D]+"
_AXES = range(1, quality_rules.DIM + 1)
_PAIRS = [(i, j) for i in _AXES for j in range(1, i + 1)]
_MEANS = ", ".join(f"m{i}" for i in _AXES)


def _distance(rows: str, estimates: str) -> str:
    """Subquery with d2: each y is the rest of an axis after the earlier ones."""
    inner = f"SELECT v.*, {', '.join(f'e.m{i}' for i in _AXES)}, {', '.join(f'e.l{i}{j}' for i, j in _PAIRS)} FROM {rows} v JOIN {estimates} e USING (g)"
    for i in _AXES:
        rest = "".join(f" - l{i}{j} * y{j}" for j in range(1, i))
        inner = f"SELECT *, (x{i} - m{i}{rest}) / l{i}{i} AS y{i} FROM ({inner})"
    return f"(SELECT *, {' + '.join(f'y{i} * y{i}' for i in _AXES)} AS d2 FROM ({inner}))"


def _concentrated(rows: str, estimates: str) -> str:
    sums = [f"sum(x{i}) AS t{i}" for i in _AXES] + [f"sum(x{i} * x{j}) AS t{i}{j}" for i, j in _PAIRS]
    names = ["n", *[f"t{i}" for i in _AXES], *[f"t{i}{j}" for i, j in _PAIRS]]
    bins = (
        f"SELECT g, least(floor(sqrt(d2) * 16)::BIGINT, {quality_rules.BINS - 1}) AS bin, count(*) AS n, {', '.join(sums)} "
        f"FROM {_distance(rows, estimates)} GROUP BY ALL"
    )
    inner = f"""SELECT g, {', '.join(f'sum({c})::DOUBLE AS {c}' for c in names)} FROM (
        SELECT *, coalesce(sum(n) OVER (PARTITION BY g ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nearer,
            sum(n) OVER (PARTITION BY g) AS total FROM ({bins})) WHERE nearer < total::DOUBLE * {quality_rules.CORE_SHARE} GROUP BY g"""
    inner = f"SELECT *, {', '.join(f't{i} / n AS m{i}' for i in _AXES)} FROM ({inner})"
    scatter = []
    for i, j in _PAIRS:
        value = f"(t{i}{j} / n - m{i} * m{j}) * {quality_rules.CONSISTENCY}::DOUBLE"
        if i == j:
            value = f"greatest({value}, 0.0::DOUBLE) + {quality_rules.FLOORS[i - 1] ** 2}::DOUBLE"
        scatter.append(f"{value} AS c{i}{j}")
    inner = f"SELECT *, {', '.join(scatter)} FROM ({inner})"
    for j in _AXES:
        for i in range(j, quality_rules.DIM + 1):
            rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
            value = f"sqrt(greatest({rest}, 1.0::DOUBLE))" if i == j else f"({rest}) / l{j}{j}"
            inner = f"SELECT *, {value} AS l{i}{j} FROM ({inner})"
    return f"SELECT g, {_MEANS}, {', '.join(f'l{i}{j}' for i, j in _PAIRS)} FROM ({inner})"


def _logged(count: str) -> str:
    return f"floor(log2(1.0::DOUBLE + {count} * 100.0::DOUBLE / n_words) * 64 + 0.5::DOUBLE)::BIGINT"


_DIAGONAL = ", ".join(
    f"greatest(1.4826::DOUBLE * s{i}, {quality_rules.FLOORS[i - 1]}::DOUBLE) AS l{i}{j}" if i == j else f"0.0::DOUBLE AS l{i}{j}"
    for i, j in _PAIRS
)
_ROUNDS = "".join(
    f",\ne{n} AS MATERIALIZED ({_concentrated('vectors', f'e{n - 1}')})" for n in range(1, quality_rules.CONCENTRATIONS + 1)
)

OP3 = f"""
WITH base AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS body,
        regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS ls
    FROM documents
),
places AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM base),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS times FROM places),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM windows, range(3) x(k) WHERE times > 1 GROUP BY r),
stats AS MATERIALIZED (
    SELECT r, doc_id, lang, source, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
        (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM base LEFT JOIN covered USING (r)
),
marked AS MATERIALIZED (
    SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.REPEAT_PERCENT} * n_words AS base_failed FROM stats
),
sized AS (
    SELECT *, count(*) OVER (PARTITION BY lang, source) AS n_pair, count(*) OVER (PARTITION BY lang) AS n_lang
    FROM marked WHERE NOT base_failed
),
named AS (
    SELECT *, min(n_pair) OVER (PARTITION BY lang) AS least_pair,
        struct_pack(l := lang, s := source, k := 2)::VARCHAR AS of_pair, struct_pack(l := lang, s := NULL, k := 1)::VARCHAR AS of_lang
    FROM sized
),
judged AS MATERIALIZED (
    SELECT r, n_pair, n_lang, least_pair, of_pair, of_lang, CASE WHEN n_pair >= {quality_rules.MIN_GROUP} THEN of_pair
            WHEN n_lang >= {quality_rules.MIN_GROUP} THEN of_lang ELSE 'all' END AS g,
        floor(word_chars / n_words * 64 + 0.5::DOUBLE)::BIGINT AS x1,
        {_logged("n_symbols")} AS x2, {_logged("n_dup_lines")} AS x3, {_logged("n_repeat_words")} AS x4
    FROM named
),
vectors AS MATERIALIZED (
    SELECT of_pair AS g, x1, x2, x3, x4 FROM judged WHERE n_pair >= {quality_rules.MIN_GROUP}
    UNION ALL
    SELECT of_lang, x1, x2, x3, x4 FROM judged WHERE n_lang >= {quality_rules.MIN_GROUP} AND least_pair < {quality_rules.MIN_GROUP}
    UNION ALL
    SELECT 'all', x1, x2, x3, x4 FROM judged WHERE EXISTS (FROM judged WHERE g = 'all')
),
medians AS MATERIALIZED (SELECT g, {", ".join(f"median(x{i})::DOUBLE AS m{i}" for i in _AXES)} FROM vectors GROUP BY g),
deviations AS (
    SELECT g, {", ".join(f"median(abs(x{i} - m{i}))::DOUBLE AS s{i}" for i in _AXES)} FROM vectors JOIN medians USING (g) GROUP BY g
),
e0 AS MATERIALIZED (SELECT g, {_MEANS}, {_DIAGONAL} FROM medians JOIN deviations USING (g)){_ROUNDS},
measured AS (SELECT r, d2 FROM {_distance("judged", f"e{quality_rules.CONCENTRATIONS}")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    coalesce(d2 <= {quality_rules.CUTOFF}::DOUBLE, false) AS kept, round(d2, 6) AS d2
FROM marked LEFT JOIN measured USING (r)
"""

OP8 = f"""
WITH RECURSIVE base AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws
    FROM documents
),
shingles AS MATERIALIZED (
    SELECT DISTINCT r, array_to_string(ws[i : i + 2], ' ') AS s
    FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM base WHERE len(ws) > 0)
),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (
    SELECT a.r AS a, b.r AS b, count(*) AS k
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY ALL
),
links AS MATERIALIZED (
    SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)
),
reach(a, b) AS (SELECT r, r FROM base UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id,
    d.doc_id IS NOT DISTINCT FROM min(o.doc_id) AS kept
FROM reach JOIN base d ON d.r = reach.a JOIN base o ON o.r = reach.b LEFT JOIN sizes ON sizes.r = reach.a
GROUP BY reach.a, d.doc_id
"""

# Positions are counted in half bytes of the hexadecimal text.
OP9 = """
WITH base AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
),
starts AS MATERIALIZED (
    SELECT r, i, md5_number(substr(h, 2 * i + 1, 800)) AS name
    FROM (SELECT r, h, unnest(range(0, greatest(len(h) // 2 - 399, 0))) AS i FROM base)
),
twice AS (SELECT name FROM starts GROUP BY name HAVING count(*) > 1),
found AS (SELECT r, i FROM starts SEMI JOIN twice USING (name)),
marked AS (SELECT r, i, coalesce(i > lag(i) OVER w + 400, true) AS opens FROM found WINDOW w AS (PARTITION BY r ORDER BY i)),
runs AS (SELECT r, i, sum(opens::INTEGER) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
spans AS (SELECT r, run, min(i) AS first, max(i) + 400 AS last FROM runs GROUP BY ALL),
cuts AS (SELECT r, list(struct_pack(f := first, l := last) ORDER BY first) AS c FROM spans GROUP BY r),
pieces AS (
    SELECT r, unnest(ps) AS piece, unnest(range(len(ps))) AS j
    FROM (SELECT row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS ps FROM documents)
),
ends AS (SELECT *, sum(strlen(piece)) OVER (PARTITION BY r ORDER BY j) AS e FROM pieces),
fifties AS MATERIALIZED (
    SELECT r, e - strlen(piece) AS s, lead(e, 50) OVER (PARTITION BY r ORDER BY j) AS e
    FROM ends WHERE regexp_matches(piece, '[^\\x20\\x09-\\x0D]')
),
phrases AS MATERIALIZED (
    SELECT f.r, f.s, f.e, md5_number(substr(h, (2 * s + 1)::BIGINT, (2 * (e - s))::BIGINT)) AS name FROM fifties f JOIN base USING (r) WHERE e IS NOT NULL
),
again AS (SELECT name FROM phrases GROUP BY name HAVING count(*) > 1),
islands AS (
    SELECT *, coalesce(s > max(e) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens
    FROM phrases SEMI JOIN again USING (name)
),
numbered AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY r ORDER BY s) AS island FROM islands),
passages AS (SELECT r, sum(n) AS n FROM (SELECT r, island, max(e) - min(s) AS n FROM numbered GROUP BY ALL) GROUP BY r),
kept AS (
    SELECT r, doc_id, h, coalesce(c, []) AS c,
        array_to_string(list_transform(range(0, len(coalesce(c, [])) + 1), lambda k:
            substr(h, CASE WHEN k = 0 THEN 1 ELSE 2 * c[k].l + 1 END,
                (CASE WHEN k = len(coalesce(c, [])) THEN len(h) ELSE 2 * c[k + 1].f END)
                - (CASE WHEN k = 0 THEN 0 ELSE 2 * c[k].l END))), '') AS rest
    FROM base LEFT JOIN cuts USING (r)
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, ((len(h) - len(rest)) // 2)::BIGINT AS n_removed,
    len(c)::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256, coalesce(n, 0)::BIGINT AS n_passage_bytes
FROM kept LEFT JOIN passages USING (r)
"""

OP11 = r"""
WITH base AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
    row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM base
WINDOW w AS (PARTITION BY body ORDER BY doc_id NULLS LAST, r)
"""

OP12 = """
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
        sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest
    FROM documents
),
hashed AS (SELECT *, len(units)::BIGINT AS n, list_transform(range(4), lambda i: ('0x' || substr(digest, 8 * i + 1, 8))::BIGINT) AS h FROM cut),
placed AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
        CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
            WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM hashed
),
parts AS (
    SELECT *, array_to_string(units[1 : low], '') AS p, array_to_string(units[low + 1 : high], '') AS m,
        array_to_string(units[high + 1 : n], '') AS s
    FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(body) AS restored_sha256
FROM parts
"""

OP13 = f"""
WITH base AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
        regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws
    FROM documents
),
failing AS (
    SELECT part, doc_id,
        CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 10 * length(body) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS f
    FROM base
),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
sets AS MATERIALIZED (
    SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM failing LEFT JOIN marks USING (doc_id) GROUP BY ALL
),
letters AS (SELECT unnest(string_split('ABCDE', '')) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
removal AS (
    SELECT *, coalesce(list_min(list_transform(string_split(f, ''), lambda x: CASE WHEN x <> '' THEN strpos(filter_order, x) END)), 6) AS gone
    FROM sets, orders
),
counted AS (
    SELECT part, filter_order, step, filter_order[step] AS x,
        coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone < step AND contains(f, filter_order[step])), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (f = filter_order[step]), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost
    FROM removal, range(1, 6) s(step) GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted
"""

ORACLES = {
    "op1_sharding": OP1,
    "op3_quality_rules": OP3,
    "op8_near_duplicates": OP8,
    "op9_repeated_passages": OP9,
    "op10_license_scan": OP10,
    "op11_exact_duplicates": OP11,
    "op12_fill_in_middle": OP12,
    "op13_filter_audit": OP13,
}
