"""DuckDB SQL of the operators whose results SQL can express, over the whole tables."""

from __future__ import annotations

from .common import LOWER, UPPER
from .cover_dedup import OP13_SQL
from .mixing import MAX_EPOCHS, WEIGHTS
from .mph_dedup import OP2_SQL
from .quality import (CLEAN_PRICE, DELTA, LENGTH_GRID, MAX_FALSE_REJECTION, MAX_REPEAT_PERCENT, MIN_WORDS, RULES,
                      SHARE_GRID)
from .warc import OP10_SQL

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

OP3_SQL = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
    FROM w
), n AS (
    SELECT w.doc_id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
), common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), e AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
    SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON e.x = reach.r
)
SELECT n.doc_id, n.n AS n_shingles, min(reach.r) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY 1, 2
"""

# The checksum's table follows from its polynomial; a text's bytes are read from its hexadecimal form.
OP4_SQL = """
WITH t AS (
    SELECT list(c ORDER BY i) AS crc FROM (
        SELECT i, list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
        FROM (SELECT unnest(range(256)) AS i))
), d AS (
    SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h,
        md5('shard-1:' || coalesce(doc_id::VARCHAR, '')) AS k
    FROM documents
), b AS (
    SELECT doc_id, xor(list_reduce([('0x' || x)::BIGINT for x in regexp_extract_all(h, '..')],
        lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc
    FROM d, t
), r AS (
    SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY k, doc_id) - 1) / (2.0::DOUBLE * count(*) OVER (PARTITION BY source)) AS f FROM d
), p AS (
    SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, k, doc_id) - 1 AS place, count(*) OVER () AS n FROM r
)
SELECT p.doc_id, p.size, coalesce(b.crc, 0) AS text_crc32, 'rows' AS law, (place * 16 // n)::INT AS shard,
    place - ((place * 16 // n) * n + 15) // 16 AS slot, NULL::INT AS grown_shard
FROM p JOIN b USING (doc_id)
"""

_WEIGHTS = "([" + ", ".join(f"{w}.0" for w in WEIGHTS) + "]::DOUBLE[])"
OP6_SQL = f"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
        md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), s AS (
    SELECT *, {_WEIGHTS}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w, {MAX_EPOCHS} * total::DOUBLE AS cap
    FROM (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY 1)
), o AS (  -- sources in the order in which the rising level clamps them
    SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS r FROM s
), a AS (  -- the level when the first j sources are clamped
    SELECT j, (sum(total) - coalesce(sum(cap) FILTER (r <= j), 0)) / sum(w) FILTER (r > j) AS level,
        min(cap / w) FILTER (r > j) AS next_cap
    FROM o, (SELECT unnest(range((SELECT count(*) FROM s))) AS j) GROUP BY j
), lv AS (
    SELECT arg_min(level, j) AS level FROM a WHERE level <= next_cap
), g AS (
    SELECT source, total, least(cap, w * level) AS target FROM s, lv
), m AS (
    SELECT d.*, g.total, g.target, CASE WHEN g.total > 0 THEN floor(g.target / g.total) ELSE 0 END::BIGINT AS whole,
        sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), x AS (
    SELECT *, target - whole * total AS rest, (size > 0 AND target - whole * total > 0 AND before + size / 2.0::DOUBLE <= target - whole * total)::INT AS extra FROM m
), gp AS (
    SELECT *, rest - sum(extra * size) OVER (PARTITION BY source) AS gap FROM x
), sw AS (
    SELECT source, arg_min(doc_id, struct_pack(o := abs(abs(gap) - size), k := k, i := doc_id)) AS swap_id
    FROM gp WHERE size > 0 AND rest > 0 AND (gap > 0 AND extra = 0 OR gap < 0 AND extra = 1) AND abs(abs(gap) - size) < abs(gap)
    GROUP BY 1
)
SELECT doc_id, size, total AS source_size, target,
    size * (whole + CASE WHEN doc_id = swap_id THEN 1 - extra ELSE extra END) AS taken
FROM gp LEFT JOIN sw ON gp.source IS NOT DISTINCT FROM sw.source
"""


def _grid(rule: str, share: str) -> str:
    return " + ".join(f"({share} >= {c}::DOUBLE)::INT" for c in RULES[rule])


_SHARES = {
    "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "word_chars"), "mean_word_chars": ("word_chars", "n_words"),
}


def _share(rule: str) -> str:
    a, b = _SHARES[rule]
    return f"(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END)"


_ALPHA = MAX_FALSE_REJECTION / len(RULES)
OP7_SQL = f"""
WITH w AS (
    SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), win AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
    SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1)
    GROUP BY 1
), c AS (
    SELECT w.doc_id, coalesce('=' || lang, 'null') AS stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
        length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM w LEFT JOIN rep USING (doc_id)
), f AS (
    SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c
), held AS (
    SELECT f.*, q FROM f JOIN (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY 1) USING (doc_id)
    WHERE NOT base_failed OR q > 0
), flat AS (
    {" UNION ALL ".join(f"SELECT stratum, q, '{r}' AS rule, {_grid(r, _share(r))} AS level FROM held" for r in RULES)}
), cell AS (
    SELECT stratum, rule, level, count(*) FILTER (q > 0) AS good, count(*) FILTER (q <= 0) AS bad FROM flat GROUP BY ALL
), cum AS (
    SELECT stratum, rule, level, sum(good) OVER (PARTITION BY stratum, rule) AS n,
        sum(good) OVER (PARTITION BY stratum, rule ORDER BY level DESC) AS k, sum(bad) OVER (PARTITION BY stratum, rule ORDER BY level DESC) AS junk,
        CASE WHEN rule = 'mean_word_chars' THEN {list(LENGTH_GRID)}[level] ELSE {list(SHARE_GRID)}[level]::DOUBLE END AS cutoff
    FROM cell
), ok AS (
    SELECT *, junk - {CLEAN_PRICE} * k AS worth FROM cum
    WHERE level > 0 AND n > 0 AND k < n * {_ALPHA}
      AND list_sum(list_transform(range(0, k::BIGINT + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
            + i * ln({_ALPHA}) + (n - i) * ln(1 - {_ALPHA})))) <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM cell) * {len(RULES)})
), best AS (
    SELECT stratum, rule, arg_max(cutoff, struct_pack(w := worth, c := cutoff)) AS cutoff FROM ok WHERE worth > 0 GROUP BY ALL
), hit AS (
    SELECT DISTINCT doc_id FROM f JOIN best USING (stratum) WHERE CASE rule
        {" ".join(f"WHEN '{r}' THEN {_share(r)} >= cutoff" for r in RULES)} END
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept
FROM f
"""

# The checksum's table, as above.
_CRC_TABLE = """SELECT list(c ORDER BY i) AS crc FROM (
        SELECT i, list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
        FROM (SELECT unnest(range(256)) AS i))"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join([*map(_either_case, ("password", "passwd", "secret", "token")),
                          _either_case("api") + "_?" + _either_case("key")]) + r""")["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)"""
_PATTERNS = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{24,}",
             "github": "gh[pousr]_[A-Za-z0-9]{36,}", "npm": "npm_[A-Za-z0-9]{36,}"}


def _found(number: int, kind: str) -> str:
    p = _PATTERNS[kind].replace("\\'", "''")
    value = f"regexp_extract_all(t, '{p}', 2)" if kind == "assign" else f"regexp_extract_all(t, '{p}')"
    return (f"SELECT doc_id, {number} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS ms, {value} AS vs, "
            f"string_split_regex(t, '{p}') AS ps FROM d")


# Matches are placed by the lengths of what lies between them.
OP9_SQL = f"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), crc_table AS ({_CRC_TABLE}), f AS (
    {" UNION ALL ".join(_found(i, k) for i, k in enumerate(_PATTERNS))}
), m AS (
    SELECT doc_id, k, kind, ms[i] AS m, vs[i] AS v, coalesce(list_sum([length(x) for x in ps[1:i]]), 0)
        + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS a
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f)
), sums AS (
    SELECT m.*, CASE WHEN k > 2 AND length(m) = 40 THEN
        xor(list_reduce([ascii(x)::BIGINT for x in string_split(m[5:34], '')], lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]),
            4294967295::BIGINT), 4294967295) END AS crc,
        list_reduce([(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', x) - 1)::BIGINT for x in string_split(m[35:40], '')],
            lambda c, x: c * 62 + x, 0::BIGINT) AS told
    FROM m, crc_table
), ok AS (
    SELECT doc_id, k, a, kind || ':' || a::BIGINT || ':' || (a + length(m))::BIGINT AS s FROM sums
    WHERE CASE kind WHEN 'assign' THEN length(v) >= 6 WHEN 'access' THEN length(m) >= 20 WHEN 'hex' THEN length(m) >= 24 ELSE crc = told END
)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    sha256(coalesce(string_agg(s, ',' ORDER BY a, k) FILTER (k <= 2), '')) AS base_sha256,
    coalesce(string_agg(s, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN ok USING (doc_id) GROUP BY 1
"""

# The checksum's table as in OP4_SQL; a decimal's bytes are its characters.
OP11_SQL = """
WITH t AS (
    SELECT list(c ORDER BY i) AS crc FROM (
        SELECT i, list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
        FROM (SELECT unnest(range(256)) AS i))
), r AS (
    SELECT conv_id, turn, strlen(coalesce(text, '')) AS b,
        sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS dg
    FROM conversations WHERE conv_id IS NOT NULL
), o AS (
    SELECT conv_id, list(dg ORDER BY turn NULLS FIRST, dg) AS ds, list(b ORDER BY turn NULLS FIRST, dg) AS bs FROM r GROUP BY 1
), h AS (
    SELECT o.*, xor(list_reduce([ascii(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')],
        lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 9 AS h
    FROM o, t
), s AS (
    SELECT h.conv_id AS c, list_concat(coalesce(b.ds[1:h.h], []), h.ds[h.h + 1:]) AS ds,
        list_concat(coalesce(b.bs[1:h.h], []), h.bs[h.h + 1:]) AS bs
    FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5
), p AS (
    SELECT c, d, len(ds) AS n, array_to_string(ds[1:d], ',') AS k, CASE WHEN d > 0 THEN array_to_string(ds[1:d - 1], ',') END AS pk,
        CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b
    FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS d FROM s)
), g AS (
    SELECT d, k, any_value(pk) AS pk, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS own,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n), '')) AS ends_sha256
    FROM p GROUP BY d, k
), kids AS (
    SELECT d - 1 AS d, pk AS k, count(*) AS n FROM g WHERE d > 0 GROUP BY 1, 2
), m AS (
    SELECT g.*, coalesce(kids.n, 0) AS n_children FROM g LEFT JOIN kids USING (d, k)
), under AS (  -- every node and each node above it, along the path of its smallest member
    SELECT p.d, p.k, sum(m.own) AS saved, count(*) FILTER (m.n_children = 0) AS leaves
    FROM m JOIN p ON p.c = m.c AND p.d <= m.d GROUP BY 1, 2
)
SELECT m.c AS conv_id, m.d AS depth, parent.c AS parent_conv_id, m.n_convs, m.n_children, under.leaves AS n_leaves,
    under.saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN under USING (d, k) LEFT JOIN m AS parent ON parent.d = m.d - 1 AND parent.k = m.pk
"""

SQL: dict[str, str] = {
    "op2_mph_exact_dedup": OP2_SQL,
    "op3_parity_sketch_join": OP3_SQL,
    "op4_stratified_interleave": OP4_SQL,
    "op6_capped_water_filling": OP6_SQL,
    "op7_risk_controlled_rules": OP7_SQL,
    "op9_secret_scan": OP9_SQL,
    "op10_warc_index_merge": OP10_SQL,
    "op11_zfast_conversation_trie": OP11_SQL,
    "op13_difference_cover_dedup": OP13_SQL,
}
