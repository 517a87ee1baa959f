"""DuckDB SQL for the operators that SQL can express, over the same Parquet tables."""

from __future__ import annotations

from . import chat, quality, repeats, secrets

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, {2 * repeats.WIDTH})) AS g FROM (SELECT doc_id, h, unnest(range(n - {repeats.WIDTH - 1})) AS i FROM d WHERE n >= {repeats.WIDTH})),
r AS (SELECT g FROM w GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {repeats.WIDTH}, true) AS first FROM w WHERE g IN (SELECT g FROM r)),
t AS (SELECT doc_id, i, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM s),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + {repeats.WIDTH} AS e FROM t GROUP BY 1, 2),
v AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM u),
k AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS kept, max(e) AS last FROM v JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_SHINGLED = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS x FROM d),
c AS (SELECT x, len(x) AS n, min(doc_id) AS rep, count(*) AS copies FROM s WHERE len(x) > 0 GROUP BY 1),
p AS (SELECT rep, n, unnest(x) AS t FROM c),
f AS (SELECT a.rep AS u, b.rep AS v, a.n + b.n - count(*) AS whole, count(*) AS common FROM p a JOIN p b ON a.t = b.t AND a.rep < b.rep AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.rep, b.rep, a.n, b.n),
l AS (SELECT u, v FROM f WHERE 100 * common >= 90 * whole),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u AS rep, u AS root FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.rep),
g AS (SELECT rep, min(root) AS root FROM r GROUP BY 1),
k AS (SELECT e.u AS rep, sum(c.copies)::BIGINT AS others FROM e JOIN c ON c.rep = e.v GROUP BY 1)
"""

OP4 = f"""{_SHINGLED}
SELECT s.doc_id, len(s.x)::BIGINT AS n_shingles, coalesce(g.root, c.rep, s.doc_id) AS component_id, coalesce(c.copies - 1, 0) + coalesce(k.others, 0) AS n_links
FROM s LEFT JOIN c ON s.x = c.x LEFT JOIN g ON g.rep = c.rep LEFT JOIN k ON k.rep = c.rep
"""


def _spans(kind: int, pattern: str, value: int, least: int) -> str:
    """Matches of a pattern with their places, from the lengths of the matches and of what lies between them."""
    p = pattern.replace("'", "''")
    m = f"SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {value}) AS v, string_split_regex(t, '{p}') AS gaps FROM d"
    rows = f"SELECT doc_id, unnest(m) AS m, unnest(v) AS v, unnest(gaps[1:len(m)]) AS gap, unnest(range(len(m))) AS k FROM ({m}) WHERE len(m) > 0"
    ends = f"SELECT doc_id, m, v, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS e FROM ({rows})"
    return f"SELECT doc_id, (e - length(m))::BIGINT AS a, e::BIGINT AS e, {kind} AS kind, m FROM ({ends}) WHERE length(v) >= {least}"


def _class_limit(k: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(m, '{row[0]}') THEN {row[k]}" for row in secrets.LIMITS) + " END"


# The allowed candidates, without a look ahead and a back reference, which this SQL's patterns lack.
_ALLOWED = " OR ".join(
    ["regexp_matches(m, '{}')".format(p.replace("(?![=/_-])", "([^=/_-]|$)").replace("{2,}+", "{2,}")) for p in secrets.ALLOWED[:-1]]
    + [f"(length(m) % {p} = 0 AND length(m) >= {2 * p} AND m = repeat(substr(m, 1, {p}), (length(m) / {p})::INT))" for p in (1, 2, 3, 4)]
)

OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS ({_spans(0, secrets.ASSIGN, 2, secrets.LEAST["assign"])} UNION ALL {_spans(1, secrets.ACCESS, 0, secrets.LEAST["access"])} UNION ALL {_spans(2, secrets.HEX, 0, secrets.LEAST["hex"])}),
c AS (SELECT *, CASE WHEN length(m) >= {secrets.WINDOW} THEN {secrets.WINDOW} ELSE {secrets.SHORT_WINDOW} END AS w, CASE WHEN length(m) >= {secrets.WINDOW} THEN {_class_limit(1)} ELSE {_class_limit(2)} END AS lim FROM ({_spans(3, secrets.CANDIDATE, 0, 1)}) WHERE NOT ({_ALLOWED})),
o AS (SELECT doc_id, a, e, w, lim, m, unnest(range(length(m) - w + 1)) AS i FROM c),
x AS (SELECT doc_id, a, e, w, lim, i, unnest(string_split(substr(m, i + 1, w), '')) AS ch FROM o),
y AS (SELECT doc_id, a, e, w, lim, i, ch, count(*) AS k FROM x GROUP BY ALL),
z AS (SELECT DISTINCT doc_id, a, e FROM (SELECT doc_id, a, e, w, lim, i, sum(k * log2(k)) AS s FROM y GROUP BY ALL) WHERE s <= w * (log2(w) - lim) + 1e-9),
q AS (SELECT doc_id, a, e, kind FROM b UNION ALL SELECT doc_id, a, e, 3 FROM z WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = z.doc_id AND b.a <= z.a AND z.e <= b.e)),
n AS (SELECT doc_id, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || a || ':' || e AS line, a, kind FROM q)
SELECT d.doc_id, coalesce(sum((kind = 0)::INT), 0)::BIGINT AS n_assign, coalesce(sum((kind = 1)::INT), 0)::BIGINT AS n_access, coalesce(sum((kind = 2)::INT), 0)::BIGINT AS n_hex,
sha256(coalesce(string_agg(line, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(line, ',' ORDER BY a, kind), '') AS spans
FROM d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

_NEWLINE = "chr(10)"
_MARKS = len(chat.OPEN) + len(chat.MIDDLE) + len(chat.CLOSE)

OP8 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
k AS (SELECT *, ceil((octet_length(encode(text)) + octet_length(encode(role))) / 3)::BIGINT + 6 AS tokens, {_MARKS} + length(role) + length(regexp_replace(role, '[^\\#<:]+', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]+', '', 'g')) AS chars FROM t),
n AS (SELECT *, row_number() OVER o - 1 AS place, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(tokens) OVER (PARTITION BY conv_id) AS total FROM k WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT conv_id AS sc, tokens AS st, chars AS schars FROM n WHERE place = 0 AND role = '{chat.SYSTEM}'),
g AS (SELECT n.*, schars, greatest(floor(({chat.BUDGET - chat.HISTORY} - coalesce(st, 0)) / 2), 1) AS stride FROM n LEFT JOIN s ON n.conv_id IS NOT DISTINCT FROM sc),
w AS (SELECT *, floor(before / stride) AS w FROM g),
e AS (SELECT *, max(before + tokens) OVER (PARTITION BY conv_id, w) AS fin FROM w),
x AS (SELECT conv_id, w, place, chars, schars FROM e UNION ALL SELECT conv_id, floor(fin / stride), place, chars, schars FROM e WHERE fin < total AND fin - before <= {chat.HISTORY} AND NOT (place = 0 AND schars IS NOT NULL)),
y AS (SELECT conv_id, w, sum(chars) + CASE WHEN max(schars) IS NOT NULL AND min(place) > 0 THEN max(schars) ELSE 0 END AS chars FROM x GROUP BY 1, 2),
f AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM y GROUP BY 1),
r AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || {_NEWLINE} || text || {_NEWLINE}, '' ORDER BY place)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY place) FILTER (role = '{chat.TARGET}'), '') AS loss FROM n GROUP BY 1)
SELECT r.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id
"""

_RULES = quality.Rules()

OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, {_NEWLINE}), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {quality.GRAM - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality.GRAM - 2})) AS i FROM w WHERE len(w) >= {quality.GRAM})),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range({quality.GRAM})) AS j FROM h WHERE c > 1) GROUP BY 1),
q AS (SELECT doc_id, source, t, unnest(list_transform(l, lambda x: trim(lower(x), ' '))) AS line FROM w),
k AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY 1),
o AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT t) AS n FROM q GROUP BY 1, 2) JOIN k USING (source) WHERE n > least(greatest({_RULES.line_docs}, {_RULES.line_share} * docs), {max(_RULES.line_docs, _RULES.line_most)})),
z AS (SELECT doc_id, sum(len(regexp_extract_all(line, '{_WORD}')))::BIGINT AS gone FROM q JOIN o USING (source, line) GROUP BY 1),
b AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^{quality.SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0) AS gone FROM w LEFT JOIN r USING (doc_id) LEFT JOIN z USING (doc_id)),
f AS (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND (gone = 0 OR n_words - gone >= {_RULES.min_left} AND 100 * (n_words - gone) >= {_RULES.min_left_share} * n_words) AS kept FROM f
"""

SQL = {"op1_suffix_dedup": OP1, "op4_jaccard_join": OP4, "op6_secret_scan": OP6, "op8_chat_format": OP8, "op10_quality_rules": OP10}
