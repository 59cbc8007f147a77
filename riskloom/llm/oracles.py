"""SQL twins (DuckDB) of the operators that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from .decontaminate import WINDOW
from .licenses import TEMPLATES, THRESHOLD, anchors
from .queries import CONTROL
from .vptree import K


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP2 = f"""
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
d AS (SELECT * FROM v WHERE len(v) = (SELECT len(v) FROM v GROUP BY ALL ORDER BY count(*) DESC, len(v) LIMIT 1)),
p AS (SELECT q.vec_id AS query_id, x.vec_id, max(list_inner_product(q.v, x.v)) AS score
  FROM d q JOIN d x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""

_ESCAPE = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')"
OP3 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {_q(CONTROL)}), (-1, 1, 'assistant', {_q(CONTROL)})),
e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPE.format("text")}) + CASE WHEN before IS DISTINCT FROM role THEN 9 + length({_ESCAPE.format("role")}) ELSE 3 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
n AS (SELECT item, w, least(len(w), {WINDOW}) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM n, unnest(range(1, len(w) - k + 2)) AS x(i)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM d, ks, unnest(range(1, len(w) - k + 2)) AS x(i)),
h AS (SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, win)),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(range(i, i + k)) AS u(q) GROUP BY doc_id),
o AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN o USING (doc_id)
"""

_TEMPLATES = ", ".join(f"({i}, {_q(name)}, {_q(text)})" for i, (name, text) in enumerate(TEMPLATES))
_ANCHORS = ", ".join(f"({_q(w)}, {p}, {n})" for w, p, n in anchors(TEMPLATES))
_ONE = r"trim(regexp_replace({}, ' *\n[ \n]*', ' ', 'g'))"
OP10 = f"""
WITH t(template, license, text) AS (VALUES {_TEMPLATES}),
tw AS (SELECT template, license, string_split(trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS w FROM t),
tg AS (SELECT template, w[i] || ' ' || w[i + 1] AS gram, count(*) AS times FROM tw, unnest(range(1, len(w))) AS x(i) GROUP BY ALL),
tn AS (SELECT template, license, len(w) - 1 AS n FROM tw),
an(word, before, words) AS (VALUES {_ANCHORS}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
f AS (SELECT rid, lower(regexp_replace(text, ' *[^A-Za-z0-9\n ][^A-Za-z0-9\n]*| {{2,}}', ' ', 'g')) AS flat FROM docs WHERE text IS NOT NULL),
ws AS (SELECT rid, string_split({_ONE.format("flat")}, ' ') AS w FROM f),
wi AS (SELECT rid, array_to_string(w[greatest(1, i - before):i - before + words - 1], ' ') AS unit FROM ws, unnest(range(1, len(w) + 1)) AS x(i) JOIN an ON w[i] = word),
u AS (SELECT rid, unnest(list_transform(list_concat(string_split(flat, chr(10)), string_split_regex(flat, '\n(?: ?\n)+'), [flat]),
  lambda l: {_ONE.format("l")})) AS unit FROM f UNION SELECT rid, unit FROM wi),
uw AS (SELECT rid, unit, string_split(unit, ' ') AS w FROM u WHERE unit <> ''),
s AS (SELECT * FROM uw WHERE len(w) >= 2 AND len(w) - 1 <= (SELECT max(n) * (2 - {THRESHOLD}) / {THRESHOLD} + 1 FROM tn)),
g AS (SELECT rid, unit, len(w) - 1 AS n, w[i] || ' ' || w[i + 1] AS gram, count(*) AS times FROM s, unnest(range(1, len(w))) AS x(i) GROUP BY ALL),
m AS (SELECT rid, unit, template, any_value(g.n) AS n, sum(least(g.times, tg.times)) AS shared FROM g JOIN tg USING (gram) GROUP BY ALL),
r AS (SELECT rid, unit, template, license, CAST(2 * shared AS DOUBLE) / (m.n + tn.n) AS dice FROM m JOIN tn USING (template)),
best AS (SELECT rid, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n_matches
  FROM r WHERE dice >= {THRESHOLD} GROUP BY rid)
SELECT d.doc_id, license, dice, licenses, coalesce(n_matches, 0) AS n_matches FROM docs d LEFT JOIN best USING (rid)
"""

OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
u AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
o AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM u, (VALUES (1), (2), (3), (4)) AS ks(k)),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT * FROM g WHERE f >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE k >= 2),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS j FROM c),
parts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS part, array_to_string(w[j + 1:], ' ') AS rest FROM cuts),
s AS (SELECT parts.*, b.f AS l, e.f AS r, CAST((2000000::HUGEINT * a) // (b.f + e.f) AS BIGINT) AS score FROM parts
  JOIN often b ON b.lang = parts.lang AND b.phrase = part JOIN often e ON e.lang = parts.lang AND e.phrase = rest),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase FROM c WHERE k > 2),
inside AS (SELECT lang, phrase, max(a) AS top FROM longer GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE top IS NULL OR 100 * top < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op2_vp_trees": OP2,
    "op3_chat_format": OP3,
    "op5_decontaminate": OP5,
    "op10_license_scan": OP10,
    "op11_collocations": OP11,
}
