"""The registered queries again, as DuckDB SQL, from the same rule list and constants.

DuckDB's regular expressions are RE2, the dialect the rules are written in, so patterns go in as they are.
"""

from __future__ import annotations

import hashlib

from ..functions.rules import EXFIL, INJECTION, MALWARE, MAX_SCORE, PII, RISKY, SECRETS, SEVERITIES, VISIBLE_RULES, WEIGHTS, Rule
from ..operators import audit, policy
from . import corpus


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


PROMPTS = f"prompts(idx, content) AS ({values(list(enumerate(corpus.PROMPTS)))})"
_RANK = {s: i + 1 for i, s in enumerate(SEVERITIES)}
def rules_cte(rules: list[Rule]) -> str:
    rows = [(n, r.id, r.category, r.type, r.detail, f"CAST({r.confidence} AS DOUBLE)", r.severity, _RANK[r.severity], WEIGHTS[_RANK[r.severity] - 1], r.pattern) for n, r in enumerate(rules)]
    listed = values(rows).replace("'CAST(", "CAST(").replace(" AS DOUBLE)'", " AS DOUBLE)")
    return f"rules(no, id, category, type, detail, confidence, severity, rank, weight, pattern) AS ({listed})"


RULES = rules_cte(VISIBLE_RULES)


def spans_sql(text: str, rules: list[Rule]) -> str:
    """CASE expressions for byte offsets of the first match, by rule number."""

    def lead(r: Rule) -> str:
        flags, body = ("(?i)", r.pattern[4:]) if r.pattern.startswith("(?i)") else ("", r.pattern)
        return f"strlen(regexp_extract({text}, {q(f'{flags}(?s:^(.*?))(?:{body})')}, 1))"

    at = {n: r for n, r in enumerate(VISIBLE_RULES) if r in rules and r.has_span}
    start = " ".join(f"WHEN {n} THEN {lead(r)}" for n, r in at.items())
    end = " ".join(f"WHEN {n} THEN {lead(r)} + strlen(regexp_extract({text}, {q(r.pattern)}))" for n, r in at.items())
    return f"CAST(CASE no {start} END AS INTEGER) AS span_start, CAST(CASE no {end} END AS INTEGER) AS span_end"


def flag(name: str, category: str) -> str:
    return f"coalesce(bool_or(category = {q(category)}), false) AS {name}"


_TOOLS = " ".join(f"WHEN {q(k)} THEN {[*v]}" if v else f"WHEN {q(k)} THEN CAST([] AS VARCHAR[])" for k, v in corpus.TOOLS.items())
HITS = f"""hits AS (SELECT idx, no FROM prompts, rules WHERE regexp_matches(content, pattern)),
pf AS (SELECT p.idx, any_value(p.content) AS content, count(no) AS n_findings, coalesce(max(rank), 0) AS worst,
  CAST(least({MAX_SCORE}, coalesce(sum(weight), 0)) AS INTEGER) AS base, count(DISTINCT category) AS n_cat,
  {flag("sec", SECRETS)}, {flag("mal", MALWARE)}, {flag("inj", INJECTION)}, {flag("pii", PII)}, {flag("exf", EXFIL)}, {flag("ops", RISKY)}
  FROM prompts p LEFT JOIN hits USING (idx) LEFT JOIN rules USING (no) GROUP BY p.idx)"""
BASE = f"""WITH {PROMPTS}, {RULES},
{HITS},
requests AS (SELECT event_id AS event_no, 'evt_' || event_id AS event_id, ts, 't' || (user_id % 5) AS tenant_id, 's' || user_id AS session_id,
  {corpus.PROFILES}[event_id % {len(corpus.PROFILES)} + 1] AS policy_profile,
  CASE event_type {_TOOLS} ELSE CAST([] AS VARCHAR[]) END AS tools, CAST((event_id * 7 + user_id) % {len(corpus.PROMPTS)} AS INTEGER) AS idx FROM events),
e AS (SELECT r.*, pf.* EXCLUDE (idx), len(list_filter(tools, lambda t: lower(t) IN ({", ".join(map(q, policy.PRIVILEGED))}))) > 0 AS priv,
  tenant_id || ':' || session_id AS session_key FROM requests r JOIN pf USING (idx)),
"""


def _parts(again: str, exfil: str, blocked: str) -> list[tuple[str, str, str]]:
    head, _, tail = policy.CROSS_SIGNAL.partition("%d")
    return [
        ("n_cat >= 2", f"{q(head)} || n_cat || {q(tail)}", f"{policy.PER_CATEGORY} * (n_cat - 1)"),
        *(
            (cond, q(text), str(bonus))
            for cond, (text, bonus) in [
                ("inj AND exf", policy.INJECTION_EXFIL),
                ("sec AND exf", policy.SECRET_EXFIL),
                ("mal AND ops", policy.MALWARE_RISKY),
                ("priv AND (inj OR exf OR ops)", policy.PRIVILEGED_ATTACK),
                (f"{again} AND inj", policy.REPEAT_INJECTION),
                (f"{exfil} AND exf", policy.REPEAT_EXFIL),
                (f"{blocked} AND n_findings > 0", policy.RECENT_BLOCK),
            ]
        ),
    ]


def score_sql(again: str = "false", exfil: str = "false", blocked: str = "false") -> str:
    terms = " + ".join(f"CASE WHEN {c} THEN {b} ELSE 0 END" for c, _, b in _parts(again, exfil, blocked))
    return f"CAST(least({MAX_SCORE}, base + {terms}) AS INTEGER)"


def factors_sql(again: str = "false", exfil: str = "false", blocked: str = "false") -> str:
    each = ", ".join(f"CASE WHEN {c} THEN {f} END" for c, f, _ in _parts(again, exfil, blocked))
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


def case_sql(profile: str, escalated: str, score: str) -> str:
    """Struct (level, reason)."""
    grave, armed = "sec OR mal OR worst = 4", "priv AND (inj OR exf OR ops)"

    def chain(cases: list[tuple[str, str, str]]) -> str:
        *most, last = [(c, f"{{'level': {q(level)}, 'reason': {q(reason)}}}") for c, level, reason in cases]
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in most) + f" ELSE {last[1]} END"

    b, r = policy.BLOCK, policy.REVIEW
    s, m, p = policy.STRICT_REASONS, policy.MODERATE_REASONS, policy.PERMISSIVE_REASONS
    strict = chain(
        [
            (grave, b, s[0]), (armed, b, s[1]), (f"{escalated} AND (inj OR exf)", b, s[2]), ("pii OR worst = 3", b, s[3]),
            ("inj OR worst = 2", r, s[4]), ("", r, s[5]),
        ]
    )
    moderate = chain(
        [
            (grave, b, m[0]), (armed, b, m[1]), (f"{escalated} AND {score} >= {policy.MODERATE_ESCALATION}", b, m[2]),
            ("pii OR inj", r, m[3]), ("exf OR ops", r, m[4]), ("", r, m[5]),
        ]
    )
    permissive = chain(
        [
            (grave, b, p[0]), (f"({armed}) AND {score} >= {policy.PERMISSIVE_PRIVILEGED}", b, p[1]),
            (f"{escalated} AND {score} >= {policy.PERMISSIVE_ESCALATION}", b, p[2]), ("", r, p[3]),
        ]
    )
    safe = f"{{'level': {q(policy.SAFE)}, 'reason': {q(policy.NO_ISSUES)}}}"
    return f"CASE WHEN n_findings = 0 THEN {safe} WHEN {profile} = 'strict' THEN {strict} WHEN {profile} = 'permissive' THEN {permissive} ELSE {moderate} END"


def decided(profile: str) -> str:
    """CTE ``d``: decisions without sessions."""
    return f"""s AS (SELECT *, {score_sql()} AS risk_score, {factors_sql()} AS factors FROM e),
c AS (SELECT *, {case_sql(profile, "false", "risk_score")} AS k FROM s),
d AS (SELECT * EXCLUDE (k), k.level AS risk_level, k.reason || CASE WHEN len(factors) > 0 THEN ' [' || array_to_string(factors, '; ') || ']' ELSE '' END AS reasoning FROM c)
"""


_EARLIER = "OVER (PARTITION BY session_key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SESSIONS = f"""f AS (SELECT session_key, category, row_number() OVER (PARTITION BY session_key ORDER BY ts, event_id, no) AS seq FROM e JOIN hits USING (idx) JOIN rules USING (no)),
b AS (SELECT *, CAST(count(*) {_EARLIER} AS INTEGER) AS recent_scans, coalesce(sum(n_findings) {_EARLIER}, 0) AS prior FROM e),
m AS (SELECT event_no, count(*) FILTER (category = {q(INJECTION)}) >= 2 AS again, count(*) FILTER (category = {q(EXFIL)}) >= 2 AS exfil,
  coalesce(string_agg(category, ',' ORDER BY seq), '') AS remembered
  FROM b LEFT JOIN f ON f.session_key = b.session_key AND f.seq > b.prior - 6 AND f.seq <= b.prior GROUP BY event_no),
w AS (SELECT b.*, m.* EXCLUDE (event_no) FROM b JOIN m USING (event_no)),
one AS (SELECT *, {case_sql("policy_profile", "false", score_sql("again", "exfil"))}.level = 'BLOCK' AS base_block FROM w),
two AS (SELECT *, coalesce(bool_or(base_block) {_EARLIER}, false) AS blocked FROM one),
s AS (SELECT *, {score_sql("again", "exfil", "blocked")} AS risk_score, {factors_sql("again", "exfil", "blocked")} AS factors, blocked AND (again OR exfil) AS esc FROM two),
c AS (SELECT *, {case_sql("policy_profile", "esc", "risk_score")} AS k FROM s),
d AS (SELECT * EXCLUDE (k), k.level AS risk_level, k.reason || CASE WHEN len(factors) > 0 THEN ' [' || array_to_string(factors, '; ') || ']' ELSE '' END AS reasoning FROM c)
"""


def hmac_sql(secret: str, message: str) -> str:
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(k ^ pad for k in key).hex() for pad in (0x36, 0x5C))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"


def payload_sql(prev: str) -> str:
    fields = ["event_id", "tenant_id", "session_id", "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')", "risk_level", "risk_score", "n_findings", "policy_profile"]
    return " || '|' || ".join([f"CAST({f} AS VARCHAR)" for f in fields] + [prev])


def chain_sql(secret: str) -> str:
    """CTEs ``numbered`` and ``chained`` over ``d``: a chain per tenant and day."""
    signed = hmac_sql(secret, payload_sql("prev"))
    return f""", numbered AS (SELECT event_id, tenant_id, session_id, ts, risk_level, risk_score, n_findings, policy_profile, strftime(ts, '%Y-%m-%d') AS day,
  row_number() OVER (PARTITION BY tenant_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) - 1 AS seq FROM d),
chained AS (SELECT event_id, tenant_id, day, seq, '' AS prev_signature, {signed.replace("prev", "''")} AS signature FROM numbered WHERE seq = 0
  UNION ALL SELECT n.event_id, n.tenant_id, n.day, n.seq, c.signature, {hmac_sql(secret, payload_sql("c.signature")).replace("CAST(", "CAST(n.").replace("CAST(n.strftime(ts", "CAST(strftime(n.ts")}
  FROM numbered n JOIN chained c ON n.tenant_id = c.tenant_id AND n.day = c.day AND n.seq = c.seq + 1)
"""


def merkle_sql(secret: str, levels: int = 5) -> str:
    """CTEs up to ``seals`` over ``chained``: a tree of 16 children a node for each chain, up to 16^levels entries."""
    parts = [
        "k0 AS (SELECT tenant_id, day, seq AS node, sha256(from_hex('00') || encode(signature)) AS d, max(seq) OVER (PARTITION BY tenant_id, day) AS last FROM chained)"
    ]
    for k in range(1, levels + 1):
        open_ = f" WHERE last >= {audit.FAN ** (k - 1)}" if k > 1 else ""
        parts.append(
            f"k{k} AS (SELECT tenant_id, day, node // {audit.FAN} AS node, sha256(from_hex('01') || encode(string_agg(d, '' ORDER BY node))) AS d, any_value(last) AS last "
            f"FROM k{k - 1}{open_} GROUP BY tenant_id, day, node // {audit.FAN})"
        )
    tops = " UNION ALL ".join(f"SELECT tenant_id, day, last + 1 AS entries, d AS root FROM k{k} WHERE last < {audit.FAN**k}" for k in range(1, levels + 1))
    sealed = hmac_sql(secret, "tenant_id || '|' || day || '|' || entries || '|' || root")
    return ", ".join([*parts, f"tops AS ({tops})", f"seals AS (SELECT *, {sealed} AS seal FROM tops)"])


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def redact_sql(where: str) -> str:
    """CTEs ``z`` (spans by start descending, as start:end:tag in hex digits) and ``rewritten`` over ``e``."""
    return f"""sp AS (SELECT idx, no, {spans_sql("content", VISIBLE_RULES)}, type FROM hits JOIN prompts USING (idx) JOIN rules USING (no)),
z AS (SELECT idx, list(span_start * 2 || ':' || span_end * 2 || ':' || hex(encode('[REDACTED_' || type || ']')) ORDER BY span_start DESC, no) AS spans FROM sp WHERE span_end > span_start GROUP BY idx),
rewritten AS (SELECT p.idx, CASE WHEN z.spans IS NULL THEN content ELSE decode(from_hex(list_reduce(list_prepend(hex(encode(content)), z.spans),
  lambda acc, s: CASE WHEN CAST(string_split(s, ':')[2] AS INTEGER) <= length(acc)
    THEN acc[1:CAST(string_split(s, ':')[1] AS INTEGER)] || string_split(s, ':')[3] || acc[CAST(string_split(s, ':')[2] AS INTEGER) + 1:] ELSE acc END))) END AS safe
  FROM prompts p LEFT JOIN z USING (idx)){where}"""
