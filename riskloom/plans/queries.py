"""The engine's registered queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import EXFIL_PACK, INJECTION_PACK, MALWARE_PACK, PACKS, PII_PACK, RISKY_PACK, VISIBLE_RULES, Rule
from ..operators import audit, policy, stats
from ..operators.detect import dealt, detect, exploded, or_ok, rule_hits
from ..operators.govern import PolicyConfig, annotations, default_config, govern, governance_audit, remote_profile, resolve_profile
from ..operators.rewrite import safe_rewrite
from ..operators.session import session_profiles
from ..sources import ingest
from ..sources.shared import new_path, written
from ..streaming import scan as streams
from ..streaming import store
from ..streaming.memory import remembered_decisions, rocksdb
from . import corpus
from . import oracle as sql
from .pipeline import ScanConfig, audit_log, response_rows, scan
from .views import create_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SECRET = "dev-secret"


def query(name: str, twin: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if twin is not None:
            ORACLE_SQL[name] = twin
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- detection --------------------------------------------------------------------------------------


def _hits(rules: list[Rule]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("key"), F.col("text").alias("content"))
        pages = _table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("key"), F.col("html").alias("content"))
        turns = _table(spark, sf_dir, "conversations").select(
            F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.col("text").alias("content")
        )
        asked = corpus.requests(spark, sf_dir).select(F.lit("requests").alias("source"), F.col("event_no").alias("key"), "content")
        rows = dealt(docs).union(dealt(pages)).union(dealt(turns)).union(asked).withColumn("at", F.struct("source", "key"))
        return rule_hits(rows, rules, "at").select("at.source", "at.key", "rule_id")

    return run


def _hits_sql(rules: list[Rule]) -> str:
    texts = [("documents", "doc_id", "text", "documents"), ("pages", "page_id", "html", "pages"), ("conversations", "conv_id * 1000 + turn", "text", "conversations")]
    parts = [
        f"SELECT {sql.q(s)} AS source, {k} AS key, {sql.q(r.id)} AS rule_id FROM {t} WHERE regexp_matches({c}, {sql.q(r.pattern)})"
        for r in rules
        for s, k, c, t in texts
    ]
    ids = ", ".join(sql.q(r.id) for r in rules)
    asked = f"SELECT 'requests', event_no, id FROM e JOIN hits USING (idx) JOIN rules USING (no) WHERE id IN ({ids})"
    return f"{sql.BASE.rstrip().rstrip(',')} {asked} UNION ALL " + " UNION ALL ".join(parts)


for _name, _rules in (("injection", INJECTION_PACK), ("pii", PII_PACK), ("riskyops", RISKY_PACK), ("exfil", EXFIL_PACK), ("malware", MALWARE_PACK)):
    _twin = _hits_sql(_rules)
    # The first SELECT of the union names the columns.
    _twin = _twin.replace("SELECT 'requests', event_no, id FROM", "SELECT 'requests' AS source, event_no AS key, id AS rule_id FROM")
    query(f"rule_hits_{_name}", _twin)(_hits(_rules))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(corpus.requests(spark, sf_dir))


_FINDING = "category, type, detail, confidence, severity"


@query(
    "findings_exploded",
    f"{sql.BASE} sp AS (SELECT idx, no, {sql.spans_sql('content', VISIBLE_RULES)} FROM hits JOIN prompts USING (idx)) "
    f"SELECT event_no, CAST(row_number() OVER (PARTITION BY event_no ORDER BY no) - 1 AS INTEGER) AS n, {_FINDING}, span_start, span_end "
    "FROM e JOIN sp USING (idx) JOIN rules USING (no)",
)
def findings_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exploded(_requests(spark, sf_dir), ["event_no"], "findings", "f", "n")
    return rows.select("event_no", "n", *[f"f.{c}" for c in _FINDING.split(", ")], F.col("f.location.start").alias("span_start"), F.col("f.location.end").alias("span_end"))


@query(
    "pii_spans",
    "WITH "
    + sql.RULES
    + ", h AS ("
    + " UNION ALL ".join(f"SELECT doc_id, text, {VISIBLE_RULES.index(r)} AS no FROM documents WHERE regexp_matches(text, {sql.q(r.pattern)})" for r in PII_PACK)
    + f") SELECT doc_id, type, {sql.spans_sql('text', PII_PACK)} FROM h JOIN rules USING (no)",
)
def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), PII_PACK)
    return exploded(rows, ["doc_id"], "findings", "f").select(
        "doc_id", "f.type", F.col("f.location.start").alias("span_start"), F.col("f.location.end").alias("span_end")
    )


@query(
    "ok_placeholder",
    f"{sql.BASE} o AS (SELECT event_no, greatest(n_findings, 1) AS n, n_findings FROM e) "
    "SELECT event_no, CAST(n AS INTEGER) AS n_findings, CASE WHEN n_findings = 0 THEN 'OK' ELSE 'FOUND' END AS kind FROM o",
)
def ok_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = or_ok(F.col("findings"))
    kind = F.when(F.get(shown, 0)["category"] == "OK", "OK").otherwise("FOUND")
    return _requests(spark, sf_dir).select("event_no", F.size(shown).alias("n_findings"), kind.alias("kind"))


# -- policy -------------------------------------------------------------------------------------------


@query("max_severity", f"{sql.BASE} x AS (SELECT 1) SELECT event_no, {list(sql.SEVERITIES)}[greatest(worst, 1)] AS severity FROM e")
def max_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("event_no", policy.max_severity(F.col("findings")).alias("severity"))


@query("base_score", f"{sql.BASE} x AS (SELECT 1) SELECT event_no, base AS score FROM e")
def base_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("event_no", policy.base_score(F.col("findings")).alias("score"))


@query("adaptive_score", f"{sql.BASE} {sql.decided('policy_profile')} SELECT event_no, risk_score AS score FROM d")
def adaptive_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.evaluate(_requests(spark, sf_dir)).select("event_no", F.col("risk_score").alias("score"))


@query(
    "risk_factors",
    f"{sql.BASE} {sql.decided('policy_profile')} SELECT event_no, CAST(len(factors) AS INTEGER) AS n_factors, array_to_string(factors, '; ') AS factors FROM d",
)
def risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = policy.evaluate(_requests(spark, sf_dir))
    return done.select("event_no", F.size("decision_factors").alias("n_factors"), F.array_join("decision_factors", "; ").alias("factors"))


def _decide(profile: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _requests(spark, sf_dir)
        rows = rows.withColumn("policy_profile", F.lit(profile)) if profile else rows
        return policy.evaluate(rows).select("event_no", "risk_level", "risk_score", "reasoning")

    return run


for _profile in ("strict", "moderate", "permissive", None):
    query(
        f"decide_{_profile or 'profile_dispatch'}",
        f"{sql.BASE} {sql.decided(sql.q(_profile) if _profile else 'policy_profile')} SELECT event_no, risk_level, risk_score, reasoning FROM d",
    )(_decide(_profile))


@query("privileged_context", f"{sql.BASE} x AS (SELECT 1) SELECT event_no, priv AS privileged FROM e")
def privileged_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.requests(spark, sf_dir).select("event_no", policy.privileged(F.col("tool_capabilities")).alias("privileged"))


@query(
    "safe_rewrite",
    f"{sql.BASE} {sql.decided('policy_profile')}, {sql.redact_sql('')} "
    "SELECT event_no, CASE WHEN risk_level <> 'SAFE' THEN safe END AS safe_rewrite FROM d JOIN rewritten USING (idx)",
)
def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safe_rewrite(policy.evaluate(_requests(spark, sf_dir))).select("event_no", "safe_rewrite")


def _views(spark: SparkSession, sf_dir: str) -> None:
    corpus.requests(spark, sf_dir).createOrReplaceTempView("riskloom_requests")
    create_views(spark, "riskloom_requests", prefix="riskloom_prescan")


@query("sql_prescan", ORACLE_SQL["decide_profile_dispatch"])
def sql_prescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return spark.sql("SELECT event_no, risk_level, risk_score, reasoning FROM riskloom_prescan")


@query(
    "sql_findings_by_category",
    f"{sql.BASE} {sql.decided('policy_profile')} SELECT category, risk_level, count(*) AS n, count(DISTINCT event_no) AS requests FROM d JOIN hits USING (idx) JOIN rules USING (no) GROUP BY ALL",
)
def sql_findings_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return spark.sql("SELECT category, risk_level, count(*) AS n, count(DISTINCT event_id) AS requests FROM riskloom_prescan_findings GROUP BY category, risk_level")


# -- sessions -----------------------------------------------------------------------------------------


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(corpus.requests(spark, sf_dir))


_SIGNALS = (
    "SELECT event_no, session_key, recent_scans, "
    f"CAST(coalesce(sum(CASE WHEN risk_level = 'REVIEW' THEN 1 END) {sql._EARLIER}, 0) AS INTEGER) AS recent_reviews, "
    f"CAST(coalesce(sum(CASE WHEN risk_level = 'BLOCK' THEN 1 END) {sql._EARLIER}, 0) AS INTEGER) AS recent_blocks, "
)


@query(
    "session_signals",
    f"{sql.BASE} {sql.SESSIONS} {_SIGNALS} remembered AS recent_categories, again AS repeated_injection_attempts, exfil AS repeated_exfiltration_hints, esc AS recent_attack_escalation FROM d",
)
def session_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select(
        "event_no", "session_key", "recent_scans", "recent_reviews", "recent_blocks", F.array_join("recent_categories", ",").alias("recent_categories"),
        "repeated_injection_attempts", "repeated_exfiltration_hints", "recent_attack_escalation",
    )


@query("session_decisions", f"{sql.BASE} {sql.SESSIONS} SELECT event_no, risk_level, risk_score, reasoning FROM d")
def session_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("event_no", "risk_level", "risk_score", "reasoning")


#: Every event as a request without ids: one session over the whole table, in many segments.
_SHARED_BUCKET = f"{sql.BASE} {sql.SESSIONS}".replace("tenant_id || ':' || session_id AS session_key", "'anonymous' AS session_key")


@query(
    "session_shared_bucket",
    f"{_SHARED_BUCKET} {_SIGNALS} remembered AS recent_categories, risk_level, risk_score, esc AS recent_attack_escalation FROM d",
)
def session_shared_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    nobody = corpus.requests(spark, sf_dir).withColumns({"tenant_id": F.lit(""), "session_id": F.lit(None).cast("string")})
    return scan(nobody, ScanConfig(segment_rows=2_000)).select(
        "event_no", "session_key", "recent_scans", "recent_reviews", "recent_blocks", F.array_join("recent_categories", ",").alias("recent_categories"),
        "risk_level", "risk_score", "recent_attack_escalation",
    )


@query(
    "session_profile_final",
    f"{sql.BASE} {sql.SESSIONS}, t AS (SELECT session_key, count(*) AS scans, count(*) FILTER (risk_level = 'REVIEW') AS reviews, "
    "count(*) FILTER (risk_level = 'BLOCK') AS blocks FROM d GROUP BY session_key), "
    "g AS (SELECT session_key, max(seq) AS most FROM f GROUP BY session_key), "
    "l AS (SELECT f.session_key, string_agg(category, ',' ORDER BY seq) AS cats FROM f JOIN g ON f.session_key = g.session_key AND seq > most - 6 GROUP BY f.session_key) "
    "SELECT t.session_key, scans, reviews, blocks, coalesce(cats, '') AS recent_categories FROM t LEFT JOIN l USING (session_key)",
)
def session_profile_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = session_profiles(_decided(spark, sf_dir))
    return last.withColumn("recent_categories", F.array_join("recent_categories", ","))


@query(
    "response_rows",
    f"{sql.BASE} {sql.SESSIONS}, sp AS (SELECT idx, no, {sql.spans_sql('content', VISIBLE_RULES)} FROM hits JOIN prompts USING (idx)) "
    f"SELECT event_id, risk_level, CAST(row_number() OVER (PARTITION BY event_id ORDER BY no) - 1 AS INTEGER) AS n, {_FINDING}, span_start, span_end "
    "FROM d JOIN sp USING (idx) JOIN rules USING (no) UNION ALL "
    "SELECT event_id, risk_level, 0, 'OK', 'NONE', 'No security issues detected', CAST(1.0 AS DOUBLE), 'none', NULL, NULL FROM d WHERE n_findings = 0",
)
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response_rows(_decided(spark, sf_dir))


#: A response document, field by field, as text; nothing is written for an empty optional field.
_RESPONSE = (
    f"{sql.BASE} {sql.SESSIONS}, {sql.redact_sql('')}, found AS (SELECT idx, string_agg("
    "'{\"category\":' || to_json(category) || ',\"type\":' || to_json(type) || ',\"detail\":' || to_json(detail) || ',\"confidence\":' || confidence || ',\"severity\":' || to_json(severity) "
    "|| CASE WHEN span_start IS NULL THEN '' ELSE ',\"location\":{\"start\":' || span_start || ',\"end\":' || span_end || '}' END || '}', ',' ORDER BY no) AS list "
    f"FROM (SELECT idx, no, {sql.spans_sql('content', VISIBLE_RULES)} FROM hits JOIN prompts USING (idx)) JOIN rules USING (no) GROUP BY idx), "
    "body AS (SELECT event_id, '{\"event_id\":' || to_json(event_id) || ',\"tenant_id\":' || to_json(tenant_id) || ',\"session_id\":' || to_json(session_id) "
    "|| ',\"policy_profile\":' || to_json(policy_profile) || ',\"risk_level\":' || to_json(risk_level) || ',\"risk_score\":' || risk_score || ',\"findings\":[' "
    "|| coalesce(list, '{\"category\":\"OK\",\"type\":\"NONE\",\"detail\":\"No security issues detected\",\"confidence\":1.0,\"severity\":\"none\"}') || ']' "
    "|| CASE WHEN risk_level = 'SAFE' OR safe = '' THEN '' ELSE ',\"safe_rewrite\":' || to_json(safe) END || ',\"timestamp\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '\"' "
    "|| CASE WHEN reasoning = '' THEN '' ELSE ',\"reasoning\":' || to_json(reasoning) END "
    "|| CASE WHEN len(factors) = 0 THEN '' ELSE ',\"decision_factors\":' || to_json(factors) END || '}' AS value FROM d JOIN rewritten USING (idx) LEFT JOIN found USING (idx)) "
    "SELECT event_id, replace(replace(replace(value, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS value FROM body"
)


@query("response_json", _RESPONSE)
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.responses(_decided(spark, sf_dir))


@query("access_log", f"{sql.BASE} {sql.SESSIONS} SELECT event_id, '[' || risk_level || '] ' || event_id || ' | score=' || risk_score || ' | findings=' || n_findings AS line FROM d")
def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.access_log(_decided(spark, sf_dir))


#: Whole documents as prompts under all packs, the secrets pack included, each profile in turn.
_SECRETS_RULES = PACKS["visible+secrets"]


@query(
    "secrets_decisions",
    f"WITH prompts AS (SELECT doc_id AS idx, coalesce(text, '') AS content FROM documents), {sql.rules_cte(_SECRETS_RULES)}, {sql.HITS}, "
    "e AS (SELECT pf.*, idx AS event_no, ['strict', 'moderate', 'permissive'][idx % 3 + 1] AS policy_profile, false AS priv FROM pf), "
    f"{sql.decided('policy_profile')} SELECT event_no, policy_profile, risk_level, risk_score, reasoning, sec AS has_secret FROM d",
)
def secrets_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    profile = F.get(F.array(*[F.lit(p) for p in ("strict", "moderate", "permissive")]), F.pmod("doc_id", F.lit(3)).cast("int"))
    rows = docs.select(F.col("doc_id").alias("event_no"), F.col("text").alias("content"), profile.alias("policy_profile"), F.array().cast("array<string>").alias("tool_capabilities"))
    done = policy.evaluate(detect(rows, _SECRETS_RULES))
    secret = F.exists("findings", lambda f: f["category"] == "SECRETS")
    return done.select("event_no", "policy_profile", "risk_level", "risk_score", "reasoning", secret.alias("has_secret"))


# -- audit and counters -------------------------------------------------------------------------------


@query(
    "audit_payload_signature",
    f"{sql.BASE} {sql.SESSIONS} SELECT event_id, {sql.hmac_sql(SECRET, sql.payload_sql(chr(39) * 2))} AS signature FROM d",
)
def audit_payload_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sign_alone(audit.entries(_decided(spark, sf_dir)), SECRET).select("event_id", "signature")


@query("audit_chain", sql.recursive(f"{sql.BASE} {sql.SESSIONS} {sql.chain_sql(SECRET)} SELECT event_id, tenant_id, day, seq, prev_signature, signature FROM chained"))
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_log(_decided(spark, sf_dir), ScanConfig(secret=SECRET)).select("event_id", "tenant_id", "day", "seq", "prev_signature", "signature")


@query(
    "audit_verify",
    f"{sql.BASE} x AS (SELECT 1) SELECT tenant_id, count(*) AS entries, count(*) AS valid FROM e GROUP BY tenant_id",
)
def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = audit_log(_decided(spark, sf_dir), ScanConfig(secret=SECRET))
    checked = audit.verify(log, SECRET, ["tenant_id", "day"])
    return checked.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if("valid").alias("valid"))


_CHAINED = f"{sql.BASE} {sql.SESSIONS} {sql.chain_sql(SECRET)}"
_CHAIN_KEYS = ["tenant_id", "day"]


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chained log, written once: trees read it several times."""
    return written(audit_log(_decided(spark, sf_dir), ScanConfig(secret=SECRET)), "log")


@query("audit_seals", sql.recursive(f"{_CHAINED}, {sql.merkle_sql(SECRET)} SELECT tenant_id, day, entries, root, seal FROM seals"))
def audit_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.seal(_log(spark, sf_dir), SECRET, _CHAIN_KEYS)


# What happens to a sealed log, by tenant: t1 loses its last two entries, t2 has one altered, t3 loses the first, t4 gets one more.
@query(
    "audit_seal_check",
    f"{sql.BASE} n AS (SELECT tenant_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM e GROUP BY ALL), "
    "m AS (SELECT *, CASE tenant_id WHEN 't1' THEN greatest(n - 2, 0) WHEN 't3' THEN n - 1 WHEN 't4' THEN n + 1 ELSE n END AS found FROM n) "
    "SELECT tenant_id, day, CASE WHEN found = 0 THEN 'missing' WHEN found < n THEN 'shorter' WHEN found > n THEN 'longer' WHEN tenant_id = 't2' AND n > 1 THEN 'changed' ELSE 'whole' END AS status, "
    "n AS entries, found, CASE WHEN tenant_id = 't1' THEN found // 16 * 16 WHEN tenant_id = 't3' OR (tenant_id = 't2' AND n > 1) THEN 0 WHEN tenant_id = 't4' THEN n // 16 * 16 END AS first_bad FROM m",
)
def audit_seal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    nodes = written(audit.merkle(log, _CHAIN_KEYS), "nodes")
    seals = written(audit.seal(log, SECRET, _CHAIN_KEYS, nodes=nodes), "seals")
    places = log.groupBy(*_CHAIN_KEYS).agg(F.max("seq").alias("last"))
    rows = log.join(places, _CHAIN_KEYS)
    kept = rows.where("NOT (tenant_id = 't1' AND seq > last - 2) AND NOT (tenant_id = 't3' AND seq = 0)")
    altered = F.when((F.col("tenant_id") == "t2") & (F.col("seq") == 1), F.reverse("signature")).otherwise(F.col("signature"))
    added = rows.where("tenant_id = 't4' AND seq = last").withColumn("seq", F.col("seq") + 1)
    bent = written(kept.withColumn("signature", altered).unionByName(added).drop("last"), "bent")
    where = audit.locate(bent, nodes, _CHAIN_KEYS).groupBy(*_CHAIN_KEYS).agg(F.min("first").alias("first_bad"))
    return audit.check_seals(bent, seals, SECRET, _CHAIN_KEYS).join(where, _CHAIN_KEYS, "left").select(*_CHAIN_KEYS, "status", "entries", "found", "first_bad")


@query(
    "audit_proofs",
    f"{sql.BASE} n AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, strftime(ts, '%Y-%m-%d')) AS n FROM e) "
    "SELECT event_id, CAST(CASE WHEN n <= 16 THEN 1 WHEN n <= 256 THEN 2 WHEN n <= 4096 THEN 3 ELSE 4 END AS INTEGER) AS steps, true AS proven, false AS proven_elsewhere FROM n",
)
def audit_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    nodes = written(audit.merkle(log, _CHAIN_KEYS), "nodes")
    roots = written(nodes.where("top").select(*_CHAIN_KEYS, F.col("digest").alias("root")), "roots")
    # Roots are met by entries, not by proofs: those are too large to shuffle.
    asked = log.select("event_id", *_CHAIN_KEYS, "seq", "signature").join(roots, _CHAIN_KEYS)
    proofs = audit.proofs(asked, log, nodes, _CHAIN_KEYS)
    elsewhere = audit.proven(F.col("signature"), F.col("proof"), F.sha2(F.encode("root", "UTF-8"), 256))
    return proofs.select("event_id", F.size("proof").alias("steps"), audit.proven(F.col("signature"), F.col("proof"), F.col("root")).alias("proven"), elsewhere.alias("proven_elsewhere"))


@query(
    "stats_by_decision",
    f"{sql.BASE} {sql.SESSIONS}, l(risk_level) AS (VALUES ('SAFE'), ('REVIEW'), ('BLOCK')) "
    "SELECT l.risk_level, count(d.event_no) AS n FROM l LEFT JOIN d USING (risk_level) GROUP BY l.risk_level",
)
def stats_by_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_decision(_decided(spark, sf_dir))


@query(
    "stats_totals",
    f"{sql.BASE} {sql.SESSIONS} SELECT count(*) AS total_scans, count(*) FILTER (risk_level = 'SAFE') AS safe, "
    "count(*) FILTER (risk_level = 'REVIEW') AS review, count(*) FILTER (risk_level = 'BLOCK') AS block FROM d",
)
def stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(_decided(spark, sf_dir))


@query(
    "stats_by_tenant_profile",
    f"{sql.BASE} {sql.SESSIONS} SELECT tenant_id, policy_profile, count(*) AS scans, count(*) FILTER (risk_level = 'BLOCK') AS blocks, "
    "CAST(sum(risk_score) AS BIGINT) AS score_sum FROM d GROUP BY ROLLUP (tenant_id, policy_profile)",
)
def stats_by_tenant_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rollup(_decided(spark, sf_dir))


# -- ingest -------------------------------------------------------------------------------------------

#: Shapes a request document comes in, by event number: (template, content seen, reject); %n is the number.
SHAPES: list[tuple[str, str | None, str | None]] = [
    ('{"event_id":"e%n","content":"hello %n","policy_profile":"moderate","context":{"tool_capabilities":["shell"],"trust_level":"low"}}', "hello %n", None),
    ('{"Content":"cased %n","SESSION_ID":"s","unknown":[1,{"a":2}],"context":null}', "cased %n", None),
    ('{"content":"   ","policy_profile":"foo"}', "   ", None),
    ('{"content":""}', "", ingest.EMPTY),
    ('{"tenant_id":"t%n"}', "", ingest.EMPTY),
    ('{"content":%n}', None, ingest.INVALID),
    ('{"content":"cut %n', None, ingest.INVALID),
    ("[%n]", None, ingest.INVALID),
    ('{"content":"ok","context":{"tool_capabilities":"shell"}}', None, ingest.INVALID),
    ('{"content":null,"event_id":"e%n"}', "", ingest.EMPTY),
    ('{"content":"first %n","Content":"last %n"}', "last %n", None),
    ('{"content":"kept %n","content":null,"context":{"trust_level":"a","trust_level":"b"}}', "kept %n", None),
    ('{"content":"x","content":5}', None, ingest.INVALID),
]


def _shape(i: int) -> Column:
    number = F.col("event_id").cast("string")
    made = F.lit(None).cast("string")
    for k, row in enumerate(SHAPES):
        text = F.lit(None).cast("string") if row[i] is None else F.replace(F.lit(row[i]), F.lit("%n"), number)
        made = F.when(F.col("event_id") % len(SHAPES) == k, text).otherwise(made)
    return made


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dealt(_table(spark, sf_dir, "events").select("event_id"))
    return ingest.decode(lines.select(F.col("event_id").alias("event_no"), _shape(0).alias("value")))


def _shape_sql(i: int) -> str:
    cases = " ".join(f"WHEN {k} THEN {'NULL' if r[i] is None else f'replace({sql.q(r[i])}, {sql.q("%n")}, CAST(event_id AS VARCHAR))'}" for k, r in enumerate(SHAPES))
    return f"CASE event_id % {len(SHAPES)} {cases} END"


_SHAPED = f"WITH x AS (SELECT event_id, event_id AS event_no, {_shape_sql(1)} AS content, {_shape_sql(2)} AS reject FROM events)"


@query("ingest_valid", f"{_SHAPED} SELECT event_no, content FROM x WHERE reject IS NULL")
def ingest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.accepted(_documents(spark, sf_dir)).select("event_no", "content")


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request documents as lines of text files, read as a stream into files; each with the number its event had."""
    folder = new_path(spark, "requests")
    lines = dealt(_table(spark, sf_dir, "events").select("event_id"))
    numbered = lines.select(F.concat(F.coalesce(_shape(0), F.lit("")), F.lit(" "), F.col("event_id").cast("string")).alias("value"))
    numbered.write.text(folder)
    rows = spark.readStream.text(folder)
    cut = F.regexp_extract("value", r"(?s)^(.*) (\d+)$", 2)
    document = F.regexp_extract("value", r"(?s)^(.*) (\d+)$", 1)
    return _stored(ingest.decode(rows.select(cut.cast("long").alias("event_no"), document.alias("value"))))


@query("ingest_stream", f"{_SHAPED} SELECT event_no, content, reject FROM x")
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrived(spark, sf_dir).select("event_no", "content", "reject")


@query("ingest_rejects", f"{_SHAPED} SELECT event_no, reject FROM x WHERE reject IS NOT NULL")
def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.rejected(_documents(spark, sf_dir)).select("event_no", "reject")


@query(
    "request_defaults",
    f"{_SHAPED} SELECT event_no, CASE event_no % {len(SHAPES)} WHEN 0 THEN 'e' || event_no "
    f"ELSE 'evt_' || substr(sha256('' || chr(31) || CASE event_no % {len(SHAPES)} WHEN 1 THEN 's' ELSE '' END || chr(31) || content || chr(31) || event_no), 1, 16) END AS event_id, "
    f"CASE event_no % {len(SHAPES)} WHEN 0 THEN 'moderate' WHEN 2 THEN 'foo' ELSE 'strict' END AS policy_profile, "
    f"CAST(CASE event_no % {len(SHAPES)} WHEN 0 THEN 1 ELSE 0 END AS INTEGER) AS n_tools FROM x WHERE reject IS NULL",
)
def request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ingest.with_defaults(ingest.accepted(_documents(spark, sf_dir)), ["event_no"])
    return done.select("event_no", "event_id", "policy_profile", F.size("tool_capabilities").alias("n_tools"))


@query("health", "SELECT 'ok' AS status, 'riskloom' AS service, '1.0.0' AS version")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.health(spark)


@query(
    "service_health",
    f"{sql.BASE} {sql.SESSIONS}, t AS (SELECT tenant_id, count(*) AS scans, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS latest FROM d GROUP BY tenant_id) "
    "SELECT 'ok' AS status, 'riskloom' AS service, '1.0.0' AS version, tenant_id, scans, latest FROM t",
)
def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health answer beside what the service has done for each tenant: read from the log, ``ok`` if every entry verifies."""
    log = audit.verify(_log(spark, sf_dir), SECRET, _CHAIN_KEYS)
    done = log.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("scans"), F.max("timestamp").alias("latest"), F.every("valid").alias("whole"))
    now = ingest.health(spark).first()
    status = F.when(F.col("whole"), F.lit(now["status"])).otherwise("broken")
    return done.select(status.alias("status"), F.lit(now["service"]).alias("service"), F.lit(now["version"]).alias("version"), "tenant_id", "scans", "latest")


# -- governance ---------------------------------------------------------------------------------------

_GOVERNED = sql.BASE.replace("tools, lambda t:", "CAST([] AS VARCHAR[]), lambda t:")


@query(
    "govern_review_rewrite",
    f"{_GOVERNED} {sql.decided(sql.q('moderate'))}, {sql.redact_sql('')} "
    "SELECT event_no, risk_level, CASE risk_level WHEN 'BLOCK' THEN NULL WHEN 'REVIEW' THEN safe ELSE content END AS prompt FROM d JOIN rewritten USING (idx)",
)
def govern_review_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = PolicyConfig(profile="moderate", allow_rewrite=True)
    return corpus.requests(spark, sf_dir).transform(govern(cfg)).select("event_no", "risk_level", "prompt")


@query(
    "govern_block_errors",
    f"{_GOVERNED} {sql.decided('policy_profile')} "
    "SELECT event_no, CASE WHEN risk_level = 'BLOCK' THEN 'policy violation [' || policy_profile || ']: ' || reasoning END AS error FROM d",
)
def govern_block_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.requests(spark, sf_dir).transform(govern(default_config(), override="policy_profile")).select("event_no", "error")


@query(
    "resolve_profile",
    "SELECT event_id AS event_no, CASE event_id % 3 WHEN 0 THEN 'permissive' ELSE 'moderate' END AS profile FROM events",
)
def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    override = F.when(F.col("event_id") % 3 == 0, "permissive").when(F.col("event_id") % 3 == 1, "")
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("event_no"), resolve_profile(override, "", PolicyConfig(profile="moderate")).alias("profile")
    )


class _Answers:
    """A fetcher with one answer; an error is raised."""

    def __init__(self, answer: str | Exception):
        self.answer = answer

    def fetch(self, url: str, timeout_ms: int) -> str:
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer


#: What remotes answer, by name: a known profile, an unknown one, none, and a failure.
REMOTES: dict[str, str | Exception] = {"known": "permissive", "unknown": "lenient", "empty": "", "down": OSError("refused")}


@query(
    "remote_precedence",
    "SELECT event_id AS event_no, remote, CASE WHEN event_id % 3 = 0 THEN 'strict' WHEN remote = 'known' THEN 'permissive' ELSE 'moderate' END AS profile "
    f"FROM events, (VALUES {', '.join(f'({sql.q(n)})' for n in REMOTES)}) AS r(remote)",
)
def remote_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    override = F.when(F.col("event_id") % 3 == 0, "strict").when(F.col("event_id") % 3 == 1, "")
    cfg = PolicyConfig(profile="moderate", remote_override_url="http://control/profile")
    events, out = _table(spark, sf_dir, "events").select("event_id"), None
    for name, answer in REMOTES.items():
        profile = resolve_profile(override, remote_profile(cfg, _Answers(answer)), cfg)
        part = events.select(F.col("event_id").alias("event_no"), F.lit(name).alias("remote"), profile.alias("profile"))
        out = part if out is None else out.union(part)
    return out


#: Comments that annotate a function with a policy, and some that don't.
ANNOTATIONS = [
    '// @Policy(profile="strict", block=true, rewrite=false)', '# @Policy(rewrite=true, remote="http://control/p")', "@Policy(profile=strict)",
    "no policy here", '@Policy(profile="moderate")  @Policy(profile="strict")', "@Policy()",
]


@query(
    "annotation_configs",
    f"WITH t(n, text) AS ({sql.values(list(enumerate(ANNOTATIONS)))}), p AS (SELECT n, regexp_extract(text, '@Policy\\(([^)]+)\\)', 1) AS s FROM t) "
    """SELECT n, regexp_extract(s, 'profile\\s*=\\s*"([^"]+)"', 1) AS profile, regexp_matches(s, 'block\\s*=\\s*true') AS block,
    regexp_matches(s, 'rewrite\\s*=\\s*true') AS rewrite, regexp_extract(s, 'remote\\s*=\\s*"([^"]+)"', 1) AS remote FROM p""",
)
def annotation_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = [PolicyConfig.from_annotation(t) for t in ANNOTATIONS]
    rows = [(n, c.profile, c.block_on_violation, c.allow_rewrite, c.remote_override_url) for n, c in enumerate(read)]
    return spark.createDataFrame(rows, "n int, profile string, block boolean, rewrite boolean, remote string")


#: Comments by event number, with its tenant in the address.
_COMMENTS = ['// @Policy(profile="strict", block=true, rewrite=false)', '# @Policy(rewrite=true, remote="http://control/%t")', "@Policy(profile=strict)", "no policy here",
             '@Policy(profile="moderate") @Policy(profile="strict")', '@Policy(profile="a", profile="b", block=false, block=true)']
_COMMENT_SQL = f"replace([{', '.join(map(sql.q, _COMMENTS))}][event_id % {len(_COMMENTS)} + 1], '%t', 't' || user_id)"


@query(
    "annotation_columns",
    f"WITH c AS (SELECT event_id AS event_no, regexp_extract({_COMMENT_SQL}, '@Policy\\(([^)]+)\\)', 1) AS s FROM events) "
    """SELECT event_no, coalesce(regexp_extract_all(s, 'profile\\s*=\\s*"([^"]+)"', 1)[-1], '') AS profile, coalesce(regexp_extract_all(s, 'block\\s*=\\s*(true|false)', 1)[-1], '') = 'true' AS block,
    coalesce(regexp_extract_all(s, 'rewrite\\s*=\\s*(true|false)', 1)[-1], '') = 'true' AS rewrite, coalesce(regexp_extract_all(s, 'remote\\s*=\\s*"([^"]+)"', 1)[-1], '') AS remote FROM c""",
)
def annotation_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    comment = F.get(F.array(*map(F.lit, _COMMENTS)), F.pmod("event_id", F.lit(len(_COMMENTS))).cast("int"))
    text = F.replace(comment, F.lit("%t"), F.concat(F.lit("t"), F.col("user_id").cast("string")))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("event_no"), *[c.alias(n) for n, c in annotations(text).items()])


@query(
    "govern_audit",
    f"{_GOVERNED} {sql.decided(sql.q('strict'))} SELECT risk_level, risk_score, CAST(n_findings AS INTEGER) AS finding_count, "
    + sql.hmac_sql(SECRET, sql.payload_sql("''").replace("CAST(event_id", "CAST('directive'").replace("CAST(tenant_id", "CAST(''").replace("CAST(session_id", "CAST(''").replace("CAST(policy_profile", "CAST('strict'"))
    + " AS signature FROM d",
)
def govern_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = PolicyConfig(profile="strict", audit_enabled=True, audit_secret=SECRET)
    done = corpus.requests(spark, sf_dir).transform(govern(cfg))
    return governance_audit(done, cfg, F.col("ts")).select("risk_level", "risk_score", "finding_count", "signature")


# -- streams ------------------------------------------------------------------------------------------


def _spread(rows: DataFrame) -> DataFrame:
    """A stream's narrow rows dealt over the cores: one file of few row groups is as few tasks, and detection comes after."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "event_id")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return corpus.from_events(spark, _spread(rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")))


def _stored(stream: DataFrame, mode: str = "append", out: str | None = None, state: str | None = None) -> DataFrame:
    """Run a stream over what there is, into files in the shared folder, and return those.

    ``append``: Spark's file sink; ``complete``: each batch's whole result replaces the one before.
    """
    spark = stream.sparkSession
    out, state = out or new_path(spark, "stream"), state or new_path(spark, "state")
    writer = stream.writeStream.option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    with rocksdb(spark):
        started = writer.start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_stats", f"{sql.BASE} {sql.decided('policy_profile')} SELECT risk_level, count(*) AS n FROM d GROUP BY risk_level")
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(streams.decision_counts(_event_stream(spark, sf_dir)), "complete")


@query(
    "stream_tumbling",
    f"{sql.BASE} {sql.decided('policy_profile')} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, tenant_id, risk_level, count(*) AS n FROM d GROUP BY ALL",
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _stored(streams.tumbling_counts(_event_stream(spark, sf_dir)), "complete")
    return counted.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "tenant_id", "risk_level", "n")


@query(
    "stream_session_decisions",
    f"{sql.BASE} {sql.SESSIONS} {_SIGNALS} event_id, risk_level, risk_score, esc AS recent_attack_escalation FROM d".replace("SELECT event_no, session_key", "SELECT session_key"),
)
def stream_session_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _stored(streams.session_decisions(_event_stream(spark, sf_dir)))
    return done.select(
        "session_key", "recent_scans", "recent_reviews", "recent_blocks", "event_id", "risk_level", "risk_score", "recent_attack_escalation"
    )


#: Idle sessions are forgotten after more than any session rests, so the answer is that of the batch plan; state on RocksDB.
_IDLE_MS = 10 * 366 * 86_400_000


@query(
    "stream_session_memory",
    f"{sql.BASE} {sql.SESSIONS} {_SIGNALS} event_id, risk_level, risk_score, esc AS recent_attack_escalation FROM d".replace("SELECT event_no, session_key", "SELECT session_key"),
)
def stream_session_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _stored(remembered_decisions(_event_stream(spark, sf_dir), _IDLE_MS))
    return done.select("session_key", "recent_scans", "recent_reviews", "recent_blocks", "event_id", "risk_level", "risk_score", "recent_attack_escalation")


def _stored_log(spark: SparkSession, sf_dir: str) -> str:
    """The events as a stream of decisions, appended to a stored audit log; its path."""
    path = new_path(spark, "audit-log")
    writer = remembered_decisions(_event_stream(spark, sf_dir)).writeStream.option("checkpointLocation", new_path(spark, "state"))
    with rocksdb(spark):
        started = writer.foreachBatch(store.appender(path, SECRET)).trigger(availableNow=True).start()
    started.awaitTermination()
    return path


@query("stream_audit_log", ORACLE_SQL["audit_chain"])
def stream_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.log(spark, _stored_log(spark, sf_dir)).select("event_id", "tenant_id", "day", "seq", "prev_signature", "signature")


@query("stream_counters", ORACLE_SQL["stats_totals"])
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.totals(spark, _stored_log(spark, sf_dir))


#: Events arrive in three parts: the older half, the newer half, and last every tenth event of the older half, held up on its way.
_LATE = 10


@query(
    "stream_late_windows",
    f"{sql.BASE} {sql.decided('policy_profile')}, m AS (SELECT quantile_disc(ts, 0.5) AS mid FROM d), "
    f"a AS (SELECT d.*, date_trunc('hour', ts) AS w, ts <= mid AND event_no % {_LATE} = 0 AS late FROM d, m), "
    "marks AS (SELECT max(ts) FILTER (NOT late) - INTERVAL 10 MINUTE AS mark FROM a) "
    "SELECT strftime(w, '%Y-%m-%d %H') AS hour, tenant_id, risk_level, count(*) AS n FROM a, marks WHERE NOT late AND w + INTERVAL 1 HOUR <= mark GROUP BY ALL",
)
def stream_late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows come out once, when the watermark has passed them; what comes for them later is dropped, what isn't over is held back."""
    events = _table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    mid = events.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(ts)) AS mid")).first()["mid"] or 0
    part = F.when(F.unix_micros("ts") > mid, 2).when(F.col("event_id") % _LATE == 0, 3).otherwise(1)
    arrivals, state, out = (new_path(spark, tag) for tag in ("arrivals", "state", "stream"))
    for k in (1, 2, 3):  # each time the stream is started anew and goes on where it was
        events.where(part == k).write.mode("append").parquet(arrivals)
        rows = spark.readStream.schema(events.schema).parquet(arrivals)
        counted = _stored(streams.tumbling_counts(corpus.from_events(spark, _spread(rows))), out=out, state=state)
    return counted.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "tenant_id", "risk_level", "n")
