"""Policy: score, factors, level and reasoning from findings, tools and session signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import EXFIL, INJECTION, MALWARE, MAX_SCORE, PII, RISKY, SECRETS, SEVERITIES, WEIGHTS

SAFE, REVIEW, BLOCK = "SAFE", "REVIEW", "BLOCK"
# Tools that count as privileged, the bonuses and their factor texts, in order.
PRIVILEGED = ("shell", "terminal", "filesystem-write", "database", "browser", "network")
NO_ISSUES = "No issues detected"
CROSS_SIGNAL, PER_CATEGORY = "cross-signal evidence across %d categories", 10
INJECTION_EXFIL = ("injection paired with exfiltration intent", 20)
SECRET_EXFIL = ("secret exposure paired with extraction behavior", 15)
MALWARE_RISKY = ("malware intent paired with destructive operations", 15)
PRIVILEGED_ATTACK = ("privileged tool access increases blast radius", 15)
REPEAT_INJECTION = ("repeat injection behavior in this session", 10)
REPEAT_EXFIL = ("repeat exfiltration behavior in this session", 10)
RECENT_BLOCK = ("recent blocked activity from same session", 5)
# Reasons of the profiles in the order of their cases.
STRICT_REASONS = (
    "Strict policy: critical finding or secret/malware detected",
    "Strict policy: privileged tools with attack-like prompt",
    "Strict policy: repeated attack behavior escalated this session",
    "Strict policy: PII or high-severity finding",
    "Strict policy: injection attempt or medium-severity finding",
    "Strict policy: low-severity finding flagged for review",
)
MODERATE_REASONS = (
    "Moderate policy: critical finding or secret/malware detected",
    "Moderate policy: privileged tools raise attack prompt to block",
    "Moderate policy: repeated risky session activity escalated to block",
    "Moderate policy: PII or injection flagged for review",
    "Moderate policy: suspicious operational prompt flagged for review",
    "Moderate policy: finding flagged for review",
)
PERMISSIVE_REASONS = (
    "Permissive policy: only critical findings blocked",
    "Permissive policy: privileged agent context made the prompt too risky",
    "Permissive policy: repeated risky session activity escalated to block",
    "Permissive policy: non-critical finding, review recommended",
)
MODERATE_ESCALATION, PERMISSIVE_PRIVILEGED, PERMISSIVE_ESCALATION = 70, 75, 80


def has(findings: Column, category: str) -> Column:
    return F.exists(findings, lambda f: f["category"] == category)


def severity_rank(severity: Column) -> Column:
    """1 for the least severity up to 4; 0 for a label that isn't one."""
    rank = F.lit(0)
    for i, s in enumerate(SEVERITIES):
        rank = F.when(severity == s, i + 1).otherwise(rank)
    return rank


def max_severity(findings: Column) -> Column:
    """The greatest severity; the least label where none is known."""
    top = F.aggregate(findings, F.lit(0), lambda acc, f: F.greatest(acc, severity_rank(f["severity"])))
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.greatest(top, F.lit(1)) - 1)


def base_score(findings: Column) -> Column:
    weights = F.array(F.lit(0), *[F.lit(w) for w in WEIGHTS])
    total = F.aggregate(findings, F.lit(0), lambda acc, f: acc + F.get(weights, severity_rank(f["severity"])))
    return F.least(total, F.lit(MAX_SCORE))


def privileged(tools: Column) -> Column:
    """Any tool, in any case, that is privileged; no list is no tool."""
    lowered = F.transform(tools, F.lower)
    return F.coalesce(F.exists(lowered, lambda t: t.isin(*PRIVILEGED)), F.lit(False))


#: Facts about a request's findings, each computed once.
FACTS = {"_sec": SECRETS, "_mal": MALWARE, "_inj": INJECTION, "_pii": PII, "_exf": EXFIL, "_ops": RISKY}


def with_facts(df: DataFrame) -> DataFrame:
    """Adds the facts that scores and decisions are made of: categories, worst severity, base score, armed tools."""
    findings = F.col("findings")
    flags = df.withColumns({name: has(findings, category) for name, category in FACTS.items()})
    return flags.withColumns(
        {
            "_worst": max_severity(findings),
            "_base": base_score(findings),
            "_kinds": F.size(F.array_distinct(F.transform(findings, lambda f: f["category"]))),
            "_armed": privileged(F.col("tool_capabilities")) & (F.col("_inj") | F.col("_exf") | F.col("_ops")),
        }
    )


def _signals(repeat_injection: Column, repeat_exfil: Column, blocked: Column) -> list[tuple[Column, Column | str, Column | int]]:
    """(condition, factor, bonus) in order, over the facts."""
    n, injection, exfil = F.col("_kinds"), F.col("_inj"), F.col("_exf")
    return [
        (n >= 2, F.format_string(CROSS_SIGNAL, n), (n - 1) * PER_CATEGORY),
        (injection & exfil, *INJECTION_EXFIL),
        (F.col("_sec") & exfil, *SECRET_EXFIL),
        (F.col("_mal") & F.col("_ops"), *MALWARE_RISKY),
        (F.col("_armed"), *PRIVILEGED_ATTACK),
        (repeat_injection & injection, *REPEAT_INJECTION),
        (repeat_exfil & exfil, *REPEAT_EXFIL),
        (blocked & (n > 0), *RECENT_BLOCK),
    ]


def adaptive_score(signals) -> Column:
    score = F.col("_base")
    for condition, _, bonus in signals:
        score = score + F.when(condition, bonus).otherwise(0)
    return F.least(score, F.lit(MAX_SCORE))


def factors(signals) -> Column:
    each = [F.when(c, f if isinstance(f, Column) else F.lit(f)) for c, f, _ in signals]
    return F.filter(F.array(*each), lambda f: f.isNotNull())


def _cases(cases: list[tuple[Column | None, str, str]]) -> Column:
    """First case that holds, as struct (level, reason); the last has no condition."""
    chain = None
    for condition, level, reason in cases:
        value = F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))
        if condition is None:
            return value if chain is None else chain.otherwise(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain


def decide(profile: Column, escalation: Column, score: Column) -> Column:
    """Struct (level, reason) under strict, permissive or, for any other name, moderate rules, over the facts."""
    secrets, malware, injection, pii, exfil, risky, worst, armed = (F.col(c) for c in (*FACTS, "_worst", "_armed"))
    grave = secrets | malware | (worst == "critical")
    s, m, p = STRICT_REASONS, MODERATE_REASONS, PERMISSIVE_REASONS
    strict = _cases(
        [
            (grave, BLOCK, s[0]),
            (armed, BLOCK, s[1]),
            (escalation & (injection | exfil), BLOCK, s[2]),
            (pii | (worst == "high"), BLOCK, s[3]),
            (injection | (worst == "medium"), REVIEW, s[4]),
            (None, REVIEW, s[5]),
        ]
    )
    moderate = _cases(
        [
            (grave, BLOCK, m[0]),
            (armed, BLOCK, m[1]),
            (escalation & (score >= MODERATE_ESCALATION), BLOCK, m[2]),
            (pii | injection, REVIEW, m[3]),
            (exfil | risky, REVIEW, m[4]),
            (None, REVIEW, m[5]),
        ]
    )
    permissive = _cases(
        [
            (grave, BLOCK, p[0]),
            (armed & (score >= PERMISSIVE_PRIVILEGED), BLOCK, p[1]),
            (escalation & (score >= PERMISSIVE_ESCALATION), BLOCK, p[2]),
            (None, REVIEW, p[3]),
        ]
    )
    safe = F.struct(F.lit(SAFE).alias("level"), F.lit(NO_ISSUES).alias("reason"))
    chosen = F.when(profile == "strict", strict).when(profile == "permissive", permissive).otherwise(moderate)
    return F.when(F.col("_kinds") == 0, safe).otherwise(chosen)


def with_outcomes(df: DataFrame, variants: list[tuple[bool, bool, bool]]) -> DataFrame:
    """Adds ``outcomes``: level and score under each combination of session signals, from facts that are computed once for all."""
    names, scores, levels = [f"_s{k}" for k in range(len(variants))], {}, []
    for name, variant in zip(names, variants, strict=True):
        injection, exfil, blocked = map(F.lit, variant)
        scores[name] = adaptive_score(_signals(injection, exfil, blocked))
        level = decide(F.col("policy_profile"), blocked & (injection | exfil), F.col(name))["level"]
        levels.append(F.concat_ws(":", level, F.col(name).cast("string")))
    tried = with_facts(df).withColumns(scores).withColumn("outcomes", F.array_join(F.array(*levels), ","))
    return tried.drop("_worst", "_base", "_kinds", "_armed", *FACTS, *names)


def evaluate(
    df: DataFrame,
    repeat_injection: Column | None = None,
    repeat_exfil: Column | None = None,
    blocked: Column | None = None,
) -> DataFrame:
    """Adds ``risk_level, risk_score, reasoning, decision_factors``.

    Needs ``findings, policy_profile, tool_capabilities``. Signals left out are false.
    """
    no = F.lit(False)
    injection_again, exfil_again, seen_block = (no if c is None else c for c in (repeat_injection, repeat_exfil, blocked))
    signals = _signals(injection_again, exfil_again, seen_block)
    scored = with_facts(df).withColumns({"risk_score": adaptive_score(signals), "decision_factors": factors(signals)})
    escalation = seen_block & (injection_again | exfil_again)
    decided = scored.withColumn("_case", decide(F.col("policy_profile"), escalation, F.col("risk_score")))
    why = F.when(
        F.size("decision_factors") > 0,
        F.concat(F.col("_case.reason"), F.lit(" ["), F.array_join("decision_factors", "; "), F.lit("]")),
    ).otherwise(F.col("_case.reason"))
    out = decided.withColumns({"risk_level": F.col("_case.level"), "reasoning": why})
    return out.drop("_case", "_worst", "_base", "_kinds", "_armed", *FACTS)
