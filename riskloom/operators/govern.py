"""Governance: a policy put around whatever produces prompts.

``govern(cfg)`` is a transform for ``DataFrame.transform``: it resolves the profile (row override, then remote, then
configuration, then strict), scans and evaluates without tools or session signals, and enforces.
A remote profile is resolved once per call, on the driver, through a fetcher; any failure falls
through to the configuration.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import wraps
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import ANNOTATION, SETTING, Rule, parse_annotation
from .audit import sign_alone
from .detect import detect
from .policy import BLOCK, REVIEW, evaluate
from .rewrite import redact

# Known profiles, the last resort, the time allowed, and the event id of governed prompts.
PROFILES, DEFAULT_PROFILE, TIMEOUT_MS, EVENT_ID = ("strict", "moderate", "permissive"), "strict", 500, "directive"


@dataclass(frozen=True)
class PolicyConfig:
    """All off unless set; :func:`default_config` is the recommended set."""

    profile: str = ""
    block_on_violation: bool = False
    allow_rewrite: bool = False
    remote_override_url: str = ""
    remote_timeout_ms: int = 0
    audit_enabled: bool = False
    audit_secret: str = ""

    @classmethod
    def from_annotation(cls, text: str) -> PolicyConfig:
        """From a ``@Policy(...)`` comment: ``profile, block, rewrite, remote``."""
        s = parse_annotation(text)
        return cls(s.get("profile", ""), s.get("block") == "true", s.get("rewrite") == "true", s.get("remote", ""))


def default_config() -> PolicyConfig:
    return PolicyConfig("strict", True, True, "", TIMEOUT_MS, True, "")


class ProfileFetcher(Protocol):
    def fetch(self, url: str, timeout_ms: int) -> str: ...


class HttpFetcher:
    """GETs ``{"profile": ...}``. Errors are raised; the name is not checked here."""

    def __init__(self, headers: dict[str, str] | None = None):
        self.headers = {"Accept": "application/json", **(headers or {})}

    @classmethod
    def from_env(cls, agent: str = "RISKLOOM_AGENT_ID", environment: str = "RISKLOOM_ENV") -> HttpFetcher:
        named = (("X-Agent-ID", agent), ("X-Environment", environment))
        return cls({h: os.environ[v] for h, v in named if os.environ.get(v)})

    def fetch(self, url: str, timeout_ms: int = TIMEOUT_MS) -> str:
        with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=(timeout_ms or TIMEOUT_MS) / 1000) as r:
            if r.status != 200:
                raise OSError(f"unexpected status: {r.status}")
            return json.loads(r.read()).get("profile", "")


def remote_profile(cfg: PolicyConfig, fetcher: ProfileFetcher | None = None) -> str:
    """A known profile from the remote, or the empty string whatever goes wrong."""
    if not cfg.remote_override_url:
        return ""
    try:
        name = (fetcher or HttpFetcher.from_env()).fetch(cfg.remote_override_url, cfg.remote_timeout_ms or TIMEOUT_MS)
    except Exception:
        return ""
    return name if name in PROFILES else ""


class LatestProfile:
    """A remote's profile as a stream sees it: fetched anew for each micro-batch, the last good one where that fails.

    ``versions`` has (batch, profile, fetched) of every batch so far; a batch that is run again keeps the profile it had.
    """

    def __init__(self, cfg: PolicyConfig, fetcher: ProfileFetcher | None = None):
        self.cfg, self.fetcher = cfg, fetcher
        self.versions: list[tuple[int, str, bool]] = []

    def of(self, batch: int) -> str:
        for b, profile, _ in self.versions:
            if b == batch:
                return profile
        name = remote_profile(self.cfg, self.fetcher)
        last = next((p for _, p, _ in reversed(self.versions) if p), "")
        self.versions.append((batch, name or last, bool(name)))
        return name or last


def governed_batches(
    cfg: PolicyConfig, sink: Callable[[DataFrame, int], None], latest: LatestProfile, **options
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch is governed by the remote's profile of that moment and given to ``sink``, with its batch id."""
    local = replace(cfg, remote_override_url="")

    def run(df: DataFrame, batch: int) -> None:
        now = latest.of(batch)
        sink(df.transform(govern(replace(local, profile=now or cfg.profile), **options)), batch)

    return run


def annotations(text: Column) -> dict[str, Column]:
    """What a ``@Policy(...)`` comment says, as columns: ``profile, block, rewrite, remote``; the last of repeated settings counts."""
    inside = F.regexp_extract(F.coalesce(text, F.lit("")), ANNOTATION.pattern, 1)
    pairs = F.regexp_extract_all(inside, F.lit(SETTING.pattern), F.lit(0))

    def last(name: str) -> Column:
        found = F.filter(pairs, lambda p: F.regexp_extract(p, SETTING.pattern, 1) == name)
        return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))

    def value(name: str) -> Column:
        said = last(name)
        return F.concat(F.regexp_extract(said, SETTING.pattern, 2), F.regexp_extract(said, SETTING.pattern, 3))

    return {"profile": value("profile"), "block": value("block") == "true", "rewrite": value("rewrite") == "true", "remote": value("remote")}


def resolve_profile(override: Column, remote: str, cfg: PolicyConfig) -> Column:
    """Row override (unchecked), remote, configured, strict: the first that isn't empty."""
    return F.coalesce(F.nullif(override, F.lit("")), *[F.lit(p) for p in (remote, cfg.profile, DEFAULT_PROFILE) if p])


def govern(
    cfg: PolicyConfig,
    fetcher: ProfileFetcher | None = None,
    rules: list[Rule] | None = None,
    content: str = "content",
    override: str | None = None,
    strict_errors: bool = False,
) -> Callable[[DataFrame], DataFrame]:
    """Transform that adds ``effective_profile, risk_level, risk_score, finding_count, reasoning, prompt, error``.

    ``prompt`` is null where ``error`` is set (a block); with ``strict_errors`` a block fails the job instead.
    """

    def transform(df: DataFrame) -> DataFrame:
        row = F.col(override) if override else F.lit(None).cast("string")
        known = df.withColumn("effective_profile", resolve_profile(row, remote_profile(cfg, fetcher), cfg))
        scanned = detect(known, rules, content).withColumns(
            {"policy_profile": F.col("effective_profile"), "tool_capabilities": F.array().cast("array<string>")}
        )
        text = F.coalesce(F.col(content), F.lit(""))
        done = evaluate(scanned)
        message = (
            F.concat(F.lit("policy violation ["), F.col("effective_profile"), F.lit("]: "), F.col("reasoning"))
            if cfg.block_on_violation
            else F.concat(F.lit("blocked: "), F.col("reasoning"))
        )
        blocked = F.col("risk_level") == BLOCK
        kept = F.when((F.col("risk_level") == REVIEW) & F.lit(cfg.allow_rewrite), redact(text, F.col("findings"))).otherwise(text)
        error = F.when(blocked, F.raise_error(message) if strict_errors else message)
        return done.withColumns(
            {"error": error.cast("string"), "prompt": F.when(~blocked, kept), "finding_count": F.size("findings")}
        ).drop("policy_profile", "tool_capabilities", "findings", "decision_factors")

    return transform


def governed(cfg: PolicyConfig, **options) -> Callable:
    """Decorator for functions that return a DataFrame of prompts."""

    def wrap(produce: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(produce)
        def run(*args, **kwargs) -> DataFrame:
            return produce(*args, **kwargs).transform(govern(cfg, **options))

        return run

    return wrap


def governance_audit(done: DataFrame, cfg: PolicyConfig, at: Column) -> DataFrame:
    """Audit entries of governed prompts, each the first of its own chain; none where auditing is off."""
    rows = done.where(F.lit(cfg.audit_enabled)).select(
        F.lit(EVENT_ID).alias("event_id"), F.lit("").alias("tenant_id"), F.lit("").alias("session_id"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "risk_level", "risk_score", "finding_count",
        F.col("effective_profile").alias("policy_profile"),
    )
    return sign_alone(rows, cfg.audit_secret)
