"""The request life cycle as one plan: detect, remember, decide, redact; then audit and count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import PACKS
from ..operators.audit import chain, entries
from ..operators.detect import detect, or_ok
from ..operators.policy import evaluate
from ..operators.rewrite import safe_rewrite
from ..operators.session import SEGMENT_ROWS, decide_sessions
from ..operators.stats import by_decision
from ..sources.ingest import with_defaults


@dataclass(frozen=True)
class ScanConfig:
    pack: str = "visible"
    sessions: bool = True
    overlap: str = "sequential"
    secret: str = "dev-secret"
    chain_keys: tuple[str, ...] = ("tenant_id", "day")
    segment_rows: int = SEGMENT_ROWS


def scan(requests: DataFrame, cfg: ScanConfig | None = None) -> DataFrame:
    """Requests with ``findings``, decision and ``safe_rewrite``; one shuffle (on session and segment) if sessions count.

    Texts are redacted before that shuffle, so a plan that doesn't ask for ``content`` doesn't move it.
    """
    cfg = cfg or ScanConfig()
    found = safe_rewrite(detect(with_defaults(requests), PACKS[cfg.pack]), cfg.overlap)
    return decide_sessions(found, cfg.segment_rows) if cfg.sessions else evaluate(found)


def audit_log(decided: DataFrame, cfg: ScanConfig | None = None) -> DataFrame:
    cfg = cfg or ScanConfig()
    rows = entries(decided).withColumn("day", F.substring("timestamp", 1, 10))
    return chain(rows, cfg.secret, list(cfg.chain_keys))


def stats(decided: DataFrame) -> DataFrame:
    return by_decision(decided)


def response_rows(decided: DataFrame) -> DataFrame:
    """One row per request and finding, the OK placeholder included."""
    return decided.select("event_id", "risk_level", F.posexplode(or_ok(F.col("findings"))).alias("n", "f")).select(
        "event_id", "risk_level", "n", "f.category", "f.type", "f.detail", "f.confidence", "f.severity",
        F.col("f.location.start").alias("span_start"), F.col("f.location.end").alias("span_end"),
    )
