"""Structured Streaming: the same detection and policy, with session memory as keyed state.

Detection is stateless and stays in the plan. The state of a session is its counters and last categories; each
micro-batch sorts a session's new requests by (ts, event_id) and folds them in. Requests that arrive in
order give what the batch plan gives; one that comes in a later batch than its successors is
folded in when it comes. There is no time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import EXFIL, INJECTION, PACKS
from ..operators.detect import detect
from ..operators.policy import BLOCK, REVIEW, evaluate, with_outcomes
from ..operators.session import REMEMBERED, REPEATED, session_key
from ..sources.ingest import with_defaults

STATE = "scans int, reviews int, blocks int, categories string"
OUT = (
    "event_id string, session_key string, risk_level string, risk_score int, recent_scans int, recent_reviews int, "
    "recent_blocks int, repeated_injection_attempts boolean, repeated_exfiltration_hints boolean, recent_attack_escalation boolean"
)
VARIANTS = [(i, x, b) for i in (False, True) for x in (False, True) for b in (False, True)]


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    scans, reviews, blocks, remembered = state.get if state.exists else (0, 0, 0, "")
    last = remembered.split(",") if remembered else []
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    out = []
    for r in rows.itertuples():
        injection, exfil = last.count(INJECTION) >= REPEATED, last.count(EXFIL) >= REPEATED
        level, score = r.outcomes.split(",")[VARIANTS.index((injection, exfil, blocks > 0))].split(":")
        out.append((r.event_id, key[0], level, int(score), scans, reviews, blocks, injection, exfil, blocks > 0 and (injection or exfil)))
        scans, reviews, blocks = scans + 1, reviews + (level == REVIEW), blocks + (level == BLOCK)
        last = [*last, *(r.categories.split(",") if r.categories else [])][-REMEMBERED:]
    state.update((scans, reviews, blocks, ",".join(last)))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def session_decisions(requests: DataFrame, pack: str = "visible") -> DataFrame:
    """A streaming frame of decisions, in append mode."""
    found = detect(with_defaults(requests), PACKS[pack])
    keyed = with_outcomes(found, VARIANTS).select(
        session_key(F.col("tenant_id"), F.col("session_id")).alias("session_key"), "ts", "event_id", "outcomes",
        F.array_join(F.transform("findings", lambda f: f["category"]), ",").alias("categories"),
    )
    return keyed.groupBy("session_key").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def decision_counts(requests: DataFrame, pack: str = "visible") -> DataFrame:
    """Running counts by level, for complete mode; decisions without session signals."""
    return evaluate(detect(with_defaults(requests), PACKS[pack])).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


def tumbling_counts(requests: DataFrame, width: str = "1 hour", late: str = "10 minutes", pack: str = "visible") -> DataFrame:
    """Counts by window, tenant and level on event time, with a watermark."""
    decided = evaluate(detect(with_defaults(requests.withWatermark("ts", late)), PACKS[pack]))
    return decided.groupBy(F.window("ts", width), "tenant_id", "risk_level").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), "tenant_id", "risk_level", "n"
    )
