"""Session memory as keyed state with an end, on the RocksDB state store.

A session's state is its counters, its last categories (a list) and the time of its latest request. A timer on event time goes
off when nothing has come for ``idle``; the session is then forgotten, and what comes later begins a new one. Without ``idle``
sessions are kept for good, as the batch plan does. The state is in the checkpoint, so a stream that was killed goes on
where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.rules import EXFIL, INJECTION, PACKS
from ..operators.detect import detect
from ..operators.policy import BLOCK, REVIEW, with_outcomes
from ..operators.session import REMEMBERED, REPEATED, session_key
from ..sources.ingest import with_defaults
from .scan import VARIANTS

#: What the decisions of a stream carry: enough for an audit entry and for the counters.
DECISION = (
    "event_id string, tenant_id string, session_id string, ts timestamp, policy_profile string, finding_count int, session_key string, risk_level string, risk_score int, "
    "recent_scans int, recent_reviews int, recent_blocks int, repeated_injection_attempts boolean, repeated_exfiltration_hints boolean, recent_attack_escalation boolean"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's setting is as before afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class SessionMemory(StatefulProcessor):
    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "scans int, reviews int, blocks int, latest long")
        self.last = handle.getListState("last", "category string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        scans, reviews, blocks, latest = self.counts.get() if self.counts.exists() else (0, 0, 0, 0)
        last = [c for (c,) in self.last.get()] if self.last.exists() else []
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for r in new.itertuples():
            injection, exfil = last.count(INJECTION) >= REPEATED, last.count(EXFIL) >= REPEATED
            level, score = r.outcomes.split(",")[VARIANTS.index((injection, exfil, blocks > 0))].split(":")
            out.append(
                (
                    r.event_id, r.tenant_id, r.session_id, r.ts, r.policy_profile, r.finding_count, key[0], level, int(score),
                    scans, reviews, blocks, injection, exfil, blocks > 0 and (injection or exfil),
                )
            )
            scans, reviews, blocks = scans + 1, reviews + (level == REVIEW), blocks + (level == BLOCK)
            last = [*last, *(r.categories.split(",") if r.categories else [])][-REMEMBERED:]
        latest = max(latest, int(new["ts"].max().timestamp() * 1000))
        self.counts.update((scans, reviews, blocks, latest))
        if last:
            self.last.put([(c,) for c in last])
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(latest + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def remembered_decisions(requests: DataFrame, idle_ms: int | None = None, late: str = "1 hour", pack: str = "visible") -> DataFrame:
    """A streaming frame of decisions with what an audit entry needs, in append mode; start it inside :func:`rocksdb`.

    Requests later than ``late`` behind the latest one are dropped.
    """
    found = detect(with_defaults(requests.withWatermark("ts", late)), PACKS[pack])
    keyed = with_outcomes(found, VARIANTS).select(
        session_key(F.col("tenant_id"), F.col("session_id")).alias("session_key"), "ts", "event_id", "tenant_id", "session_id", "policy_profile", "outcomes",
        F.size("findings").alias("finding_count"), F.array_join(F.transform("findings", lambda f: f["category"]), ",").alias("categories"),
    )
    mode = "none" if idle_ms is None else "eventTime"
    return keyed.groupBy("session_key").transformWithStateInPandas(SessionMemory(idle_ms), DECISION, "append", mode)
