"""Streams that end in storage: restart, replay, idle sessions, pages and counters."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_operators import requests

from riskloom.operators import audit
from riskloom.plans.corpus import POSITIVES
from riskloom.plans.pipeline import ScanConfig, audit_log, scan
from riskloom.streaming import store
from riskloom.streaming.memory import remembered_decisions, rocksdb

SCHEMA = "event_id string, ts timestamp, tenant_id string, session_id string, content string, policy_profile string, tool_capabilities array<string>"
SHOWN = ["event_id", "risk_level", "risk_score", "recent_scans", "recent_reviews", "recent_blocks", "recent_attack_escalation"]


def prompts(n=60):
    return [[*POSITIVES.values(), "hello"][i * 7 % 57] for i in range(n)]


def keys(n=60):
    return [(f"t{i % 2}", f"s{i % 5}") if i % 7 else ("", "") for i in range(n)]


def run(spark, folder, sink, state):
    with rocksdb(spark):
        writer = sink(spark.readStream.schema(SCHEMA).parquet(folder)).option("checkpointLocation", state).trigger(availableNow=True)
        started = writer.start()
    started.awaitTermination()
    return started


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = requests(spark, prompts(), keys=keys())
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for low, high in ((0, 20), (20, 45), (45, 60)):
        rows.where(F.col("event_id").between(f"e{low:05d}", f"e{high - 1:05d}")).write.mode("append").parquet(source)
        run(spark, source, lambda s: remembered_decisions(s).writeStream.format("parquet").option("path", out), state)
    got = sorted(map(tuple, spark.read.parquet(out).select(*SHOWN).collect()))
    assert got == sorted(map(tuple, scan(rows).select(*SHOWN).collect()))


def test_idle_sessions_leave_the_state(spark, tmp_path):
    at, source, out, state = datetime(2024, 5, 1), *(str(tmp_path / x) for x in ("in", "out", "state"))
    bad = POSITIVES["MAL01"]
    steps = [
        [("a", 0, bad), ("b", 0, bad)], [("a", 30, "hello")], [("a", 200, "hello")], [("c", 201, "hello")], [("b", 202, "hello"), ("a", 203, "hello")],
    ]  # minutes; a session is forgotten after an hour
    n, sizes = 0, []
    for step in steps:
        made = [(f"e{(n := n + 1):03d}", at + timedelta(minutes=m), "t", s, text, "strict", []) for s, m, text in step]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        q = run(spark, source, lambda s: remembered_decisions(s, 3_600_000, "1 minute").writeStream.format("parquet").option("path", out), state)
        sizes.append(q.lastProgress["stateOperators"][0]["customMetrics"])
    got = {r["event_id"]: r["recent_scans"] for r in spark.read.parquet(out).collect()}
    # Half an hour later session a is still known; b rested for 202 minutes and is new, and so is a after its rest.
    assert got == {"e001": 0, "e002": 0, "e003": 1, "e004": got["e004"], "e005": 0, "e006": 0, "e007": got["e004"] + 1}
    assert sizes


def decided(spark, n=60):
    return scan(requests(spark, prompts(n), keys=keys(n)))


def test_a_replayed_batch_appends_nothing_twice(spark, tmp_path):
    path, rows = str(tmp_path / "log"), decided(spark)
    assert store.log(spark, path).count() == 0 and store.totals(spark, path).first()["total_scans"] == 0
    parts = [rows.where(F.col("event_id").between(f"e{a:05d}", f"e{b:05d}")) for a, b in ((0, 24), (25, 39), (40, 59))]
    seen = []
    for batch, part in enumerate(parts):
        store.append(part, batch, path, "k")
        seen.append(store.totals(spark, path).first()["total_scans"])
    store.append(parts[2], 2, path, "k")  # the last batch again, as after a failure
    assert seen == [25, 40, 60]
    kept = store.log(spark, path)
    want = audit_log(rows, ScanConfig(secret="k"))
    shown = ["event_id", "tenant_id", "day", "seq", "prev_signature", "signature"]
    assert sorted(map(tuple, kept.select(*shown).collect())) == sorted(map(tuple, want.select(*shown).collect()))
    assert audit.verify(kept, "k", store.CHAIN).where("not valid").count() == 0
    counted = {(r["tenant_id"], r["risk_level"]): r["n"] for r in store.counters(spark, path).collect()}
    assert counted == {(r["tenant_id"] or "", r["risk_level"]): r["count"] for r in rows.groupBy("tenant_id", "risk_level").count().collect()}


def test_pages_read_their_partitions_only(spark, tmp_path):
    path = str(tmp_path / "log")
    store.append(decided(spark), 0, path, "k")
    first = store.page(spark, path, "t1", "2024-05-01", rows=10)
    second = store.page(spark, path, "t1", "2024-05-01", after=9, rows=10)
    assert [r["seq"] for r in first.collect()] == list(range(10)) and [r["seq"] for r in second.collect()] == list(range(10, 20))
    plan = first._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "day" in filters and "bucket" in filters
    assert store.page(spark, path, "nobody", "2024-05-01").count() == 0


def test_a_stream_into_the_log(spark, tmp_path):
    rows = requests(spark, prompts(), keys=keys())
    source, path, state = (str(tmp_path / x) for x in ("in", "log", "state"))
    for low, high in ((0, 30), (30, 60)):
        rows.where(F.col("event_id").between(f"e{low:05d}", f"e{high - 1:05d}")).write.mode("append").parquet(source)
        run(spark, source, lambda s: remembered_decisions(s).writeStream.foreachBatch(store.appender(path, "k")), state)
    kept = store.log(spark, path)
    assert kept.count() == 60 and audit.verify(kept, "k", store.CHAIN).where("not valid").count() == 0


def test_the_session_s_setting_is_left_alone(spark):
    from riskloom.streaming.memory import PROVIDER

    before = spark.conf.get(PROVIDER, None)
    with pytest.raises(ValueError), rocksdb(spark):
        raise ValueError
    assert spark.conf.get(PROVIDER, None) == before


def test_outcomes_come_from_facts_made_once(spark):
    from riskloom.operators.detect import detect
    from riskloom.operators.policy import evaluate, with_outcomes
    from riskloom.streaming.scan import VARIANTS

    found = detect(requests(spark, prompts(), keys=keys())).withColumn("policy_profile", F.get(F.array(*map(F.lit, ("strict", "moderate", "permissive"))), F.pmod(F.hash("event_id"), F.lit(3))))
    made = with_outcomes(found, VARIANTS)
    got = {r["event_id"]: r["outcomes"].split(",") for r in made.collect()}
    for k, signals in enumerate(VARIANTS):
        for r in evaluate(found, *map(F.lit, signals)).collect():
            assert got[r["event_id"]][k] == f"{r['risk_level']}:{r['risk_score']}"
    plan = made.select("event_id", "outcomes")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS _worst#") == 1


def test_a_stream_of_one_file_is_dealt_over_the_cores(spark, small):
    from riskloom.plans.queries import _event_stream

    plan = _event_stream(spark, small)._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression [event_id" in plan and plan.index("RepartitionByExpression") > plan.index("Join")
