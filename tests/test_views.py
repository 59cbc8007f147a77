"""The engine from SQL."""

import pytest

from riskloom.operators.govern import PolicyConfig
from riskloom.plans.corpus import POSITIVES
from riskloom.plans.pipeline import ScanConfig
from riskloom.plans.views import create_views

TEXTS = ["hello", POSITIVES["INJ01"], POSITIVES["MAL01"], "ssn 123-45-6789", None]


@pytest.fixture
def asked(spark):
    spark.createDataFrame(list(enumerate(TEXTS)), "id int, Content string").createOrReplaceTempView("asked")
    return create_views(spark, "asked", policy=PolicyConfig(profile="moderate", allow_rewrite=True))


def test_views(spark, asked):
    assert asked == ["prescan", "prescan_findings", "prescan_governed"]
    levels = {r["id"]: r["risk_level"] for r in spark.sql("SELECT id, risk_level FROM prescan").collect()}
    assert levels == {0: "SAFE", 1: "BLOCK", 2: "BLOCK", 3: "BLOCK", 4: "SAFE"}
    assert spark.sql("SELECT sum(span_end - span_start) AS n FROM prescan_findings WHERE type = 'US_SSN'").first()["n"] == 11
    out = {r["id"]: (r["prompt"], r["error"]) for r in spark.sql("SELECT id, prompt, error FROM prescan_governed").collect()}
    assert out[0] == ("hello", None) and out[2][0] is None and out[2][1].startswith("blocked") and out[1] == (TEXTS[1], None) and out[4] == ("", None)


def test_own_columns_and_sessions(spark):
    spark.sql("SELECT *, timestamp'2024-05-01' AS ts, 'permissive' AS policy_profile, concat('e', id) AS event_id FROM VALUES (1, 'hello'), (2, 'rm -rf build') AS t(id, content)").createOrReplaceTempView("asked2")
    create_views(spark, "asked2", ScanConfig(), prefix="p2")
    got = [tuple(r) for r in spark.sql("SELECT event_id, risk_level, recent_scans FROM p2 ORDER BY id").collect()]
    assert got == [("e1", "SAFE", 0), ("e2", "REVIEW", 1)]


def test_a_count_moves_no_text(spark, asked):
    plan = spark.sql("SELECT risk_level, count(*) FROM prescan GROUP BY risk_level")._jdf.queryExecution().optimizedPlan().toString()
    assert "safe_rewrite" not in plan
