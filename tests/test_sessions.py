"""Long sessions in segments against a sequential fold."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import model, requests

from riskloom.functions.rules import EXFIL, INJECTION, MALWARE, PII, RISKY
from riskloom.operators.detect import FINDING, detect
from riskloom.operators.session import cut_points, decide_sessions, in_segments
from riskloom.plans.corpus import POSITIVES
from riskloom.plans.pipeline import ScanConfig, scan

KINDS = [
    [], [], [], [(PII, "medium")], [(RISKY, "high")], [(INJECTION, "medium")], [(EXFIL, "high")], [(INJECTION, "high"), (EXFIL, "high")],
    [(PII, "medium"), (PII, "medium"), (RISKY, "high"), (INJECTION, "medium"), (INJECTION, "medium"), (EXFIL, "high"), (EXFIL, "high"), (PII, "high")], [(MALWARE, "critical")],
]
GRAVE = len(KINDS) - 1


def kind_of(i, first_block):
    if i >= first_block and i % 50_021 == 7:
        return GRAVE
    return i * 2_654_435_761 % 1_000_003 % GRAVE


def long_session(spark, n, first_block, session=None):
    i = F.col("id")
    kind = F.when((i >= first_block) & (i % 50_021 == 7), GRAVE).otherwise(F.pmod(i * 2_654_435_761, F.lit(1_000_003)) % GRAVE).cast("int")
    found = [F.array(*[F.struct(F.lit(c), F.lit("T"), F.lit("d"), F.lit(0.5), F.lit(s), F.lit(None).cast("struct<start:int,end:int>")) for c, s in k]).cast(f"array<{FINDING}>") for k in KINDS]
    return spark.range(0, n, 1, 8).select(
        i, F.format_string("%09d", i).alias("event_id"), F.timestamp_micros(F.expr("id div 3") * 1_000_003).alias("ts"), F.lit("").alias("tenant_id"),
        F.lit(session).cast("string").alias("session_id"), F.lit("permissive").alias("policy_profile"), F.array(F.lit("shell")).alias("tool_capabilities"),
        F.get(F.array(*found), kind).alias("findings"),
    )


def fold(n, first_block):
    scans = reviews = blocks = 0
    last, known = (), {}
    for i in range(n):
        kind = kind_of(i, first_block)
        again, exfil, blocked = last.count(INJECTION) >= 2, last.count(EXFIL) >= 2, blocks > 0
        key = (kind, again, exfil, blocked)
        if key not in known:
            known[key] = model(KINDS[kind], "permissive", ["shell"], again, exfil, blocked)
        level, score = known[key]
        yield level, score, scans, reviews, blocks, ",".join(last), blocked and (again or exfil)
        scans, reviews, blocks = scans + 1, reviews + (level == "REVIEW"), blocks + (level == "BLOCK")
        last = (*last, *(c for c, _ in KINDS[kind]))[-6:]


SHOWN = ["risk_level", "risk_score", "recent_scans", "recent_reviews", "recent_blocks", "categories", "recent_attack_escalation"]


def told(df):
    done = df.withColumn("categories", F.array_join("recent_categories", ",")).select("id", *SHOWN).toArrow().sort_by("id")
    return zip(*(done.column(c).to_pylist() for c in SHOWN), strict=True)


@pytest.mark.parametrize(("n", "rows", "first_block"), [(1_000_000, 100_000, 412_000), (30_000, 1_000, 0), (5_000, 400, 10**9)])
def test_a_long_session_equals_the_fold(spark, n, rows, first_block):
    got = told(decide_sessions(long_session(spark, n, first_block), rows))
    for i, (g, w) in enumerate(zip(got, fold(n, first_block), strict=True)):
        assert g == w, i


def test_segments_are_even_and_many(spark):
    keyed = long_session(spark, 200_000, 0).withColumn("session_key", F.lit("anonymous"))
    cuts = cut_points(keyed, 10_000)
    sizes = Counter({r["_segment"]: r["count"] for r in in_segments(keyed, cuts).groupBy("_segment").count().collect()})
    assert len(sizes) == 20 and max(sizes.values()) < 12_000
    assert cut_points(keyed, 200_000) is None


def test_a_row_does_not_look_at_every_cut(spark):
    keyed = spark.range(5_000).selectExpr("'anonymous' AS session_key", "timestamp_micros(id) AS ts", "id")
    keyed = keyed.union(spark.createDataFrame([("anonymous", None, -1), ("other", None, -1)], "session_key string, ts timestamp, id long"))
    points = list(range(4, 5_000, 5))[:999]
    cuts = spark.createDataFrame([("anonymous", points)], "session_key string, cuts array<long>")
    dealt = in_segments(keyed, cuts)
    assert dealt.where("id >= 0").where(F.col("_segment") != F.least((F.col("id") / 5).cast("int"), F.lit(999))).count() == 0
    assert [r["_segment"] for r in dealt.where("id < 0").collect()] == [0, 0]
    assert "filter(cuts" not in dealt._jdf.queryExecution().optimizedPlan().toString()


def test_the_long_session_s_plan_deals_segments(spark):
    plan = decide_sessions(long_session(spark, 20_000, 0), 2_000)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert dealt and all("_segment" in line for line in dealt) and "SinglePartition" not in plan


def test_sessions_of_all_sizes_at_once(spark):
    prompts = [*POSITIVES.values(), "hello"] * 12
    keys = [("", "") if i % 3 else ("t", f"s{i % 40}") for i in range(len(prompts))]
    rows = requests(spark, prompts, "permissive", keys)
    rows = rows.union(rows.where("event_id = 'e00007'").withColumns({"event_id": F.lit("none"), "ts": F.lit(None).cast("timestamp")}))
    shown = ["event_id", "session_key", "recent_scans", "recent_reviews", "recent_blocks", "recent_categories", "risk_level", "risk_score", "reasoning", "safe_rewrite"]
    whole, cut = (sorted(map(tuple, scan(rows, ScanConfig(segment_rows=n)).select(*shown).collect())) for n in (10**6, 25))
    assert whole == cut and len(cut) == len(prompts) + 1


def test_times_without_a_zone(spark):
    rows = long_session(spark, 3_000, 0).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert list(told(decide_sessions(rows, 500))) == list(fold(3_000, 0))


def test_no_and_null_rows(spark):
    none = long_session(spark, 0, 0)
    assert decide_sessions(none, 1).count() == 0
    one = detect(requests(spark, [None, "", "hello"], keys=[(None, None)] * 3))
    assert [r["recent_scans"] for r in decide_sessions(one, 1).orderBy("event_id").collect()] == [0, 1, 2]


def test_texts_stay_where_they_are(spark):
    asked = scan(requests(spark, ["hello"] * 50)).groupBy("risk_level").count()
    shuffles = [x for x in asked._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    assert shuffles and "content" not in asked._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0]
