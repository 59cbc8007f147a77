"""Repeated keys, event ids, response texts, and detection on frames of any shape."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.functions.rules import VISIBLE_RULES
from riskloom.operators.detect import dealt, detect, rule_hits
from riskloom.plans.corpus import POSITIVES
from riskloom.plans.pipeline import scan
from riskloom.sources import ingest

REQUEST = "event_id string, ts timestamp, tenant_id string, session_id string, content string, policy_profile string, tool_capabilities array<string>"


@pytest.mark.parametrize(
    ("text", "content", "trust", "tools", "reject"),
    [
        ('{"content":"a","content":"b"}', "b", "", [], None), ('{"CONTENT":"a","content":"b","Content":"c"}', "c", "", [], None),
        ('{"content":"a","content":null}', "a", "", [], None), ('{"content":"a","content":1}', None, None, None, ingest.INVALID),
        ('{"content":1,"content":"a"}', None, None, None, ingest.INVALID), ('{"content":"a","x":{"y":1,"y":2}}', "a", "", [], None),
        ('{"content":"a","context":{"trust_level":"t"},"context":{"tool_capabilities":["x",null]}}', "a", "t", ["x", ""], None),
        ('{"content":"a","context":{"trust_level":"t"},"context":null}', "a", "", [], None),
        ('{"content":"a","context":null,"context":{"Trust_Level":"u","trust_level":"v"}}', "a", "v", [], None),
        ('{"content":"a","context":{"trust_level":5}}', None, None, None, ingest.INVALID), ('{"content":"a","context":3}', None, None, None, ingest.INVALID),
        (" null ", "", "", [], ingest.EMPTY), ("{'content':'a'}", None, None, None, ingest.INVALID), ('{"content":NaN}', None, None, None, ingest.INVALID),
        ('{"content":"a"', None, None, None, ingest.INVALID), ("", None, None, None, ingest.INVALID),
    ],
)
def test_decoding_of_repeated_and_odd_keys(spark, text, content, trust, tools, reject):
    r = ingest.decode(spark.createDataFrame([(text, 9)], "value string, offset int")).first()
    assert (r["content"], r["trust_level"], r["tool_capabilities"], r["reject"], r["offset"]) == (content, trust, tools, reject, 9)


def test_event_ids_are_distinct_and_repeatable(spark):
    rows = [("", f"2024-05-01 00:00:0{i % 2}", "t", "s", "same prompt", "", None, i) for i in range(4)]
    df = spark.createDataFrame(rows, REQUEST.replace("timestamp", "string") + ", offset int").withColumn("ts", F.col("ts").cast("timestamp"))
    ids = [r["event_id"] for r in ingest.with_defaults(df, ["offset"]).orderBy("offset").collect()]
    assert len(set(ids)) == 4 and ids == [r["event_id"] for r in ingest.with_defaults(df, ["offset"]).orderBy("offset").collect()]
    assert len({r["event_id"] for r in ingest.with_defaults(df).collect()}) == 2
    assert {r["event_id"] for r in ingest.with_defaults(df.withColumn("event_id", F.lit("own"))).collect()} == {"own"}


def test_responses_are_json_that_a_page_may_hold(spark):
    prompts = ['<script>alert("x") & more</script>  ', POSITIVES["PII02"], "hello"]
    df = spark.createDataFrame([(f"e{i}", None, "<t>", "s", p, "strict", []) for i, p in enumerate(prompts)], REQUEST).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    bodies = [r["value"] for r in ingest.responses(scan(df)).orderBy("event_id").collect()]
    assert not any(c in b for b in bodies for c in "<>& ") and [json.loads(b)["tenant_id"] for b in bodies] == ["<t>"] * 3
    assert json.loads(bodies[1])["findings"][0]["location"] and "findings" in json.loads(bodies[2])
    lines = [r["line"] for r in ingest.access_log(scan(df)).orderBy("event_id").collect()]
    assert lines[2] == "[SAFE] e2 | score=0 | findings=0" and len(lines) == 3


def test_detection_keeps_every_column(spark):
    df = spark.createDataFrame([(1, POSITIVES["INJ01"], "t", "f", 3, "h"), (2, None, "t", "f", 3, "h")], "id int, content string, _text string, _Folded string, _digits int, _hits string")
    out = detect(df)
    assert out.columns == [*df.columns, "findings"] and {(r["_text"], r["_Folded"], r["_digits"], r["_hits"]) for r in out.collect()} == {("t", "f", 3, "h")}
    assert [(r["id"], r["rule_id"]) for r in rule_hits(df, VISIBLE_RULES, "id").collect()] == [(1, "INJ01")]


def test_rows_are_dealt_only_where_a_scan_has_few_partitions(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert dealt(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and dealt(one).count() == 1000
    wide = spark.range(0, 1000, 1, 64)
    assert dealt(wide).rdd.getNumPartitions() == 64 and dealt(wide.groupBy("id").count()).count() == 1000


# -- files, streams and remotes that change ------------------------------------------------------------


def test_lone_surrogates_become_the_replacement_character(spark):
    texts = {
        r'{"content":"a\ud800b"}': "a�b", r'{"content":"\udc00"}': "�", r'{"content":"😀"}': "\U0001f600", r'{"content":"\ud800\ud800x"}': "��x",
        r'{"content":"\\ud800"}': r"\ud800", r'{"content":"\\\ud800"}': "\\�", r'{"content":"\uD83D"}': "�",
    }
    got = {r["v"]: r["content"] for r in ingest.decode(spark.createDataFrame([(t, t) for t in texts], "v string, value string")).collect()}
    assert got == texts


def test_files_of_requests_as_a_batch_and_as_a_stream(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    sets = [['{"content":"a"}', '{"content":5}', '{"content":"a"}'], ['{"content":"b"}', "{", '{"CONTENT":"c"}']]
    for n, lines in enumerate(sets):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(folder)
        for _ in range(2):  # the second time there is nothing new
            started = ingest.read_requests(spark, folder, stream=True).writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
            started.awaitTermination()
        assert spark.read.parquet(out).count() == 3 * (n + 1)
    shown = ["content", "reject", "file"]
    batch = ingest.read_requests(spark, folder)
    assert sorted(map(str, batch.select(*shown).collect())) == sorted(map(str, spark.read.parquet(out).select(*shown).collect()))
    assert ingest.accepted(batch).count() == 4 and ingest.rejected(batch).count() == 2
    ids = [r["event_id"] for r in ingest.with_defaults(ingest.accepted(batch), ["file"]).collect()]
    assert len(set(ids)) == 3 and sorted(ids) == sorted(r["event_id"] for r in ingest.with_defaults(ingest.accepted(spark.read.parquet(out)), ["file"]).collect())


def test_a_remote_that_changes_between_batches(spark, tmp_path):
    from riskloom.operators import govern
    from riskloom.plans.corpus import POSITIVES

    answers = iter(["permissive", "strict", OSError("down"), "odd", "moderate"])

    class Remote:
        def fetch(self, url, timeout_ms):
            answer = next(answers)
            if isinstance(answer, Exception):
                raise answer
            return answer

    cfg = govern.PolicyConfig(profile="moderate", remote_override_url="http://control")
    latest, seen = govern.LatestProfile(cfg, Remote()), {}

    def sink(df, batch):
        seen[batch] = [(r["effective_profile"], r["risk_level"]) for r in df.collect()]

    run = govern.governed_batches(cfg, sink, latest)
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    for _ in range(5):
        spark.createDataFrame([(POSITIVES["INJ01"],)], "content string").coalesce(1).write.mode("append").parquet(folder)
        started = spark.readStream.schema("content string").parquet(folder).writeStream.foreachBatch(run).option("checkpointLocation", state).trigger(availableNow=True).start()
        started.awaitTermination()
    assert seen == {0: [("permissive", "REVIEW")], 1: [("strict", "BLOCK")], 2: [("strict", "BLOCK")], 3: [("strict", "BLOCK")], 4: [("moderate", "REVIEW")]}
    assert latest.of(1) == "strict" and latest.versions[2] == (2, "strict", False)  # a batch that is run again keeps its profile
    down = govern.LatestProfile(cfg, type("Down", (), {"fetch": lambda *a: (_ for _ in ()).throw(OSError())})())
    govern.governed_batches(cfg, sink, down)(spark.createDataFrame([("x",)], "content string"), 9)
    assert seen[9] == [("moderate", "SAFE")]


def test_small_inputs_are_dealt_and_large_ones_stay(spark, small, monkeypatch):
    from riskloom.operators import detect

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert detect.dealt(docs).rdd.getNumPartitions() > docs.rdd.getNumPartitions()
    monkeypatch.setattr(detect, "DEALT_BYTES", 1)
    assert detect.dealt(docs) is docs
