"""Chains checked in ranges, Merkle seals and proofs, against hashes made by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_operators import requests

from riskloom.operators import audit
from riskloom.plans.pipeline import ScanConfig, audit_log, scan

KEYS = ["tenant_id", "day"]


@pytest.fixture(scope="module")
def log(spark):
    prompts = ["hello" if i % 5 else "rm -rf /" for i in range(331)]
    keys = [("t0", "s")] + [("t1", "s")] * 17 + [("t2", "s")] * 300 + [(None, None)] * 13
    rows = audit_log(scan(requests(spark, prompts, keys=keys)), ScanConfig(secret="k"))
    from riskloom.sources.shared import written

    return written(rows, "test-log")


def tree(signatures, fan=16):
    level = [hashlib.sha256(b"\x00" + s.encode()).hexdigest() for s in signatures]
    while True:
        level = [hashlib.sha256(b"\x01" + "".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            return level[0]


def test_seals_equal_trees_by_hand(log):
    chains = {}
    for r in log.orderBy("tenant_id", "seq").collect():
        chains.setdefault((r["tenant_id"], r["day"]), []).append(r["signature"])
    got = {(r["tenant_id"], r["day"]): r for r in audit.seal(log, "k", KEYS).collect()}
    assert set(got) == set(chains) and sorted(len(c) for c in chains.values()) == [1, 13, 17, 300]
    for k, signatures in chains.items():
        assert (got[k]["entries"], got[k]["root"]) == (len(signatures), tree(signatures))
    small = {(r["tenant_id"], r["day"]): r["root"] for r in audit.seal(log, "k", KEYS, fan=3).collect()}
    assert small == {k: tree(c, 3) for k, c in chains.items()}


def test_ranges_find_what_one_window_finds(log):
    for rows in (1, 4, 16, 1000):
        assert audit.verify(log, "k", KEYS, rows).where("not valid").count() == 0
        bent = log.withColumn("risk_score", F.when((F.col("seq") == 16) & (F.col("tenant_id") == "t2"), F.col("risk_score") + 1).otherwise(F.col("risk_score")))
        assert [(r["tenant_id"], r["seq"]) for r in audit.verify(bent, "k", KEYS, rows).where("not valid").collect()] == [("t2", 16)]
        cut = log.where("tenant_id <> 't2' or seq not between 8 and 15")  # whole ranges of 4
        assert [(r["tenant_id"], r["seq"]) for r in audit.verify(cut, "k", KEYS, rows).where("not valid").collect()] == [("t2", 16)]


def test_a_single_chain_is_checked_in_many_tasks(spark):
    decided = scan(requests(spark, ["hello"] * 200, keys=[(f"t{i % 3}", "s") for i in range(200)]))
    single = audit.chain(audit.entries(decided), "k")
    checked = audit.verify(single, "k", range_rows=20)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    windows = plan[: plan.index("MapInPandas")]
    assert "hashpartitioning(_range" in windows and "SinglePartition" not in windows
    assert checked.where("valid").count() == 200
    assert audit.check_seals(single.where("seq < 150"), audit.seal(single, "k"), "k").first()["status"] == "shorter"


def test_what_seals_tell(log):
    seals, nodes = audit.seal(log, "k", KEYS), audit.merkle(log, KEYS)

    def status(df, s=seals):
        return {r["tenant_id"]: r["status"] for r in audit.check_seals(df, s, "k", KEYS).collect()}

    whole = dict.fromkeys(("", "t0", "t1", "t2"), "whole")
    assert status(log) == whole and audit.locate(log, nodes, KEYS).count() == 0
    tail = log.where("tenant_id <> 't2' or seq < 290")
    assert audit.verify(tail, "k", KEYS).where("not valid").count() == 0  # a chain alone doesn't show its tail is gone
    assert status(tail) == {**whole, "t2": "shorter"}
    assert [(r["tenant_id"], r["first"], r["last"]) for r in audit.locate(tail, nodes, KEYS).collect()] == [("t2", 288, 303)]
    middle = log.where("tenant_id <> 't2' or seq <> 100")
    assert [(r["first"], r["last"]) for r in audit.locate(middle, nodes, KEYS).collect()] == [(96, 111)]
    assert status(log.where("tenant_id <> 't0'"))["t0"] == "missing"
    assert status(log, seals.where("tenant_id <> 't1'"))["t1"] == "unsealed"
    assert status(log, seals.withColumn("entries", F.col("entries") + F.when(F.col("tenant_id") == "t1", 1).otherwise(0)))["t1"] == "forged"
    more = log.union(log.where("tenant_id = 't1' and seq = 16").withColumn("seq", F.col("seq") + 1))
    assert status(more)["t1"] == "longer"
    assert audit.check_seals(log.limit(0), seals, "k", KEYS).where("status <> 'missing'").count() == 0
    assert audit.seal(log.limit(0), "k", KEYS).count() == 0


def test_proofs(log):
    nodes = audit.merkle(log, KEYS)
    roots = nodes.where("top").select(*KEYS, F.col("digest").alias("root"))
    made = audit.proofs(log.select(*KEYS, "seq", "signature"), log, nodes, KEYS).join(roots, KEYS)
    ok = audit.proven(F.col("signature"), F.col("proof"), F.col("root"))
    rows = made.select("tenant_id", "seq", F.size("proof").alias("n"), ok.alias("ok"), audit.proven(F.reverse("signature"), F.col("proof"), F.col("root")).alias("other")).collect()
    assert len(rows) == 331 and all(r["ok"] and not r["other"] for r in rows)
    assert {(r["tenant_id"], r["n"]) for r in rows} == {("", 1), ("t0", 1), ("t1", 2), ("t2", 3)}
    moved = made.where("tenant_id = 't2'").withColumn("proof", F.transform("proof", lambda s: s.withField("place", F.lit(1))))
    assert moved.where(ok).count() == 1  # only the first entry stands in the first place everywhere


def test_proofs_equal_trees_by_hand_and_do_not_shuffle(log):
    nodes = audit.merkle(log, KEYS, 3)
    asked = log.select(*KEYS, "seq", "signature")
    made = audit.proofs(asked.union(asked.where("seq = 5")), log, nodes, KEYS, 3)  # an entry asked for twice has its proof twice
    chains = {}
    for r in log.orderBy("tenant_id", "seq").collect():
        chains.setdefault(r["tenant_id"], []).append(r["signature"])
    got = sorted((r["tenant_id"], r["seq"], [(s["place"], s["digests"]) for s in r["proof"]]) for r in made.collect())
    want = []
    for tenant, signatures in chains.items():
        levels = [[hashlib.sha256(b"\x00" + s.encode()).hexdigest() for s in signatures]]
        while len(levels) == 1 or len(levels[-1]) > 1:
            levels.append([hashlib.sha256(b"\x01" + "".join(levels[-1][i : i + 3]).encode()).hexdigest() for i in range(0, len(levels[-1]), 3)])
        for seq in [*range(len(signatures)), *([5] if len(signatures) > 5 else [])]:
            at = [seq // 3**k for k in range(len(levels) - 1)]
            want.append((tenant, seq, [(n % 3 + 1, level[n // 3 * 3 : n // 3 * 3 + 3]) for n, level in zip(at, levels, strict=False)]))
    assert got == sorted(want)
    plan = audit.proofs(asked, log, nodes, KEYS)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange")]
    assert "SortMergeJoin" in above or "BroadcastHashJoin" in above or "ShuffledHashJoin" in above
    assert "explode" not in above.lower() and "Aggregate" not in above


def test_proofs_of_a_single_chain(spark):
    single = audit.chain(audit.entries(scan(requests(spark, ["hello"] * 40))), "k")
    nodes = audit.merkle(single)
    made = audit.proofs(single.select("seq", "signature"), single, nodes)
    root = nodes.where("top").first()["digest"]
    assert made.where(audit.proven(F.col("signature"), F.col("proof"), F.lit(root))).count() == 40 == made.count()


def test_a_seal_from_a_tree_that_is_there(log):
    nodes = audit.merkle(log, KEYS)
    made = audit.seal(log.drop("signature"), "k", KEYS, nodes=nodes)  # no signature is hashed again
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, audit.seal(log, "k", KEYS).collect()))
