"""The chains, the ratio, the cutting of tokens and the redaction of secrets against plain re-tellings."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.llm import secrets

DOCS = "doc_id long, text string"
BASE62 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


@pytest.fixture(scope="module")
def table(spark):
    return secrets.train(secrets.labelled_samples(spark))


def slow_class(c):
    return secrets.ALPHABET.index(c) if c in secrets.ALPHABET else len(secrets.ALPHABET)


def slow_llr(token, table):
    return sum(table[slow_class(a) * secrets.N_CLASSES + slow_class(b)] for a, b in zip(token, token[1:], strict=False))


def test_chains_equal_a_count_by_hand(spark):
    rows = [(t, 1) for t in ("q8Zt3L", "AbAbAb==", "x")] + [(t, 0) for t in ("user_name", "getUser", "", "a-b é")]
    got = secrets.train(spark.createDataFrame(rows, "text string, random int"))
    n, counts = secrets.N_CLASSES, {0: {}, 1: {}}
    for t, y in rows:
        for a, b in zip(t, t[1:], strict=False):
            key = slow_class(a), slow_class(b)
            counts[y][key] = counts[y].get(key, 0) + 1
    for a in range(n):
        total = {y: sum(counts[y].get((a, b), 0) + 0.5 for b in range(n)) for y in (0, 1)}
        for b in range(n):
            p, q = ((counts[y].get((a, b), 0) + 0.5) / total[y] for y in (1, 0))
            assert math.isclose(got[a * n + b], math.log(p / q), rel_tol=1e-9, abs_tol=1e-12)


def slow_groups(start, hit, table):
    """Random spans of a part: pieces cut after = and /, groups of most evidence, else the whole."""
    out, at = [], start
    group, total, peak, end = at, 0.0, 0.0, at
    pieces = [p for p in re.split(r"(?<=[=/])", hit) if p]

    def close():
        if peak > secrets.PRIOR and end - group >= secrets.LEAST:
            out.append((group, end))

    for p in pieces:
        at += len(p)
        total += slow_llr(p, table) - secrets.RATE * len(p)
        if total <= 0 or total < peak - secrets.PRIOR:
            close()
            group, total, peak, end = at, 0.0, 0.0, at
        elif total > peak:
            peak, end = total, at
    close()
    if not out and slow_llr(hit, table) > secrets.PRIOR + secrets.RATE * len(hit):
        out = [(start, start + len(hit))]
    return out


def slow_random(text, base, table):
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", text):
        at = m.start()
        for a, b in sorted(x for x in base if x[0] < m.end() and m.start() < x[1]) + [(m.end(), m.end())]:
            if a - at >= 16:
                out += slow_groups(at, text[at:a], table)
            at = max(at, b)
    return out


def slow_base(text):
    kinds = [
        (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    return [m.span() for pattern, good in kinds for m in re.finditer(pattern, text) if good(m)]


def test_random_spans_equal_brute_force(spark, table):
    rng = random.Random(31)
    words = ["user", "Config", "MAX_SIZE", "deployment/", "configuration/", "auth=", "token=", "é", " ", "=", "/", "_", "-", "0123456789abcdef01234567"]
    texts = []
    for _ in range(400):
        bits = [rng.choice(words) if rng.random() < 0.6 else "".join(rng.choice(BASE62) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 9))]
        texts.append("".join(bits))
    texts += ["", "x" * 15, BASE62 * 300]
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_report(spark.createDataFrame(list(enumerate(texts)), DOCS), table).collect()}
    found = 0
    for i, t in enumerate(texts):
        mine = [tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s.startswith("random")]
        assert mine == slow_random(t, slow_base(t), table), t
        found += len(mine)
    assert found > 100


def test_held_out_precision_and_recall(spark, table):
    held = secrets.labelled_samples(spark, 6000, 6000).withColumn("doc_id", F.monotonically_increasing_id()).where("length(text) >= 16").cache()
    judged = secrets.secret_report(held.select("doc_id", F.concat(F.lit("see "), "text", F.lit(" there")).alias("text")), table)
    rows = held.join(judged, "doc_id").select("random", ((F.col("n_random") + F.col("n_hex")) > 0).alias("hit"), "n_random", "n_hex").collect()
    hits = sum(r["hit"] for r in rows if r["random"])
    false = sum(r["hit"] for r in rows if not r["random"])
    own = [r for r in rows if r["random"] and not r["n_hex"]]
    print(len(rows), hits / sum(r["random"] for r in rows), false, sum(r["n_random"] > 0 for r in own) / len(own))
    assert hits / sum(r["random"] for r in rows) > 0.98 and hits / (hits + false) > 0.99
    assert sum(r["n_random"] > 0 for r in own) / len(own) > 0.98


def test_no_end_of_a_longer_secret_is_left(spark, table):
    texts = ["a ghQp7_0123456789abcdef01234567XyZqWv8Tn b", "my_password=q8Zt3LxV0bN7rKp2WfYs!", "plain", None, ""]
    rows = [(i, t, "mine", 7, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS + ", base string, added int, whole string")
    out = {r["doc_id"]: r for r in secrets.redact_secrets(df, table).collect()}
    assert [out[i]["text"] for i in range(5)] == ["a [SECRET] b", "my_[SECRET]!", "plain", None, ""]
    assert all((r["base"], r["added"], r["whole"]) == ("mine", 7, None) for r in out.values())
    assert secrets.redact_secrets(df.limit(0), table).columns == df.columns
    with pytest.raises(ValueError, match="base"):
        secrets.scan_secrets(df, table)
    assert {"b2", "a2"} < set(secrets.scan_secrets(df, table, "b2", "a2").columns)
