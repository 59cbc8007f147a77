import random

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.functions.re2 import Refused, digit_run, required, to_java
from riskloom.functions.rules import PACKS, SECRETS_PACK, VISIBLE_RULES, Rule, parse_annotation, rule_named
from riskloom.operators.detect import detect, matches, rule_hits
from riskloom.plans.corpus import NEAR_MISSES, POSITIVES, PROMPTS


def fired(spark, texts, rules):
    df = spark.createDataFrame(list(enumerate(texts)), "key int, content string")
    return {(r["key"], r["rule_id"]) for r in rule_hits(df, rules, "key").collect()}


def re2(texts, rules):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (key INTEGER, content VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    return {(k, r.id) for r in rules for (k,) in con.execute("SELECT key FROM t WHERE regexp_matches(content, ?)", [r.pattern]).fetchall()}


def test_inventory():
    assert len(VISIBLE_RULES) == 56 and len({r.id for r in VISIBLE_RULES}) == 56
    count = lambda s: sum(r.severity == s for r in VISIBLE_RULES)
    assert (count("critical"), count("high"), count("medium"), count("low")) == (24, 25, 7, 0)
    assert set(POSITIVES) == {r.id for r in VISIBLE_RULES}


def test_positives_and_near_misses(spark):
    texts = list(POSITIVES.values())
    hits = fired(spark, texts, VISIBLE_RULES)
    assert {(i, rule) for i, rule in enumerate(POSITIVES)} <= hits
    assert not fired(spark, list(NEAR_MISSES.values()), VISIBLE_RULES)


def test_same_matches_as_re2(spark):
    rng = random.Random(5)
    pieces = [w for p in PROMPTS for w in p.split(" ")] + ["K", "ſ", "\x0b", "\r", " ", "\x85", "é", "İ", "ı", "\n", "_", "🙂"]
    texts = []
    for _ in range(1500):
        p = rng.choice(PROMPTS)
        at = rng.randrange(len(p) + 1)
        cut = rng.choice(["", rng.choice(pieces), p[:at].replace("k", "K").replace("s", "ſ")])
        texts.append(rng.choice([p[:at] + cut + p[at:], p.replace(" ", rng.choice(["\x0b", "\t", " ", "  "])), p.upper(), cut + p]))
    assert fired(spark, texts, VISIBLE_RULES + SECRETS_PACK) == re2(texts, VISIBLE_RULES + SECRETS_PACK)


def test_required_literals_never_hide_a_match(spark):
    texts = [*PROMPTS, *(p.upper() for p in PROMPTS), *(p.replace("k", "K").replace("s", "ſ") for p in PROMPTS)]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, content string")
    bare = [F.when(matches(F.col("content"), r), F.lit(r.id)) for r in VISIBLE_RULES]
    plain = {(r["key"], x) for r in df.select("key", F.array(*bare).alias("x")).collect() for x in r["x"] if x}
    assert plain == fired(spark, texts, VISIBLE_RULES)


@pytest.mark.parametrize(
    ("rule", "text", "hit"),
    [
        ("OPS01", "rm -f /", True), ("OPS18", "format C:", False), ("OPS18", "format C:x", True), ("PII03", "4111 1111 1111 1111", False),
        ("PII06", "4111 1111 1111 1111", True), ("PII07", "passport number is AB123456", False), ("PII08", "qq123456c", False),
        ("PII09", "99912025550143", True), ("PII02", "é123-45-6789", True), ("OPS08", "chmod\x0b777", False),
    ],
)
def test_quirks(spark, rule, text, hit):
    assert bool(fired(spark, [text], [rule_named(rule)])) is hit


def test_translation():
    assert to_java(r"(?i)a\s[\sx]k") == "(?id)a[\\t\\n\\f\\r ][\\t\\n\\f\\r x][k\\x{212A}]"
    assert "(?<=\\w)" in to_java(r"\bx") and to_java(r"\<x") == "(?d)<x"


def test_findings_and_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "é😀 ssn: 123-45-6789 and 123-45-6780", "z")], "id int, content string, category string")
    rows = {r["id"]: r for r in detect(df).collect()}
    assert rows[1]["findings"] == [] and rows[2]["findings"] == [] and rows[3]["category"] == "z"
    spans = {f["type"]: (f["location"]["start"], f["location"]["end"]) for f in rows[3]["findings"] if f["location"]}
    raw = "é😀 ssn: 123-45-6789 and 123-45-6780".encode()
    assert raw[slice(*spans["US_SSN"])] == b"123-45-6789"
    assert raw[slice(*spans["US_SSN_EXPLICIT"])] == b"ssn: 123-45-6789"
    assert detect(df, []).first()["findings"] == []
    assert detect(df.limit(0)).count() == 0


def test_secrets_pack(spark):
    texts = ["my key is sk-abcdefghijklmnopqrst", "postgresql://admin:pw@db.example.com/x", "the key format starts with sk- and more"]
    hits = fired(spark, texts, PACKS["visible+secrets"])
    assert (0, "SEC01") in hits and (1, "SEC06") in hits and not any(k == 2 for k, _ in hits)


def test_annotation():
    assert parse_annotation('// @Policy(profile="strict", block=true, rewrite=false, remote="http://x")') == {
        "profile": "strict", "block": "true", "rewrite": "false", "remote": "http://x",
    }
    assert parse_annotation("nothing here") == {} and parse_annotation(None) == {}


def test_rule_is_plain_data():
    assert Rule("X", "PII", "T", "d", "low", 0.5, "x").has_span


# -- trees ---------------------------------------------------------------------------------------------


def random_pattern(rng, depth=0):
    kind = rng.randrange(14 if depth < 3 else 8)
    if kind < 4:
        return rng.choice(["a", "b", "k", "s", "K", "S", "1", "23", "ab", "é", "-", " ", r"\.", r"\x41", r"\$", "_"])
    if kind == 4:
        return rng.choice([".", r"\d", r"\s", r"\w", r"\D", r"\S", r"\W"])
    if kind == 5:
        return rng.choice(["[a-c]", "[^a-c]", r"[\sk]", r"[^\d]", "[sS1]", "[[:alpha:]]", r"[\-.]", "[k-t]", "[^ks]", r"[\w-]", "[0-9]", "[1-3]"])
    if kind == 6:
        return rng.choice([r"\b", r"\B", "^", "$", r"\A", r"\z", "(?m:^)", "(?m:$)"])
    if kind == 7:
        return rng.choice([r"\d{3}", r"[0-9]{2,4}", r"1?", "(?s:.)", "a{2}", r"\d+"])
    inner = random_pattern(rng, depth + 1)
    if kind == 8:
        return f"({inner}|{random_pattern(rng, depth + 1)})"
    if kind == 9:
        return f"(?:{inner}){rng.choice(['*', '+', '?', '{0,2}', '{2}', '*?', '+?'])}"
    if kind == 10:
        return f"({rng.choice(['?i:', '?-i:', '?:', '?P<n>'])}{inner})"
    return inner + random_pattern(rng, depth + 1)


def test_random_patterns_equal_re2(spark):
    rng = random.Random(71)
    patterns = {rng.choice(["", "(?i)"]) + "".join(random_pattern(rng) for _ in range(rng.randrange(1, 5))) for _ in range(700)}
    # A name may be used once, and some patterns are refused: they mustn't be translated wrongly.
    rules = []
    for i, p in enumerate(sorted(p for p in patterns if p.count("<n>") < 2)):
        try:
            to_java(p)
        except Refused:
            continue
        rules.append(Rule(f"R{i}", "X", "T", "d", "low", 0.5, p))
    assert len(rules) > 400
    letters = list("abksKS1234 .-_$A\n\t") + ["\x0b", "é", "É", "\u212a", "\u017f", "12", "345", "ab"]
    texts = ["", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(250))]
    assert fired(spark, texts, rules) == re2(texts, rules)


def test_derived_tests_hold_wherever_a_pattern_matches():
    import re

    rng = random.Random(72)
    texts = ["".join(rng.choice(["a", "b", "k", "1", "23", "-", " ", "ab", "A", "s"]) for _ in range(rng.randrange(12))) for _ in range(400)]
    seen = 0
    for _ in range(800):
        p = "".join(random_pattern(rng) for _ in range(rng.randrange(1, 4)))
        if any(x in p for x in ("[[:", "(?-i", "<n>", r"\z", "(?m:", "(?s:", "é")):
            continue
        literals, run = required(p), digit_run(p)
        for t in texts:
            if (literals or run) and re.search(p, t, re.ASCII):
                seen += 1
                low = t.lower()
                assert all(any(x in low for x in group) for group in literals), (p, t)
                assert not run or re.search(f"[0-9]{{{run}}}", t), (p, t, run)
    assert seen > 1000


@pytest.mark.parametrize(
    ("pattern", "literals", "run"),
    [
        (r"(?i)\brm\s+-r?f\s+/", (("-f", "-rf"), ("rm",), ("/",)), 0), (r"a(bc|bd)e", (("abce", "abde"),), 0), (r"(foo|bar+x|qux.*)", (("foo", "qux", "ba"),), 0),
        (r"4[0-9]{12}(?:[0-9]{3})?", (("4",),), 13), (r"(ab)?c*", (), 0), (r"\d{2}(-\d{5}|\d{7})", (), 5), (r"x|", (), 0), (r"(?i)KEY\d", (("key",),), 1), (r"\d{3}\b\d{2}", (), 5),
    ],
)
def test_what_a_tree_says(pattern, literals, run):
    assert tuple(map(set, required(pattern))) == tuple(map(set, literals)) and digit_run(pattern) == run


@pytest.mark.parametrize("pattern", [r"(a)\1", "(?=a)", "(?<=a)b", "a**", "[b-a]", r"\pL", "(?i)é", "a{1001}", "(a", "a)", "[a", "*a", r"\C", "(?U)a", r"\Qab\E+", "a{2}{3}", "a\\"])
def test_what_is_refused(pattern):
    with pytest.raises(Refused):
        to_java(pattern)


def test_rules_of_a_user_s_own_fire(spark):
    rules = [
        Rule("D5", "X", "T", "d", "low", 0.5, r"\d{5}"), Rule("D20", "X", "T", "d", "low", 0.5, r"\b\d{20}\b"), Rule("D7", "X", "T", "d", "low", 0.5, "no [0-9]+", digits=7),
        Rule("L", "X", "T", "d", "low", 0.5, "(?i)strasse|weg", needs=(("str", "weg"),)), Rule("Q", "X", "T", "d", "low", 0.5, r"it's \"x\\y\""),
    ]
    texts = ["a 12345 b", "1234", "x 12345678901234567890 y", "no 1234567", "no 123456", "WEG", "it's \"x\\y\""]
    assert fired(spark, texts, rules) == {(0, "D5"), (2, "D5"), (2, "D20"), (3, "D5"), (3, "D7"), (4, "D5"), (5, "L"), (6, "Q")}
