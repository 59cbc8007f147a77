"""Chat formatting, decontamination, secrets, licences and toxicity against plain re-tellings."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from riskloom.llm import chat, decontaminate, licenses, secrets, toxicity
from riskloom.llm.oracles import ORACLE_SQL
from riskloom.llm.queries import QUERIES

DOCS = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_twin(spark, duck, small, name):
    same(QUERIES[name](spark, small), duck, ORACLE_SQL[name])


# -- chat ----------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["</s>", "<s>[", "[+]", "]", "&lt;", "&amp;", "[INST]", "é", "🙂", "\n", "a", "", "&#91;"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))
            rows.append((None if c == 0 else c, t, rng.choice(["user", "assistant", "a]b", None, ""]), text, "x"))
    rows.append((5, 0, "user", "again", "x"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_chat(df)
    got = {r["conv_id"]: r for r in chat.digest(done).collect()}
    out = {r["conv_id"]: r for r in done.collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((t, role or "", text or "") for k, t, role, text, _ in rows if k == c)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), sha(said), len(loss), sha(loss))
        full, at, under = out[c]["formatted"], 0, ""
        assert got[c]["formatted_chars"] == len(full)
        for run in out[c]["loss_mask"]:
            under += full[at : at + run["chars"]] if run["loss"] else ""
            at += run["chars"]
        for raw, safe in reversed(chat.ESCAPES):
            under = under.replace(safe, raw)
        assert at == len(full) and under == loss
    assert chat.digest(chat.format_chat(df.limit(0))).count() == 0


def test_chat_merges_runs(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(df).first()["formatted"] == "<s>[user]a[+]b</s><s>[assistant]c</s>"


# -- decontamination -------------------------------------------------------------------------------------


def slow_report(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, who = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        k = min(10, len(own))
        for i in range(len(own) - k + 1 if own else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == own[i : i + k]:
                    hit |= set(range(j, j + k))
                    who.add(item)
    return len(words), len(hit), len(who), sha(",".join(sorted(who))), bool(hit)


@pytest.mark.parametrize("block", [1, 30, 10**6])
def test_decontamination_equals_brute_force(spark, block):
    rng = random.Random(4)
    vocabulary = ["a", "B", "é", "7", "x-y", "Ünï", "\u0085", "zz"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(str(i), text(rng.choice([0, 2, 5, 9, 10, 11, 25]))) for i in range(12)] + [("", None), ("3", "b b b b")]
    docs = [(i, rng.choice([None, "", text(30), text(15) + ". " + rng.choice(items)[1].upper() + "! " + text(9) if rng.choice(items)[1] else ""]) if i % 3 else text(60)) for i in range(40)]
    docs = [(i, t) for i, t in docs] + [docs[5]]
    bench = spark.createDataFrame([(int(i) if i else None, b) for i, b in items], "item_id long, text string")
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS + ", n_words int")
    got = sorted(tuple(r) for r in decontaminate.report(decontaminate.contamination(df, bench, block_words=block)).collect())
    assert got == sorted((i, *slow_report(t, items)) for i, t in docs)


def test_contaminated_spans_point_into_the_original(spark):
    body = "the quick brown fox jumps over the lazy dog today"
    text = "Čau 🙂, so: The QUICK - brown fox; jumps over the lazy dog (today)! End"
    found = decontaminate.contamination(
        spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame([(9, body)], "item_id long, text string")
    ).first()
    (a, b), = found["spans"]
    assert text[a:b] == "The QUICK - brown fox; jumps over the lazy dog (today" and found["items"] == ["9"]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(spark.createDataFrame([(1, text)], DOCS), empty).first()["hit_words"] == []


# -- secrets ---------------------------------------------------------------------------------------------


def slow_base(text):
    text = text or ""
    kinds = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    out = []
    for rank, (kind, pattern, good) in enumerate(kinds):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if good(m)]
    return [s for _, _, s in sorted(out)]


def test_secrets_equal_brute_force(spark):
    rng = random.Random(6)
    bits = ["token", "secret", "API_KEY", "apikey", "password", "=", ": ", '"', "'", " ", "abc", "abcdef", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef", "é🙂", "\n", "x.y", "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)] + [None, "", "secret=token: abcdefgh"]
    texts.append(("word " * 50 + "token = abcdefgh ") * 700)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS + ", base string")
    got = {r["doc_id"]: r for r in secrets.secret_report(df).collect()}
    for i, t in enumerate(texts):
        base = slow_base(t)
        assert got[i]["base_sha256"] == sha(",".join(base)), t
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        every = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert [s for s in every if not s.startswith("random")] == base
        taken = sorted(tuple(map(int, s.split(":")[1:])) for s in base)
        for s in every:
            if s.startswith("random"):
                a, b = map(int, s.split(":")[1:])
                assert re.fullmatch(r"[A-Za-z0-9+/_=-]{16,}", t[a:b]) and not any(x < b and a < y for x, y in taken)


def test_markov_chains_tell_random_strings(spark):
    table = secrets.train(secrets.labelled_samples(spark))
    good = ["getHTTPResponseCodeFromServer", "internationalization", "usr/local/share/dict/words", "=" * 40, "a" * 30, "MAX_CONNECTION_TIMEOUT_SECONDS", "Donaudampfschifffahrtsgesellschaft"]
    bad = ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "ghp_16C7e42F292c6912E7710c838347Ae178B4a", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "q8Zt3LxV0bN7rKp2WfYs"]
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(good + bad)], DOCS)
    got = {r["doc_id"]: r["n_random"] for r in secrets.secret_report(df, table).collect()}
    assert [got[i] for i in range(len(good))] == [0] * len(good) and all(got[len(good) + i] for i in range(len(bad)))


def test_random_values_are_found_behind_names_and_paths(spark):
    rng = random.Random(19)
    base62 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    cases = [("AWS_SECRET_ACCESS_KEY=", key)]
    for i in range(60):
        value = "".join(rng.choice(base62) for _ in range(24))
        cases.append((["CLIENT_CREDENTIAL=", "authorization=", "deployment/configuration/production/"][i % 3], value))
    texts = [f"see {a}{b} there" for a, b in cases]
    texts += [f"a0b1c2d3e4f5a0b1c2d3e4f5/{cases[1][1]} x", "deployment/configuration/production/environment=default"]
    rows = secrets.secret_report(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    spans = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s.startswith("random")] for r in rows}
    inside = lambda i, v: [texts[i][int(a) : int(b)] for _, a, b in spans[i]] == [v]
    assert inside(0, key) and sum(inside(i, v) for i, (_, v) in enumerate(cases)) >= 0.95 * len(cases)
    assert len(spans[61]) == 1 and texts[61][int(spans[61][0][1]) : int(spans[61][0][2])].endswith(cases[1][1]) and spans[62] == []


def test_redaction(spark):
    df = spark.createDataFrame([(1, 'é token = "abcdef0123456789abcdef01234567" end', 3), (2, None, 4), (3, "plain", 5)], DOCS + ", n_chars long")
    rows = {r["doc_id"]: r for r in secrets.redact_secrets(df).collect()}
    assert rows[1]["text"] == 'é [SECRET]" end' and rows[2]["text"] is None and rows[3]["text"] == "plain" and rows[3]["n_chars"] == 5
    assert secrets.secret_report(df.limit(0)).count() == 0


# -- licences --------------------------------------------------------------------------------------------


def test_licences(spark):
    full = "\n".join(["Permission to use, copy, modify, and/or distribute this software for any purpose with", "or without fee is hereby granted, provided that the above copyright notice and this permission", "notice appear in all copies."])
    rows = [
        (1, "prose here\nReleased under the MIT License.\nmore prose"), (2, None), (3, ""), (4, "Released under the MIT Licence"),
        (5, "intro text\n\n" + full + "\n\nmore of the same"), (6, "the license of the released mit under"), (7, "word " * 5000 + "\nAll rights reserved."),
        (8, "Licensed under CC BY-NC 4.0."), (8, "Licensed under CC BY-NC 4.0."), (9, "!!! ???\n \n\t"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", license string")
    got = sorted(((r["doc_id"], r["license"], r["dice"]) for r in licenses.license_scan(df).collect()), key=str)
    best = {k: (name, d) for k, name, d in got}
    assert best[1] == ("MIT", 1.0) and best[2] == best[3] == best[9] == (None, None) and best[5][0] == "ISC" and best[7] == ("Proprietary", 1.0)
    assert best[6] == (None, None) and [k for k, *_ in got].count(8) == 2 and best[8] == ("CC-BY-NC-4.0", 1.0)
    assert licenses.license_scan(df.limit(0)).count() == 0 and licenses.license_matches(df, []).count() == 0


def test_size_bounds_lose_nothing():
    for n, _, name, grams in licenses.size_index(licenses.TEMPLATES, 0.8):
        total = sum(c for _, c in grams)
        assert 2 * min(n, total) / (n + total) >= 0.8, name


def test_texts_without_a_telltale_match_nothing():
    rng = np.random.default_rng(47)
    groups = licenses.telltales(licenses.TEMPLATES, 0.8)
    told = lambda low: any(all(w in low for w in g) for g in groups)
    assert not told("the cat sat by the door of the mit, once more at work") and not told("")
    near = 0
    for _, template in licenses.TEMPLATES:
        words, want = licenses.words_of(template), licenses.bigrams_of(template)
        for _ in range(300):
            gone = set(rng.choice(words, rng.integers(0, 1 + len(words) // 3)))  # whole words go, wherever they stand
            unit = " ".join(w for w in words if w not in gone)
            own = licenses.bigrams_of(unit)
            if 2 * (own & want).total() >= 0.8 * (own.total() + want.total()):
                near += bool(gone)
                assert told(f"x {unit} y"), (template, unit)
    assert near > 500
    assert licenses.telltales(licenses.TEMPLATES, 0.0) == [()] and licenses.telltales([("a", "word")], 0.8) == []


# -- toxicity --------------------------------------------------------------------------------------------


def auc(score, y):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        ranks[score == s] = ranks[score == s].mean()
    n = y.sum()
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity_held_out(spark):
    where = "/root/testdata/sf0.01"
    got = QUERIES["op8_toxicity"](spark, where).join(spark.read.parquet(f"{where}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert auc(got["score"].to_numpy(), got["toxic"].to_numpy()) > 0.85


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate([None, "", "You are a stupid idiot!", "A kind word."] * 20)], DOCS + ", score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 2)) for i in range(80)] + [(2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 80 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and toxicity.toxicity(docs.limit(0), labels).count() == 0
    clean = toxicity.toxicity(docs, labels.where("toxic = 0")).agg(F.max("score")).first()[0]
    assert clean == 0.0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float)
    centres, means = toxicity.isotonic(x, y)
    assert (np.diff(centres) > 0).all() and (np.diff(means) > 0).all()


def test_scores_ignore_everything_but_the_text():
    model = toxicity.Model(frozenset(), 0.1, toxicity.Trees().fit(np.random.default_rng(0).random((50, len(toxicity.NAMES))), np.arange(50) % 2.0), (np.array([-1.0, 1.0]), np.array([0.0, 1.0])))
    a = model.scores([b"you fool", None, b"", b"x" * 3_000_000])
    assert a[1] == a[2] and (0 <= a).all() and (a <= 1).all()
