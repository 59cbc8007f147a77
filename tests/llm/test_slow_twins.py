"""Sharding, toxicity, licences and substring dedup against slow re-tellings."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import licenses, ring, substring, toxicity

DOCS = "doc_id long, text string"


# -- sharding ------------------------------------------------------------------------------------------


def test_placement_equals_a_walk_row_by_row(spark):
    rng = random.Random(51)
    rows = [(i, None if i % 40 == 0 else "é" * rng.randrange(60)) for i in range(700)] + [(None, "same")] * 250 + [(7, "x" * 100_000)] * 3
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", slot int")
    shards, vnodes = 7, 9
    keyed = df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).collect()
    points = ring.ring_points(shards, vnodes)
    home = [next((i for i, (p, _) in enumerate(points) if p >= r["key"]), 0) for r in keyed]
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    # Rows of an arc in the order of their keys; homes fill first, then each goes on clockwise.
    order = sorted(range(len(rows)), key=lambda i: (home[i], keyed[i]["key"]))
    placed, late = {}, []
    for i in order:
        s = points[home[i]][1]
        if room[s]:
            room[s] -= 1
            placed[i] = s
        else:
            late.append(i)
    for i in late:
        at = home[i]
        while not room[points[at][1]]:
            at = (at + 1) % len(points)
        room[points[at][1]] -= 1
        placed[i] = points[at][1]
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()), placed[i]) for i, r in enumerate(keyed)), key=str)
    got = sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in ring.shard_documents(df, shards, vnodes).collect()), key=str)
    assert got == want


# -- toxicity ------------------------------------------------------------------------------------------


def slow_features(text, learned, fixed):
    """The 22 numbers told from their names, on str where the operator works on bytes."""
    raw = (text or b"").decode()
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    words = [w.encode() for w in re.findall(r"[0-9a-z\u0080-\U0010ffff]+", low)]
    n, size = max(1, len(words)), max(1, len(raw.encode()))
    at = [i for i, w in enumerate(words) if w in fixed | learned]
    you = [i for i, w in enumerate(words) if w in toxicity.YOU]
    mine = [words[i] for i in at if words[i] in learned]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in at)
    worst = max((sum(i <= j < i + 50 for j in at) for i in at), default=0)
    leet = dict(zip("0134578@$!|+", "oieastbasiit", strict=True))
    plain = lambda w: "".join(leet.get(c, c) for c in w).encode()
    hidden = 0
    for w in toxicity.SIGNED.findall(low.encode()):
        p = plain(w.decode().replace("*", ""))
        hidden += p != w and p.strip(b"i") != b"" and p in fixed | learned
    spaced = sum(plain(re.sub(r"[ .*_-]", "", s.decode())) in fixed | learned for s in toxicity.SPACED.findall(low.encode()))
    count = lambda signs: sum(c in signs for c in raw)
    hits = sum(words[i] in fixed for i in at)
    caps = sum(1 for w in re.split(r"[\t\n\x0b\x0c\r ]+", raw) if len(w.encode()) > 2 and any("A" <= c <= "Z" for c in w) and not any("a" <= c <= "z" for c in w))
    return [
        np.log1p(len(words)), size / n, np.log1p(hits), hits / n, np.log1p(len(mine)), len(mine) / n, worst, np.log1p(near), near / n, len(you) / n,
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, caps / n, raw.count("!") / n, raw.count("?") / n, count(toxicity.MARKS.decode()) / size,
        count("0123456789") / size, np.log1p(hidden), hidden / n, np.log1p(spaced), sum(low.count(c * 3) for c in "aeiou") / n,
        max((mine.count(w) for w in mine), default=0) / n, len(set(mine)),
    ]


def test_features_equal_slow_ones():
    rng = random.Random(52)
    bits = ["you", "Idiot", "st0pid", "i d i o t", "s.c.u.m", "tr@sh", "!!", "??", "42", "SHUT UP", "gentle", "é", "\n", "sooo", "zorg", "zorg", "*", "f*ck", "$hit", "-", "|", "YOUR", "plain words here"]
    learned = frozenset([b"zorg", b"plain"])
    for _ in range(400):
        t = rng.choice([" ", "", ". "]).join(rng.choice(bits) for _ in range(rng.randint(0, 25))).encode()
        assert np.allclose(toxicity.features(t, learned, toxicity.FIXED), slow_features(t, learned, toxicity.FIXED)), t
    assert toxicity.features(None, learned, toxicity.FIXED) == toxicity.features(b"", learned, toxicity.FIXED)


def slow_trees(x, y, t):
    """Every split of every node tried one by one."""
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    raw = np.full(len(y), np.log(share / (1 - share)))
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, t.bins + 1)[1:-1]))) for c in x.T]

    def grow(rows, g, h, depth, step):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if depth and len(rows) >= 2 * t.least:
            for f, values in enumerate(cuts):
                for v in values:
                    a, b = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                    if min(len(a), len(b)) < t.least:
                        continue
                    gain = g[a].sum() ** 2 / (h[a].sum() + t.l2) + g[b].sum() ** 2 / (h[b].sum() + t.l2) - gs**2 / (hs + t.l2)
                    if gain > best[0] + 1e-12:
                        best = (gain, (a, b))
        if best[1]:
            for part in best[1]:
                grow(part, g, h, depth - 1, step)
        else:
            step[rows] = t.rate * gs / (hs + t.l2)

    for _ in range(t.rounds):
        p = 1 / (1 + np.exp(-raw))
        step = np.zeros(len(y))
        grow(np.arange(len(y)), y - p, np.maximum(p * (1 - p), 1e-9), t.depth, step)
        raw = raw + step
    return raw


def test_trees_equal_an_exhaustive_search():
    rng = np.random.default_rng(53)
    x = np.round(rng.normal(size=(120, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=120) * 0.3 > 0.4).astype(float)
    t = toxicity.Trees(rounds=6, bins=9, least=5).fit(x, y)
    assert np.allclose(t.raw(x), slow_trees(x, y, t), atol=1e-9)


def test_isotonic_equals_the_min_max_formula():
    rng = np.random.default_rng(54)
    x = rng.permutation(60) / 7.0
    y = (rng.random(60) < 0.2 + 0.6 * (x > 4)).astype(float)
    s = y[np.argsort(x)]
    n = len(s)
    want = [max(min(s[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    centres, means = toxicity.isotonic(x, y)
    assert np.allclose(sorted(set(np.round(want, 12))), np.round(means, 12))
    assert np.all(np.diff(centres) > 0)


def test_one_labelled_id_on_two_texts_gives_one_model(spark):
    rng = random.Random(55)
    rows = [(i % 90, f"{'you idiot scum' if i % 3 == 0 else 'good day'} {rng.random()}") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    scores = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = toxicity.toxicity(spark.createDataFrame(rows, DOCS).repartition(seed * 2), labels).collect()
        scores.append(sorted((r["doc_id"], r["score"]) for r in got))
    assert scores[0] == scores[1] and len(scores[0]) == 240


# -- licences ------------------------------------------------------------------------------------------


def test_every_row_counts_by_itself(spark):
    mit = licenses.TEMPLATES[[n for n, _ in licenses.TEMPLATES].index("Zlib") - 1][1]
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "nothing"), (None, "All rights reserved."), (None, "nothing"), (2, None)]
    rows += [(3, "Copyright (c) 2024 Acme Corp. Licensed under the MIT License."), (4, "code before it " * 20 + mit.replace("\n", " ") + " and code after it" * 20)]
    got = licenses.license_scan(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", n_matches int")).collect()
    assert [(r["doc_id"], r["license"], r["n_matches"] > 0) for r in got] == [
        (1, "MIT", True), (1, "MIT", True), (1, None, False), (None, "Proprietary", True), (None, None, False), (2, None, False), (3, "MIT", True), (4, "MIT", True),
    ]
    assert got[0]["n_matches"] == got[1]["n_matches"] and got[6]["dice"] == 1.0 and got[7]["dice"] == 1.0


# -- substring dedup -------------------------------------------------------------------------------------


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_repeats_end_to_end_against_all_pairs(spark):
    """Near lines at a Jaccard of 0.8 or more, equal lines, and runs of 51 words: found as all pairs show them."""
    rng = random.Random(56)
    pool = [prose(rng, 160).split() for _ in range(6)]
    base = [prose(rng, rng.choice([8, 20, 45])).split() for _ in range(12)]
    rows = []
    for i in range(300):
        parts = []
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.2 and not any(len(x) > 600 for x in parts):  # one pool passage a document
                a = rng.randrange(100)
                parts.append(" ".join(prose(rng, 70).split() + rng.choice(pool)[a : a + rng.choice([30, 51, 55, 60])] + prose(rng, 70).split()))
            elif kind < 0.5:
                w = list(rng.choice(base))
                for _ in range(rng.choice([0, 0, 1, 2])):
                    w[rng.randrange(len(w))] = prose(rng, 1)
                parts.append(" ".join(w))
            else:
                parts.append(prose(rng, rng.choice([3, 9, 30])))
        rows.append((i, "\n".join(parts)))
    got = substring.repeats(spark.createDataFrame(rows, DOCS)).collect()
    text = dict(rows)
    covered = {i: np.zeros(len(t), bool) for i, t in rows}
    for r in got:
        covered[r["doc_id"]][r["start_char"] : r["end_char"]] = True
        assert r["removed"] == (r["doc_id"] != r["component_id"]) and r["component_id"] <= r["doc_id"]
    lines = [(i, ln, m.start()) for i, t in rows for m in re.finditer(r"[^\n]+", t) for ln in [m[0]]]
    sets = [frozenset(zip(*(ln.split()[k:] for k in range(5)), strict=False)) for _, ln, _ in lines]
    near, found, alike_at = 0, 0, []
    for a, (i, x, p) in enumerate(lines):
        alike = [b for b, (j, y, _) in enumerate(lines) if i != j and (x == y or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))]
        if alike:
            alike_at.append(a)
            near += 1
            found += covered[i][p : p + len(x)].all()
    assert near > 60 and found >= 0.99 * near
    where = {}
    for i, t in rows:
        spans = [m.span() for m in re.finditer(r"\S+", t)]
        words = t.split()
        for k in range(len(words) - 50):
            where.setdefault(tuple(words[k : k + 51]), []).append((i, spans[k][0], spans[k + 50][1]))
    shared = [v for v in where.values() if len({i for i, _, _ in v}) > 1]
    assert len(shared) > 30
    for holders in shared:  # whichever two documents share a run, every word of it is covered
        for i, a, b in holders:
            assert covered[i][a:b].all(), (i, text[i][a:b])
    runs = {}
    for i, t in rows:
        for k in range(len(t.split()) - 15):
            runs.setdefault(tuple(t.split()[k : k + 16]), set()).add(i)
    dirty = {i for v in runs.values() if len(v) > 1 for i in v} | {lines[a][0] for a in alike_at}
    assert {r["doc_id"] for r in got} <= dirty and len(dirty) < len(rows)


def test_a_hot_line_and_a_very_long_text(spark):
    rng = random.Random(57)
    line, passage = prose(rng, 12), prose(rng, 60)
    long = prose(rng, 200_000)
    rows = [(i, f"{prose(rng, 6)}\n{line}") for i in range(400)] + [(1000, f"{long} {passage} {prose(rng, 90)}"), (1001, f"{prose(rng, 90)} {passage} {prose(rng, 90)}"), (1000, f"{long} {passage} {prose(rng, 90)}")]
    got = substring.repeats(spark.createDataFrame(rows, DOCS)).collect()
    text = dict(rows)
    assert {r["doc_id"] for r in got} == {*range(400), 1000, 1001}
    assert {text[r["doc_id"]][r["start_char"] : r["end_char"]] for r in got if r["doc_id"] < 1000} == {line}
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] >= 1000} == {(1000, 1000), (1001, 1000)}
    assert [text[1001][r["start_char"] : r["end_char"]] for r in got if r["doc_id"] == 1001] == [passage]


def test_large_buckets_meet_their_leader_first(spark, monkeypatch):
    rng = random.Random(58)
    monkeypatch.setattr(substring, "TILE_SHINGLES", 200)
    base = [prose(rng, 60).split() for _ in range(2)]
    lines = []
    for i in range(80):
        w = list(base[i % 2])
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(60)] = f"e{i}"
        lines.append(" ".join(w))
    sets = [frozenset(zip(*(ln.split()[k:] for k in range(5)), strict=False)) for ln in lines]
    df = spark.createDataFrame(list(enumerate(lines)), DOCS)
    found = substring._paragraphs(df, 5, 16, 36).where("line").select("doc_id", "h1", "bands", "shingles").cache()
    name = {r["doc_id"]: r["h1"] for r in found.collect()}
    root = {h: h for h in name.values()}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in substring.line_links(found.drop("doc_id"), tile=8).collect():
        root[find(r["a"])] = find(r["b"])
    for a in range(len(lines)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                assert find(name[a]) == find(name[b])
    assert len({find(h) for h in root}) >= 2
