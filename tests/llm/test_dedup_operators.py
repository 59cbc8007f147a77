"""Components, SimHash, substring dedup, sharding, nearest neighbours and the codec against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import ring, sentencepiece_codec, simhash, substring, vptree
from riskloom.llm.components import components

DOCS = "doc_id long, text string"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def classes_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == classes_of({n for e in real for n in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- SimHash -------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts(rng, n):
    words = ["alpha", "Beta", "é", "x y", "gamma", "d", "7"]
    out = [None, "", " \t\n", "one", "one two", "ONE two three"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(300)) for _ in range(4)]
    while len(out) < n:
        own = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 1, 2, 4, 40])):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(rng.choice([" ", "\x0b"]).join(own))
    return out


def test_simhash_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 7)
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(texts(rng, 160))]
    rows += [rows[7], (11, "a second text of one id"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], DOCS + ", fp int")
    prints = [slow_fingerprint(t) for _, t in rows]
    edges = [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    root = classes_of(range(len(rows)), edges)
    least = {}
    for k, r in root.items():
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    expected = sorted(((rows[k][0], f"{prints[k]:016x}", least.get(root[k])) for k in range(len(rows))), key=str)
    assert sorted((tuple(r) for r in simhash.simhash_classes(df).collect()), key=str) == expected
    assert simhash.simhash_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [2, 5, 4096])
def test_links_in_tiles_of_any_size(spark, tile):
    rng = random.Random(tile)
    centre = rng.getrandbits(64)
    fps = {centre, 0}
    for _ in range(150):
        f = rng.choice(sorted(fps)) if rng.random() < 0.7 else centre
        for _ in range(rng.randint(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=tile).collect()]
    true = [(a, b) for (a, x), (b, y) in combinations(zip(signed, fps, strict=True), 2) if (x ^ y).bit_count() <= 3]
    assert {tuple(sorted(e)) for e in got} <= {tuple(sorted(e)) for e in true}
    assert classes_of(signed, got) == classes_of(signed, true)


def test_fingerprint_of_a_long_text():
    text = "Wort und WORD " * 60_000
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


# -- substring -------------------------------------------------------------------------------------------


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_repeated_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(1)
    shared = [prose(rng, n) for n in (52, 55, 60, 90, 200)]
    rows, dirty = [], set()
    for i in range(240):
        own = prose(rng, rng.choice([5, 60, 150, 400]))
        if i % 3 == 0:
            at = rng.randrange(len(own.split()) + 1)
            w = own.split()
            own = " ".join([*w[:at], shared[(i // 3) % 5], *w[at:]]) if i % 2 else own + "\n" + shared[(i // 3) % 5]
            dirty.add(i)
        rows.append((i, own))
    rows += [(None, shared[0]), (500, None), (501, ""), (1, rows[1][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", line string")
    got = substring.repeats(df).collect()
    assert {r["doc_id"] for r in got} == dirty
    text = dict(rows)
    for r in got:
        span = set(text[r["doc_id"]][r["start_char"] : r["end_char"]].split())
        # A near-equal line is reported whole, with the few words that are its own.
        assert any(len(span & set(s.split())) >= 0.8 * len(span) for s in shared) and r["removed"] == (r["doc_id"] != r["component_id"])
    assert substring.repeats(df.limit(0)).count() == 0


def test_repeated_passages_are_covered_to_both_ends(spark):
    rng = random.Random(16)
    shared = [prose(rng, n) for n in (51, 60, 84, 100, 400)]  # too small a part of their lines for these to be near copies
    rows, where = [], {}
    for i in range(60):
        head, tail = prose(rng, 100 + rng.randrange(200)), prose(rng, 100 + rng.randrange(200))
        body = shared[i % 5]
        rows.append((i, f"{head} {body}; {tail}".strip()))
        at = rows[-1][1].index(body)
        where[i] = (i % 5, at, at + len(body))
    words = shared[3].split()  # document 70 has a part only
    rows += [(70, prose(rng, 50) + " " + " ".join(words[:70]) + " " + prose(rng, 50))]
    df = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["component_id"], r["start_char"], r["end_char"]) for r in substring.repeats(df).collect()}
    assert {(i, k, a, b) for i, (k, a, b) in where.items()} <= got
    text = dict(rows)
    assert {text[70][a:b] for i, k, a, b in got if i == 70 and k == 3} == {" ".join(words[:70])}


def test_what_a_longer_run_adds_stays_in_its_first_holder(spark):
    rng = random.Random(17)
    body = prose(rng, 110).split()
    rows = [(1, " ".join(body[:70])), (2, " ".join(body)), (3, " ".join(body))]
    rows = [(i, f"{prose(rng, 40)} {t} {prose(rng, 40)}") for i, t in rows]
    text = dict(rows)
    got = {(r["doc_id"], r["component_id"], text[r["doc_id"]][r["start_char"] : r["end_char"]]) for r in substring.repeats(spark.createDataFrame(rows, DOCS)).collect()}
    for i in (1, 2, 3):
        assert [t for d, k, t in got if d == i and k == 1] == [" ".join(body[:70])]
    for i in (2, 3):
        assert any(k == 2 and t.endswith(body[-1]) for d, k, t in got if d == i)


def test_short_lines_and_wrapped_blocks_repeat(spark):
    rng = random.Random(18)
    wrap = lambda words, k: "\n".join(" ".join(words[i : i + k]) for i in range(0, len(words), k))
    line, tiny, block = prose(rng, 20).split(), "Zq zr zs", prose(rng, 90).split()
    near_line, near_block = [*line[:19], "other"], [*block[:45], "other", *block[46:]]
    own = [prose(rng, 12) for _ in range(12)]
    rows = [(1, " ".join(line)), (2, f"{own[0]}\n{' '.join(near_line)}\n{own[1]}"), (3, f"{own[2]}\n{tiny}"), (4, tiny + "\n" + own[3])]
    rows += [(5, f"{own[4]}\n\n{wrap(block, 12)}\n \t\n{own[5]}"), (6, f"{own[6]}\n\n{wrap(near_block, 7)}\n\n{own[7]}"), (7, own[8]), (8, own[9] + "\n\n" + own[10])]
    text = dict(rows)
    got = {(r["doc_id"], r["component_id"], text[r["doc_id"]][r["start_char"] : r["end_char"]]) for r in substring.repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {
        (1, 1, " ".join(line)), (2, 1, " ".join(near_line)), (3, 3, tiny), (4, 3, tiny),
        (5, 5, wrap(block, 12)), (6, 5, wrap(near_block, 7)),
    }


def test_near_equal_lines_are_clustered_whatever_the_tile(spark):
    rng = random.Random(2)
    base = [prose(rng, 80).split() for _ in range(3)]
    lines = []
    for i in range(60):
        w = list(base[i % 3])
        w[rng.randrange(80)] = f"edit{i}"
        lines.append(" ".join(w))
    lines += [prose(rng, 80) for _ in range(20)]
    sets = [set(zip(*(ln.split()[k:] for k in range(5)), strict=False)) for ln in lines]
    true = [(a, b) for a, b in combinations(range(len(lines)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = classes_of(range(len(lines)), true)
    df = spark.createDataFrame(list(enumerate(lines)), DOCS)
    found = substring._paragraphs(df, 24, 16, 36).where("line").select("doc_id", "h1", "bands", "shingles").cache()
    name = {r["doc_id"]: r["h1"] for r in found.collect()}
    for tile in (4, 1024):
        got = [(r["a"], r["b"]) for r in substring.line_links(found.drop("doc_id"), tile=tile).collect()]
        mine = classes_of(name.values(), got)
        for a, b in combinations(range(len(lines)), 2):
            assert (mine[name[a]] == mine[name[b]]) == (root[a] == root[b])


def test_banding_recall():
    assert 1 - (1 - substring.JACCARD**substring.ROWS) ** substring.BANDS > 0.99


# -- sharding ----------------------------------------------------------------------------------------------


def test_ring_law_and_slots(spark):
    rows = [(i, None if i % 50 == 0 else "t" * (i % 90)) for i in range(1003)] + [(None, "same")] * 200 + [(7, "é")] * 30
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", shard int")
    got = ring.shard_documents(df, 8, 16).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] >= 16
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 50} == {(16, 0)}
    assert ring.shard_documents(df.limit(0), 8, 16).count() == 0
    assert ring.shard_documents(df.limit(3), 8, 16).count() == 3


def test_ring_moves_little_when_a_shard_comes():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(-(2**63), 2**63 - 1, 40_000))

    def place(shards):
        points = ring.ring_points(shards, 128)
        edges = np.array([p for p, _ in points])
        arcs = np.searchsorted(edges, keys, "left") % len(points)
        counts = np.bincount(arcs, minlength=len(points)).tolist()
        out = np.empty(len(keys), int)
        order = np.argsort(arcs, kind="stable")
        first = np.searchsorted(arcs[order], np.arange(len(points)))
        parts = sorted(ring.place_arcs([s for _, s in points], counts, shards))
        for k, (arc, rank, shard, _) in enumerate(parts):
            end = parts[k + 1][1] if k + 1 < len(parts) and parts[k + 1][0] == arc else counts[arc]
            out[order[first[arc] + rank : first[arc] + end]] = shard
        return out

    before, after = place(20), place(21)
    assert np.ptp(np.bincount(before)) <= 1 and (before != after).mean() < 0.3


# -- nearest neighbours -------------------------------------------------------------------------------------


def slow_nearest(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v) and len(v) == 6:
            ok.setdefault(i, set()).add(tuple(float(np.float32(c)) for c in v))
    out = []
    for q, mine in ok.items():
        if q % 20:
            continue
        best = sorted((-max(sum(a * b for a, b in zip(x, y, strict=True)) for x in mine for y in v), i) for i, v in ok.items() if i != q)
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best[:k])]
    return sorted(out)


def vectors(rng, n):
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(6)]) for i in range(n)]
    rows += [(n + i, rows[4][1]) for i in range(90)]
    return rows + [(1001, None), (1002, [0.0] * 6), (1003, [float("nan")] * 6), (1004, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1005, [1.0]), (1006, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), rows[3]]


@pytest.mark.parametrize(("shard_rows", "block"), [(8192, 2048), (40, 3)])
def test_exact_search_equals_brute_force(spark, shard_rows, block):
    rows = vectors(random.Random(5), 300)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in vptree.nearest(df, k=7, factor=1.0, sample=100, shard_rows=shard_rows, query_block=block).collect())
    want = slow_nearest(rows, 7)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_an_id_with_many_vectors_is_one_neighbour(spark, shard_rows):
    rng = random.Random(15)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    rows += [(777, [8 * c + rng.gauss(0, 0.1) for c in rows[20][1]]) for _ in range(60)] + [(778, [rng.gauss(0, 4) for _ in range(6)]) for _ in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in vptree.nearest(df, k=7, factor=1.0, sample=100, shard_rows=shard_rows, query_block=3).collect())
    want = slow_nearest(rows, 7)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in vptree.nearest(df).collect()] == [(0, 1, 1)]
    assert vptree.nearest(df.limit(0)).count() == 0


def test_factor_trades_recall_for_work():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 3
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 8)) * 0.2
    x /= np.sqrt((x * x).sum(1))[:, None]
    ids, q, radius = np.arange(6000), np.arange(0, 6000, 60), 1.0 + 1e-12
    run = lambda f: vptree.Search(x, ids, x[q], q, radius, 10, f, np.full(len(q), np.inf))
    exact, loose = run(1.0), run(1.5)
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact.found, loose.found, strict=True)])
    assert exact.seen < 0.8 * len(q) * len(x) and loose.seen <= exact.seen and recall >= 0.9


# -- codec -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return sentencepiece_codec.Codec(f.read())


ALPHABET = ["a", "b", "the", "in", "er", " ", "  ", "\n", "é", "日", "本", "x", "\t", "ß", "tion", "🙂", "​", "▁", "==", "0", "\x00"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_codec_equals_the_library_and_round_trips(codec):
    for t in odd_texts(1500, 1):
        ids = codec.encode(t).tolist()
        assert codec.decode(ids) == t
        if "▁" not in t:
            assert ids == codec.library.encode(t)


def test_scan_equals_the_whole(codec):
    rng = random.Random(7)
    for t in [x for x in odd_texts(300, 2) if x] + ["".join(rng.choice(["a", "the", "in", "er", "日"]) for _ in range(70)) for _ in range(200)]:
        s, size = " " + t, rng.choice([1, 2, 5, 16, 17, 40])
        cuts = [(s[max(0, b - codec.longest) : b + size + codec.longest], min(b, codec.longest), min(b, codec.longest) + min(size, len(s) - b), b + size >= len(s)) for b in range(0, len(s), size)]
        matrices = [codec.transfer(*c) for c in cuts]
        states = sentencepiece_codec.resolve(matrices)
        assert b"".join(codec.backtrace(*c[:3], states[k], states[k + 1]) for k, c in enumerate(cuts)) == codec.encode(t).tobytes()
        left, right = matrices[0], matrices[-1]
        for m in matrices[1:]:
            left = sentencepiece_codec.product(left, m)
        for m in reversed(matrices[:-1]):
            right = sentencepiece_codec.product(m, right)
        assert left == sorted(set(right)) or len(matrices) == 1


def test_giant_documents_are_split(spark, codec):
    rng = random.Random(9)
    giant = "".join(rng.choice(ALPHABET) for _ in range(3000))
    solid = "".join(rng.choice(["a", "the", "日", "x"]) for _ in range(1500))
    rows = [(1, giant), (1, giant), (2, solid), (3, None), (4, ""), (5, "short one"), (6, giant + "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", ids int")
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(df, MODEL, chunk=100, giant=500), MODEL).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in out) == sorted((i, t or "") for i, t in rows)
    for r in out:
        assert r["decoded"] == r["text"]
        assert r["ids"] == (None if r["text"] is None else codec.encode(r["text"]).tolist())
    assert sentencepiece_codec.encode(df.limit(0), MODEL).count() == 0
