"""Phrase mining against counting every n-gram in a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from compare import same
from riskloom.llm import collocations
from riskloom.llm.oracles import ORACLE_SQL
from riskloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string"


def slow(rows, least, top, longest=4):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(inside[lang, w[i : i + m]], a)
    found = {}
    for (lang, w), a in candidates.items():
        if 100 * inside[lang, w] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])
    )


def told(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def test_query_equals_its_sql(spark, small, duck):
    same(QUERIES["op11_collocations"](spark, small), duck, ORACLE_SQL["op11_collocations"])


def corpus():
    rng = random.Random(111)
    words = ["a", "B", "é", "of", "the", "x y", "z\x00", "#", "Ünd", "_"]
    rows = []
    for i in range(160):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", "!? "]) for _ in range(rng.randrange(40)))
        rows.append((i, text, rng.choice(["en", "en", "de", None])))
    rows += [(500, "the hot piece of all, " * 300, "en")] * 30 + [(None, None, "en"), (501, "", None), (502, " \t ,. ", "fr"), (503, "once only", "xx")]
    return rows


def test_equals_counting_everything(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", rank int").repartition(7)
    for least, top in ((3, 2000), (12, 5)):
        assert told(collocations.collocations(df, least, top)) == slow(rows, least, top)


def test_full_maps_lose_nothing(spark, monkeypatch):
    from riskloom.llm import common

    monkeypatch.setattr(common, "MAP_BITS", 7)
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS)
    assert told(collocations.collocations(df, 4, 2000)) == slow(rows, 4, 2000)


def test_packed_weights_come_back(spark):
    h = np.arange(1, 2000, dtype=np.uint64) << np.uint64(37)
    w = np.where(np.arange(1999) % 7 == 0, 254 + np.arange(1999), 1)
    batches = list(collocations.packed(h, w, 6))
    rows = spark.createDataFrame(pa.Table.from_batches(batches).to_pandas(), "bucket int, hashes binary, weights binary, large binary")
    want = {int(collocations.code(np.array([b]), np.array([x]))[0].view(np.int64)) for b, x in {
        (int(a >> np.uint64(40)) % 6, a & np.uint64((1 << 40) - 1)) for a, n in zip(h, w, strict=True) if n >= 1000}}
    got = {r["v"] for r in collocations.frequent_codes(rows, 6, 1000).collect()}
    assert want <= got


def test_exact_beyond_64_bits(spark):
    big = 2**55
    frequent = spark.createDataFrame([("en", "a", big), ("en", "b", big + 12345), ("en", "a b", big - 1)], "lang string, phrase string, f long")
    (r,) = collocations.scored(frequent).collect()
    assert r["score"] == 2_000_000 * (big - 1) // (2 * big + 12345)


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "rare words only", "en")], DOCS)).count() == 0
    long = "ab ba " * 300_000
    got = told(collocations.collocations(spark.createDataFrame([(1, long, "en")], DOCS)))
    assert got == slow([(1, long, "en")], 30, 2000)
