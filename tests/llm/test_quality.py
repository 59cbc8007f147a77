"""Quality rules: counts re-told on str, the language model re-told with dictionaries, bands from sorted lists."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from riskloom.llm import quality
from riskloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string"
WORD = re.compile("[^\x20\x09-\x0d]+")
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def half_of(text):
    return xxhash.xxh64_intdigest((text or "").encode(), 42) % 2


class SlowModel:
    """Interpolated modified Kneser-Ney of order five over the bytes of words, by dictionaries."""

    def __init__(self, texts):
        seen = Counter()
        for t in texts:
            for w in WORD.findall(t):
                marked = b" " + w.encode().lower() + b" "
                for i in range(1, len(marked)):
                    seen[marked[max(0, i - 4) : i + 1]] += 1
        self.counts = {5: {g: c for g, c in seen.items() if len(g) == 5}}
        for k in (4, 3, 2, 1):
            left = defaultdict(set)
            for g in self.counts[k + 1]:
                left[g[1:]].add(g[0])
            self.counts[k] = {g: len(s) for g, s in left.items()} | {g: c for g, c in seen.items() if len(g) == k}
        self.followers = {k: defaultdict(list) for k in self.counts}
        self.cut = {}
        for k, found in self.counts.items():
            n = [sum(c == j for c in found.values()) for j in range(5)]
            share = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
            for j in (1, 2, 3):
                d = j - (j + 1) * share * n[j + 1] / n[j] if share is not None and n[j] else 0.5 * j
                self.cut[k, j] = min(float(j), max(0.05, d))
            for g, c in found.items():
                self.followers[k][g[:-1]].append(c)

    def p(self, gram):
        k, context = len(gram), gram[:-1]
        after = self.followers[k].get(context)
        if after is None:
            return self.p(gram[1:])
        own = self.counts[k].get(gram, 0)
        cut = lambda c: self.cut[k, min(c, 3)]
        spare = sum(map(cut, after)) / sum(after)
        below = self.p(gram[1:]) if k > 1 else 1 / (len(after) + 1)
        return (max(0.0, own - cut(own)) / sum(after) if own else 0.0) + spare * below

    def score(self, text):
        nats, n = 0.0, 0
        for w in WORD.findall(text):
            marked = b" " + w.encode().lower() + b" "
            for i in range(1, len(marked)):
                nats -= math.log(self.p(marked[max(0, i - 4) : i + 1]))
                n += 1
        return nats, n


def invented(rng, n, alphabet):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(121)
    rows = [(i, invented(rng, rng.randrange(0, 60), "aabbcdeé" if i % 3 else "xyzzyß"), "en" if i % 3 else "de") for i in range(90)]
    rows += [(200, None, "en"), (None, rows[4][1], None), (201, "", None), (202, "a\nb b\na\n\x00 b b\n\nb b\n", "en")]
    rows += [(300 + i, rows[7][1], "en") for i in range(40)] + [(400, "one two three four five " * 30, "en"), (401, "Ab # $$ <|>\r\n" * 3, "und")]
    return rows


def test_counts_of_whole_tables(spark, small, duck):
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in QUERIES["op12_quality_rules"](spark, small).collect()}
    want = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert got == {i: slow_counts(t) for i, t in want.items()}


def test_counts_on_bytes_of_any_text():
    rng = random.Random(122)
    texts = ["", "\n", "\n\n", "a\n", "\na", " ", "a b a b a b a b", "é\né\né"] + ["".join(rng.choice("ab \n\t#é\x0b") for _ in range(rng.randrange(80))) for _ in range(400)]
    for cut in (0, 3, 200):
        column = pa.array(texts, pa.string())[cut:]
        got = list(zip(*(c.tolist() for c in quality.Slice(column).base()), strict=True))
        assert got == [slow_counts(t) for t in texts[cut:]]


@pytest.mark.parametrize("entries", [quality.SHARD_ENTRIES, 400])
def test_perplexity_equals_a_slow_model(spark, corpus, entries):
    df = spark.createDataFrame(corpus, DOCS).repartition(5)
    got = quality.score(df, ["doc_id"], entries).collect()
    assert len(got) == len(corpus)
    texts = {}
    for i, t, lang in corpus:
        texts.setdefault((lang or "und", half_of(t)), []).append(t or "")
    models = {k: SlowModel(v) for k, v in texts.items() if any(WORD.search(t) for t in v)}
    by = sorted(((r["doc_id"] or -1, r["symbols"], r["nats"]) for r in got), key=str)
    want = []
    for i, t, lang in corpus:
        model = models.get((lang or "und", 1 - half_of(t)))
        n = sum(len(w.encode()) + 1 for w in WORD.findall(t or ""))
        want.append((i or -1, n, model.score(t or "")[0] if model else None if n else 0.0))
    want.sort(key=str)
    for g, w in zip(by, want, strict=True):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None) and (g[2] is None or abs(g[2] - w[2]) <= 1e-4 * max(1, w[2]))


def test_bands_and_verdicts(spark, corpus):
    rng = random.Random(123)
    rows = [(i, invented(rng, 60, "aabbcdeé"), "en") for i in range(80)] + [(900, invented(rng, 60, "qwjkxvüöñ#+"), "en"), (901, " ".join(["aab"] * 9), "en")]
    df = spark.createDataFrame([(*r, True) for r in rows], DOCS + ", kept boolean")
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert [i for i, r in got.items() if not r["kept"]] == [900, 901] and got[901]["base_failed"] and not got[900]["base_failed"]
    assert got[900]["perplexity"] > got[900]["upper"] and all(r["lower"] < r["perplexity"] < r["upper"] for i, r in got.items() if i < 900)
    figures = sorted(round(math.log(r["perplexity"]) * 1000) for i, r in got.items() if not r["base_failed"])
    q1, q3 = (figures[math.ceil(len(figures) * q / 4) - 1] / 1000 for q in (1, 3))
    r = got[0]
    slack = quality.NOISE / math.sqrt(sum(len(w.encode()) + 1 for w in rows[0][1].split()))
    assert np.isclose(math.log(r["upper"]), q3 + quality.WIDTH * (q3 - q1) + slack) and np.isclose(math.log(r["lower"]), q1 - quality.WIDTH * (q3 - q1) - slack)


def test_wrong_language_is_rejected_and_clean_texts_stay(spark, small, duck):
    got = {r["doc_id"]: r for r in QUERIES["op12_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    labels = dict(duck.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    clean = [got[i] for i, q in labels.items() if q == 1 and i in got and not got[i]["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)


def test_defined_cases(spark):
    assert quality.quality(spark.createDataFrame([], DOCS)).count() == 0
    one = quality.quality(spark.createDataFrame([(1, "only one text of a language, kept as it has no model to judge it", "fr"), (2, None, None)], DOCS)).collect()
    assert {r["doc_id"]: (r["perplexity"], r["kept"], r["lang"]) for r in one} == {1: (None, True, "fr"), 2: (None, False, "und")}
    long = "ab ba " * 400_000 + "x" * 500_000
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame([(1, long, "en"), (2, "ab ba ab", "en"), (3, "ba ab", "en"), (4, "ab", "en"), (5, "ba", "en")], DOCS)).collect()}
    assert (got[1]["n_words"], got[1]["n_repeat_words"], got[1]["word_chars"]) == (800_001, 800_000, 2_100_000)


def test_symbol_ridden_texts_are_judged_by_a_model_of_the_others(spark):
    rng = random.Random(124)
    marks = ["###", "$$$", "%%%", "&&&", "***"]
    ridden = lambda n: " ".join(w + rng.choice(marks) for w in invented(rng, n, "aabbcdeé").split())
    rows = [(i, invented(rng, 200, "aabbcdeé"), "en") for i in range(120)] + [(500 + i, ridden(200), "en") for i in range(15)]
    rows += [(700, invented(rng, 200, "aabbcdeé") + " #" * 20, "en")]  # 20 symbols, 220 words: few
    rows += [(800 + i, ridden(200), "code") for i in range(30)] + [(900, invented(rng, 200, "aabbcdeé"), "code")]  # usual there, so the last is the odd one
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert len(got) == len(rows) and not any(r["base_failed"] for r in got.values())
    assert [i for i, r in sorted(got.items()) if not r["kept"]] == [*range(500, 515), 900]
    texts = {i: t for i, t, lang in rows}
    for lang, learned in (("en", [*range(120), 700]), ("code", [*range(800, 830), 900])):
        models = [SlowModel([texts[i] for i in learned if half_of(texts[i]) == half]) for half in (0, 1)]
        for i in [i for i, _, x in rows if x == lang][::7]:
            nats, n = models[1 - half_of(texts[i])].score(texts[i])
            assert np.isclose(math.log(got[i]["perplexity"]), nats / n, rtol=1e-4)


def test_bands_reject_most_texts_labelled_bad_that_pass_the_counts(spark, duck):
    got = {r["doc_id"]: r for r in QUERIES["op12_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    bad = [i for (i,) in duck.sql("SELECT doc_id FROM '/root/testdata/sf0.01/labels.parquet' WHERE quality = 0").fetchall()]
    passed = [got[i] for i in bad if i in got and not got[i]["base_failed"]]
    assert len(passed) > 20 and sum(not r["kept"] for r in passed) >= 0.9 * len(passed)
