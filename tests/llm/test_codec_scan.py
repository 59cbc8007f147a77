"""The parallel scan in groups of any fan, the walk of a word, and the library's ids."""

import random

import pytest

from riskloom.llm import sentencepiece_codec

DOCS = "doc_id long, text string"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BITS = ["a", "b", "the", "in", "er", " ", "  ", "\n", "é", "日", "本", "x", "ß", "tion", "🙂", "▁", "==", "0"]


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return sentencepiece_codec.Codec(f.read())


def test_encoding_does_not_ask_the_library(codec, monkeypatch):
    rng = random.Random(41)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 50))) for _ in range(300)]
    texts = [t for t in texts if "▁" not in t]
    want = [codec.library.encode(t) for t in texts]

    def no(*_):
        raise AssertionError("the library was asked")

    monkeypatch.setattr(codec, "library", no)
    codec.units.clear()
    codec.older.clear()
    assert [codec.encode(t).tolist() for t in texts] == want


def test_a_walk_is_the_path_of_the_scan(codec):
    rng = random.Random(42)
    for _ in range(400):
        u = " " + "".join(rng.choice([b for b in BITS if b not in (" ", "  ", "▁")]) for _ in range(rng.randint(1, 40)))
        assert codec.walk(u) == codec.search(u) == codec.path(u, 0, len(u), ("", 0), None) == codec.merge(u)


def test_the_local_test_equals_an_encoding_of_both(codec):
    rng = random.Random(45)
    pieces = [t for t in codec.ids if len(t) < 9]
    for k in range(40_000):
        a = rng.choice(pieces)
        b = rng.choice(pieces) if k % 2 else a[-rng.randint(1, len(a)) :] + rng.choice("aeinst")
        if b in codec.ids or len(b) == 1:
            assert codec.stable(a, b) == (codec.merge(a + b) == [a, b]), (a, b)
    assert all(codec.stable("", t) == (codec.merge(t) == [t]) for t in rng.sample(pieces, 2000))


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_levels_of_any_fan_give_the_same_ids(spark, codec, fan):
    rng = random.Random(43)
    long = "".join(rng.choice(BITS) for _ in range(1200))
    solid = "".join(rng.choice(["a", "the", "日", "x"]) for _ in range(900))
    rows = [(1, long), (2, solid), (3, long[:333]), (4, "short"), (5, None), (6, ""), (7, solid + "!")]
    out = sentencepiece_codec.encode(spark.createDataFrame(rows, DOCS), MODEL, chunk=60, giant=300, keep=["doc_id"], check=True, fan=fan).collect()
    got = {r["doc_id"]: r["ids"] for r in out}
    assert all(r["round_trip"] for r in out) and len(out) == len(rows)
    for i, t in rows:
        assert got[i] == (None if t is None else codec.encode(t).tolist())


def test_product_is_associative(codec):
    rng = random.Random(44)
    for _ in range(30):
        s = " " + "".join(rng.choice(BITS) for _ in range(60))
        cuts = [(s, b, min(len(s), b + 9), b + 9 >= len(s)) for b in range(0, len(s), 9)]
        a, b, c = (codec.transfer(*x) for x in cuts[:3])
        p = sentencepiece_codec.product
        assert p(p(a, b), c) == p(a, p(b, c))


def test_parts_of_words_are_walked_once(codec, monkeypatch):
    rng = random.Random(46)
    for _ in range(300):
        u = " " + "".join(rng.choice([b for b in BITS if b not in (" ", "  ", "▁")]) for _ in range(rng.randint(1, 30)))
        parts = codec.parts(u)
        assert "".join(parts) == u and [t for p in parts for t in codec.merge(p)] == codec.merge(u)
    walked, search = [], codec.search
    monkeypatch.setattr(codec, "search", lambda u: walked.append(u) or search(u))
    text = " ".join(f"harbouring{end}\nharbour{end}" for end in ("", "日", "\n", "\t\t", "日\n日"))
    codec.units.clear()
    codec.older.clear()
    assert codec.decode(codec.encode(text).tolist()) == text
    assert walked.count(" harbouring") == 1 and walked.count("harbour") == 1 and len(walked) < 8
