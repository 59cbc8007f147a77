"""The pipeline's stages on a small corpus, each against what it must keep and change."""

import random

import corpus_pipeline
from test_dedup_operators import classes_of, prose, slow_fingerprint

from riskloom.llm import sentencepiece_codec
from riskloom.llm.queries import MODEL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, n int, items string, base string, hit_words int"


def corpus(spark, path):
    rng = random.Random(12)
    words = lambda n: prose(rng, n)
    item = words(12)
    rows = [(i, words(rng.choice([30, 80, 200]))) for i in range(120)]
    rows += [(200 + i, f"{words(20)} you stupid idiot, worthless trash {words(20)} pathetic scum") for i in range(40)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, rows[3][1] + " tail"), (303, f"{words(9)} {item.upper()} {words(9)}")]
    rows += [(304, f'{words(9)} token = "0123456789abcdef0123456789abcdef"'), (305, None), (306, ""), (307, ""), (5, rows[5][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9, 8, "it", "b", i) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(200 <= i < 240)) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return dict(rows)


def test_stages(spark, tmp_path):
    text = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "sentencepiece"]

    def step(name, docs):
        out = stages[name](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        back = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "sentencepiece" or back.columns == docs.columns
        return back, [r["doc_id"] for r in back.select("doc_id").collect()]

    kept, ids = step("toxicity", docs)
    assert not [i for i in ids if 200 <= i < 240] and set(text) - set(range(200, 240)) == set(ids) and ids.count(5) == 2
    nodes = sorted(set(ids))
    prints = {i: slow_fingerprint(text[i]) for i in nodes}
    root = classes_of(nodes, [(a, b) for a in nodes for b in nodes if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    kept, ids = step("simhash_near_dedup", kept)
    assert sorted(ids) == sorted(set(root.values())) and ids.count(5) == 1 and 300 not in ids
    kept, after = step("benchmark_decontamination", kept)
    assert set(ids) - set(after) == {303}
    kept, same = step("secret_scans", kept)
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert sorted(same) == sorted(after) and rows[304]["text"].endswith("[SECRET]\"") and rows[304]["n_chars"] == len(rows[304]["text"])
    assert all(rows[i]["text"] == text[i] for i in rows if i != 304)
    assert all((r["score"], r["n"], r["items"], r["base"], r["hit_words"]) == (9, 8, "it", "b", i) for i, r in rows.items())
    final, _ = step("sentencepiece", kept)
    with open(MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    for r in final.collect():
        own = rows[r["doc_id"]]["text"]
        assert r["round_trip"] and r["ids"] == (None if own is None else codec.encode(own).tolist())


def test_run_and_empty_tables(spark, tmp_path):
    corpus(spark, f"{tmp_path}/a")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/a/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_rows_of_one_id_are_decided_one_by_one(spark):
    rng = random.Random(13)
    own = [prose(rng, 80) for _ in range(12)]
    rows = [(None, t, 1) for t in own[:4]] + [(7, t, 1) for t in own[4:8]] + [(1, own[8], 1), (9, own[8], 1), (9, own[9], 1)]
    rows += [(None, own[8], 1), (None, own[0], 2), (None, own[0], 1), (7, own[4], 1), (None, None, 1)]
    df = spark.createDataFrame([(i, t, n) for i, t, n in rows], "doc_id long, text string, n int")
    want = {(None, t, 1) for t in own[:4]} | {(7, t, 1) for t in own[4:8]} | {(1, own[8], 1), (9, own[9], 1), (None, None, 1)}
    kept = []
    for parts in (1, 5):
        got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, df.repartition(parts), "").collect()]
        assert len(got) == len(want) and {r[:2] for r in got} == {r[:2] for r in want}
        kept.append(sorted(got, key=str))
    assert kept[0] == kept[1]
