"""Bounds and losses that earlier versions had."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, secrets, toxicity, vptree

DOCS = "doc_id long, text string"


def test_a_block_holds_no_more_words_than_it_may(spark):
    items = [(i, ",".join(f"w{i}x{j}" for j in range(1000))) for i in range(20)]
    blocks = list(decontaminate._blocks(spark.createDataFrame(items, "item_id long, text string"), 2000))
    assert len(blocks) == 20 and all(sum(len(decontaminate.words_of(t)) for _, t in b) <= 2000 for b in blocks)


@pytest.mark.parametrize("name", ["Base", "ADDED"])
def test_a_column_that_differs_in_case_is_not_overwritten(spark, name):
    df = spark.createDataFrame([(1, "password = hunter22", "mine")], f"{DOCS}, {name} string")
    with pytest.raises(ValueError, match="exist"):
        secrets.scan_secrets(df, [0.0] * secrets.N_CLASSES**2)
    kept = secrets.scan_secrets(df, [0.0] * secrets.N_CLASSES**2, "found", "more").first()
    assert kept[name] == "mine"


def test_labels_of_the_calibration_fold_shape_no_feature(spark):
    rng = random.Random(141)
    fold = {r["id"]: r["f"] for r in spark.range(3000).select("id", toxicity.fold(F.col("id")).alias("f")).collect()}
    docs, labels = [], []
    for i, f in fold.items():
        bad = rng.random() < 0.4
        words = [f"w{rng.randrange(300)}" for _ in range(20)] + (["onlyfour" if f == 4 else "elsewhere"] if bad else [])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert b"elsewhere" in model.learned and b"onlyfour" not in model.learned


def test_a_part_s_own_words_don_t_train_its_trees(spark):
    # Each toxic text has a word of its part alone: learned from the other parts it says nothing, so the trees learn nothing from it.
    rng = random.Random(142)
    part = {r["doc_id"]: r["p"] for r in spark.range(2000).withColumnRenamed("id", "doc_id").select("doc_id", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(toxicity.PARTS)).alias("p")).collect()}
    docs, labels = [], []
    for i, p in part.items():
        bad = rng.random() < 0.5
        docs.append((i, " ".join([f"w{rng.randrange(50)}" for _ in range(12)] + ([f"sign{p}"] if bad else ["plain"]))))
        labels.append((i, int(bad)))
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert b"sign1" in model.learned
    raw = model.trees.raw(np.array([toxicity.features(t.encode(), model.learned, toxicity.FIXED) for t in ("w1 w2 sign1", "w1 w2 plain")]))
    assert abs(raw[0] - raw[1]) < 1


def test_many_vectors_of_one_query_id_in_many_shards(spark):
    rng = np.random.default_rng(143)
    rows = [(0, v) for v in rng.normal(size=(400, 6))] + [(1 + i, v) for i, v in enumerate(rng.normal(size=(300, 6)))]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"]) for r in vptree.nearest(df, shard_rows=16, query_block=4, sample=64).where("query_id = 0").collect())
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    best = sorted(((-(x[ids == 0] @ x[ids == j].T).max(), j) for j in set(ids) - {0}))[:20]
    assert got == [(n + 1, int(j)) for n, (_, j) in enumerate(best)]
