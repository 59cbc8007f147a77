"""Empty tables, very long texts and clashing columns where other tests don't have them."""

import random

from riskloom.llm import chat, decontaminate, secrets, simhash, toxicity, vptree
from riskloom.llm.common import shared_dir

DOCS = "doc_id long, text string"


def test_decontamination_of_no_and_of_very_long_documents(spark):
    rng = random.Random(61)
    item = " ".join(f"w{rng.randrange(50)}" for _ in range(14))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    long = "filler " * 150_000 + item + " filler" * 150_000
    df = spark.createDataFrame([(1, long, "x"), (2, "filler", "x")], DOCS + ", hit_words string")
    got = {r["doc_id"]: r for r in decontaminate.report(decontaminate.contamination(df, bench)).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["contaminated"], got[2]["contaminated"]) == (300_014, 14, True, False)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    kept = decontaminate.contamination(df.select("doc_id", "text"), bench, keep=["doc_id", "text"]).collect()
    assert {r["doc_id"]: r["spans"] for r in kept} == {1: [[7 * 150_000, 7 * 150_000 + len(item)]], 2: []}


def test_a_mask_of_many_turns_is_cut_in_blocks(spark):
    rng = random.Random(62)
    turns = [(1, i, rng.choice(["user", "assistant"]), "é<[&]🙂"[: rng.randrange(7)]) for i in range(700)]
    r = chat.digest(chat.format_chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    assert r["loss_chars"] == sum(len(t) for _, _, role, t in turns if role == "assistant") and r["n_turns"] == 700


def test_a_wrong_mask_shows_in_the_digest(spark):
    from pyspark.sql import functions as F

    done = chat.format_chat(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "bc")], "conv_id long, turn long, role string, text string"))
    bent = done.withColumn("loss_mask", F.transform("loss_mask", lambda m: F.struct(m["chars"].alias("chars"), (~m["loss"]).alias("loss"))))
    assert chat.digest(done).first()["loss_chars"] == 2 and chat.digest(bent).first()["loss_chars"] > 2


def test_stored_distances_are_those_of_the_path():
    import numpy as np

    rng = np.random.default_rng(63)
    x = rng.normal(size=(600, 5))
    radius = float(np.sqrt((x * x).sum(1)).max())
    router = vptree.Router(x, radius, 20)
    leaf, way = router.routed(vptree.lifted(x, radius))
    table = router.table(vptree.lifted(x, radius))
    for i in range(len(x)):
        path = router.paths[leaf[i]]
        assert np.allclose(way[i], [table[i, k] for k, _ in path]) and len(way[i]) <= 6


def test_a_hot_fingerprint_and_null_ids(spark):
    rows = [(i % 3 if i % 7 else None, "one text of many") for i in range(900)] + [(50, "another text here"), (51, "")]
    got = simhash.simhash_classes(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", component_id int")).collect()
    assert len(got) == 902 and {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2, None)} == {0}


def test_empty_tables(spark):
    df = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(df, labels).count() == 0 and secrets.redact_secrets(df, [0.0] * secrets.N_CLASSES**2).count() == 0
    assert shared_dir(spark)


def test_a_very_long_text_is_scored_whole(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs = [(i, ("you stupid idiot " if i % 2 else "the calm sea ") * 5) for i in range(60)] + [(100, "the calm sea " * 200_000), (101, "the calm sea " * 200_000 + "you stupid idiot " * 200_000)]
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(spark.createDataFrame(docs, DOCS), labels).collect()}
    assert got[100] < 0.5 < got[101]


def test_a_giant_text_at_the_usual_sizes(spark):
    from riskloom.llm import sentencepiece_codec
    from riskloom.llm.queries import MODEL

    rng = random.Random(64)
    assert sentencepiece_codec.GIANT <= 65_536
    giant = "".join(rng.choice(["the ", "inert", "日本", "x", "  ", "tion\n", "é"]) for _ in range(60_000))
    with open(MODEL, "rb") as f:
        whole = sentencepiece_codec.Codec(f.read()).library.encode(giant)
    df = spark.createDataFrame([(1, giant), (2, "short")], DOCS)
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(df, MODEL), MODEL).where("doc_id = 1").first()
    assert len(giant) > 2 * sentencepiece_codec.GIANT and out["ids"] == whole and out["decoded"] == giant


def test_null_ids_of_fingerprints_and_empty_tables(spark):
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_classes(spark.createDataFrame([(None, "a b c d"), (9, "a b c d"), (8, "x y z")], DOCS)).collect()}
    assert got == {None: 9, 9: 9, 8: 8} and simhash.simhash_classes(spark.createDataFrame([], DOCS)).count() == 0
