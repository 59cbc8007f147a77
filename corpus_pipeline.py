"""A corpus pipeline of five stages, each written as Parquet and read by the next.

Stages take ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, secrets, sentencepiece_codec, simhash, toxicity
from riskloom.llm.common import discard, discard_all, join_hot, materialize, maybe_in, scratch, table
from riskloom.llm.queries import MODEL


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the whole row as one struct: no column of the input can clash with an operator's own."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.

    Null and empty texts are scored like any other; rows of one id are scored each by their own text; without both
    classes among the labels every score is their share of toxic ones; an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_packed(docs), model, ["_row"]).where("score < 0.5").select("_row.*")


def _row_key(docs: DataFrame) -> Column:
    """What tells rows apart, in the order of preference: rows with an id first, the least id, then hashes of text and the rest."""
    rest = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_")))
    return F.struct(F.isnull("doc_id").alias("void"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), F.xxhash64(rest).alias("rest"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash class stays, that of the least row key; rows of one id in different classes all stay.

    Texts stay where they are: the keys that go, or that several equal rows share, make a bit map, and only rows that
    may be among them are joined with the list. Null ids come after all others; null texts are empty texts, of which
    one row stays; of fully repeated rows one stays; an empty table stays empty.
    """
    with scratch() as made:
        classes = simhash.simhash_classes(docs.select(_row_key(docs).alias("doc_id"), "text"))
        judged = classes.groupBy(F.col("doc_id").alias("_key")).agg(
            F.min(F.col("doc_id") == F.col("component_id")).alias("_stays"), F.count(F.lit(1)).alias("_n")
        )
        listed = materialize(judged.where("not _stays or _n > 1"), "listed")
        discard_all(made, listed)
    packed = docs.select(_row_key(docs).alias("_key"), F.struct(*docs.columns).alias("_row")).withColumn("_at", F.xxhash64("_key"))
    at = listed.select(F.xxhash64("_key"))
    clear = maybe_in(packed, "_at", at, other=True).select("_row.*")
    doubt = join_hot(maybe_in(packed, "_at", at), listed, ["_key"], "_n", F.xxhash64(F.monotonically_increasing_id()), "left")
    stays = doubt.where("_stays is null").union(doubt.where("_stays").dropDuplicates(["_key"]))
    return clear.union(stays.select("_row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null texts hold none; rows of one id are judged each; without benchmark items, or without documents, all stay.
    """
    found = decontaminate.contamination(_packed(docs), table(spark, sf_dir, "benchmark"), keep=["_row"])
    return found.where(F.size("hit_words") == 0).select("_row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; the secrets in their texts are replaced, and ``n_chars`` follows. Null texts stay null, with a null ``n_chars``."""
    clean = secrets.redact_secrets(_packed(docs))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row, repeated ones included, with a flag that decoding them gives the text back; null texts have null ids."""
    encoded = sentencepiece_codec.encode(docs, MODEL, keep=["doc_id"], check=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch() as made:
            out = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard_all(made, out)
        discard(docs)
        docs = out


#: Hash fingerprints, a trained model and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
