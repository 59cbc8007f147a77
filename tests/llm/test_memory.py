"""What a task and a worker hold at once, whatever the tables hold."""

import pyarrow as pa
from pyspark.sql import functions as F

from riskloom.llm import common


def test_batches_of_long_texts_are_bounded_by_bytes(spark, tmp_path):
    spark = spark.newSession()
    spark.range(8000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 600).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    docs = common.table(spark, str(tmp_path), "documents")
    most = docs.coalesce(1).mapInArrow(sizes, "n long").agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    assert most["n"] == 8000 and most["most"] * 3000 < 5 << 20
    own = spark.newSession()
    own.conf.set(common.BATCH_BYTES, "9m")
    common.table(own, str(tmp_path), "documents")
    assert own.conf.get(common.BATCH_BYTES) == "9m"


def test_a_worker_keeps_one_operators_things(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    common.only("codec")["model"] = 1
    assert common.only("codec") == {"model": 1}
    assert common.only("toxicity") == {} and common.only("codec") == {}
