"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES, USUAL = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark from wherever the path points.

    Batches that go to Python are bounded by bytes from here on, unless the session has a bound of its own: the usual 10,000
    rows of whole texts are tens of MB, several times over, in each task's JVM and worker.
    """
    if spark.conf.get(BATCH_BYTES) == USUAL:
        spark.conf.set(BATCH_BYTES, "4m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[str, dict] = {}


def only(name: str) -> dict:
    """What this Python worker keeps from task to task for one operator. Workers outlive a step, so what others kept goes."""
    for other in [k for k in _kept if k != name]:
        del _kept[other]
    return _kept.setdefault(name, {})


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def literal_array(values: list, kind: str) -> Column:
    """A constant array: one literal that Catalyst folds, instead of an expression per element."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where neither the setting nor a checkpoint directory exists, and the master is local (tests,
    notebooks), is a local temporary folder made and registered; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="riskloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


_open: list[list[DataFrame]] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at replicated files.

    The files go by :func:`discard`, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/riskloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _place(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._riskloom_path = path  # type: ignore[attr-defined]
    for made in _open:
        made.append(out)
    return out


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`materialize`."""
    path = getattr(df, "_riskloom_path", None)
    if path:
        where, fs = _place(df.sparkSession, path)
        fs.delete(where, True)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver's JVM collects what refers to them: let it, so that a job of
    many steps doesn't hold the files of all of them."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Collects what :func:`materialize` makes meanwhile, so that it can be discarded once it isn't needed."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open[:] = [x for x in _open if x is not made]


def discard_all(made: list[DataFrame], *but: DataFrame) -> None:
    for df in made:
        if not any(df is x for x in but):
            discard(df)


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so each part holds at most ``max_bytes`` of text (one row at least)."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)

# -- filters and joins that hold up under hot keys -----------------------------------------------------

MAP_BITS, BITS_A_VALUE = 28, 64


def bit_map(values: DataFrame):
    """A broadcast bit map of one column of 64-bit hashes: 64 bits a value, 2^28 bits (32 MB) at most.

    It has every value; how many others it lets through grows once it is full, what it loses never does.
    """
    spark = values.sparkSession
    values = values.toDF("v").where("v is not null")
    bits = min(MAP_BITS, max(12, (values.count() * BITS_A_VALUE).bit_length()))
    top = values.select(F.shiftrightunsigned("v", 64 - bits).alias("t"))
    words = top.select(F.expr("cast(t >> 6 as int) AS w"), F.expr("shiftleft(1L, cast(t & 63 as int)) AS b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # 2^22 rows at most
    held = np.zeros(1 << (bits - 6), np.int64)
    held[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return spark.sparkContext.broadcast((bits, held.view(np.uint64)))


def in_map(sent: tuple[int, np.ndarray], values: np.ndarray) -> np.ndarray:
    """Which of ``values`` (uint64) may be in a bit map."""
    bits, held = sent
    t = values >> np.uint64(64 - bits)
    return (held[(t >> np.uint64(6)).astype(np.int64)] >> (t & np.uint64(63))) & np.uint64(1) != 0


def maybe_in(df: DataFrame, column: Column | str, values: DataFrame, other: bool = False) -> DataFrame:
    """Rows whose ``column`` (hashes, not null) may be among ``values``; none that is gets lost. With ``other``, the rest.

    Only that column goes through Python.
    """
    sent = bit_map(values)

    @F.pandas_udf("boolean")
    def held(at: pd.Series) -> pd.Series:
        return pd.Series(in_map(sent.value, at.to_numpy(np.int64).view(np.uint64)) != other)

    return df.where(held(column))


HOT_SHARE, SALTS = 256, 64


def join_hot(rows: DataFrame, few: DataFrame, keys: list[str], weight: str, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``, whose ``keys`` are unique, not null, and stand for ``weight`` rows each.

    Keys with more than 1/256 of all the weight, at most 256 of them, are dealt into 64 parts by the hash ``spread``
    of the rows; only those keys are broadcast. No key is a task's whole lot, and each side shuffles once.
    """
    spark = rows.sparkSession
    total = few.agg(F.sum(weight).alias("n")).first()["n"] or 0
    hot = few.where(F.col(weight) * HOT_SHARE > F.lit(total)).select(*keys).collect()  # under HOT_SHARE rows
    if not hot:
        return rows.join(few, keys, how)
    named = spark.createDataFrame(hot, few.select(*keys).schema).withColumn("_hot", F.lit(True))
    salt = F.when(F.col("_hot"), F.pmod(spread, F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(named), keys, "left").withColumn("_salt", salt).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = few.join(F.broadcast(named), keys, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
