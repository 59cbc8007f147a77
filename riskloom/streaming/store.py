"""The stored audit log: appended by a stream batch by batch, read by day and tenant, counted as it grows.

Three tables under one path, each partitioned by what readers ask for and by the batch that wrote it:

* ``entries``: signed entries, by day and by a bucket of the tenant;
* ``heads``: each chain's last signature and length after a batch that touched it, by day;
* ``counters``: a batch's entries by day, tenant and level.

A batch overwrites its own partitions and nothing else, and begins each chain at the heads of the batches before it. So a batch that
is replayed, whole or after a failure half way, leaves the log as if it had come once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import chain, entries
from ..operators.policy import BLOCK, REVIEW, SAFE
from ..sources.shared import discard, new_path

CHAIN = ["tenant_id", "day"]
TENANT_BUCKETS = 64
ENTRY = (
    "event_id string, session_id string, timestamp string, risk_level string, risk_score int, finding_count int, policy_profile string, ts timestamp, tenant_id string, "
    "seq long, prev_signature string, signature string, day string, bucket int, batch long"
)
HEAD = "tenant_id string, seq0 long, prev0 string, day string, batch long"
COUNTER = "day string, tenant_id string, risk_level string, n long, batch long"


def _bucket(tenant):
    return F.pmod(F.xxhash64(tenant), F.lit(TENANT_BUCKETS)).cast("int")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _put(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def log(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/entries", ENTRY)


def append(decided: DataFrame, batch: int, path: str, secret: str) -> None:
    """One batch of decisions (with ``findings`` or ``finding_count``), put behind what the log has of their chains."""
    spark = decided.sparkSession
    rows = entries(decided).withColumn("day", F.substring("timestamp", 1, 10))
    staged = new_path(spark, "batch")
    try:
        # Written once: what made the batch, a stream's state among it, isn't worked through again for each table.
        rows.write.parquet(staged)
        _append(spark.read.schema(rows.schema).parquet(staged), batch, path, secret)
    finally:
        discard(spark, staged)


def _append(rows: DataFrame, batch: int, path: str, secret: str) -> None:
    spark = rows.sparkSession
    days = [r["day"] for r in rows.select("day").distinct().collect()]  # the days of one batch
    known = _read(spark, f"{path}/heads", HEAD).where(F.col("day").isin(days) & (F.col("batch") < batch))
    heads = known.groupBy(*CHAIN).agg(F.max_by("seq0", "batch").alias("seq0"), F.max_by("prev0", "batch").alias("prev0"))
    signed = chain(rows, secret, CHAIN, heads)
    numbered = signed.withColumns({"bucket": _bucket("tenant_id"), "batch": F.lit(batch).cast("long")})
    _put(numbered.select(*[c.split()[0] for c in ENTRY.split(", ")]), f"{path}/entries", ["day", "bucket", "batch"])
    mine = log(spark, path).where(F.col("day").isin(days) & (F.col("batch") == batch))
    after = mine.groupBy(*CHAIN, "batch").agg((F.max("seq") + 1).alias("seq0"), F.max_by("signature", "seq").alias("prev0"))
    _put(after.select("tenant_id", "seq0", "prev0", "day", "batch"), f"{path}/heads", ["day", "batch"])
    _put(mine.groupBy("day", "tenant_id", "risk_level", "batch").agg(F.count(F.lit(1)).alias("n")), f"{path}/counters", ["batch"])


def appender(path: str, secret: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``."""
    return lambda decided, batch: append(decided, batch, path, secret)


def page(spark: SparkSession, path: str, tenant: str, day: str, after: int = -1, rows: int = 100) -> DataFrame:
    """The next ``rows`` entries of a chain behind place ``after``, in order; only the partitions of that day and tenant are read."""
    bucket = spark.range(1).select(_bucket(F.lit(tenant))).first()[0]
    mine = log(spark, path).where((F.col("day") == day) & (F.col("bucket") == bucket) & (F.col("tenant_id") == tenant) & (F.col("seq") > after))
    return mine.orderBy("seq").limit(rows)


def counters(spark: SparkSession, path: str) -> DataFrame:
    """``day, tenant_id, risk_level, n``, merged from what each batch counted: the log itself isn't read."""
    return _read(spark, f"{path}/counters", COUNTER).groupBy("day", "tenant_id", "risk_level").agg(F.sum("n").alias("n"))


def totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``total_scans`` and a count per level."""
    n = counters(spark, path)
    return n.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_scans"),
        *[F.coalesce(F.sum(F.when(F.col("risk_level") == level, F.col("n"))), F.lit(0)).alias(level.lower()) for level in (SAFE, REVIEW, BLOCK)],
    )
