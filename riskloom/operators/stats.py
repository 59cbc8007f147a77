"""Counters over decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policy import BLOCK, REVIEW, SAFE


def by_decision(decided: DataFrame) -> DataFrame:
    """``risk_level, n`` with a row for each level, zero where there is none."""
    levels = decided.sparkSession.createDataFrame([(SAFE,), (REVIEW,), (BLOCK,)], "risk_level string")
    counted = decided.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counted, "risk_level", "left").select("risk_level", F.coalesce("n", F.lit(0)).alias("n"))


def totals(decided: DataFrame) -> DataFrame:
    """One row: ``total_scans`` and a count per level."""
    return decided.agg(
        F.count(F.lit(1)).alias("total_scans"),
        *[F.count_if(F.col("risk_level") == level).alias(level.lower()) for level in (SAFE, REVIEW, BLOCK)],
    )


def rollup(decided: DataFrame) -> DataFrame:
    """Scans and mean score by tenant and profile, with subtotals (null: all)."""
    return decided.rollup("tenant_id", "policy_profile").agg(
        F.count(F.lit(1)).alias("scans"),
        F.count_if(F.col("risk_level") == BLOCK).alias("blocks"),
        F.sum("risk_score").cast("long").alias("score_sum"),
    )
