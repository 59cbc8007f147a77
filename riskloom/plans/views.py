"""The engine from SQL: views over a table of requests, planned by Catalyst like any other query.

``prescan`` has a row for each request with its decision, ``prescan_findings`` one for each finding, ``prescan_governed`` what a
policy lets through. A query reads the columns it asks for and no more: a count by level moves no text.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import exploded
from ..operators.govern import PolicyConfig, ProfileFetcher, default_config, govern
from .pipeline import ScanConfig, scan

#: What a table of requests may leave out, and how it is read then.
OPTIONAL = {"event_id": "string", "tenant_id": "string", "session_id": "string", "policy_profile": "string", "tool_capabilities": "array<string>"}


def requests_of(spark: SparkSession, table: str) -> DataFrame:
    """The rows of a table or view with a ``content``; what they don't have is null."""
    rows = spark.table(table)
    given = {c.lower() for c in rows.columns}
    return rows.withColumns({n: F.lit(None).cast(t) for n, t in OPTIONAL.items() if n not in given})


def create_views(
    spark: SparkSession, table: str, cfg: ScanConfig | None = None, policy: PolicyConfig | None = None, fetcher: ProfileFetcher | None = None, prefix: str = "prescan"
) -> list[str]:
    """Temporary views over ``table``; their names. Decisions are without session memory unless ``cfg`` says otherwise (``table`` has a ``ts`` then)."""
    rows = requests_of(spark, table)
    decided = scan(rows, cfg or replace(ScanConfig(), sessions=False))
    kept = [c for c in decided.columns if c != "findings"]
    found = exploded(decided, kept, "findings", "finding", "n").select(
        "event_id", "risk_level", "n", *[f"finding.{f}" for f in ("category", "type", "detail", "confidence", "severity")],
        F.col("finding.location.start").alias("span_start"), F.col("finding.location.end").alias("span_end"),
    )
    # A request's own profile goes before the policy's, as a row's override does.
    governed = rows.transform(govern(policy or default_config(), fetcher, override="policy_profile"))
    made = {prefix: decided, f"{prefix}_findings": found, f"{prefix}_governed": governed}
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return list(made)
