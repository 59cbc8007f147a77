"""Redaction: findings' spans replaced by tags, on bytes.

``overlap="sequential"`` (the default) replaces spans from the last start to the first, each at its original
offsets in the text as already changed, and passes over a span that ends beyond it; so overlapping
spans cut into earlier tags, as the semantics to match have it. ``overlap="merge"`` joins overlapping
spans first, under the tag of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import SAFE

# Fixed value: the tag.
TAG = "[REDACTED_%s]"


def spans(findings: Column) -> Column:
    """Structs (start, end, type) of findings with a location, by start descending, ties in rule order."""
    located = F.filter(
        findings,
        lambda f: f["location"].isNotNull() & (f["location"]["start"] >= 0) & (f["location"]["end"] > f["location"]["start"]),
    )
    numbered = F.transform(
        located,
        lambda f, i: F.struct(
            (-f["location"]["start"]).alias("order"), i.alias("i"), f["location"]["start"].alias("start"),
            f["location"]["end"].alias("end"), f["type"].alias("type"),
        ),
    )
    return F.array_sort(numbered)


def merged(found: Column) -> Column:
    """Overlapping spans as one, still by start descending."""
    by_start = F.reverse(found)
    kind = "array<struct<start:int,end:int,type:string>>"
    return F.reverse(
        F.aggregate(
            by_start,
            F.array().cast(kind),
            lambda acc, s: F.when(
                (F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]),
                F.concat(
                    F.slice(acc, 1, F.size(acc) - 1),
                    F.array(
                        F.struct(
                            F.element_at(acc, -1)["start"].alias("start"),
                            F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                            F.element_at(acc, -1)["type"].alias("type"),
                        )
                    ),
                ),
            ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"))))),
        )
    )


def redact(content: Column, findings: Column, overlap: str = "sequential") -> Column:
    found = spans(findings)
    if overlap == "merge":
        found = merged(found)
    raw = F.encode(content, "UTF-8")
    done = F.aggregate(
        found,
        raw,
        lambda text, s: F.when(
            s["end"] <= F.octet_length(text),
            F.concat(
                F.substring(text, F.lit(1), s["start"]),
                F.encode(F.format_string(TAG, s["type"]), "UTF-8"),
                F.substring(text, s["end"] + 1, F.octet_length(text)),
            ),
        ).otherwise(text),
    )
    return F.when(F.size(found) == 0, content).otherwise(done.cast("string"))


def safe_rewrite(df: DataFrame, overlap: str = "sequential") -> DataFrame:
    """Adds ``safe_rewrite``: the redacted text where the level isn't SAFE, else null.

    A level isn't SAFE where there are findings, and only there; so rows that aren't decided yet can be redacted as well.
    """
    gate = F.size("findings") > 0
    if "risk_level" in df.columns:
        gate = (F.col("risk_level") != SAFE) & gate
    return df.withColumn("safe_rewrite", F.when(gate, redact(F.col("content"), F.col("findings"), overlap)))
