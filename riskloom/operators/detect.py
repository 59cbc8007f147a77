"""Detection: rule packs as Column expressions. One narrow projection, nothing shuffles.

Findings come in pack order, then rule order. A rule gives one finding at most; rules that find
personal data or secrets also give the span of their first match, as UTF-8 byte offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.re2 import to_java
from ..functions.rules import OK, VISIBLE_RULES, Rule

LOCATION = "struct<start:int,end:int>"
FINDING = f"struct<category:string,type:string,detail:string,confidence:double,severity:string,location:{LOCATION}>"


def folded(content: Column) -> Column:
    """What the rules' required literals are looked up in."""
    return F.translate(F.lower(content), "\u017f", "s")


def matches(content: Column, rule: Rule) -> Column:
    """Whether a rule fires, without the literal test."""
    return content.rlike(to_java(rule.pattern))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fires(rule: Rule, names: tuple[str, str, str]) -> str:
    plain, low, runs = names
    tests = [f"{runs} >= {rule.run}"] if rule.run else []
    tests += ["(" + " OR ".join(f"contains({low}, {_text(n)})" for n in group) + ")" for group in rule.literals]
    return " AND ".join([*tests, f"{plain} RLIKE {_text(to_java(rule.pattern))}"])


def _first_span(rule: Rule, plain: str) -> str:
    """Byte offsets of the first match: the length of what is lazily before it, and its own."""
    pattern = to_java(rule.pattern)
    flags, body = pattern.split(")", 1)
    start = f"octet_length(regexp_extract({plain}, {_text(f'{flags})(?s:^(.*?))(?:{body})')}, 1))"
    return f"named_struct('start', {start}, 'end', {start} + octet_length(regexp_substr({plain}, {_text(pattern)})))"


def _finding(rule: Rule, plain: str) -> str:
    location = _first_span(rule, plain) if rule.has_span else f"CAST(NULL AS {LOCATION})"
    fields = [("category", rule.category), ("type", rule.type), ("detail", rule.detail)]
    named = ", ".join(f"'{k}', {_text(v)}" for k, v in fields)
    return f"named_struct({named}, 'confidence', {rule.confidence}D, 'severity', {_text(rule.severity)}, 'location', {location})"


def _longest_run(text: Column, rules: list[Rule]) -> Column:
    """The greatest length that one of the rules asks for and some run of digits in the text reaches, 0 if none; the first test that fails ends it."""
    lengths = sorted({r.run for r in rules if r.run})
    if not lengths:
        return F.lit(0)
    out = F
    for reached, n in zip([0, *lengths], lengths, strict=False):
        out = out.when(~text.rlike(f"[0-9]{{{n}}}"), reached)
    return out.otherwise(lengths[-1])


def _unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: The largest input, by Spark's estimate, that is dealt anew.
DEALT_BYTES = 1 << 30


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over the cores where a scan gives few partitions, as one file of one row group does.

    A scan with at least half as many partitions as there are cores stays as it is, and so does whatever has been
    shuffled, or streams, or is larger than ``DEALT_BYTES``: large inputs are never moved for this.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > DEALT_BYTES:
        return df
    if "AdaptiveSparkPlan" in plan.executedPlan().nodeName() or plan.toRdd().getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores)


def _each(df: DataFrame, content: str, rules: list[Rule], made, kind: str, name: str) -> DataFrame:
    """Adds array ``name`` of what ``made(rule, text)`` is for the rules that fire. One SQL text: a pack is a single expression to build and parse."""
    names = tuple(_unused(df, n) for n in ("_text", "_folded", "_digits"))
    text = F.coalesce(F.col(content), F.lit(""))
    ready = df.withColumn(names[0], text)
    ready = ready.withColumns({names[1]: folded(F.col(names[0])), names[2]: _longest_run(F.col(names[0]), rules)})
    cases = [f"CASE WHEN {_fires(r, names)} THEN {made(r, names[0])} END" for r in rules]
    found = f"filter(array({', '.join(cases)}), f -> f IS NOT NULL)" if cases else f"CAST(array() AS array<{kind}>)"
    return ready.withColumn(name, F.expr(found)).drop(*names)


def detect(df: DataFrame, rules: list[Rule] | None = None, content: str = "content") -> DataFrame:
    """Adds ``findings``. Null content is empty content."""
    return _each(df, content, VISIBLE_RULES if rules is None else rules, _finding, FINDING, "findings")


def rule_hits(df: DataFrame, rules: list[Rule], key: str, content: str = "content") -> DataFrame:
    """``key, rule_id`` for every rule that fires."""
    hits = _unused(df, "_hits")
    found = _each(df, content, rules, lambda r, _: _text(r.id), "string", hits)
    return exploded(found, [key], hits, "rule_id")


def exploded(df: DataFrame, kept: list[str], array: str, name: str, at: str | None = None) -> DataFrame:
    """``kept`` and the elements of ``array``, none of them null, with their places.

    An inner explode would have the optimizer test the array's size below it, and so make the findings twice.
    """
    every = F.posexplode_outer(array).alias(at, name) if at else F.explode_outer(array).alias(name)
    return df.select(*kept, every).where(F.col(name).isNotNull())


def or_ok(findings: Column) -> Column:
    """The response's placeholder: one OK finding where there is none."""
    ok = F.struct(
        F.lit(OK).alias("category"),
        F.lit("NONE").alias("type"),
        F.lit("No security issues detected").alias("detail"),
        F.lit(1.0).alias("confidence"),
        F.lit("none").alias("severity"),
        F.lit(None).cast(LOCATION).alias("location"),
    ).cast(FINDING)
    return F.when(F.size(findings) == 0, F.array(ok)).otherwise(findings)
