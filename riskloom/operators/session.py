"""Session memory as windows: what earlier requests of a session say about the present one.

A decision depends on earlier decisions only through "was there a block before", and the first block of a
session is decided without any. So two passes give what a sequential fold would: decide as if there had
been no block, then take the running maximum of those blocks.

A session may be of any size (all callers without ids share one), so a long one is cut into *segments* of time, some
``SEGMENT_ROWS`` requests each, that are worked on in different tasks: a segmented prefix scan. What a segment does to the memory
is a small summary: how many requests it has, its last six categories, whether it blocks anyone, and its reviews and blocks
under either answer to "was there a block before". Summaries combine associatively, so windows over the segments of a session (a row
each) say what every segment begins with; each is then finished on its own. Sessions of up to ``SEGMENT_ROWS`` requests are one segment
that begins with nothing, and where there is no other, no summary is made.

One shuffle, on session and segment; the frames are running aggregates and a bounded list. Summaries are made from a
narrow copy of the long sessions' rows (order, categories, severities), which shuffles without texts and is written once to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.rules import EXFIL, INJECTION
from ..sources.shared import written
from .policy import BLOCK, REVIEW, evaluate

# Categories remembered, how many of a kind are a repetition, and the key of no ids.
REMEMBERED, REPEATED, ANONYMOUS = 6, 2, "anonymous"

#: Requests in a segment, segments of a session at most, and cut points up to which their list is broadcast.
SEGMENT_ROWS, MOST_SEGMENTS, BROADCAST_CUTS = 500_000, 1_000, 100_000
SEGMENT = "_segment"


def session_key(tenant: Column, session: Column) -> Column:
    tenant, session = F.coalesce(tenant, F.lit("")), F.coalesce(session, F.lit(""))
    return F.when((tenant == "") & (session == ""), F.lit(ANONYMOUS)).otherwise(F.concat_ws(":", tenant, session))


def _earlier(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _last_six(categories: Column) -> Column:
    return F.slice(categories, F.greatest(F.size(categories) - REMEMBERED + 1, F.lit(1)), REMEMBERED)


def _count(categories: Column, category: str) -> Column:
    return F.size(F.filter(categories, lambda c: c == category))


def _again() -> tuple[Column, Column]:
    return _count(F.col("recent_categories"), INJECTION) >= REPEATED, _count(F.col("recent_categories"), EXFIL) >= REPEATED


def _remember(df: DataFrame, categories: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``_after``, the last six categories up to and with a row that has any (else null), and ``_before``, those of earlier rows."""
    df = df.withColumns({"_has": F.size(categories) > 0, "_categories": categories})
    # Rows with categories hold one each at least, so the last six rows of them hold the last six categories.
    among = Window.partitionBy(*keys, "_has").orderBy(*order).rowsBetween(1 - REMEMBERED, 0)
    gathered = _last_six(F.flatten(F.collect_list("_categories").over(among)))
    df = df.withColumn("_after", F.when(F.col("_has"), gathered))
    before = F.last("_after", ignorenulls=True).over(_earlier(keys, order))
    return df.withColumn("_before", F.coalesce(before, F.array().cast("array<string>"))).drop("_has", "_categories")


def _micros() -> Column:
    """The time of a request as a number; times without a zone are read in the session's."""
    return F.unix_micros(F.col("ts").cast("timestamp"))


# -- long sessions -------------------------------------------------------------------------------------


def cut_points(keyed: DataFrame, segment_rows: int) -> DataFrame | None:
    """``session_key, cuts``: microseconds after which a long session's next segment begins; None where no session is long.

    Two scans of key and time only, the second of long sessions. Requests of one instant stay together.
    """
    spark = keyed.sparkSession
    counted = keyed.groupBy("session_key").agg(F.count(F.lit(1)).alias("n"))
    long = counted.where(F.col("n") > segment_rows).collect()  # a row for each segment_rows requests at most
    if not long:
        return None
    wanted = {r["session_key"]: min(MOST_SEGMENTS, -(-r["n"] // segment_rows)) for r in long}
    many = max(wanted.values())
    listed = spark.createDataFrame([(k,) for k in wanted], "session_key string")
    ours = keyed.join(F.broadcast(listed) if len(wanted) <= BROADCAST_CUTS else listed, "session_key")
    at = F.percentile_approx(_micros(), [i / many for i in range(1, many)], 100 * many)
    rows = []
    for r in ours.groupBy("session_key").agg(at.alias("at")).collect():
        n = wanted[r["session_key"]]
        points = sorted({(r["at"] or [])[i * many // n - 1] for i in range(1, n)}) if r["at"] else []
        rows.append((r["session_key"], points))
    cuts = spark.createDataFrame(rows, "session_key string, cuts array<long>")
    return F.broadcast(cuts) if sum(len(p) for _, p in rows) <= BROADCAST_CUTS else cuts


def in_segments(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds the segment's number, counted from 0; a request without a time is in the first."""
    at = _micros()
    # By halving: a row looks at ten of up to MOST_SEGMENTS cuts.
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(MOST_SEGMENTS.bit_length()))])
    passed = F.aggregate(halves, F.lit(0), lambda n, step: F.when(F.get("cuts", n + step - 1) < at, n + step).otherwise(n))
    return keyed.join(cuts, "session_key", "left").withColumn(SEGMENT, passed).withColumn("_long", F.col("cuts").isNotNull()).drop("cuts")


def beginnings(rows: DataFrame) -> DataFrame:
    """What each segment of the long sessions begins with: ``_scans0, _categories0, _blocked0, _reviews0, _blocks0``."""
    keys, order = ["session_key", SEGMENT], ["ts", "event_id"]
    slim = F.transform("findings", lambda f: F.struct(f["category"].alias("category"), f["severity"].alias("severity")))
    narrow = rows.where("_long").select(*keys, *order, "policy_profile", "tool_capabilities", slim.alias("findings"))
    narrow = written(_remember(narrow.repartition(*keys), F.transform("findings", lambda f: f["category"]), keys, order), "long-sessions")
    across = _earlier(["session_key"], [SEGMENT])
    # A segment's summary stands in for its rows: the same windows, a row for each segment.
    found = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max_by("_after", F.when(F.col("_after").isNotNull(), F.struct(*order))).alias("last"))
    first = _remember(found, F.coalesce("last", F.array().cast("array<string>")), ["session_key"], [SEGMENT])
    first = first.select(*keys, F.coalesce(F.sum("n").over(across), F.lit(0)).alias("_scans0"), F.col("_before").alias("_categories0"))
    first = written(first, "beginnings")
    known = narrow.join(first, keys).withColumn("recent_categories", _last_six(F.concat("_categories0", "_before")))
    again, exfil = _again()
    base = evaluate(known, again, exfil).select(*known.columns, (F.col("risk_level") == BLOCK).cast("int").alias("_block"))
    running = F.coalesce(F.max("_block").over(_earlier(keys, order)), F.lit(0)).alias("_blocked")
    base = base.select("*", running)
    counted = {}
    for answer, blocked in (("no", F.col("_blocked") > 0), ("yes", F.lit(True))):
        base = evaluate(base, again, exfil, blocked).withColumnRenamed("risk_level", f"_{answer}").drop("risk_score", "reasoning", "decision_factors")
        counted |= {f"{level}_{answer}": F.count_if(F.col(f"_{answer}") == level) for level in (REVIEW, BLOCK)}
    sums = base.groupBy(*keys).agg(F.max("_block").alias("any"), *[c.alias(n) for n, c in counted.items()])
    sums = sums.withColumn("_blocked0", F.coalesce(F.max("any").over(across), F.lit(0)))
    own = {level: F.when(F.col("_blocked0") > 0, F.col(f"{level}_yes")).otherwise(F.col(f"{level}_no")) for level in (REVIEW, BLOCK)}
    sums = sums.withColumns({level: c for level, c in own.items()})
    before = {n: F.coalesce(F.sum(level).over(across), F.lit(0)).alias(n) for n, level in (("_reviews0", REVIEW), ("_blocks0", BLOCK))}
    return written(first.join(sums.select(*keys, "_blocked0", *before.values()), keys), "beginnings")


# -- decisions -----------------------------------------------------------------------------------------


def decide_sessions(df: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Adds memory, decision and the signals the decision was made under.

    Needs ``event_id, ts, tenant_id, session_id, policy_profile, tool_capabilities, findings``; requests
    of a session follow one another by (ts, event_id). Sessions of more than ``segment_rows`` requests are worked on in segments.
    """
    names = df.columns
    keyed = df.withColumn("session_key", session_key(F.col("tenant_id"), F.col("session_id")))
    cuts = cut_points(keyed.select("session_key", "ts"), segment_rows)
    keys, order = ["session_key"], ["ts", "event_id"]
    nothing = {"_scans0": F.lit(0), "_categories0": F.array().cast("array<string>"), "_blocked0": F.lit(0), "_reviews0": F.lit(0), "_blocks0": F.lit(0)}
    if cuts is None:
        keyed = keyed.withColumns(nothing)
    else:
        keys.append(SEGMENT)
        keyed = in_segments(keyed, cuts)
        begun = beginnings(keyed)
        few = begun.count() <= BROADCAST_CUTS  # a row for each segment_rows requests at most
        keyed = keyed.drop("_long").join(F.broadcast(begun) if few else begun, keys, "left")
        keyed = keyed.withColumns({n: F.coalesce(n, c) for n, c in nothing.items()})
    # Dealt by session and segment once: that serves the windows by (session, has findings) too, which would deal anew.
    known = _remember(keyed.repartition(*keys), F.transform("findings", lambda f: f["category"]), keys, order)
    earlier = _earlier(keys, order)
    known = known.withColumns(
        {
            "recent_categories": _last_six(F.concat("_categories0", "_before")),
            "recent_scans": (F.col("_scans0") + F.count(F.lit(1)).over(earlier)).cast("int"),
        }
    )
    again, exfil = _again()
    known = known.withColumns({"repeated_injection_attempts": again, "repeated_exfiltration_hints": exfil}).drop("_after", "_before")
    again, exfil = F.col("repeated_injection_attempts"), F.col("repeated_exfiltration_hints")
    first = evaluate(known, again, exfil).withColumn("_block", (F.col("risk_level") == BLOCK).cast("int"))
    before = F.greatest("_blocked0", F.coalesce(F.max("_block").over(earlier), F.lit(0)))
    first = first.select(*known.columns, before.alias("_blocked"))
    done = evaluate(first, again, exfil, F.col("_blocked") > 0)

    def earlier_with(level: str, begun: str) -> Column:
        return (F.col(begun) + F.coalesce(F.sum((F.col("risk_level") == level).cast("int")).over(earlier), F.lit(0))).cast("int")

    done = done.withColumns(
        {
            "recent_reviews": earlier_with(REVIEW, "_reviews0"),
            "recent_blocks": earlier_with(BLOCK, "_blocks0"),
            "recent_attack_escalation": (F.col("_blocked") > 0) & (again | exfil),
        }
    )
    added = ["session_key", "recent_categories", "recent_scans", "repeated_injection_attempts", "repeated_exfiltration_hints"]
    decided = ["risk_score", "decision_factors", "risk_level", "reasoning", "recent_reviews", "recent_blocks", "recent_attack_escalation"]
    return done.select(*names, *added, *decided)


def session_profiles(decided: DataFrame) -> DataFrame:
    """What a session's memory holds after its last request."""
    categories = F.transform("findings", lambda f: f["category"])
    last = F.max_by(F.concat("recent_categories", categories), F.struct("ts", "event_id"))
    return (
        decided.groupBy("session_key")
        .agg(
            F.count(F.lit(1)).alias("scans"),
            F.count_if(F.col("risk_level") == REVIEW).alias("reviews"),
            F.count_if(F.col("risk_level") == BLOCK).alias("blocks"),
            last.alias("_all"),
        )
        .select("session_key", "scans", "reviews", "blocks", _last_six(F.col("_all")).alias("recent_categories"))
    )
