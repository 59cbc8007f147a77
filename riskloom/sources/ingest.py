"""Requests in: JSON decoding with its rejects, defaults; responses out.

Decoding follows a case-insensitive JSON decoder that reads one value: keys match in any case, unknown keys are
ignored, a value of the wrong type makes the document invalid, null stands for the zero value. Of keys given
several times the last wins; null then leaves a text as it was, and drops a context; contexts otherwise add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Request fields, messages, defaults.
TEXT_FIELDS = ("event_id", "tenant_id", "session_id", "content", "policy_profile")
INVALID, EMPTY = "invalid JSON", "content is required"
DEFAULT_PROFILE, EVENT_PREFIX = "strict", "evt_"
#: Signs that responses escape.
UNSAFE = ("<", ">", "&", "\u2028", "\u2029")


#: What a strict JSON reader refuses.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


#: An escaped high surrogate without a low one behind it, and a low one without a high one before it. An even number of backslashes
#: before the escape makes it one; an odd number makes it text.
LONE_HIGH = r"(?<!\\)((?:\\\\)*)\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F][0-9a-fA-F]{2})"
LONE_LOW = r"(?<!\\)((?:\\\\)*)(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}"


def _whole_signs(text: Column) -> Column:
    """Lone surrogates as the replacement character's escape; texts without an escape of that kind are left as they are."""
    mended = text
    for lone in (LONE_HIGH, LONE_HIGH, LONE_LOW):  # twice: of two in a row the second begins where the first ended
        mended = F.regexp_replace(mended, lone, r"$1\\ufffd")
    return F.when(F.lower(text).contains("\\ud"), mended).otherwise(text)


def _entries(text: Column, kind: str = "variant") -> Column:
    """The members of a JSON object in document order, repeated keys included; null if it is none."""
    return F.map_entries(F.from_json(text, f"map<string,{kind}>", STRICT))


def _named(entries: Column, name: str) -> Column:
    """Values whose key matches in any case, in order."""
    found = F.filter(entries, lambda e: F.translate(F.lower(e["key"]), "\u017f", "s") == name)
    return F.transform(found, lambda e: e["value"])


def _is(v: Column, kind: str) -> Column:
    """Null, or of a kind."""
    return v.isNull() | F.is_variant_null(v) | F.schema_of_variant(v).startswith(kind)


def _void(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def _texts(values: Column) -> Column:
    """The last text that isn't null, else the empty one."""
    said = F.filter(values, lambda v: ~_void(v))
    return F.coalesce(F.try_variant_get(F.try_element_at(said, F.lit(-1)), "$", "string"), F.lit(""))


def _once(df: DataFrame, kept: list[str], **made: Column) -> DataFrame:
    """``kept`` and new columns, each made once per row: a filter further up doesn't go below the generator."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def decode(lines: DataFrame, value: str = "value") -> DataFrame:
    """One JSON document per row -> the other columns, request columns and ``reject`` (null if the request is good).

    Sets ``spark.sql.variant.allowDuplicateKeys`` for the session: a key repeated deep inside a document is no error.
    Other columns must not be named like request columns.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    kept = [c for c in lines.columns if c != value]
    document = _whole_signs(F.col(value))
    nothing = document.rlike(r"^[ \t\r\n]*null[ \t\r\n]*$")  # a null document is a request of zero values
    read = _once(lines, kept, entries_=_entries(document), raw_=_entries(document, "string"), nothing_=nothing)
    members = F.col("entries_")
    context = _named(members, "context")
    cut = F.coalesce(F.array_max(F.transform(context, lambda v, i: F.when(_void(v), i + 1).otherwise(0))), F.lit(0))
    given = F.filter(_named(F.col("raw_"), "context"), lambda v, i: i >= cut)
    named = {n: _named(members, n) for n in TEXT_FIELDS}
    wrong = ~F.forall(context, lambda v: _is(v, "OBJECT"))
    for n in TEXT_FIELDS:
        wrong = wrong | ~F.forall(named[n], lambda v: _is(v, "STRING"))
    read = _once(
        read, kept, ok_=members.isNotNull() | F.coalesce("nothing_", F.lit(False)), wrong_=F.coalesce(wrong, F.lit(False)),
        inside_=F.flatten(F.transform(given, lambda t: F.coalesce(_entries(t), F.array().cast("array<struct<key:string,value:variant>>")))),
        **{f"{n}_": _texts(named[n]) for n in TEXT_FIELDS},
    )
    inside = F.col("inside_")
    tools, trust = _named(inside, "tool_capabilities"), _named(inside, "trust_level")
    lists = F.transform(tools, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")))
    odd = ~F.forall(tools, lambda v: _is(v, "ARRAY")) | ~F.forall(trust, lambda v: _is(v, "STRING"))
    odd = odd | F.exists(F.flatten(lists), lambda t: ~_is(t, "STRING"))
    last = F.coalesce(F.try_element_at(lists, F.lit(-1)), F.array().cast("array<variant>"))
    names = F.transform(last, lambda t: F.coalesce(F.try_variant_get(t, "$", "string"), F.lit("")))
    fields = [f"{n}_" for n in TEXT_FIELDS]
    read = _once(
        read, [*kept, *fields], bad_=~F.col("ok_") | F.col("wrong_") | F.coalesce(odd, F.lit(False)),
        tools_=F.coalesce(names, F.array().cast("array<string>")), trust_=F.coalesce(_texts(trust), F.lit("")),
    )
    good = ~F.col("bad_")
    return read.select(
        *kept,
        *[F.when(good, F.coalesce(F.col(f"{n}_"), F.lit(""))).alias(n) for n in TEXT_FIELDS],
        F.when(good, F.col("tools_")).alias("tool_capabilities"),
        F.when(good, F.col("trust_")).alias("trust_level"),
        F.when(~good, INVALID).when(F.coalesce(F.col("content_"), F.lit("")) == "", EMPTY).alias("reject"),
    )


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Request documents, one a line, of all files under ``path``, decoded, with ``file`` and ``reject``; with ``stream`` as they arrive.

    Files are the offsets of a stream: each is read once, also after a restart from the checkpoint. Rejects stay beside the requests
    (:func:`accepted`, :func:`rejected`). With the file as position, :func:`with_defaults` gives ids that a replay gives again, and equal
    documents of one file the same id.
    """
    lines = spark.readStream.text(path) if stream else spark.read.text(path)
    return decode(lines.select("value", F.col("_metadata.file_name").alias("file")))


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where("reject is null").drop("reject")


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.where("reject is not null")


def with_defaults(requests: DataFrame, position: list[str] | None = None) -> DataFrame:
    """Event ids where there is none, strict profile, no tools.

    An id is a hash of tenant, session, content, the time ``ts`` if there is one, and the columns in ``position``, which tell
    where a request comes from (file and row, topic and offset): a replay gives the same ids, and requests that
    differ in any of these have ids of their own.
    """
    parts = ["tenant_id", "session_id", "content", *(["ts"] if "ts" in requests.columns else []), *(position or [])]
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]
    made = F.concat(F.lit(EVENT_PREFIX), F.substring(F.sha2(F.concat_ws("\x1f", *texts), 256), 1, 16))
    return requests.withColumns(
        {
            "event_id": F.coalesce(F.nullif(F.col("event_id"), F.lit("")), made),
            "policy_profile": F.coalesce(F.nullif(F.col("policy_profile"), F.lit("")), F.lit(DEFAULT_PROFILE)),
            "tool_capabilities": F.coalesce(F.col("tool_capabilities"), F.array().cast("array<string>")),
        }
    )


def health(spark) -> DataFrame:
    return spark.createDataFrame([("ok", "riskloom", "1.0.0")], "status string, service string, version string")


def responses(decided: DataFrame) -> DataFrame:
    """Response documents, one JSON text per row, empty optional fields left out; ``<``, ``>``, ``&`` and the two Unicode line
    ends are written as escapes, so a document may stand in a web page."""
    from ..operators.audit import TIME_FORMAT
    from ..operators.detect import or_ok

    fields = decided.select(
        "event_id", F.nullif("tenant_id", F.lit("")).alias("tenant_id"), F.nullif("session_id", F.lit("")).alias("session_id"),
        "policy_profile", "risk_level", "risk_score", or_ok(F.col("findings")).alias("findings"),
        F.nullif("safe_rewrite", F.lit("")).alias("safe_rewrite"), F.date_format("ts", TIME_FORMAT).alias("timestamp"),
        F.nullif("reasoning", F.lit("")).alias("reasoning"),
        F.when(F.size("decision_factors") > 0, F.col("decision_factors")).alias("decision_factors"),
    )
    body = F.to_json(F.struct(*fields.columns))
    for sign in UNSAFE:  # they occur inside texts only
        body = F.replace(body, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return fields.select("event_id", body.alias("value"))


def access_log(decided: DataFrame) -> DataFrame:
    """One line per request: level, id, score and number of findings."""
    line = F.format_string("[%s] %s | score=%d | findings=%d", "risk_level", "event_id", "risk_score", F.size("findings"))
    return decided.select("event_id", line.alias("line"))
