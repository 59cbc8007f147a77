"""Chat formatting with Spark expressions only.

A conversation is collected as turn structs, sorted, cut into runs of one role, and concatenated::

    <s>[role]text[+]text</s><s>[role]text</s>

``<s>[role]`` opens a run, ``[+]`` stands between two turns of the same role, ``</s>`` closes it.
Inside texts and roles the characters that start a control string are written as entities, so no
control string can be forged and :func:`read_back` restores every turn exactly.

Defined cases: rows are ordered by (turn, role, text), nulls first; repeated rows are turns of their
own; null text or role is the empty string; a null ``conv_id`` is one conversation; other columns
are ignored; an empty table gives an empty result. A conversation is one row, so its formatted
length is bounded by Spark's 2 GB value limit: a longer one, as all rows without a ``conv_id`` may be, fails the job. Leave such
rows out, or give them ids of their own, where there are as many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, PART, CLOSE = "<s>[", "]", "[+]", "</s>"
LOSS_ROLE = "assistant"
#: The order matters, ``&`` is escaped first and restored last.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;")]


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_chat(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` -> ``conv_id, formatted, loss_mask``.

    ``loss_mask`` is run-length coded: structs (chars, loss) that tile ``formatted`` in code points;
    a run has ``loss`` set exactly when it is the (escaped) text of an assistant turn.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    grouped = grouped.withColumn("starts", starts)
    runs = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("turns", s)["role"].alias("role"),
            F.transform(
                F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s),
                lambda t: escape(t["text"]),
            ).alias("parts"),
        ),
    )
    grouped = grouped.select("conv_id", runs.alias("runs"))

    def head(run: Column) -> Column:
        return F.concat(F.lit(OPEN), escape(run["role"]), F.lit(ROLE_END))

    def span(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))

    def mask(run: Column) -> Column:
        parts = F.transform(
            run["parts"],
            lambda p, i: F.array(
                span(F.char_length(p), run["role"] == LOSS_ROLE),
                span(F.when(i == F.size(run["parts"]) - 1, len(CLOSE)).otherwise(len(PART)), F.lit(False)),
            ),
        )
        return F.concat(F.array(span(F.char_length(head(run)), F.lit(False))), F.flatten(parts))

    return grouped.select(
        "conv_id",
        F.array_join(
            F.transform("runs", lambda r: F.concat(head(r), F.array_join(r["parts"], PART), F.lit(CLOSE))), ""
        ).alias("formatted"),
        F.flatten(F.transform("runs", mask)).alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of structs (role, text), as they went in."""
    blocks = F.split(formatted, CLOSE, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        cut = F.instr(block, ROLE_END)
        role = unescape(F.substr(block, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1))
        return F.transform(
            F.split(F.substr(block, cut + 1), r"\[\+\]", -1),
            lambda p: F.struct(role.alias("role"), unescape(p).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


BLOCK = 256


def under_mask(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped: the runs marked so, cut from the formatted text by running sums.

    A cut costs as much as what lies before it, so the text is cut into blocks of runs first.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(mask) - 1) / BLOCK).cast("int")), lambda b: F.slice(mask, b * BLOCK + 1, F.lit(BLOCK)))
    sized = F.transform(blocks, lambda b: F.struct(F.aggregate(b, F.lit(0), lambda n, run: n + run["chars"]).alias("chars"), b.alias("runs")))
    none = F.array().cast("array<struct<at:int,chars:int,runs:array<struct<chars:int,loss:boolean>>>>")
    placed = F.aggregate(
        sized,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, b: F.struct(
            (acc["at"] + b["chars"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), b["chars"].alias("chars"), b["runs"].alias("runs")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )

    def cut(text: Column, runs: Column) -> Column:
        return F.aggregate(
            runs,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda acc, run: F.struct(
                (acc["at"] + run["chars"]).alias("at"),
                F.when(run["loss"], F.concat(acc["out"], F.substr(text, acc["at"] + 1, run["chars"]))).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: unescape(acc["out"]),
        )

    # Every piece stands in a one-element array, which binds it to a name, so that it is cut once.
    pieces = F.transform(placed, lambda b: F.get(F.transform(F.array(F.substr(formatted, b["at"] + 1, b["chars"])), lambda t: cut(t, b["runs"])), 0))
    return F.array_join(pieces, "")


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, what reading back gives: turns from the formatted text, the loss from what its mask covers."""
    back = formatted.withColumn("turns", read_back(F.col("formatted")))
    back = back.withColumn("loss_text", under_mask(F.col("formatted"), F.col("loss_mask")))
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
