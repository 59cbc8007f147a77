"""The audit log: HMAC-SHA256 signatures, hash chains and their verification.

A signature covers the entry's fields and the signature before it. A chain is sequential by nature, so chains are
kept per chain key (tenant and day, say): rows are dealt by key, sorted, and each task streams through
its chains with one signature in memory. An empty key list is the single chain over everything.

Verification needs no order of work: every row is signed anew and compared, and must follow its predecessor. A chain of any
length is checked in ranges of ``RANGE_ROWS`` entries, each by itself; only its first entry is compared with the last signature
of the range before, which crosses over as one row a range.

A chain that is cut off at its end still verifies. So a closed chain gets a *seal*: the root of a Merkle tree over its
signatures (``FAN`` children a node, leaves and nodes hashed apart), the number of its entries, and an HMAC of both. The inner nodes, a
sixteenth of the entries, say which entries differ when the root does, and give proofs of inclusion that need no other entry.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

# The signed fields in order, and what joins them.
FIELDS = ("event_id", "tenant_id", "session_id", "timestamp", "risk_level", "risk_score", "finding_count", "policy_profile", "prev_signature")
JOINT = "|"
#: Entries checked as one range, children of a node, and what tells leaves from nodes.
RANGE_ROWS, FAN, LEAF, NODE = 100_000, 16, "\x00", "\x01"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def hmac_sha256(secret: str, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of the message's UTF-8, from ``sha2``; the padded keys are literals."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def entries(decided: DataFrame) -> DataFrame:
    """Unsigned entries of decided requests, with ``ts`` for the order."""
    return decided.select(
        "event_id",
        F.coalesce("tenant_id", F.lit("")).alias("tenant_id"),
        F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.date_format("ts", TIME_FORMAT).alias("timestamp"),
        "risk_level",
        "risk_score",
        F.col("finding_count") if "finding_count" in decided.columns else F.size("findings").alias("finding_count"),
        "policy_profile",
        "ts",
    )


def payload(prev: Column) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS[:-1]]
    return F.concat_ws(JOINT, *parts, prev)


def sign_alone(rows: DataFrame, secret: str) -> DataFrame:
    """Each entry as the first of a chain of its own."""
    return rows.withColumns({"prev_signature": F.lit(""), "signature": hmac_sha256(secret, payload(F.lit("")))})


def chain(rows: DataFrame, secret: str, keys: list[str] | None = None, heads: DataFrame | None = None) -> DataFrame:
    """Adds ``seq, prev_signature, signature``; the order inside a chain is (ts, event_id).

    ``heads`` (``keys, seq0, prev0``) are chains that go on: entries they have, and the last one's signature.
    """
    keys = keys or []
    names = rows.columns
    # One task signs a single chain; an exchange, so that what comes before isn't done in that task as well.
    spread = rows.repartition(*keys) if keys else rows.repartition(1)
    if heads is None:
        spread = spread.withColumns({"seq0": F.lit(0).cast("long"), "prev0": F.lit("")})
    elif not keys:
        head = heads.first()
        spread = spread.withColumns({"seq0": F.lit(head["seq0"] if head else 0).cast("long"), "prev0": F.lit(head["prev0"] if head else "")})
    else:
        begun = heads.select(*[F.col(k).alias(f"_{k}") for k in keys], "seq0", "prev0")
        spread = spread.join(begun, _same(keys), "left").drop(*[f"_{k}" for k in keys])
        spread = spread.withColumns({"seq0": F.coalesce("seq0", F.lit(0)).cast("long"), "prev0": F.coalesce("prev0", F.lit(""))})
    ordered = spread.sortWithinPartitions(*keys, "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, prev, seq = None, "", 0
        key = secret.encode()
        for batch in batches:
            before, signatures, numbers = [], [], []
            chains = list(map(tuple, batch[keys].astype(object).where(batch[keys].notna(), None).to_numpy())) if keys else [()] * len(batch)
            for c, seq0, prev0, row in zip(chains, batch["seq0"], batch["prev0"], zip(*(batch[f] for f in FIELDS[:-1]), strict=True), strict=True):
                if c != last:
                    last, prev, seq = c, prev0, seq0
                text = JOINT.join([*("" if pd.isna(x) else str(x) for x in row), prev])
                before.append(prev)
                prev = hmac.new(key, text.encode(), "sha256").hexdigest()
                signatures.append(prev)
                numbers.append(seq)
                seq += 1
            yield batch[names].assign(seq=numbers, prev_signature=before, signature=signatures)

    out = StructType([rows.schema[n] for n in names]).add("seq", "long").add("prev_signature", "string").add("signature", "string")
    return ordered.mapInPandas(run, out)


def _range(rows: int) -> Column:
    return F.floor(F.col("seq") / rows).alias("_range")


def verify(chained: DataFrame, secret: str, keys: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``valid``: the signature fits the row, and the row follows its predecessor in the chain."""
    keys = keys or []
    rows = chained.select("*", _range(range_rows))
    tails = rows.groupBy(*keys, "_range").agg(F.max_by("signature", "seq").alias("_tail"))
    tails = tails.select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("_range") + 1).alias("_next"), "_tail")
    same = F.col("_range") == F.col("_next")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    order = Window.partitionBy(*keys, "_range").orderBy("seq")
    before = F.coalesce(F.lag("signature").over(order), F.when(F.row_number().over(order) == 1, F.col("_tail")), F.lit(""))
    fits = F.col("signature") == hmac_sha256(secret, payload(F.col("prev_signature")))
    valid = F.coalesce(fits & (F.col("prev_signature") == before), F.lit(False))
    return rows.join(tails, same, "left").select(*chained.columns, valid.alias("valid"))


# -- seals ---------------------------------------------------------------------------------------------


def _hash(mark: str, text: Column) -> Column:
    return F.sha2(F.encode(F.concat(F.lit(mark), text), "UTF-8"), 256)


def leaves(log: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, level, node, digest``: an entry's place in its chain and the hash of its signature."""
    return log.select(*keys, F.lit(0).alias("level"), F.col("seq").cast("long").alias("node"), _hash(LEAF, F.col("signature")).alias("digest"))


def merkle(log: DataFrame, keys: list[str] | None = None, fan: int = FAN) -> DataFrame:
    """``keys, level, node, digest, top``: the inner nodes of each chain's tree; ``top`` marks its root, at the first level of one node.

    A node hashes the digests of its children in order; each level shuffles a ``fan``-th of the one below. A chain of one entry
    has a root of one child. Repeated entries are children of a node each.
    """
    if not keys:
        return merkle(log.withColumn("_all", F.lit(0)), ["_all"], fan).drop("_all")
    longest = log.agg(F.max("seq")).first()[0]
    level, out = leaves(log, keys), None
    # What a chain has is told by its own last place, not by the longest chain's.
    ends = log.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("seq").cast("long").alias("last"))
    k = 0
    while k == 0 or fan**k <= (longest or 0):
        k += 1
        grouped = level.groupBy(*keys, F.expr(f"node div {fan}").alias("node"))
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: c["digest"]), "")  # at most fan, but for repeated entries
        if k == 1:
            made = grouped.agg(_hash(NODE, children).alias("digest")).join(ends, _same(keys)).drop(*[f"_{k}" for k in keys])
        else:
            made = grouped.agg(_hash(NODE, children).alias("digest"), F.first("last").alias("last"))
        size = fan**k
        made = made.select(*keys, F.lit(k).alias("level"), "node", "digest", "last", (F.col("last") < size).alias("top"))
        out = made if out is None else out.unionByName(made)
        level = made.where("not top").drop("top")
    return out.drop("last")


def _same(keys: list[str], left: str = "", right: str = "_") -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}"))
    return condition


def _sealed(keys: list[str], secret: str) -> Column:
    named = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return hmac_sha256(secret, F.concat_ws(JOINT, *named, F.col("entries").cast("string"), "root"))


def seal(log: DataFrame, secret: str, keys: list[str] | None = None, fan: int = FAN, nodes: DataFrame | None = None) -> DataFrame:
    """``keys, entries, root, seal``: one row a chain. ``nodes`` is the log's tree, if there is one already (with keys)."""
    if not keys:
        return _seal(log.withColumn("_all", F.lit(0)), secret, ["_all"], [], fan).drop("_all")
    return _seal(log, secret, keys, keys, fan, nodes)


def _seal(log: DataFrame, secret: str, keys: list[str], named: list[str], fan: int, nodes: DataFrame | None = None) -> DataFrame:
    roots = (merkle(log, keys, fan) if nodes is None else nodes).where("top").select(*keys, F.col("digest").alias("root"))
    counted = log.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("entries"))
    both = roots.join(counted, _same(keys)).withColumn("seal", _sealed(named, secret))
    return both.select(*keys, "entries", "root", "seal")


def check_seals(log: DataFrame, seals: DataFrame, secret: str, keys: list[str] | None = None, fan: int = FAN) -> DataFrame:
    """``keys, status, entries, found``: how each chain's log compares with its seal.

    ``whole``; ``forged`` (the seal itself isn't ours); ``missing`` (no entry left); ``unsealed`` (no seal); ``shorter``,
    ``longer`` or ``changed`` (as many entries, not the same).
    """
    keys = keys or []
    now = seal(log, secret, keys, fan).select(*keys, F.col("entries").alias("found"), F.col("root").alias("now"))
    then = seals.withColumn("ours", F.col("seal") == _sealed(keys, secret)).withColumnsRenamed({k: f"_{k}" for k in keys})
    both = now.join(then, _same(keys), "full")
    status = (
        F.when(F.col("root").isNull(), "unsealed").when(~F.col("ours"), "forged").when(F.col("now").isNull(), "missing")
        .when(F.col("now") == F.col("root"), "whole").when(F.col("found") < F.col("entries"), "shorter").when(F.col("found") > F.col("entries"), "longer").otherwise("changed")
    )
    named = [F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in keys]
    return both.select(*named, status.alias("status"), F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("found", F.lit(0)).alias("found"))


def locate(log: DataFrame, nodes: DataFrame, keys: list[str] | None = None, fan: int = FAN) -> DataFrame:
    """``keys, first, last``: ranges of ``fan`` places in which the log differs from what the stored tree's lowest nodes say."""
    keys = keys or []
    then = nodes.where("level = 1").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("node").alias("_node"), F.col("digest").alias("_digest"))
    now = merkle(log, keys, fan).where("level = 1").select(*keys, "node", "digest")
    both = now.join(then, _same(keys) & (F.col("node") == F.col("_node")), "full")
    node = F.coalesce("node", "_node")
    named = [F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in keys]
    differs = ~F.col("digest").eqNullSafe(F.col("_digest"))
    return both.where(differs).select(*named, (node * fan).alias("first"), (node * fan + fan - 1).alias("last"))


def proofs(wanted: DataFrame, log: DataFrame, nodes: DataFrame, keys: list[str] | None = None, fan: int = FAN) -> DataFrame:
    """``wanted`` (``keys, seq`` and more) with ``proof``: for each level the digests beside the entry's own, and where that stands among them.

    A proof is ``fan`` digests a level, far more than its entry. So proofs never shuffle: entries and leaves are dealt once by chain and
    block of ``fan``^2 places, what lies above a block is one row, and an entry's proof is put together from its block's row.
    """
    if not keys:
        named = [df.withColumn("_all", F.lit(0)) for df in (wanted, log, nodes)]
        return proofs(*named, ["_all"], fan).drop("_all")
    height = nodes.agg(F.max("level")).first()[0] or 1
    chain_of = F.struct(*keys).alias("_chain")  # structs are equal where their nulls are
    child, digests = F.struct("node", "digest"), lambda c: F.transform(c, lambda d: d["digest"])
    inner = nodes.where("not top").select(chain_of, "level", "node", "digest")

    def families(k: int) -> DataFrame:
        mine = inner.where(F.col("level") == k)
        return mine.groupBy("_chain", F.expr(f"node div {fan}").alias("_up")).agg(F.array_sort(F.collect_list(child)).alias("_c"))

    def under(rows: DataFrame, above: DataFrame | None) -> DataFrame:
        """Adds ``_above``, the steps over a family's parent; none for the root."""
        if above is None:
            return rows.withColumn("_above", F.array().cast("array<struct<_level:int,place:bigint,digests:array<string>>>"))
        parents = above.select(F.col("_chain").alias("_pc"), F.col("node").alias("_pn"), F.col("_steps").alias("_above"))
        return rows.join(parents, (F.col("_chain") == F.col("_pc")) & (F.col("_up") == F.col("_pn")), "left").drop("_pc", "_pn")

    above = None
    for k in range(height - 1, 1, -1):
        each = under(families(k), above).select("*", F.posexplode("_c").alias("_at", "_n"))
        step = F.struct(F.lit(k).alias("_level"), (F.col("_at") + 1).cast("long").alias("place"), digests("_c").alias("digests"))
        above = each.select("_chain", "_n.node", F.concat(F.array(step), F.coalesce("_above", F.array())).alias("_steps"))
    over = under(families(1), above).select(F.col("_chain").alias("_oc"), F.col("_up").alias("_ob"), F.col("_c").alias("_first"), "_above")

    block = (F.expr(f"seq div {fan * fan}")).alias("_block")
    leaf = log.select(chain_of, block, F.col("seq").cast("long").alias("node"), _hash(LEAF, F.col("signature")).alias("digest"))
    rows = leaf.repartition("_chain", "_block").groupBy("_chain", "_block", F.expr(f"node div {fan}").alias("up")).agg(F.array_sort(F.collect_list(child)).alias("c"))
    rows = rows.groupBy("_chain", "_block").agg(F.collect_list(F.struct("up", "c")).alias("_leaves"))  # fan families at most
    rows = rows.join(over, (F.col("_chain") == F.col("_oc")) & (F.col("_block") == F.col("_ob")), "full")
    rows = rows.select(F.coalesce("_chain", "_oc").alias("_bc"), F.coalesce("_block", "_ob").alias("_bb"), "_leaves", "_first", "_above")

    def step_at(k: int, family: Column) -> Column:
        place = F.array_position(F.transform(family, lambda d: d["node"]), F.expr(f"seq div {fan**k}"))
        return F.when(family.isNotNull(), F.struct(F.lit(k).alias("_level"), place.alias("place"), digests(family).alias("digests")))

    met = wanted.withColumns({"_wc": F.struct(*keys), "_wb": F.expr(f"seq div {fan * fan}")}).join(rows, (F.col("_wc") == F.col("_bc")) & (F.col("_wb") == F.col("_bb")))
    own = F.get(F.filter("_leaves", lambda f: f["up"] == F.expr(f"seq div {fan}")), 0)["c"]
    met = met.where(own.isNotNull() | F.col("_first").isNotNull()).withColumn("_own", own)
    below = F.filter(F.array(step_at(0, F.col("_own")), step_at(1, F.col("_first"))), lambda s: s.isNotNull())
    return met.select(*wanted.columns, F.concat(below, F.coalesce("_above", F.array())).alias("proof"))


def proven(signature: Column, proof: Column, root: Column) -> Column:
    """Whether a proof leads from an entry's signature to the root."""
    start = F.struct(_hash(LEAF, signature).alias("digest"), F.lit(True).alias("ok"))

    def step(acc: Column, s: Column) -> Column:
        ok = acc["ok"] & F.coalesce(F.get(s["digests"], (s["place"] - 1).cast("int")) == acc["digest"], F.lit(False))
        return F.struct(_hash(NODE, F.array_join(s["digests"], "")).alias("digest"), ok.alias("ok"))

    end = F.aggregate(proof, start, step)
    return F.coalesce(end["ok"] & (end["digest"] == root), F.lit(False))
