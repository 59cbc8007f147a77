"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions.

Every shard owns ``vnodes`` points of a 64-bit ring; a key belongs to the first point clockwise of
its hash. Shards have quotas (row counts that differ by at most one); what finds its shard full
continues clockwise to the next point whose shard has room. So counts are exactly balanced, and all
keys but the overflow stay where plain consistent hashing puts them.

Only one small thing reaches the driver: a row count per arc, ``shards * vnodes`` numbers whatever
the input. From these the overflow is resolved arc by arc into segments (arc, first rank, shard,
first slot), and the rows find theirs by their rank inside the arc. Rows shuffle once, without text.

The ring key is a hash of ``doc_id`` and text, so rows that share a (null, say) ``doc_id`` still spread.

Defined cases: a null text has size 16 and CRC 0; a null ``doc_id`` is like any other; fully repeated
rows share an arc and take consecutive ranks; a text of any length is measured whole in its row and goes no further than that; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import literal_array

OVERHEAD_BYTES = 16


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted (point, shard); points are signed 64-bit. A shard's points don't depend on the others."""
    points = [
        (int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s)
        for s in range(shards)
        for v in range(vnodes)
    ]
    return sorted(points)


def place_arcs(owners: list[int], counts: list[int], shards: int) -> list[tuple[int, int, int, int]]:
    """Bounded loads: (arc, first rank, shard, first slot) segments for arcs with ``counts`` rows.

    Home shards fill first, in ring order; the overflow of each arc then goes clockwise. A pointer
    per arc skips full points, so the walk is linear in points and overflowing arcs.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out: list[tuple[int, int, int, int]] = []
    over: list[tuple[int, int]] = []
    for arc, n in enumerate(counts):
        s = owners[arc]
        took = min(n, room[s] - used[s])
        if took:
            out.append((arc, 0, s, used[s]))
            used[s] += took
        if took < n:
            over.append((arc, took))
    n_arcs = len(owners)
    after = list(range(1, n_arcs + 1))  # next point that may have room; n_arcs: the turn of the ring

    def free(i: int) -> int:
        """First point at or after ``i`` whose shard has room, halving paths on the way."""
        seen = []
        while i < n_arcs and used[owners[i]] >= room[owners[i]]:
            seen.append(i)
            i = after[i]
        for j in seen:
            after[j] = i
        return i

    for arc, rank in over:
        at = arc
        while rank < counts[arc]:
            at = free(at)
            if at == n_arcs:
                at = free(0)
            s = owners[at]
            took = min(counts[arc] - rank, room[s] - used[s])
            out.append((arc, rank, s, used[s]))
            used[s] += took
            rank += took
    return out


def shard_documents(docs: DataFrame, shards: int = 40, vnodes: int = 128) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, size, text_crc32, shard, slot`` with row counts at most one apart."""
    spark = docs.sparkSession
    points = ring_points(shards, vnodes)
    owners = [s for _, s in points]
    edges = [p for p, _ in points]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + OVERHEAD_BYTES).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("key"),
    )
    # The arc of a key: a lookup in equal slices of the hash space gives the number of points
    # before the slice, the few points inside it are compared one by one.
    bits = 12
    starts = [-(1 << 63) + (i << (64 - bits)) for i in range(1 << bits)]
    before = [bisect.bisect_left(edges, s) for s in starts] + [len(edges)]
    slices = literal_array(before, "int")
    edge = literal_array(edges, "long")
    part = (F.shiftright("key", 64 - bits) + (1 << (bits - 1))).cast("int")
    arc = F.get(slices, part) + F.size(
        F.filter(F.slice(edge, F.get(slices, part) + 1, F.get(slices, part + 1) - F.get(slices, part)), lambda e: e < F.col("key"))
    )
    rows = rows.withColumn("arc", (arc % len(points)).cast("int"))
    counts = [0] * len(points)
    for r in rows.groupBy("arc").count().collect():  # at most shards * vnodes rows
        counts[r["arc"]] = r["count"]
    segments: dict[int, list[tuple[int, int, int]]] = {}
    for a, rank, s, slot in place_arcs(owners, counts, shards):
        segments.setdefault(a, []).append((rank, s, slot))
    plan = spark.createDataFrame(
        [(a, sorted(x)) for a, x in segments.items()],
        "arc int, segments array<struct<rank:long, shard:int, slot:long>>",
    )
    ranked = rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy("arc").orderBy("key", "doc_id", "text_crc32", "size")).cast("long") - 1
    )
    # The plan has a row per arc: its size is fixed by shards and vnodes, not by the data.
    placed = ranked.join(F.broadcast(plan), "arc").withColumn(
        "segment", F.element_at(F.filter("segments", lambda x: x["rank"] <= F.col("rank")), -1)
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("segment.shard").alias("shard"),
        (F.col("segment.slot") + F.col("rank") - F.col("segment.rank")).alias("slot"),
    )
