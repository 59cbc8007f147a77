"""SimHash near-dedup by meet-in-the-middle ball hashing.

A document's fingerprint takes, bit by bit, the majority of the XXH64 hashes of its word shingles.
Two fingerprints link at ``radius`` or fewer differing bits; classes are the connected components.

The radius is met in the middle: of the two halves of two linked fingerprints at least one differs
in at most ``radius // 2`` bits. So every distinct fingerprint emits, for each half, all variants of
that half within half the radius, and the rows shuffle on (half, variant). A fingerprint is *home*
in the bucket of its unchanged half and a *guest* in the others; linked fingerprints meet where one
of them is at home. (Whole 64-bit variants would take radius two on one side: 2081 rows a
fingerprint against 66 here, with the same links.)

No bucket emits its pairs. A bucket is a matrix of homes against members, cut into tiles of bounded
size; a tile XORs and counts bits in blocks, and returns only the edges of a spanning forest of the
links it verified, fewer than its members. Large buckets become many tiles on many tasks, so no group
lands in one task whole and none is capped. Copies collapse before anything else happens.

Defined cases: null text is empty text; no words gives fingerprint 0, linked like any other; rows with
one ``doc_id`` but different texts are nodes of one document; repeated rows are one node; a null ``doc_id`` is an id like any other,
and never the least of a class; a text is hashed whole, in bounded steps; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard_all, join_hot, literal_array, materialize, scratch, text_slices
from .components import components

SEED, WORDS, RADIUS = 42, 3, 3
STEP, TILE = 1 << 16, 4096


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes; see the module for what a word and a shingle are."""
    parts = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        shingles: Iterator[bytes] = iter([b" ".join(parts)])
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    n, ones = 0, np.zeros(64, np.int64)
    while True:
        hashes = np.fromiter((digest(s, seed) for s in islice(shingles, STEP)), np.uint64)
        if not len(hashes):
            break
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        if len(hashes) < STEP:
            break
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, fp`` (the 64 bits as a signed long)."""
    from pyspark.sql.types import LongType, StructType

    schema = StructType([docs.schema["doc_id"]]).add("fp", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                raw = part.column("text").cast(pa.large_binary()).to_pylist()
                fps = np.array([fingerprint(x) for x in raw], np.uint64).view(np.int64)
                yield pa.record_batch([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _emit(fps: DataFrame, radius: int) -> DataFrame:
    """``fp`` -> ``half, variant, home, fp``: each half as it is, and all its variants within half the radius."""
    flips = [0]
    for bits in range(1, radius // 2 + 1):
        flips += [sum(1 << b for b in pick) for pick in combinations(range(32), bits)]
    masks = literal_array(flips, "long")
    low = 0xFFFFFFFF
    halves = F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(low)))
    at = fps.select("fp", F.posexplode(halves).alias("half", "own"))
    return at.select("half", F.explode(masks).alias("flip"), "own", "fp").select(
        "half", F.col("own").bitwiseXOR(F.col("flip")).alias("variant"), (F.col("flip") == 0).alias("home"), "fp"
    )


def forest(homes: np.ndarray, members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between ``homes`` and ``members`` (uint64, distinct each)."""
    nodes = np.unique(np.concatenate([homes, members]))
    at_home, at_member = np.searchsorted(nodes, homes), np.searchsorted(nodes, members)
    label = np.arange(len(nodes))
    out = []
    block = max(1, (1 << 20) // max(1, len(members)))
    for start in range(0, len(homes), block):
        near = np.bitwise_count(homes[start : start + block, None] ^ members[None, :]) <= radius
        for k in np.flatnonzero(near.any(1)):
            me = at_home[start + k]
            labels, first = np.unique(label[at_member[near[k]]], return_index=True)
            others = labels != label[me]
            if others.any():
                found = at_member[near[k]][first[others]]
                out += [(int(nodes[me]), int(nodes[x])) for x in found]
                label[np.isin(label, labels)] = label[me]
    return out


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (``a, b``) between distinct fingerprints whose components are those of all links."""
    emitted = _emit(fps, radius)
    homes = emitted.where("home").groupBy("half", "variant").count().withColumnRenamed("count", "homes")
    # Spark's size estimates don't see that each row became 66: without the hint it may broadcast them.
    met = materialize(emitted.join(homes.hint("merge"), ["half", "variant"]), "balls")
    sizes = met.groupBy("half", "variant").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = met.join(sizes, ["half", "variant"]).withColumns(
        {"rows": F.ceil(F.col("homes") / tile).cast("int"), "cols": F.ceil(F.col("n") / tile).cast("int")}
    )
    mark = F.xxhash64("fp")
    as_row = sized.where("home").select(
        "half", "variant", F.pmod(mark, "rows").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(True).alias("row"), "fp",
    )
    as_col = sized.select(
        "half", "variant", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"),
        F.pmod(mark, "cols").cast("int").alias("j"), F.lit(False).alias("row"), "fp",
    )
    keys = ["half", "variant", "i", "j"]
    tiles = as_row.union(as_col).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(group: pd.DataFrame) -> list[tuple[int, int]]:
            fp, row = group["fp"].to_numpy().view(np.uint64), group["row"].to_numpy()
            return forest(fp[row], fp[~row], radius)

        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch])
            k = batch[keys].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            edges = []
            for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
                if b - a > 2:  # a home alone meets itself
                    edges += solve(batch.iloc[a:b])
            rest = batch.iloc[cuts[-1] :] if len(cuts) else batch
            yield _edge_frame(edges)
        if rest is not None:
            yield _edge_frame(solve(rest))

    return tiles.mapInPandas(run, "a long, b long")


def _edge_frame(edges: list[tuple[int, int]]) -> pd.DataFrame:
    ends = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})


def simhash_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per document row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (least ``doc_id`` reachable)."""
    with scratch() as made:
        fps = materialize(fingerprints(docs), "fingerprints")
        # Copies collapse, with a combine before the shuffle; a class is then a set of fingerprints.
        distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
        roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
        rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
        named = join_hot(rooted, least, ["root"], "members", F.xxhash64("fp")).select("fp", "component_id", "n")
        named = materialize(named, "named")
        discard_all(made, fps, named)
    # A fingerprint that a third of all rows share is dealt into parts.
    return join_hot(fps, named, ["fp"], "n", F.xxhash64("doc_id", F.monotonically_increasing_id())).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
