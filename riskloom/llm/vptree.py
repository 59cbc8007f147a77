"""Approximate nearest neighbours with vantage-point trees per shard.

Nearest means largest inner product. Adding one coordinate, the square root of M^2 - |x|^2 for data (M the
largest norm) and 0 for queries, makes it the nearest in Euclidean distance, so the triangle inequality
prunes: a ball is skipped when ``factor * (lower bound) > (distance of the k-th found)``. Factor one is
exact search; larger factors skip more.

A vantage-point tree fitted on a bounded sample routes every vector to a leaf, the shard; leaves with more
than ``shard_rows`` vectors are dealt into several shards by hash, so a third of the table in one point is
still many shards. Every vector is indexed. Each query searches its own leaf first; the distance to its
k-th find then prunes whole leaves (each leaf knows its least and largest distance from each vantage point
on its path), and the survivors are searched, each shard by a tree of its own, queries in blocks.

Only the sample, the router and one count and a few bounds per leaf are on the driver, all of fixed size. A stored row
carries its vector, its leaf and the distances on its own path, about as many as the tree is deep.

Defined cases: vectors that are null, empty, zero, of a length other than the commonest, or hold null or
non-finite components take no part, as query or candidate; ties go to the smaller id; an id with
several vectors counts once, with its best; fully repeated rows are one; a query's candidates leave out
its own id; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

K, SAMPLE, SHARD_ROWS, QUERY_BLOCK, BUCKET, FACTOR = 20, 16_384, 8_192, 2_048, 512, 1.0
EPS = 1e-7


def lifted(x: np.ndarray, radius: float) -> np.ndarray:
    """Data with the coordinate that makes all norms ``radius``."""
    return np.hstack([x, np.sqrt(np.maximum(radius**2 - (x * x).sum(1), 0))[:, None]])


def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(((q - v) ** 2).sum(1))


@dataclass
class Node:
    vantage: np.ndarray | None = None
    radius: float = 0.0
    inside: Node | None = None
    outside: Node | None = None
    #: Distances of the members from ``vantage``: least and largest, inside and outside.
    spans: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    rows: np.ndarray | None = None
    leaf: int = -1


def build(x: np.ndarray, rows: np.ndarray, bucket: int, rng: np.random.Generator) -> Node:
    """A vantage-point tree over ``x[rows]``; the vantage point of most spread among a few candidates."""
    if len(rows) <= bucket:
        return Node(rows=rows)
    picks = x[rng.choice(rows, min(8, len(rows)), replace=False)]
    probe = x[rng.choice(rows, min(256, len(rows)), replace=False)]
    v = picks[int(np.argmax([distances(probe, p).var() for p in picks]))]
    d = distances(x[rows], v)
    order = np.argsort(d, kind="stable")
    half = len(rows) // 2
    near, far = order[:half], order[half:]
    if d[order[0]] == d[order[-1]]:
        return Node(rows=rows)  # no vantage point tells them apart by this one
    return Node(
        vantage=v, radius=float(d[far[0]]), spans=(d[near].min(), d[near].max(), d[far].min(), d[far].max()),
        inside=build(x, rows[near], bucket, rng), outside=build(x, rows[far], bucket, rng),
    )


class Search:
    """k best of a shard for a block of queries; all queries at a node are handled at once."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, radius: float, k: int, factor: float, reach: np.ndarray):
        self.v, self.ids, self.q, self.own, self.k, self.factor = vectors, ids, queries, own, k, factor
        self.radius = radius
        self.x = lifted(vectors, radius)
        self.q0 = np.hstack([queries, np.zeros((len(queries), 1))])
        self.q2 = (queries * queries).sum(1) + radius**2
        n = len(queries)
        self.score, self.found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.reach = reach.copy()
        self.seen = 0
        root = build(self.x, np.arange(len(vectors)), BUCKET, np.random.default_rng(len(vectors)))
        self.visit(root, np.arange(n))

    def visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.rows is not None:
            step = max(1, (1 << 21) // max(1, len(who)))
            for s in range(0, len(node.rows), step):
                self.scan(node.rows[s : s + step], who)
            return
        d = distances(self.q0[who], node.vantage)
        first = d < node.radius
        for mask, near, far, near_span, far_span in (
            (first, node.inside, node.outside, node.spans[:2], node.spans[2:]),
            (~first, node.outside, node.inside, node.spans[2:], node.spans[:2]),
        ):
            self.visit(near, self.kept(who[mask], d[mask], near_span))
            self.visit(far, self.kept(who[mask], d[mask], far_span))

    def kept(self, who: np.ndarray, d: np.ndarray, span: tuple[float, float]) -> np.ndarray:
        bound = np.maximum(np.maximum(span[0] - d, d - span[1]), 0)
        return who[self.factor * bound <= self.reach[who] + EPS]

    def scan(self, rows: np.ndarray, who: np.ndarray) -> None:
        """Fast products screen; whatever could enter a query's k best is scored exactly and merged."""
        rough = self.q[who] @ self.v[rows].T
        self.seen += rough.size
        least = self.score[who, -1]
        rough[self.own[who][:, None] == self.ids[rows][None, :]] = -np.inf
        by_id = np.argsort(self.ids[rows], kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(self.ids[rows][by_id]) != 0])
        if len(rows) > self.k and (empty := np.isneginf(least)).any():
            least = least.copy()
            per_id = rough[empty]
            if len(heads) < len(rows):  # an id with several vectors counts once, with its best
                per_id = np.maximum.reduceat(per_id[:, by_id], heads, axis=1)
            cut = per_id.shape[1] - self.k
            least[empty] = np.partition(per_id, cut, axis=1)[:, cut] if cut > 0 else -np.inf
        slack = EPS * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        qi, vi = np.nonzero((rough >= (least - slack)[:, None]) & ~np.isneginf(rough))
        if not len(qi):
            return
        score, a, b = np.zeros(len(qi)), self.q[who[qi]], self.v[rows[vi]]
        for j in range(a.shape[1]):
            score += a[:, j] * b[:, j]
        touched, slot = np.unique(qi, return_inverse=True)
        mine = who[touched]
        slot = np.concatenate([slot, np.repeat(np.arange(len(mine)), self.k)])
        score = np.concatenate([score, self.score[mine].ravel()])
        found = np.concatenate([self.ids[rows[vi]], self.found[mine].ravel()])
        order = np.lexsort((found, -score, slot))
        slot, score, found = slot[order], score[order], found[order]
        again = np.zeros(len(slot), bool)  # one id with several vectors counts with its best
        pair = np.lexsort((np.arange(len(slot)), found, slot))
        again[pair[1:]] = (slot[pair[1:]] == slot[pair[:-1]]) & (found[pair[1:]] == found[pair[:-1]]) & np.isfinite(score[pair[1:]])
        slot, score, found = slot[~again], score[~again], found[~again]
        rank = np.arange(len(slot)) - np.searchsorted(slot, np.arange(len(mine)))[slot]
        keep = rank < self.k
        self.score[mine[slot[keep]], rank[keep]], self.found[mine[slot[keep]], rank[keep]] = score[keep], found[keep]
        last = self.score[mine, -1]
        full = np.sqrt(np.maximum(self.q2[mine] - 2 * np.where(np.isfinite(last), last, 0), 0))
        self.reach[mine] = np.minimum(self.reach[mine], np.where(np.isfinite(last), full, np.inf))


class Router:
    """The tree over the sample; its leaves are the shards' names."""

    def __init__(self, sample: np.ndarray, radius: float, leaves: int):
        self.radius = radius
        x = lifted(sample, radius)
        self.root = build(x, np.arange(len(x)), max(1, -(-len(x) // max(1, leaves))), np.random.default_rng(7))
        self.vantage: list[np.ndarray] = []
        self.paths: list[list[tuple[int, bool]]] = []
        self._name(self.root, [])

    def _name(self, node: Node, path: list[tuple[int, bool]]) -> None:
        if node.rows is not None:
            node.leaf, node.rows = len(self.paths), node.rows[:0]
            self.paths.append(path)
            return
        k = len(self.vantage)
        self.vantage.append(node.vantage)
        self._name(node.inside, [*path, (k, True)])
        self._name(node.outside, [*path, (k, False)])

    def table(self, x: np.ndarray) -> np.ndarray:
        """Distances from every vantage point, one column each."""
        return np.stack([distances(x, v) for v in self.vantage], 1) if self.vantage else np.zeros((len(x), 0))

    def routed(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The leaf of each row, and its distances from the vantage points on the way there, root first."""
        out, way = np.zeros(len(x), np.int32), [np.zeros(0)] * len(x)

        def down(node: Node, who: np.ndarray, passed: np.ndarray) -> None:
            if node.rows is not None:
                out[who] = node.leaf
                for i, d in zip(who, passed, strict=True):
                    way[i] = d
                return
            d = distances(x[who], node.vantage)
            inside, passed = d < node.radius, np.hstack([passed, d[:, None]])
            down(node.inside, who[inside], passed[inside])
            down(node.outside, who[~inside], passed[~inside])

        down(self.root, np.arange(len(x)), np.zeros((len(x), 0)))
        return out, way

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        return self.routed(x)[0]


def clean_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id long, v array<double>``: rows that take part, fully repeated ones once."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(
        ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    )
    return rows.distinct()


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.array(rows, float).reshape(len(rows), -1)


def nearest(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K, factor: float = FACTOR,
    sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Queries: ids divisible by ``every``. Result: ``query_id long, rank int, vec_id long, score double``."""
    spark = df.sparkSession
    rows = materialize(clean_vectors(df, id_col, vector_col), "vectors")
    dims = [r["d"] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()]
    rows = rows.where(F.size("v") == (dims[0] if dims else 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("r")).first()
    n, radius = whole["n"], float(whole["r"] or 1.0) * (1 + 1e-12)
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()  # bounded by ``sample``
    points = _matrix([r["v"] for r in picked]) if picked else np.zeros((1, 1))
    router = Router(points, radius, min(len(points) // 8 or 1, -(-n // shard_rows) or 1))
    sent = spark.sparkContext.broadcast(router)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        for b in batches:
            if b.num_rows:
                leaf, way = r.routed(lifted(_matrix(b.column("v")), r.radius))
                yield pa.record_batch([b.column("id"), b.column("v"), pa.array(leaf), pa.array(way, pa.list_(pa.float64()))], ["id", "v", "leaf", "d"])

    placed = materialize(rows.mapInArrow(assign, "id long, v array<double>, leaf int, d array<double>"), "placed")
    depth = max((len(p) for p in router.paths), default=0)
    # One row per leaf: its count, and the reach of its members from each vantage point on its path.
    found = placed.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(F.get("d", F.lit(i))).alias(f"lo{i}") for i in range(depth)],
        *[F.max(F.get("d", F.lit(i))).alias(f"hi{i}") for i in range(depth)],
    )
    info = {
        r["leaf"]: (-(-r["n"] // shard_rows), [(k_, r[f"lo{i}"], r[f"hi{i}"]) for i, (k_, _) in enumerate(router.paths[r["leaf"]])])
        for r in found.collect()
    }
    leaves = spark.sparkContext.broadcast(info)
    parts = F.from_json(F.lit(str([info.get(i, (1,))[0] for i in range(len(router.paths))])), "array<int>")
    part = F.pmod(F.xxhash64("id", "v"), F.get(parts, F.col("leaf"))).cast("int")
    data = placed.select("leaf", part.alias("part"), "id", "v")
    queries = rows.where(F.col("id") % every == 0)

    def routes(reached: bool):
        """Query rows to (leaf, part, block): the own leaf, or every other leaf the reach can't exclude."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                q = _matrix(b.column("v"))
                x = np.hstack([q, np.zeros((len(q), 1))])
                own, table = r.leaf_of(x), r.table(x)
                reach = b.column("reach").to_numpy(zero_copy_only=False)
                block = b.column("block").to_numpy(zero_copy_only=False)
                for leaf, (n_parts, spans) in leaves.value.items():
                    if reached:
                        bound = np.zeros(len(q))
                        for k_, lo, hi in spans:
                            bound = np.maximum(bound, np.maximum(lo - table[:, k_], table[:, k_] - hi))
                        go = np.flatnonzero((own != leaf) & (factor * bound <= reach + EPS))
                    else:
                        go = np.flatnonzero(own == leaf)
                    # A batch a shard, of no more rows than came in: however many shards survive, one is in memory.
                    for p in range(n_parts if len(go) else 0):
                        picked_ = b.take(pa.array(go))
                        yield pa.record_batch(
                            [pa.array(np.full(len(go), leaf, np.int32)), pa.array(np.full(len(go), p, np.int32)), pa.array(block[go]), *(picked_.column(c) for c in ("id", "v", "reach"))],
                            ["leaf", "part", "block", "id", "v", "reach"],
                        )

        return run

    def search(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        mine = mine.sort_values("id", kind="stable")
        ids = theirs["id"].to_numpy()
        s = Search(_matrix(mine["v"]), mine["id"].to_numpy(), _matrix(theirs["v"]), ids, radius, k, factor, theirs["reach"].to_numpy(float))
        ok = np.isfinite(s.score)
        q = np.broadcast_to(ids[:, None], s.found.shape)
        return pd.DataFrame({"query_id": q[ok], "vec_id": s.found[ok], "score": s.score[ok]})

    blocks = max(1, -(-(n // every) // query_block))
    # By id and vector: an id may have any number of vectors, and they are queries of their own until their finds meet.
    block = F.pmod(F.xxhash64(F.lit(5), "id", "v"), F.lit(blocks)).cast("int").alias("block")
    routed = "leaf int, part int, block int, id long, v array<double>, reach double"

    def searched(q: DataFrame, reached: bool) -> DataFrame:
        asked = q.mapInArrow(routes(reached), routed)
        # A shard goes to each query block that asks for it: the query set against all rows, in blocks.
        wanted = asked.select("leaf", "part", "block").distinct()
        shards = data.join(wanted, ["leaf", "part"]).toDF("s_leaf", "s_part", "id", "v", "s_block")
        return shards.groupBy("s_leaf", "s_part", "s_block").cogroup(asked.groupBy("leaf", "part", "block")).applyInPandas(search, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    home = materialize(searched(queries.select("id", "v", F.lit(float("inf")).alias("reach"), block), False), "home")
    # Once home is searched, the k-th find bounds the reach; fewer than k finds bound nothing.
    per_id = home.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id is a find once, in however many parts
    kth = per_id.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    reach = F.when(
        F.col("kth").isNotNull(), F.sqrt(F.greatest(F.aggregate("v", F.lit(radius**2), lambda a, c: a + c * c) - 2 * F.col("kth"), F.lit(0.0)))
    ).otherwise(float("inf"))
    away = searched(queries.join(kth, "id", "left").select("id", "v", reach.alias("reach"), block), True)
    both = home.union(away).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
