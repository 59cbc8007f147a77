"""Embedding whitening by hierarchical SVD merging.

Every partition sums its vectors up as a *summary*: their number, their exact sums, and all singular values and right
vectors of the block centred on its own mean. Two summaries merge without loss: their scaled vectors are stacked, one row
``sqrt(na * nb / (na + nb)) * (mean_a - mean_b)`` corrects for the two means, and the stack is decomposed again. No
dimension is ever cut, so the last summary has the covariance of all vectors, centred before anything is multiplied.
Summaries meet in groups, level upon level, each a shuffle of rows of d x d numbers whatever the number of vectors; the driver gets the
last one only.

Vectors are put on a grid first, ``x = floor(64 * c) + 1000000``, so their sums and each row's squared deviation are exact;
every distinct grid vector counts once in the fit. The whitened vectors' covariance is measured by the same summaries and compared
with the identity.

Defined cases: vectors that are null, empty, of a length other than the commonest, or hold null or non-finite
components take no part; rows with a null id do, like any other, and repeated rows come out each; directions without spread (a singular value
under 1e-9 of the largest) are no components, so a table of one distinct vector has no result, and neither has an empty one; equal
eigenvalues are numbered as the decomposition gives them, alike for all rows; components whose grid value, or deviations whose exact value, don't fit
a long raise an error instead of a wrong number; columns other than the id and the vector, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Summaries merged at a time: 16, fewer where vectors are so long that 16 of them would pass this many bytes.
FAN, FAN_BYTES = 16, 256 << 20
NO_SPREAD = 1e-9
STATE = "part long, n long, sums string, sigma binary, axes binary"


@dataclass
class Summary:
    """``n`` vectors: their sums (Python numbers, exact for integers), singular values and right singular vectors."""

    n: int
    sums: list
    sigma: np.ndarray
    axes: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        near = x - x[0]  # integers stay exact and small
        total = near.sum(0)
        sums = [a.item() + len(x) * b.item() for a, b in zip(total, x[0], strict=True)]
        _, sigma, axes = np.linalg.svd(near - total / len(x), full_matrices=False)
        return cls(len(x), sums, sigma, axes)

    def merge(self, other: Summary) -> Summary:
        a, b = self.n, other.n
        apart = np.array([(s * b - t * a) / (a * b) for s, t in zip(self.sums, other.sums, strict=True)])
        correction = np.sqrt(a / (a + b) * b) * apart
        stack = np.vstack([self.sigma[:, None] * self.axes, other.sigma[:, None] * other.axes, correction])
        _, sigma, axes = np.linalg.svd(stack, full_matrices=False)
        return Summary(a + b, [s + t for s, t in zip(self.sums, other.sums, strict=True)], sigma, axes)

    @property
    def covariance(self) -> np.ndarray:
        return (self.axes.T * (self.sigma**2 / self.n)) @ self.axes

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": json.dumps(self.sums), "sigma": self.sigma.tobytes(), "axes": self.axes.tobytes()}

    @classmethod
    def read(cls, r) -> Summary:
        sigma = np.frombuffer(r["sigma"])
        return cls(int(r["n"]), json.loads(r["sums"]), sigma, np.frombuffer(r["axes"]).reshape(len(sigma), -1))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summary(vectors: DataFrame, dims: int) -> Summary | None:
    """The summary of a table of one array column of ``dims`` numbers each; None without rows."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        now = None
        for batch in batches:
            if batch.num_rows:
                new = Summary.of(matrix(batch.column(0)))
                now = new if now is None else now.merge(new)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row(TaskContext.get().partitionId())], pa.schema(
                [("part", pa.int64()), ("n", pa.int64()), ("sums", pa.string()), ("sigma", pa.binary()), ("axes", pa.binary())]
            ))

    def merged(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        now = None
        for r in rows.to_dict("records"):
            new = Summary.read(r)
            now = new if now is None else now.merge(new)
        return pd.DataFrame([now.row(int(key[0]))])

    fan = max(2, min(FAN, FAN_BYTES // (8 * dims * dims)))
    states = materialize(vectors.mapInArrow(local, STATE), "summaries")
    parts = (states.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        level = states.groupBy(F.expr(f"part div {fan}").alias("group")).applyInPandas(merged, STATE)
        after = materialize(level, "summaries")
        discard(states)
        states, parts = after, -(-parts // fan)
    last = states.collect()  # one row of dims x dims numbers
    return Summary.read(last[0]) if last else None


def on_grid(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id, x`` of the vectors that take part, and their length."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where((F.size("v") > 0) & finite)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims = common[0]["d"] if common else 1
    x = F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long"))
    return rows.where(F.size("v") == dims).select("vec_id", x.alias("x")), dims


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component."""
    spark = df.sparkSession
    rows, dims = on_grid(df, id_col, vector_col)
    fit = materialize(rows.select("x").distinct(), "fit")
    whole = summary(fit, dims)
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spread = whole.sigma > max(NO_SPREAD * whole.sigma[0], 0.0) if whole else np.zeros(0, bool)
    k = min(components, int(spread.sum()))
    if whole is None or not k:
        discard(fit)
        return spark.createDataFrame([], schema)
    n, sums = whole.n, whole.sums
    weights = (whole.axes[:k] / (whole.sigma[:k, None] / np.sqrt(n))).T
    explained = (whole.sigma**2 / (whole.sigma**2).sum())[:k]
    model = spark.sparkContext.broadcast((n, sums, weights))  # dims x components numbers

    def deviations(x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: 64-bit where that holds every number, else Python's integers."""
        n, sums, _ = model.value
        most = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums))
        return n * x - np.array(sums, np.int64) if most < 2**62 else n * x.astype(object) - np.array(sums, object)

    def projected(dev: np.ndarray) -> np.ndarray:
        n, _, weights = model.value
        return (dev / n).astype(float) @ weights

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array(list(projected(deviations(matrix(batch.column(0))))), pa.list_(pa.float64()))], ["w"])

    check = summary(fit.mapInArrow(fitted, "w array<double>"), k)
    discard(fit)
    error = float(np.abs(check.covariance - np.eye(k)).max())

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                dev = deviations(matrix(part.column("x")))
                exact = dev.astype(object) if dev.dtype != object and int(np.abs(dev).max()) ** 2 * dev.shape[1] >= 2**63 else dev
                m = len(dev)
                yield pa.record_batch(
                    [
                        part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)), pa.array(np.repeat((exact * exact).sum(1), k), pa.int64()), pa.array(projected(dev).ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(every, schema)
