"""Whitening against numpy's eigenvectors of the whole covariance, and summaries against one decomposition."""

import math

import numpy as np
import pytest

from riskloom.llm import whitening
from riskloom.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, components=whitening.COMPONENTS):
    """Exact sums by Python's integers, eigenvectors of the covariance of the distinct vectors."""
    grid = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({x for _, x in grid})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], float) / n
    cov = centred.T @ centred / n
    e, vectors = np.linalg.eigh(cov)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(components, int((e > e[0] * 1e-15).sum()))
    out = []
    for i, x in grid:
        dev = [n * c - s for c, s in zip(x, sums, strict=True)]
        out.append((i, n, sum(d * d for d in dev), (np.array(dev) / n) @ vectors[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()))
    return out


def held(got, want):
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    k = len(want[0][3])
    signs = None
    for i, n, deviation, whitened, explained in want:
        mine = sorted(by[i], key=lambda r: r["component"])[:k]
        assert [r["component"] for r in mine] == list(range(1, k + 1))
        assert {(r["n"], r["deviation"]) for r in mine} == {(n, deviation)}
        assert np.allclose([r["explained"] for r in mine], explained, rtol=1e-6)
        found = np.array([r["whitened"] for r in mine])
        if signs is None:
            signs = np.sign(found * whitened)
        assert np.allclose(found * signs, whitened, atol=1e-6)
    assert all(r["identity_error"] < 1e-6 for r in got)


def test_equals_the_eigenvectors_of_all_rows(spark):
    rng = np.random.default_rng(131)
    x = rng.normal(size=(400, 24)) * np.linspace(0.2, 3, 24) + rng.normal(size=24)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[3][1]) for i in range(500)]  # a hot vector counts once in the fit
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(37)).collect()
    assert len(got) == 900 * 16
    held(got, brute(rows))


def test_the_query_over_its_whole_table(spark, small, duck):
    got = QUERIES["op13_embedding_whitening"](spark, small).collect()
    held(got, brute(duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()))


def test_merged_summaries_lose_nothing():
    rng = np.random.default_rng(132)
    x = rng.integers(-1000, 1000, size=(300, 9)) + 1_000_000
    cuts = [0, 1, 3, 50, 51, 200, 300]
    parts = [whitening.Summary.of(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    left = parts[0]
    for p in parts[1:]:
        left = left.merge(p)
    tree = parts[0].merge(parts[1]).merge(parts[2].merge(parts[3]).merge(parts[4].merge(parts[5])))
    for s in (left, tree):
        assert s.n == 300 and s.sums == x.sum(0).tolist() and len(s.sigma) == 9
        assert np.allclose(s.covariance, np.cov(x.T, bias=True), rtol=1e-9, atol=1e-6)
    assert whitening.Summary.read(left.row(0)).sums == left.sums


def test_levels_of_merging(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(133)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(60, 4)))]
    held(whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(9)).collect(), brute(rows))


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, [0.5, 0.25]), (3, None), (4, []), (5, [1.0]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [None, 1.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], VECTORS + ", component int")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r["n"] for r in got} == {3} and abs(sum(r["explained"] for r in got if r["vec_id"] == 2) - 1) < 1e-12
    assert whitening.whiten(df.where("vec_id = 1")).collect() == []  # one distinct vector has no direction
    assert whitening.whiten(df.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(20)], VECTORS)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}  # the others have no spread


def test_deviations_beyond_64_bits_raise(spark):
    rows = [(i, [float(i) * 2.0**40]) for i in range(5)]
    with pytest.raises(Exception, match="(?i)overflow|too large|out of bounds|int too big"):
        whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
