"""Whitening against a dense eigensolver and exact integers."""
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import feast_whitening as W
from tapeworks.llm import queries


def fixed(v):
    return tuple(math.floor(64.0 * float(c)) + 1_000_000 for c in v)


def against_dense(rows, vectors, k=16):
    """rows of the query against numpy on the distinct fixed-point vectors."""
    good = [(i, fixed(v)) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in good})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    y = np.array([[float(Fraction(x[j]) - Fraction(sums[j], n)) for j in range(d)] for x in fit])
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, d, int((e > 1e-12 * e[0]).sum()))
    want = {x: (sum((n * x[j] - sums[j]) ** 2 for j in range(d)), (r @ u / np.sqrt(np.maximum(e, 1e-300)))) for x, r in zip(fit, y)}
    of = {}
    for i, x in good:
        of.setdefault(i, []).append(x)
    assert Counter((r.vec_id, r.component) for r in rows) == Counter((i, c) for i, _ in good for c in range(1, k + 1))
    signs = {}
    for r in rows:
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10
        if len(of[r.vec_id]) == 1:
            deviation, z = want[of[r.vec_id][0]]
            assert r.deviation == deviation
            z = z[r.component - 1]
            if abs(z) > 1e-3:
                assert signs.setdefault(r.component, np.sign(z * r.whitened)) == np.sign(z * r.whitened)
            assert abs(abs(z) - abs(r.whitened)) < 1e-7, (r, z)
    return k


def test_query_against_dense_solver(spark, sf):
    rows = queries.QUERIES["op13_feast_whitening"](spark, sf).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert against_dense(rows, vectors) == 16


def test_hard_vectors(spark):
    rng = np.random.default_rng(6)
    vectors = [(k, rng.normal(0, 3, 5).tolist()) for k in range(60)]
    vectors += [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [1.0, float("nan"), 2.0, 3.0, 4.0]), (104, [float("inf")] * 5),
                (None, vectors[0][1]), (7, vectors[7][1]), (7, vectors[7][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("dim", "x", "n", "i", "component", "whitened")})
    rows = W.components_of(W.whiten(df)).collect()
    known = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in vectors]
    assert against_dense(rows, known) == 5
    assert W.components_of(W.whiten(df.where("vec_id > 1000"))).collect() == []
    assert W.components_of(W.whiten(df.where("vec_id = 7"))).collect() == []  # one distinct vector has no variance
    mixed = df.where("vec_id < 60 or vec_id is null").unionByName(
        spark.createDataFrame([(200, [1.0, 2.0]), (201, [3.0, 1.0]), (202, [1e300, 0.0])], "vec_id long, embedding array<double>").select("vec_id", "embedding"), allowMissingColumns=True)
    by_len = {}
    for r in W.components_of(W.whiten(mixed)).collect():
        by_len.setdefault(r.n, set()).add(r.vec_id)
    assert by_len[3] == {200, 201, 202} and len(by_len) == 2


@pytest.mark.parametrize("kind", ["spread", "equal", "cluster", "low rank", "line"])
def test_components_none_missed(spark, kind):
    rng = np.random.default_rng(8)
    d = 48
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = {"spread": np.linspace(1, 2, d), "equal": np.full(d, 3.0), "cluster": np.r_[np.full(9, 5.0), 5.0 - 1e-7, np.linspace(1, 2, d - 10)],
         "low rank": np.r_[np.arange(1.0, 8), np.zeros(d - 7)], "line": np.r_[4.0, np.zeros(d - 1)]}[kind]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, x = W.upper_components(spark, v, 16)
    want = np.sort(e)[::-1][:16]
    want = want[want > 0]
    assert len(values) == len(want) and np.abs(values - want).max() < 1e-12 * want[0]
    assert np.abs(x.T @ x - np.eye(len(want))).max() < 1e-13 and np.abs(v @ x - x * values).max() < 1e-12 * want[0]
    count = W.Inertia(v)
    assert [count.at_least(s) for s in (-1.0, 2.5, 100.0)] == [d, int((e >= 2.5).sum()), 0]
