"""Embedding whitening against a full eigendecomposition."""

import math

import numpy as np
import pytest

from brigade.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(rows, k=4):
    """{vec_id: (n, deviation, k coordinates)}, shares, eigenvalues of rows (id, vector) of one length."""
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    n, s = len(fit), [int(v) for v in fit.sum(axis=0)]
    c = fit - fit.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    out = {i: (n, sum((n * a - b) ** 2 for a, b in zip(x, s)), (np.array(x) - np.array(s) / n) @ u[:, :k] / np.sqrt(e[:k])) for i, x in good}
    return out, e[:k] / e.sum(), e


def same(got, want, shares):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(want)
    k = len(shares)
    signs = None
    for i, (n, deviation, z) in want.items():
        rows = by[i]
        assert sorted(rows) == list(range(1, k + 1)) and {r.n for r in rows.values()} == {n} and {r.deviation for r in rows.values()} == {deviation}
        mine = np.array([rows[j].whitened for j in range(1, k + 1)])
        if signs is None and np.abs(z).min() > 1e-3:
            signs = np.sign(mine) * np.sign(z)
        if signs is not None:
            np.testing.assert_allclose(mine * signs, z, rtol=1e-8, atol=1e-8)
        np.testing.assert_allclose([rows[j].explained for j in range(1, k + 1)], shares, rtol=1e-9)
    assert signs is not None and 0 <= max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_query_against_all_eigenvectors(spark):
    want, shares, _ = plain([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])
    same(whitening.query(spark, SF).collect(), want, shares)


def test_edge_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a third and more are copies
    rows += [(2000, None), (2001, [1.0, None, 0, 0, 0, 0]), (2002, [math.nan] * 6), (2003, [math.inf, 0, 0, 0, 0, 0]), (2004, [-0.0] * 6)]
    want, shares, _ = plain(rows)
    kind = "vec_id long, embedding array<float>, x string, d int, n int"
    t = spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], "x", 1, None) for i, v in rows], kind)
    t = t.selectExpr("vec_id", "transform(embedding, e -> cast(e as double)) embedding", "x", "d", "n")
    rows = [(r.vec_id, r.embedding) for r in t.collect()]
    want, shares, _ = plain(rows)
    same(whitening.whiten(t, block=2).collect(), want, shares)
    # a second space of two entries, one of empty vectors, one of one distinct vector; repeated and null keys
    more = [(3000 + i, [float(i % 7), float(i * i % 5)]) for i in range(20)] + [(3000, [0.0, 0.0]), (None, [1.0, 2.0]), (5000, []), (5001, [1.0] * 3), (5002, [1.0] * 3)]
    both = t.select("vec_id", "embedding").unionByName(spark.createDataFrame(more, "vec_id long, embedding array<double>"))
    got = whitening.whiten(both).collect()
    assert not {r.vec_id for r in got} & {5000, 5001, 5002, 2000, 2001, 2002, 2003}
    small = [r for r in got if r.vec_id is None or 3000 <= r.vec_id < 4000]
    assert {r.component for r in small} == {1, 2} and {r.n for r in small} == {len({tuple(v) for i, v in more[:22]})} and len(small) == 2 * 22
    assert sum(r.vec_id == 3000 for r in small) == 4
    assert whitening.whiten(t.limit(0)).count() == 0
    assert whitening.whiten(t.where("vec_id = 1000")).count() == 0


def test_large_entries(spark):
    """Deviations beyond a long are exact inside and held to its range outside."""
    rows = [(i, [float(10 ** (7 + i % 3)) * (i + 1), float(i), 1e30 * (i == 5)]) for i in range(8)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = {i: [max(-(2**63), min(2**63 - 1, math.floor(256 * c))) for c in v] for i, v in rows}
    s = [sum(v[j] for v in x.values()) for j in range(3)]
    for r in got:
        assert r.deviation == min(2**63 - 1, sum((8 * a - b) ** 2 for a, b in zip(x[r.vec_id], s)))
    assert len(got) and max(r.identity_error for r in got) < 1e-4


@pytest.mark.parametrize("d, block, most", [(1, 16, 512), (5, 2, 512), (60, 3, 512), (200, 4, 24), (90, 16, 512)])
def test_lanczos(d, block, most):
    rng = np.random.default_rng(d)
    for kind in range(4):
        u, _ = np.linalg.qr(rng.normal(size=(d, d)))
        e = np.sort(rng.uniform(0, 5, d))[::-1]
        if kind == 1:
            e[min(d, 3) :] = 0  # breakdown after few passes
        if kind == 2:
            e[: min(d, 9)] = 5.0  # more equal ones than a block holds
        if kind == 3:
            e = 2.0 ** -np.arange(d)
        v = (u * e) @ u.T
        v = (v + v.T) / 2
        values, vectors = whitening.block_lanczos(lambda q: v @ q, d, 4, block=block, most=most)
        np.testing.assert_allclose(values, np.sort(e)[::-1][:4], rtol=1e-10, atol=1e-12)
        np.testing.assert_allclose(v @ vectors, vectors * values, atol=1e-11)
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)


def test_lanczos_takes_few_passes():
    """Residuals end the search long before the basis is the whole space."""
    rng = np.random.default_rng(0)
    u, _ = np.linalg.qr(rng.normal(size=(600, 600)))
    e = 1.0 / (1 + np.arange(600.0)) ** 2
    v, calls = (u * e) @ u.T, []
    whitening.block_lanczos(lambda q: calls.append(q.shape[1]) or v @ q, 600, 4)
    assert sum(calls) < 200
