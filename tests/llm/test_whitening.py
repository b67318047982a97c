"""Whitening against exact integers and a symmetric eigen-solver."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import whitening as wh
from quire.llm.bidiagonal import bidiagonalise, dqds, right_singular
from quire.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<float>, x long, whitened string, `a.b` int"


def kept(rows):
    good = [(i, v) for i, v, *_ in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in good]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    return [(i, [math.floor(64 * float(np.float32(c))) + 10 ** 6 for c in v]) for i, v in good if len(v) == d]


def check(rows, out, components=32):
    rows = kept(rows)
    n, x = len(rows), np.array([v for _, v in rows], dtype=object)
    sums = x.sum(axis=0)
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    got = {}
    for r in out:
        got.setdefault((r.vec_id, r.deviation), []).append(r)
    assert len(out) == n * k and {r.component for r in out} == set(range(1, k + 1))
    assert {r.n for r in out} == {n} and len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9
    share = {r.component: r.explained for r in out}
    for c in share:
        assert share[c] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
    order = sorted(out, key=lambda r: (str(r.vec_id), r.deviation, r.component))
    own = {(str(i), d): i for (i, _), d in zip(rows, deviation)}
    assert {(str(r.vec_id), r.deviation) for r in order} == set(own)
    at = {(str(i), d): row for (i, _), d, row in zip(rows, deviation, y)}
    gaps = np.abs(np.diff(np.concatenate([values, [0]]))) / values[0]
    for c in range(k):   # a lone component is the solver's up to its sign
        if gaps[c] > 1e-6 and (c == 0 or gaps[c - 1] > 1e-6):
            pairs = [(r.whitened, at[str(r.vec_id), r.deviation] @ vectors[:, c] / math.sqrt(values[c]))
                     for r in order if r.component == c + 1]
            sign = np.sign(sum(a * b for a, b in pairs))
            assert max(abs(a - sign * b) for a, b in pairs) < 1e-6


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) * 2.0 ** -rng.integers(0, 6, d) + 3
    return [(i, v.astype(np.float32).tolist(), 0, "x", 1) for i, v in enumerate(base)]


@pytest.mark.parametrize("n,d", [(300, 12), (90, 40), (10, 16), (2, 3)])
def test_whitening_equals_eigen_solver(spark, n, d):
    rows = vectors(n, n, d)
    check(rows, wh.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())


def test_factors_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(wh, "_FAN_CELLS", 1)
    rows = vectors(5, 120, 6)
    check(rows, wh.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7), components=4).collect(), 4)


def test_whitening_edges(spark):
    rows = vectors(9, 40, 5)
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [nan] * 5), (103, [inf] * 5), (104, [-inf, 0.0, 0.0, 0.0, 0.0]),
           (105, [1.0, 2.0]), (106, []), (None, [0.5, 0.25, 1.0, -3.0, 9.0])]
    rows += [(*r, 0, "x", 1) for r in odd] + [rows[3], rows[3], (3, rows[4][1], 0, "x", 1)]
    check(rows, wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect())
    same = [(i, [1.0, 2.0], 0, "x", 1) for i in range(9)]
    for none in (rows[:0], rows[:1], same, [(1, [], 0, "x", 1)] * 3, [(1, None, 0, "x", 1)]):
        out = wh.whiten(spark.createDataFrame(none, SCHEMA))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.count() == 0


def test_large_entries(spark):
    rows = [(i, [float(2 ** 40 + i), 1e30 if i == 7 else 1.0], 0, "x", 1) for i in range(9)]
    out = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x long, w string, b int"))
    assert {r.vec_id for r in out.collect()} == set(range(9)) - {7}
    x = np.array([[10 ** 12, 5], [-10 ** 12, 7]])
    assert wh._deviations(x, 10 ** 9, np.array([3, 9], dtype=object)) == [None, None]
    small = wh._deviations(x, 2, x.sum(axis=0).astype(object))
    assert small == [None, None] and wh._deviations(x[:, 1:], 2, np.array([12], dtype=object)) == [4, 4]


def test_solver_on_hard_matrices():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    wilkinson = np.diag(np.abs(np.arange(21) - 10.0) + 30) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    hard = [np.zeros((4, 4)), np.eye(9), rng.standard_normal((1, 1)), np.linalg.cholesky(wilkinson).T,
            np.diag([3.0, 0, 2, 0, 1]), np.diag(1 + 1e-13 * np.arange(30)) @ q,
            (q * np.repeat([5.0, 3.0, 1e-3], 10)) @ q.T, rng.standard_normal((20, 4)) @ rng.standard_normal((4, 20)),
            np.diag(10.0 ** -np.arange(14)) @ rng.standard_normal((14, 14))]
    for r in hard:
        values, z = right_singular(r)
        s = np.linalg.svd(r, compute_uv=False)
        assert len(values) == (s > len(r) * 2.3e-16 * s[0]).sum() if s[0] else not len(values)
        s = s[:len(values)]
        assert np.allclose(np.sqrt(values), s, rtol=1e-12, atol=0)
        assert np.abs(z.T @ z - np.eye(len(values))).max(initial=0) < 1e-11
        assert np.abs(r.T @ (r @ z) - z * values).max(initial=0) <= 1e-13 * max(s.max(initial=0) ** 2, 1e-300)
    a, b, w = bidiagonalise(hard[-1])
    assert np.allclose(np.sort(dqds(a, b)), np.sort(np.linalg.svd(hard[-1], compute_uv=False) ** 2), rtol=1e-11)
    assert (a >= 0).all() and (b >= 0).all() and np.allclose(w.T @ w, np.eye(14))


def test_query_equals_eigen_solver(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    random.Random(0).shuffle(rows)
    check(rows, op13_whitening(spark, sf).collect())
