"""Singular values and right singular vectors of a small square matrix:
Householder bidiagonalisation, the differential quotient-difference algorithm
with shifts (dqds) for the values, twisted factorisations for the vectors.

After Fernando and Parlett, "Accurate singular values and differential qd
algorithms", and Dhillon and Parlett, "Orthogonal eigenvectors and relative gaps".
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
_CLUSTER = 1e-3   # values nearer than this, relatively, get orthogonalised vectors


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w): B = U'RW is upper bidiagonal with diagonal a and superdiagonal
    b (both made non-negative), W orthogonal."""
    m = np.array(r, dtype=np.float64)
    d = len(m)
    w = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """v with (I - 2vv')x along the first axis; none if x is there already."""
        rest = np.linalg.norm(x[1:])
        if rest == 0.0:
            return None
        v = x.copy()
        v[0] += np.copysign(np.hypot(x[0], rest), x[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(m[k:, k])
        if v is not None:
            m[k:, k:] -= 2.0 * np.outer(v, v @ m[k:, k:])
        if k < d - 2:
            v = reflector(m[k, k + 1:])
            if v is not None:
                m[k:, k + 1:] -= 2.0 * np.outer(m[k:, k + 1:] @ v, v)
                w[:, k + 1:] -= 2.0 * np.outer(w[:, k + 1:] @ v, v)
    a, b = np.diag(m).copy(), np.diag(m, 1).copy()
    # signs move into U (rows) and W (columns)
    sign = 1.0
    for k in range(d):
        if k:
            sign = -1.0 if b[k - 1] < 0 else 1.0
            w[:, k] *= sign
            a[k] *= sign
            b[k - 1] = abs(b[k - 1])
        if a[k] < 0:   # flip row k of B
            a[k] = -a[k]
            if k < d - 1:
                b[k] = -b[k]
    return a, b, w


def _sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One dqds transform of a block; none if the shift was above the smallest
    value. Also the smallest pivot, a bound of the smallest value from above."""
    n = len(q)
    qn, en = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        if d < 0.0:
            return None
        top = d + e[i]
        qn[i] = top
        if top == 0.0:
            en[i], d = 0.0, q[i + 1] - shift
        else:
            ratio = q[i + 1] / top
            en[i] = e[i] * ratio
            d = d * ratio - shift
        least = min(least, d)
    if d < 0.0:
        return None
    qn[n - 1] = d
    return qn, en, least


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal (a, b), falling."""
    found: list[float] = []
    blocks = [(a * a, b * b, 0.0)]
    while blocks:
        q, e, base = blocks.pop()
        share, bound = 0.75, None
        while len(q):
            n = len(q)
            if n == 1:
                found.append(base + q[0])
                break
            # what a dropped e changes is at most the off-diagonal entry of the tridiagonal form
            near = np.minimum(q[:-1], q[1:]) + base
            small = np.flatnonzero(np.sqrt(e) * np.sqrt(np.maximum(q[:-1], q[1:])) <= 0.25 * EPS * near)
            if len(small):
                cut = int(small[-1]) + 1
                blocks.append((q[:cut].copy(), e[:cut - 1].copy(), base))
                q, e, bound = q[cut:].copy(), e[cut:].copy(), None
                continue
            # the last 2 by 2 block of BB' and the last pivot bound the smallest value from above
            p, c, t = q[-2] + e[-1], q[-1], e[-1] * q[-1]
            low = 2.0 * (p * c - t) / (p + c + np.hypot(p - c, 2.0 * np.sqrt(t)))
            top = max(low if bound is None else min(low, bound), 0.0)
            shift = share * top
            done = _sweep(q, e, shift) if shift > EPS * base else None
            if done is None:
                if shift > EPS * base:
                    share *= 0.5
                    if share > 1e-3:
                        continue
                shift, done = 0.0, _sweep(q, e, 0.0)
                share = 0.5
            else:
                share = min((1.0 + 3.0 * share) / 4.0, 1.0 - 2.0 ** -10)
            q, e, bound = done
            base += shift
    return np.sort(np.array(found))[::-1]


def _twisted(diag: np.ndarray, low: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Columns z with (LDL' - lam I)z small, one for each of ``lam``: the
    factorisations from the top and from the bottom are joined where their
    common pivot is smallest."""
    n, m = len(diag), len(lam)
    tiny = EPS * EPS * max(diag.max(), 1e-300)

    def safe(x: np.ndarray) -> np.ndarray:
        return np.where(np.abs(x) < tiny, np.copysign(tiny, x), x)

    s, p = np.empty((n, m)), np.empty((n, m))
    down, up = np.empty((max(n - 1, 0), m)), np.empty((max(n - 1, 0), m))
    s[0] = -lam
    for i in range(n - 1):
        down[i] = diag[i] * low[i] / safe(diag[i] + s[i])
        s[i + 1] = down[i] * low[i] * s[i] - lam
    p[n - 1] = diag[n - 1] - lam
    for i in range(n - 2, -1, -1):
        t = diag[i] / safe(diag[i] * low[i] * low[i] + p[i + 1])
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - lam
    twist = np.argmin(np.abs(s + p + lam), axis=0)
    z = np.zeros((n, m))
    for k, r in enumerate(twist):
        z[r, k] = 1.0
        for i in range(r - 1, -1, -1):
            z[i, k] = -down[i, k] * z[i + 1, k]
        for i in range(r, n - 1):
            z[i + 1, k] = -up[i, k] * z[i, k]
    return z / np.linalg.norm(z, axis=0)


def _solve(tri_d: np.ndarray, tri_o: np.ndarray, lam: float, rhs: np.ndarray) -> np.ndarray:
    """(T - lam I)x = rhs up to scale, T symmetric tridiagonal, by Gaussian
    elimination with row exchanges."""
    n = len(tri_d)
    rows = np.zeros((n, 3))                       # diagonal, first and second superdiagonal
    rows[:, 0] = tri_d - lam
    rows[:-1, 1] = tri_o
    x = rhs.copy()
    tiny = EPS * (np.abs(tri_d).max() + 1e-300)
    for i in range(n - 1):
        under = np.array([tri_o[i], rows[i + 1, 0], rows[i + 1, 1]])
        if abs(under[0]) > abs(rows[i, 0]):
            rows[i], under = under, rows[i].copy()
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(rows[i, 0]) < tiny:
            rows[i, 0] = tiny
        f = under[0] / rows[i, 0]
        rows[i + 1] = [under[1] - f * rows[i, 1], under[2] - f * rows[i, 2], 0.0]
        x[i + 1] -= f * x[i]
    if abs(rows[n - 1, 0]) < tiny:
        rows[n - 1, 0] = tiny
    for i in range(n - 1, -1, -1):
        x[i] -= rows[i, 1] * (x[i + 1] if i + 1 < n else 0.0) + rows[i, 2] * (x[i + 2] if i + 2 < n else 0.0)
        x[i] /= rows[i, 0]
    return x / np.abs(x).max()


def right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors of the bidiagonal (a, b) as columns, for the
    squared singular values ``values`` (falling). Vectors of values that lie
    close together are orthogonalised against each other; where the twisted
    vector lies in the others' span, inverse iteration gives another."""
    floor = EPS * max(a.max(initial=0.0), b.max(initial=0.0), 1e-150)
    a = np.maximum(a, floor)                      # a change of the order of rounding
    diag, low = a * a, b / a[:-1]
    z = _twisted(diag, low, values)
    tri_d, tri_o = diag + np.concatenate([[0.0], b * b]), a[:-1] * b
    rng = np.random.default_rng(0)
    first = 0
    for k in range(len(values)):
        if k and values[k - 1] - values[k] > _CLUSTER * values[k - 1]:
            first = k
        if k == first:
            continue
        near, x = z[:, first:k], z[:, k].copy()
        for attempt in range(8):
            size = np.linalg.norm(x)
            for _ in range(2):
                x -= near @ (near.T @ x)
            left = np.linalg.norm(x)
            if left > 0.1 * size and attempt != 1:
                break
            x = _solve(tri_d, tri_o, values[k], rng.standard_normal(len(x)) if attempt == 0 or left == 0.0 else x / left)
        z[:, k] = x / np.linalg.norm(x)
    return z


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, falling; right singular vectors as columns)
    of a square matrix, those above rounding."""
    d = len(r)
    scale = np.abs(r).max(initial=0.0)
    if not scale:
        return np.empty(0), np.empty((d, 0))
    a, b, w = bidiagonalise(r / scale)
    size = max(a.max(), b.max(initial=0.0))
    cuts = [0, *(np.flatnonzero(b <= EPS * size) + 1).tolist(), d]   # B falls into blocks there
    values, vectors = [], []
    for lo, hi in zip(cuts, cuts[1:]):
        part = dqds(a[lo:hi], b[lo:hi - 1])
        part = part[part > (d * EPS * size) ** 2]
        if len(part):
            values.append(part)
            vectors.append(w[:, lo:hi] @ right_vectors(a[lo:hi], b[lo:hi - 1], part))
    values, vectors = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale * scale, vectors[:, order]
