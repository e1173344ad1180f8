"""Largest singular values and right singular vectors of a small square matrix, by a bidiagonal qd solver.

1. ``bidiagonal``: Householder reflections from both sides give an upper bidiagonal matrix.
2. ``singular_squares``: the dqds transform with Newton shifts, which never pass the smallest value, so all values come out with
   high relative accuracy.
3. ``twisted``: a forward and a backward factorisation of the shifted square meet where they leave the smallest rest; the vector
   follows from there by products alone.

The size is the dimension of the vectors, which does not grow with their number.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: vectors whose values are closer than this, relative to the largest, are made orthogonal explicitly
CLOSE = 1e-3


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``v`` and ``beta`` with ``(I - beta v v') x`` zero but for its first entry."""
    v, norm = x.copy(), np.linalg.norm(x)
    if norm == 0:
        return v, 0.0
    v[0] += np.copysign(norm, x[0])
    return v, 2.0 / (v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of ``U' r V`` and the orthogonal ``V``."""
    a, n = np.array(r, float), len(r)
    right = np.eye(n)
    for k in range(n):
        v, beta = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(beta * v, v @ a[k:, k:])
        if k + 2 < n:
            v, beta = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, beta * v)
            right[:, k + 1 :] -= np.outer(right[:, k + 1 :] @ v, beta * v)
    return a.diagonal().copy(), a.diagonal(1).copy(), right


def blocks(d: np.ndarray, f: np.ndarray) -> list[tuple[int, int]]:
    """Stretches between negligible superdiagonal entries; a zero on the diagonal is raised to a size below rounding."""
    size = max(np.abs(d).max(initial=0), np.abs(f).max(initial=0))
    d[np.abs(d) < EPS**2 * size] = EPS**2 * size
    loose = np.abs(f) <= EPS * np.minimum(np.abs(d[:-1]), np.abs(d[1:]))
    at = [0, *(np.flatnonzero(loose) + 1).tolist(), len(d)]
    return list(zip(at, at[1:]))


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds step; None if the shift is not below the smallest value."""
    rest = q[0] - shift
    if rest < 0:
        return None
    new_q, new_e, rests = [], [], [rest]
    for k in range(len(e)):
        s = rest + e[k]
        if s <= 0:
            return None
        ratio = q[k + 1] / s
        new_q.append(s)
        new_e.append(e[k] * ratio)
        rest = rest * ratio - shift
        if rest < 0:
            return None
        rests.append(rest)
    return [*new_q, rest], new_e, rests


def singular_squares(d: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Squares of the singular values of one block, falling."""
    q, e, total, bound, out = (d * d).tolist(), (f * f).tolist(), 0.0, 0.0, []
    while q:
        if len(q) == 1 or e[-1] <= EPS * EPS * (total + q[-1]):
            out.append(total + q.pop())
            bound = 0.0
            if e:
                e.pop()
            continue
        if 1.5 * q[0] < q[-1]:
            q.reverse()
            e.reverse()
        step = _transform(q, e, bound)
        if step is None:
            bound = 0.0
            step = _transform(q, e, 0.0)
        total += bound
        q, e, rests = step
        # the reciprocals of the rests add up to the trace of the inverse, so this never passes the smallest value
        bound = (1 - 8 * EPS * len(q)) / sum(1 / r for r in rests) if min(rests) > 0 else 0.0
        bound = bound if total + bound > total else 0.0
    return np.array(sorted(out, reverse=True))


def twisted(d: np.ndarray, f: np.ndarray, value: float) -> list[np.ndarray]:
    """Unit vectors ``z`` with ``B'B z`` about ``value z``, best twist first."""
    n, q, ratio, tiny = len(d), d * d, f / d[:-1], EPS**2 * max(value, EPS**2)
    plus, minus = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    down, up = np.empty(n), np.empty(n)
    down[0] = -value
    for k in range(n - 1):
        pivot = down[k] + q[k]
        pivot = pivot if abs(pivot) > tiny else -tiny
        plus[k] = q[k] * ratio[k] / pivot
        down[k + 1] = plus[k] * ratio[k] * down[k] - value
    up[n - 1] = q[n - 1] - value
    for k in range(n - 2, -1, -1):
        pivot = q[k] * ratio[k] ** 2 + up[k + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        t = q[k] / pivot
        minus[k] = ratio[k] * t
        up[k] = up[k + 1] * t - value
    rest = np.abs(down + up + value)
    out = []
    for twist in np.argsort(rest, kind="stable")[:8]:
        z = np.zeros(n)
        z[twist] = 1.0
        for k in range(twist - 1, -1, -1):
            z[k] = -plus[k] * z[k + 1]
        for k in range(twist, n - 1):
            z[k + 1] = -minus[k] * z[k]
        if np.isfinite(z).all():
            out.append(z / np.linalg.norm(z))
    return out


def leading(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest squared singular values of ``r``, falling, and their right singular vectors as rows."""
    d, f, right = bidiagonal(r)
    count = min(count, len(d))
    if not r.any():
        return np.zeros(count), right.T[:count]
    found = []
    for a, b in blocks(d, f):
        found += [(value, a, b) for value in singular_squares(d[a:b], f[a : b - 1])]
    found = sorted(found, key=lambda x: (-x[0], x[1]))[:count]
    values, vectors = np.array([x[0] for x in found]), []
    for value, a, b in found:
        near = [v for v, w in zip(vectors, values) if w - value <= CLOSE * values[0]]
        best, most = None, -1.0
        for z in twisted(d[a:b], f[a : b - 1], value):
            whole = np.zeros(len(d))
            whole[a:b] = z
            for _ in range(2):
                for v in near:
                    whole -= (v @ whole) * v
            size = np.linalg.norm(whole)
            if size > most + 0.1:
                best, most = whole / max(size, EPS), size
            if most > 0.5:
                break
        vectors.append(best)
    return values, np.array(vectors) @ right.T
