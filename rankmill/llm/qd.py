"""Singular values and right singular vectors of a small triangular matrix.

Householder reflections make the matrix upper bidiagonal, dqds finds the squared singular values to high
relative accuracy, and twisted factorisations of the shifted tridiagonal give the vectors. The matrix has one row
per dimension; it never grows with the data.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(float).eps)
CLUSTER = 1e-3  # values closer than this (relative) get their vectors orthogonalised


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, alpha): (I - 2 v v') x = alpha e1; v is zero where nothing is to do."""
    scale = float(np.abs(x).max(initial=0.0))
    if scale == 0.0 or len(x) == 1:
        return np.zeros_like(x), float(x[0]) if len(x) else 0.0
    v = x / scale
    alpha = -math.copysign(float(np.sqrt(v @ v)), v[0])
    v[0] -= alpha
    return v / np.sqrt(v @ v), alpha * scale


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and right reflectors of the bidiagonal form of a square matrix."""
    a, n, right = r.astype(float).copy(), len(r), []
    for k in range(n):
        v, alpha = _reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        a[k, k], a[k + 1 :, k] = alpha, 0.0
        if k + 2 < n:
            w, alpha = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            a[k, k + 1], a[k, k + 2 :] = alpha, 0.0
            right.append(w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def rotate_back(y: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """Vectors of the bidiagonal matrix (columns) as vectors of the matrix it came from."""
    y = y.copy()
    for k in range(len(right) - 1, -1, -1):
        w = right[k]
        y[k + 1 :] -= 2 * np.outer(w, w @ y[k + 1 :])
    return y


def _transform(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One differential qd transform with a shift; None where the shift was above the smallest value."""
    n = len(q)
    out, off = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        if d < 0.0:
            return None
        out[i] = d + e[i]
        if out[i] == 0.0:
            off[i], d = 0.0, q[i + 1] - shift
        else:
            t = q[i + 1] / out[i]
            off[i] = e[i] * t
            d = d * t - shift
        least = min(least, d)
    if d < 0.0 or not np.isfinite(d):
        return None
    out[n - 1] = d
    return out, off, least


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues, falling, of B'B for a bidiagonal B with squared diagonal ``q`` and squared superdiagonal ``e``."""
    found: list[float] = []
    blocks = [(np.array(q, float), np.array(e, float), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        guess = 0.0
        while len(q):
            if len(q) == 1:
                found.append(moved + q[0])
                break
            cut = np.flatnonzero(e <= EPS * EPS * (moved + np.minimum(q[:-1], q[1:])))
            if len(cut):
                at = int(cut[-1]) + 1
                blocks.append((q[:at], e[: at - 1], moved))
                q, e, guess = q[at:], e[at:], 0.0
                continue
            if q[0] < q[-1] / 4:  # the small values belong at the end
                q, e = _flipped(q, e)
            shift = guess
            while (step := _transform(q, e, shift)) is None:
                shift = shift / 4 if shift > EPS * q[-1] else 0.0
                if shift == 0.0:
                    step = _transform(q, e, 0.0)
                    break
            q, e, least = step
            moved += shift
            # what is left of the last value bounds the smallest from above; less its last coupling from below
            guess = max(0.0, min(least, q[-1]) - math.sqrt(max(0.0, e[-1] * q[-1]))) if e[-1] < q[-1] else 0.0
            guess = max(guess, 0.25 * least) if least > 0 else guess
    return np.array(sorted(found, reverse=True))


def _flipped(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The qd array of the same values read from the other end."""
    return q[::-1].copy(), e[::-1].copy()


def _twisted(q: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Factors of L D L' - value: forward multipliers, backward multipliers, residuals gamma, and the best twist."""
    n, tiny = len(q), np.finfo(float).tiny
    forward, backward = np.zeros(n - 1), np.zeros(n - 1)
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        d = s[i] + q[i]
        d = d if abs(d) > tiny else -tiny
        forward[i] = q[i] * low[i] / d
        s[i + 1] = forward[i] * low[i] * s[i] - value
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        d = q[i] * low[i] * low[i] + p[i + 1]
        d = d if abs(d) > tiny else -tiny
        t = q[i] / d
        backward[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    gamma = s + p + value
    gamma = np.where(np.isfinite(gamma), gamma, np.inf)
    return forward, backward, gamma, int(np.argmin(np.abs(gamma)))


def _vector(forward: np.ndarray, backward: np.ndarray, at: int) -> np.ndarray:
    n = len(forward) + 1
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -forward[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -backward[i] * z[i]
    return z / np.sqrt(z @ z)


def _block_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) of an unreduced bidiagonal block, for squared singular values in falling order."""
    n = len(a)
    if n == 1:
        return np.ones((1, len(values)))
    q, low = a * a, b / np.where(a == 0.0, np.finfo(float).tiny, a)[:-1]
    out = np.zeros((n, len(values)))
    tops = values.max(initial=0.0)
    for j, value in enumerate(values):
        forward, backward, gamma, at = _twisted(q, low, value)
        near = [i for i in range(j) if abs(values[i] - value) <= CLUSTER * max(values[i], tops * EPS)]
        order = np.argsort(np.abs(gamma), kind="stable")
        for at in order[: max(1, min(n, 2 * len(near) + 1))]:  # in a cluster other twists give other directions of it
            z = _vector(forward, backward, int(at))
            for _ in range(2):
                z = z - out[:, near] @ (out[:, near].T @ z)
            size = float(np.sqrt(z @ z))
            if size > 0.1:
                break
        if near and size <= 0.1:  # inside the space of the cluster found so far: any direction, made to fit by iteration
            z = _iterated(a, b, value, out[:, near])
            size = 1.0
        out[:, j] = z / size
        if near:
            out[:, j] = _iterated(a, b, value, out[:, near], out[:, j])
    return out


def _iterated(a: np.ndarray, b: np.ndarray, value: float, known: np.ndarray, z: np.ndarray | None = None) -> np.ndarray:
    """Inverse iteration by Gaussian elimination with pivoting on the tridiagonal, orthogonal to ``known``."""
    n = len(a)
    main, off = a * a, a[:-1] * b
    main[1:] += b * b
    full = np.diag(main - value * (1 + 4 * EPS)) + np.diag(off, 1) + np.diag(off, -1)
    full[np.diag_indices(n)] += EPS * EPS * max(value, main.max(initial=0.0))
    z = np.cos(np.arange(1.0, n + 1) * (known.shape[1] + 1)) if z is None else z
    for _ in range(3):
        try:
            z = np.linalg.solve(full, z)
        except np.linalg.LinAlgError:
            break
        for _ in range(2):
            z = z - known @ (known.T @ z)
        z = z / np.sqrt(z @ z)
    return z


def singular(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``count`` squared singular values of a square matrix, falling, and its right singular vectors (columns)."""
    n = len(r)
    scale = float(np.abs(r).max(initial=0.0))
    if not n or scale == 0.0:
        return np.zeros(min(count, n)), np.eye(n)[:, : min(count, n)]
    a, b, right = bidiagonal(r / scale)
    norm = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    b = np.where(np.abs(b) <= EPS * norm * 1e-3, 0.0, b)
    cuts = [0, *(np.flatnonzero(b == 0.0) + 1).tolist(), n]
    values, vectors = [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own = np.maximum(dqds(a[lo:hi] ** 2, b[lo : hi - 1] ** 2), 0.0)[:count]
        part = np.zeros((n, len(own)))
        part[lo:hi] = _block_vectors(a[lo:hi], b[lo : hi - 1], own)
        values.append(own)
        vectors.append(part)
    value, vector = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-value, kind="stable")[:count]
    return value[order] * scale * scale, rotate_back(vector[:, order], right)
