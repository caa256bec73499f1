"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

By Sylvester's law of inertia a factorisation L D L' of A - s I shows how many eigenvalues of
A lie above s: as many as D has positive ones. Bisection over s isolates each wanted
eigenvalue; inverse iteration at the isolating interval and then Rayleigh quotient iteration,
which converges cubically, give the pair; two more counts certify that it is the one of its
number. Nothing else is factorised, and only the wanted part of the spectrum is looked at.
"""

from __future__ import annotations

import numpy as np

ALPHA = (1 + np.sqrt(17)) / 8  # bounds the growth of a Bunch-Kaufman factorisation
EPS = float(np.finfo(np.float64).eps)


def count_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above the shift."""
    m = a - shift * np.eye(len(a))
    above, k, n = 0, 0, len(m)

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]

    while k < n:
        below = np.abs(m[k + 1 :, k])
        most = float(below.max(initial=0))
        step = 1
        if abs(m[k, k]) < ALPHA * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(m[r, k:])
            row[r - k] = 0
            if abs(m[k, k]) * row.max() < ALPHA * most * most:
                if abs(m[r, r]) >= ALPHA * row.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    step = 2
        rest = m[k + step :, k : k + step]
        if step == 2:
            above += 1  # such a block has one eigenvalue of either sign
            m[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(m[k : k + 2, k : k + 2], rest.T)
        elif m[k, k] != 0:
            above += m[k, k] > 0
            m[k + 1 :, k + 1 :] -= rest @ (rest.T / m[k, k])
        k += step
    return int(above)


def radius(a: np.ndarray) -> float:
    """No eigenvalue is larger in magnitude (Gershgorin)."""
    return float(np.abs(a).sum(axis=1).max(initial=0))


def solve(a: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    """A step of inverse iteration; at an eigenvalue itself the shift moves by a rounding error."""
    for _ in range(60):
        try:
            w = np.linalg.solve(a - shift * np.eye(len(a)), v)
            if np.isfinite(w).all() and w.any():
                return w / np.linalg.norm(w)
        except np.linalg.LinAlgError:
            pass
        shift += EPS * scale
    return v


def refine(a: np.ndarray, low: float, high: float, found: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """An eigenpair near the interval, orthogonal to the rows of `found`."""

    def free(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - found.T @ (found @ v)
        return v / np.linalg.norm(v)

    v = free(np.random.default_rng(len(found)).standard_normal(len(a)))
    for _ in range(3):
        v = free(solve(a, (low + high) / 2, v, scale))
    value = float(v @ a @ v)
    for _ in range(12):
        if np.linalg.norm(a @ v - value * v) <= 2 * EPS * scale:
            break
        v = free(solve(a, value, v, scale))
        value = float(v @ a @ v)
    return value, v


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, and their unit eigenvectors as rows.

    Eigenvalues closer together than rounding errors of the matrix cannot be told apart; they
    get an orthonormal set of vectors. Every other pair is certified: as many eigenvalues lie
    above its value, give or take a rounding error, as its number says.
    """
    n = len(a)
    count = min(count, n)
    scale = radius(a)
    values, vectors = np.zeros(count), np.zeros((count, n))
    if not scale:
        vectors[:, :count] = np.eye(count)
        return values, vectors
    tight = 8 * EPS * n * scale
    # stretches (low, high] with the number of eigenvalues above each end, the highest last
    todo = [(-scale - tight, scale + tight, n, 0)]
    done = 0
    while done < count:
        low, high, above_low, above_high = todo.pop()
        if above_low == above_high:
            continue
        several = above_low - above_high
        if several == 1 or high - low <= tight:
            for _ in range(min(several, count - done)):
                value, vector = refine(a, low, high, vectors[:done], scale)
                certified = count_above(a, value - tight) >= done + 1 and count_above(a, value + tight) <= done
                if certified or high - low <= tight:
                    values[done], vectors[done] = value, vector
                    done += 1
            if done == above_low or done == count:
                continue
        middle = (low + high) / 2
        above = count_above(a, middle)
        todo += [(low, middle, above_low, above), (middle, high, above, above_high)]
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[order]
