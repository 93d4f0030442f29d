"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

Sylvester's law: the LDL^T factors of ``A - s I`` have as many positive entries
as ``A`` has eigenvalues above ``s``. Bisection with these counts isolates each
wanted eigenvalue in an interval of its own, Rayleigh quotient iteration finds
it there, and two more counts, just below and above what was found, certify its
number. A count is of the order of the cube of the size, on one machine.
"""

from __future__ import annotations

from math import sqrt

import numpy as np

ALPHA = (1 + sqrt(17)) / 8


def inertia(a: np.ndarray) -> tuple[int, int]:
    """Positive and negative eigenvalues of a symmetric matrix, by LDL^T with complete pivoting."""
    a = np.array(a, np.float64)
    positive = negative = 0
    while len(a):
        size = np.abs(a)
        diagonal = np.abs(np.diag(a))
        r = int(np.argmax(diagonal))
        p, q = divmod(int(np.argmax(size)), len(a))
        if size[p, q] == 0:
            break
        if diagonal[r] >= ALPHA * size[p, q]:
            rest = np.delete(np.arange(len(a)), r)
            column, pivot = a[rest, r], a[r, r]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / pivot)
            positive, negative = positive + (pivot > 0), negative + (pivot < 0)
        else:
            # The block is smaller on its diagonal than off it: one eigenvalue of each sign.
            rest = np.delete(np.arange(len(a)), [p, q])
            block, columns = a[np.ix_([p, q], [p, q])], a[np.ix_(rest, [p, q])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
            positive, negative = positive + 1, negative + 1
        a = (a + a.T) / 2
    return positive, negative


def _solved(a: np.ndarray, shift: float, right: np.ndarray, nudge: float) -> np.ndarray:
    while True:
        try:
            found = np.linalg.solve(a - shift * np.eye(len(a)), right)
            if np.isfinite(found).all():
                return found
        except np.linalg.LinAlgError:
            pass
        shift, nudge = shift + nudge, 2 * nudge


def _quotient_iteration(a: np.ndarray, start: float, nudge: float, draw: np.random.Generator):
    """``(eigenvalue, vector)`` that the iteration from a shift ends at, or none."""
    x = draw.normal(size=len(a))
    for _ in range(2):  # inverse iteration at the fixed shift, to get near
        x = _solved(a, start, x / np.linalg.norm(x), nudge)
        x /= np.linalg.norm(x)
    for _ in range(12):
        value = float(x @ a @ x)
        if np.linalg.norm(a @ x - value * x) <= 4 * nudge:
            return value, x
        x = _solved(a, value, x, nudge)
        x /= np.linalg.norm(x)
    return None


def _cluster(a: np.ndarray, start: float, size: int, nudge: float, draw: np.random.Generator):
    """Eigenpairs too close to be told apart: an orthonormal basis of their space."""
    x = draw.normal(size=(len(a), size))
    for _ in range(4):
        x = np.linalg.qr(_solved(a, start, x, nudge))[0]
    values, turn = np.linalg.eigh(x.T @ a @ x)
    return [(float(values[k]), x @ turn[:, k]) for k in np.argsort(-values)]


def leading(a: np.ndarray, wanted: int, close: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Eigenvalues nearer than ``close`` of the norm are taken as one of several vectors.
    """
    a = (np.asarray(a, np.float64) + np.asarray(a, np.float64).T) / 2
    size = len(a)
    wanted = min(wanted, size)
    norm = float(np.abs(a).sum(axis=1).max(initial=0.0))
    if not wanted or norm == 0:
        return np.zeros(wanted), np.eye(size)[:, :wanted]
    nudge = size * np.finfo(float).eps * norm
    draw = np.random.default_rng(5)

    def above(shift: float) -> int:
        return inertia(a - shift * np.eye(size))[0]

    found: dict[int, tuple[float, np.ndarray]] = {}
    # Slices with the eigenvalues above their upper and above their lower end.
    slices = [(-norm - nudge, norm + nudge, 0, size)]
    while slices:
        low, high, first, last = slices.pop()
        if first >= min(last, wanted):
            continue
        middle = (low + high) / 2
        if high - low <= close * norm or middle in (low, high):
            for k, pair in enumerate(_cluster(a, middle, last - first, nudge, draw)):
                found[first + k] = pair
            continue
        if last - first == 1:
            pair = _quotient_iteration(a, middle, nudge, draw)
            margin = 8 * nudge
            if pair and low <= pair[0] <= high and above(pair[0] + margin) <= first < above(pair[0] - margin):
                found[first] = pair
                continue
        count = above(middle)
        slices += [(low, middle, count, last), (middle, high, first, count)]
    # A slice may end inside a group of equal eigenvalues, whose vectors have to be found together.
    band, first = close * norm, 0
    while first < wanted:
        last = first + 1
        while last < wanted and found[last - 1][0] - found[last][0] <= band:
            last += 1
        if last - first > 1:
            size_of_group = above(found[last - 1][0] - band) - first if last == wanted else last - first
            start = (found[first][0] + found[last - 1][0]) / 2
            for k, pair in enumerate(_cluster(a, start, size_of_group, nudge, draw)):
                found[first + k] = pair
        first = last
    pairs = [found[k] for k in range(wanted)]
    return np.array([p[0] for p in pairs]), np.stack([p[1] for p in pairs], axis=1)
