"""Spectra of scatter matrices, kept up to date by symmetric rank-one updates.

The scatter of n vectors is the sum of (v - mean)(v - mean)'.  It is held by its eigenvalues, ascending,
and its orthonormal eigenvectors.  One more vector adds ``n / (n + 1)`` times the outer product of its
distance from the mean; a second spectrum adds one such product for each of its eigenvectors and one for
the distance of the means.  Each product is a secular equation for the eigenvalues, solved for all of them
together, after entries that cannot matter were deflated.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: Steps of the root finder at most: a bisection alone would end within these.
STEPS = 120


class Spectrum:
    """Number, mean, eigenvalues (ascending) and eigenvectors (columns) of some vectors' scatter."""

    def __init__(self, size: int):
        self.n = 0
        self.mean = np.zeros(size)
        self.values = np.zeros(size)
        self.vectors = np.eye(size)

    def add(self, vector: np.ndarray) -> None:
        """One more vector: a centred rank-one update."""
        gap = vector - self.mean
        if self.n:
            self._update(self.n / (self.n + 1), gap)
        self.n += 1
        self.mean = self.mean + gap / self.n

    def merge(self, other: "Spectrum") -> None:
        """The spectrum of both sets of vectors, by an update for each of the other's eigenvectors."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._update(value, vector)
        gap = other.mean - self.mean
        if self.n:
            self._update(self.n * other.n / (self.n + other.n), gap)
        self.mean = self.mean + gap * (other.n / (self.n + other.n))
        self.n += other.n

    def _update(self, weight: float, vector: np.ndarray) -> None:
        """Add ``weight * vector vector'`` to the scatter."""
        norm = float(np.sqrt(vector @ vector))
        if not norm:
            return
        values, vectors = self.values, self.vectors
        z = vectors.T @ (vector / norm)
        weight = weight * norm * norm
        tolerance = 8 * EPS * max(values[-1], weight)
        # Of equal eigenvalues all but one are turned away from the vector.
        for k in np.flatnonzero(np.diff(values) <= tolerance).tolist():
            length = float(np.hypot(z[k], z[k + 1]))
            if not length:
                continue
            c, s = z[k + 1] / length, z[k] / length
            z[k], z[k + 1] = 0.0, length
            vectors[:, k], vectors[:, k + 1] = (
                c * vectors[:, k] - s * vectors[:, k + 1], s * vectors[:, k] + c * vectors[:, k + 1],
            )
        live = np.flatnonzero(weight * np.abs(z) > tolerance)
        if not len(live):
            return
        found, turned = solve_secular(values[live], z[live], weight)
        values[live], vectors[:, live] = found, vectors[:, live] @ turned
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], np.ascontiguousarray(vectors[:, order])


def solve_secular(poles: np.ndarray, z: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of ``diag(poles) + weight * z z'``, for ascending, different poles.

    The roots of ``1 + weight * sum(z^2 / (poles - root))`` lie one between each two poles and one
    beyond the last.  Each is found as its distance from the nearer pole, by interpolation with the two
    poles around it, kept inside a bracket.  The eigenvectors come from the ``z`` that has exactly these
    roots, so that they are orthogonal whatever the roots' last digits are.
    """
    size = len(poles)
    squares = weight * z * z
    gaps = np.append(np.diff(poles), squares.sum())
    index = np.arange(size)
    middle = poles + gaps / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        above = 1 + (squares / (poles - middle[:, None])).sum(axis=1) < 0
        above[-1] = False
        near = index + above
        apart = poles[None, :] - poles[near][:, None]
        low = np.where(above, -gaps / 2, 0.0)
        high = np.where(above, 0.0, gaps / 2)
        high[-1] = gaps[-1]
        offset = (low + high) / 2
        left = np.minimum(index, max(size - 2, 0))
        right = np.minimum(left + 1, size - 1)
        below = index[None, :] <= left[:, None]
        for _ in range(STEPS):
            distance = apart - offset[:, None]
            terms = squares / distance
            value = 1 + terms.sum(axis=1)
            settled = np.abs(value) <= 4 * EPS * size * (1 + np.abs(terms).sum(axis=1))
            settled |= high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
            if settled.all():
                break
            high, low = np.where(value > 0, offset, high), np.where(value > 0, low, offset)
            slopes = terms / distance
            psi = np.where(below, slopes, 0.0).sum(axis=1)
            phi = slopes.sum(axis=1) - psi
            one, two = distance[index, left], distance[index, right]
            a = (one + two) * value - one * two * (psi + phi)
            b = one * two * value
            c = value - one * psi - two * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # Beyond the last pole the other solution is the one to the right of both poles.
            last = (a[-1] + root[-1]) / (2 * c[-1]) if a[-1] >= 0 else 2 * b[-1] / (a[-1] - root[-1])
            step[-1] = last
            tried = offset + step
            inside = (tried > low) & (tried < high)
            tried = np.where(inside, tried, (low + high) / 2)
            offset = np.where(settled, offset, tried)
        between = offset[:, None] - apart
        # Row i of the quotients belongs to root i; the roots and poles alternate, so none is large.
        shifted = np.append(poles[1:], np.inf)
        base = np.where(index[:, None] < index[None, :], poles[:, None], shifted[:, None]) - poles[None, :]
        base[-1, :] = weight
        exact = np.sqrt(np.prod(between / base, axis=0))
        exact = np.where(np.isfinite(exact), exact, np.abs(z))
        turned = (np.copysign(exact, z)[None, :] / -between).T
        turned /= np.sqrt((turned * turned).sum(axis=0))
    return poles[near] + offset, turned
