"""Lengths and noises of Gaussian processes by a bounded quasi-Newton search of the marginal likelihood."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: decades beyond the least and greatest distance, and bounds of the noise, within which the search stays
LOWEST_NOISE, HIGHEST_NOISE = 1e-4, 1e2
STEPS = 25


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each of a to each of b, in no more memory than theirs."""
    d = np.zeros((len(a), len(b)))
    for i in range(0, len(a), 256):
        for c in range(a.shape[1]):
            d[i : i + 256] += (a[i : i + 256, c, None] - b[:, c]) ** 2
    return np.sqrt(d, out=d)


def shape(d: np.ndarray, ell: float, nu: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Kernel values at distances d and their slope in log(ell): RBF (None) or Matern of nu 0.5, 1.5, 2.5."""
    r = d / ell
    if nu is None:
        k = np.exp(-r * r / 2)
        return k, k * r * r
    s = math.sqrt(2 * nu) * r
    e = np.exp(-s)
    if nu == 0.5:
        return e, s * e
    if nu == 1.5:
        return (1 + s) * e, s * s * e
    return (1 + s + s * s / 3) * e, s * s * (1 + s) / 3 * e


def forward(low: np.ndarray, y: np.ndarray, block: int = 256) -> np.ndarray:
    """z of low z = y for a lower triangle, block by block; y may have columns."""
    z = np.array(y, float)
    for i in range(0, len(z), block):
        j = i + block
        z[i:j] = np.linalg.solve(low[i:j, i:j], z[i:j] - low[i:j, :i] @ z[:i])
    return z


class Pairs:
    """Log likelihood of centred y under a (K + noise I) with the best a, from the distances d of all pairs."""

    def __init__(self, d: np.ndarray, y: np.ndarray, nu: float | None = None):
        self.d, self.y, self.nu, self.at, self.k = d, y, nu, None, None

    def kernel(self, ell: float) -> np.ndarray:
        if ell != self.at:
            self.at, self.k = ell, shape(self.d, ell, self.nu)[0]
        return self.k

    def noisy(self, ell: float, noise: float) -> np.ndarray:
        c = self.kernel(ell).copy()
        c[np.diag_indices_from(c)] += noise
        return c

    def value(self, ell: float, noise: float) -> float:
        n, low = len(self.y), np.linalg.cholesky(self.noisy(ell, noise))
        z = forward(low, self.y)
        return _profile(n, float(z @ z), 2 * float(np.log(np.diag(low)).sum()))

    def slope(self, ell: float, noise: float) -> np.ndarray:
        """Of the value, in log(ell) and log(noise)."""
        inverse = np.linalg.inv(self.noisy(ell, noise))
        w = inverse @ self.y
        scale = max(float(self.y @ w) / len(w), 1e-300)
        dk = shape(self.d, ell, self.nu)[1]
        return 0.5 * np.array([float(w @ (dk @ w)) / scale - float(np.vdot(inverse, dk)), noise * (float(w @ w) / scale - float(np.trace(inverse)))])

    def fitted(self, ell: float, noise: float) -> np.ndarray:
        """K (K + noise I)^-1 y."""
        return self.kernel(ell) @ np.linalg.solve(self.noisy(ell, noise), self.y)


class Places:
    """The same for the RBF kernel of places (n x 2), by products of few columns (see columns) where the places span few lengths.

    The matrix of all pairs is made only for lengths that would take more than two thirds as many columns as there are places.
    """

    def __init__(self, at: np.ndarray, y: np.ndarray):
        self.at, self.y, self.pairs, self.now = at, y, None, None

    def _dense(self) -> Pairs:
        if self.pairs is None:
            self.pairs = Pairs(apart(self.at, self.at), self.y)
        return self.pairs

    def _sums(self, ell: float) -> tuple | None:
        """The columns' function, their products and their products with y; None where there are too many."""
        if self.now is None or self.now[0] != ell:
            self.now = None
            f = columns(self.at, ell, 1.5)
            self.now = (ell, f and (f, *summed(f, self.at, self.y)))
        return self.now[1]

    def value(self, ell: float, noise: float) -> float:
        s = self._sums(ell)
        if s is None:
            return self._dense().value(ell, noise)
        _, g, b = s
        low = np.linalg.cholesky(g + noise * np.eye(len(b)))
        z, n = forward(low, b), len(self.y)
        return _profile(n, (float(self.y @ self.y) - float(z @ z)) / noise, 2 * float(np.log(np.diag(low)).sum()) + (n - len(b)) * math.log(noise))

    def slope(self, ell: float, noise: float) -> np.ndarray:
        """A slope in log(ell) needs the products of columns times x, y and their squares, as d^2 is x^2 - 2 x x' + x'^2 and so on."""
        s = self._sums(ell)
        if s is None:
            return self._dense().slope(ell, noise)
        f, g, b = s
        inverse = np.linalg.inv(g + noise * np.eye(len(b)))
        a, n, yy = inverse @ b, len(self.y), float(self.y @ self.y)
        scale = max((yy - float(a @ b)) / noise / n, 1e-300)
        u = (self.at - self.at.mean(0)) / ell
        u = np.column_stack([u, (u * u).sum(1)])
        up, trace = [], 0.0
        for i in range(3):
            gu, bu = summed(f, self.at, self.y, u[:, i])
            up.append((bu - gu @ a) / noise)
            trace += float(np.vdot(inverse, gu @ gu)) if i < 2 else noise * float(np.vdot(inverse, gu)) - float(np.trace(gu))
        curved = 2 * (float(up[2] @ a) - float(up[0] @ up[0]) - float(up[1] @ up[1]))
        ww = (yy - 2 * float(a @ b) + float(a @ (g @ a))) / noise**2
        return 0.5 * np.array([curved / scale - 2 * trace / noise, noise * ww / scale - (n - len(b) + noise * float(np.trace(inverse)))])

    def fitted(self, ell: float, noise: float) -> np.ndarray:
        s = self._sums(ell)
        if s is None:
            return self._dense().fitted(ell, noise)
        f, g, b = s
        a = np.linalg.solve(g + noise * np.eye(len(b)), b)
        return np.concatenate([f(self.at[i : i + ROWS]) @ a for i in range(0, len(self.at), ROWS)])


def _profile(n: int, square: float, logdet: float) -> float:
    return -0.5 * (n * math.log(2 * math.pi * max(square / n, 1e-300)) + n + logdet)


def profiled(d: np.ndarray, y: np.ndarray, ell: float, noise: float, nu: float | None = None) -> tuple[float, np.ndarray]:
    """Log likelihood of centred y under a (K + noise I) with the best a, and its slope in log(ell) and log(noise)."""
    p = Pairs(d, y, nu)
    return p.value(ell, noise), p.slope(ell, noise)


def search(d: np.ndarray, y: np.ndarray, lengths: list[float], noises: list[float], nu: float | None = None) -> tuple[float, float, float]:
    return climb(Pairs(d, y, nu), lengths, noises)


def climb(process: Pairs | Places, lengths: list[float], noises: list[float]) -> tuple[float, float, float]:
    """(log likelihood, length, noise): from the best of the grid uphill, never below it.

    Steps go by a BFGS estimate of the curvature in the logarithms, cut at the bounds and halved until the likelihood
    rises.  Bounds: a hundredth of the least and a hundred times the greatest length of the grid.
    """
    best = max(((process.value(ell, s), ell, s) for ell in lengths for s in noises), key=lambda x: x[0])
    lo = np.log([min(lengths) / 100, LOWEST_NOISE])
    hi = np.log([max(lengths) * 100, HIGHEST_NOISE])
    at = np.clip(np.log([best[1], best[2]]), lo, hi)
    value, slope = process.value(*np.exp(at)), process.slope(*np.exp(at))
    h = np.eye(2) / max(1.0, float(np.abs(slope).max()))
    for _ in range(STEPS):
        free = ~(((at <= lo) & (slope < 0)) | ((at >= hi) & (slope > 0)))
        if not free.any() or np.abs(slope[free]).max() < 1e-6:
            break
        step = np.where(free, h @ np.where(free, slope, 0.0), 0.0)
        if float(step @ slope) <= 0:
            h, step = np.eye(2), np.where(free, slope, 0.0)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        for _ in range(20):
            new = np.clip(at + step, lo, hi)
            got = process.value(*np.exp(new))
            if got > value + 1e-12:
                break
            step = step / 2
        else:
            break
        rise = process.slope(*np.exp(new))
        s, g = new - at, slope - rise  # of the negative likelihood
        if float(s @ g) > 1e-12:
            rho = 1 / float(s @ g)
            left = np.eye(2) - rho * np.outer(s, g)
            h = left @ h @ left.T + rho * np.outer(s, s)
        at, value, slope = new, got, rise
    return (value, *np.exp(at)) if value > best[0] else best


#: rows of columns() that are held at a time, the most lengths that a side may span, and how far products may be off the kernel
ROWS, WIDEST, OFF = 4096, 64, 1e-12


def _side(x: np.ndarray, ell: float) -> tuple[Callable[[np.ndarray], np.ndarray], np.ndarray] | None:
    """Functions f of one coordinate, with f(a) f(b)^T the RBF kernel up to OFF between least and greatest x, and their sizes.

    They are the kernel's eigenfunctions by Gauss-Legendre quadrature.  None if x spans more than WIDEST lengths, or they are off.
    """
    lo, hi = float(x.min()), max(float(x.max()), float(x.min()) + 1e-6 * ell)
    if hi - lo > WIDEST * ell:
        return None
    t, w = np.polynomial.legendre.leggauss(40 + 6 * math.ceil((hi - lo) / ell))
    t, w = lo + (t + 1) * (hi - lo) / 2, np.sqrt(w / 2)
    k = lambda a, b: np.exp(-((a[:, None] - b) ** 2) / (2 * ell * ell))
    size, turn = np.linalg.eigh(w[:, None] * k(t, t) * w)
    kept = size > 1e-16 * size[-1]
    size, mix = size[kept][::-1], (w[:, None] * turn[:, kept] / np.sqrt(size[kept]))[:, ::-1]
    f = lambda a: k(a, t) @ mix
    probe = np.linspace(lo, hi, 257)
    return (f, size) if np.abs(f(probe) @ f(probe).T - k(probe, probe)).max() < OFF else None


def columns(at: np.ndarray, ell: float, worth: float = 4) -> Callable[[np.ndarray], np.ndarray] | None:
    """A function of places whose rows f(a), f(b) have as products the RBF kernel of length ell, up to rounding.

    None if the columns times `worth` are more than the places: then the matrix of all pairs is no more work.
    """
    sides = [_side(x, ell) for x in at.T] if len(at) > 1 else [None]
    if any(s is None for s in sides):
        return None
    (f, a), (g, b) = sides
    i, j = np.nonzero(a[:, None] * b > 1e-16 * a[0] * b[0])
    return (lambda p: f(p[:, 0])[:, i] * g(p[:, 1])[:, j]) if worth * len(i) <= len(at) else None


def summed(columns: Callable[[np.ndarray], np.ndarray], at: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Products of the columns with each other and with y over all places (times their weights), ROWS places at a time."""
    inner, right = 0.0, 0.0
    for i in range(0, len(at), ROWS):
        c = columns(at[i : i + ROWS])
        d = c if weight is None else c * weight[i : i + ROWS, None]
        inner, right = inner + c.T @ d, right + d.T @ y[i : i + ROWS]
    return inner, right


def left_out(columns: Callable[[np.ndarray], np.ndarray], at: np.ndarray, y: np.ndarray, noise: float) -> np.ndarray:
    """Each y less what the process with noise says there from the others, by Woodbury's identity, ROWS places at a time."""
    inner, right = summed(columns, at, y)
    low = np.linalg.cholesky(inner + noise * np.eye(len(right)))
    z, out = forward(low, right), np.empty(len(at))
    for i in range(0, len(at), ROWS):
        v = forward(low, columns(at[i : i + ROWS]).T)
        out[i : i + ROWS] = (y[i : i + ROWS] - v.T @ z) / (1 - (v * v).sum(0))
    return out
