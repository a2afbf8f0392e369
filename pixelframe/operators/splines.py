"""Splines and fitted mixtures: coefficients in numpy, for small dense problems inside grouped functions or on the driver, values as Columns."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .solve import nonneg_solve


def natural(xs: np.ndarray, ys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through (xs, ys) at `at`; ends go on with the outer pieces."""
    n, h = len(xs), np.diff(xs)
    if n == 1:
        return np.full(len(at), ys[0], float)
    a, r = np.eye(n), np.zeros(n)
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1] / 6, (h[k - 1] + h[k]) / 3, h[k] / 6
        r[k] = (ys[k + 1] - ys[k]) / h[k] - (ys[k] - ys[k - 1]) / h[k - 1]
    m = np.linalg.solve(a, r)
    k = np.clip(np.searchsorted(xs, at, side="right") - 1, 0, n - 2)
    t, s = xs[k + 1] - at, at - xs[k]
    return (m[k] * t**3 + m[k + 1] * s**3) / (6 * h[k]) + (ys[k] / h[k] - m[k] * h[k] / 6) * t + (ys[k + 1] / h[k] - m[k + 1] * h[k] / 6) * s


def on_grid(xs: np.ndarray, ys: np.ndarray, z: np.ndarray, ax: np.ndarray, ay: np.ndarray) -> np.ndarray:
    """Tensor product of natural splines: z[y, x] on a grid at all (ay, ax)."""
    rows = np.stack([natural(xs, r, ax) for r in z])
    return np.stack([natural(ys, c, ay) for c in rows.T], axis=1)


def cubics(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Natural cubic splines through ys (its first axis runs over xs) as powers of the distance from each piece's left knot: (piece, power, ...)."""
    n, h = len(xs), np.diff(xs)
    ys = np.asarray(ys, float)
    a, r = np.eye(n), np.zeros_like(ys)
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1] / 6, (h[k - 1] + h[k]) / 3, h[k] / 6
        r[k] = (ys[k + 1] - ys[k]) / h[k] - (ys[k] - ys[k - 1]) / h[k - 1]
    m = np.linalg.solve(a, r.reshape(n, -1)).reshape(ys.shape)
    h = h.reshape(-1, *[1] * (ys.ndim - 1))
    return np.stack([ys[:-1], np.diff(ys, axis=0) / h - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, np.diff(m, axis=0) / (6 * h)], axis=1)


def bicubics(xs: np.ndarray, ys: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The tensor product of natural splines through z[y, x] as a polynomial for each cell: (cell in y, cell in x, power of y, power of x)."""
    along_x = cubics(xs, np.asarray(z, float).T)  # piece in x, power of x, y
    return cubics(ys, np.moveaxis(along_x, 2, 0)).transpose(0, 2, 1, 3)


def cell(x: Column, start: float, step: float, pieces: int) -> Column:
    """The piece of an even grid of knots that x lies in; ends go on with the outer pieces."""
    return F.greatest(F.lit(0), F.least(F.lit(pieces - 1), F.floor((x - start) / step).cast("int")))


def bicubic_at(c: Column, t: Column, s: Column) -> Column:
    """A cell's polynomial, its 16 coefficients in an array by power of y and then of x, at the distances t and s from its lower corner."""
    rows = [c[4 * q] + t * (c[4 * q + 1] + t * (c[4 * q + 2] + t * c[4 * q + 3])) for q in range(4)]
    return rows[0] + s * (rows[1] + s * (rows[2] + s * rows[3]))


@lru_cache(64)
def sersic(n: float, parts: int = 10) -> tuple[tuple[float, float], ...]:
    """Gaussian mixture (amplitude, variance) for a Sersic profile of index n inside eight half-light radii.

    Variances are spaced in the logarithm; non-negative amplitudes minimise the squared
    difference of the profiles, weighted by area over intensity, and are normalised to one.
    """
    b = 2 * n - 1 / 3 + 4 / (405 * n) + 46 / (25515 * n * n)
    r = np.geomspace(0.01, 8.0, 400)
    target = np.exp(-b * (r ** (1 / n) - 1))
    v = np.geomspace(1e-4 if n > 1 else 1e-2, 12.0, parts)
    basis = np.exp(-0.5 * r[:, None] ** 2 / v) / (2 * np.pi * v)
    w = np.sqrt(r * np.gradient(r) / np.maximum(target, 1e-6 * target.max()))
    a, y = basis * w[:, None], target * w
    scale = np.linalg.norm(a, axis=0)
    amp = nonneg_solve((a / scale).T @ (a / scale), (a / scale).T @ y) / scale
    amp = amp / amp.sum()
    return tuple((float(x), float(s)) for x, s in zip(amp, v, strict=True) if x > 0)


#: Sersic mixtures as cubics of the index: half-light radii, knots of the index, and variances shared by all of them.
SERSIC_LOW, SERSIC_HIGH, SERSIC_PIECES = 0.5, 6.3, 29
SERSIC_STEP = (SERSIC_HIGH - SERSIC_LOW) / SERSIC_PIECES
SERSIC_VARIANCES = tuple(float(v) for v in np.geomspace(1e-3, 12.0, 12))


@lru_cache(1)
def sersic_table() -> np.ndarray:
    """Coefficients (piece, component, power) of the amplitudes between the knots of the index: natural splines through non-negative fits at the knots, normalised to one."""
    r, v = np.geomspace(0.01, 8.0, 400), np.array(SERSIC_VARIANCES)
    basis = np.exp(-0.5 * r[:, None] ** 2 / v) / (2 * np.pi * v)
    knots, fits = np.linspace(SERSIC_LOW, SERSIC_HIGH, SERSIC_PIECES + 1), []
    for n in knots:
        b = 2 * n - 1 / 3 + 4 / (405 * n) + 46 / (25515 * n * n)
        target = np.exp(-b * (r ** (1 / n) - 1))
        w = np.sqrt(r * np.gradient(r) / np.maximum(target, 1e-6 * target.max()))
        a = basis * w[:, None]
        scale = np.linalg.norm(a, axis=0)
        amp = nonneg_solve((a / scale).T @ (a / scale), (a / scale).T @ (target * w)) / scale
        fits.append(amp / amp.sum())
    return cubics(knots, np.array(fits)).transpose(0, 2, 1)
