"""Least squares on long tables: normal equations, priors, grouped solves, line searches.

Design rows are (img, x, y, pid, a) with a = derivative x inverse error and (img, x, y, b) with
the residual x inverse error. Their products are sums over pixels, so the normal matrix comes
from one self-join on the pixel and one aggregate; only dense solves of connected groups of
parameters run in numpy, one group a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_matrix(design: DataFrame) -> DataFrame:
    """i <= j and the sum of a_i * a_j over shared pixels."""
    left = design.select("img", "x", "y", F.col("pid").alias("i"), F.col("a").alias("ai"))
    right = design.select("img", "x", "y", F.col("pid").alias("j"), F.col("a").alias("aj"))
    return left.join(right, ["img", "x", "y"]).where("i <= j").groupBy("i", "j").agg(F.sum(F.col("ai") * F.col("aj")).alias("aa"))


def normal_rhs(design: DataFrame) -> DataFrame:
    """pid and the sum of a * b; b is a column of the design rows."""
    return design.groupBy(F.col("pid").alias("i")).agg(F.sum(F.col("a") * F.col("b")).alias("ab"))


def prior_terms(params: DataFrame) -> DataFrame:
    """Rows (1 / sigma, -(value - mu) / sigma) of Gaussian priors as terms of the normal equations: i, aa, ab."""
    inv = 1.0 / (F.col("sigma") * F.col("sigma"))
    return params.where("sigma > 0").select(F.col("pid").alias("i"), inv.alias("aa"), (-(F.col("value") - F.col("mu")) * inv).alias("ab"))


def with_priors(matrix: DataFrame, rhs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    m = matrix.unionByName(terms.select("i", F.col("i").alias("j"), "aa")).groupBy("i", "j").agg(F.sum("aa").alias("aa"))
    return m, rhs.unionByName(terms.select("i", "ab")).groupBy("i").agg(F.sum("ab").alias("ab"))


def shared(design: DataFrame, keys: DataFrame) -> DataFrame:
    """Design rows with parameters replaced by the key they share (pid, shared_key); rows of one key at one pixel add up."""
    named = design.join(keys, "pid", "left").withColumn("pid", F.coalesce("shared_key", "pid"))
    return named.groupBy("img", "x", "y", "pid").agg(F.sum("a").alias("a"), F.first("b").alias("b"))


def solve_groups(matrix: DataFrame, rhs: DataFrame, groups: DataFrame, damp: float = 0.0) -> DataFrame:
    """i, value, variance: x with (A'A + damp^2) x = A'b in each group (i, grp); variance is 1 / diagonal, which ignores blending.

    A group is a set of parameters that share pixels; its dense matrix must fit a task, which the
    largest cluster of overlapping sources bounds, not the catalogue.
    """
    rows = matrix.join(groups, "i").select("grp", "i", "j", "aa", F.lit(None).cast("double").alias("ab"))
    right = rhs.join(groups, "i").select("grp", "i", F.lit(None).cast(rhs.schema["i"].dataType).alias("j"), F.lit(None).cast("double").alias("aa"), "ab")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        mat, vec = pdf[pdf.j.notna()], pdf[pdf.j.isna()]
        ids = np.unique(vec.i.to_numpy())
        a = np.zeros((len(ids), len(ids)))
        i, j = np.searchsorted(ids, mat.i), np.searchsorted(ids, mat.j.astype(ids.dtype))
        a[i, j] = mat.aa
        a[j, i] = mat.aa
        b = np.zeros(len(ids))
        b[np.searchsorted(ids, vec.i)] = vec.ab
        diag = np.diag(a).copy()
        scale = np.where(diag > 0, np.sqrt(diag), 1.0)
        x = _positive_solve(a / np.outer(scale, scale) + np.eye(len(ids)) * damp**2 / np.outer(scale, scale), b / scale) / scale
        return pd.DataFrame({"i": ids, "value": x, "variance": np.where(diag > 0, 1 / np.where(diag > 0, diag, 1), 0.0)})

    kind = rhs.schema["i"].dataType.simpleString()
    return rows.unionByName(right).groupBy("grp").applyInPandas(solve, f"i {kind}, value double, variance double")


def closed_form(matrix: DataFrame, rhs: DataFrame) -> DataFrame:
    """Isolated parameters: i, value = ab / aa, iv = aa. No Python."""
    diag = matrix.where("i = j")
    return rhs.join(diag, "i").where("aa > 0").select("i", (F.col("ab") / F.col("aa")).alias("value"), F.col("aa").alias("iv"))


ALPHAS = tuple(2.0**-k for k in range(10, -1, -1)) + (2.0**0.5, 2.0)


def line_search(changes: DataFrame, start: float = 0.0, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Best step along one direction for each key, all steps evaluated at once.

    changes: key, c0 (residual) and dc (its change for a full step), in units of the error. The
    log-likelihood gain is -(alpha * sum(c0 dc) + alpha^2 sum(dc^2) / 2), a sum of changes and
    not a difference of totals. Steps are replayed in order: the search ends where the gain
    falls more than one below the best so far.
    """
    sums = changes.groupBy("key").agg(F.sum(F.col("c0") * F.col("dc")).alias("p"), F.sum(F.col("dc") * F.col("dc")).alias("q"))
    return sums.select("key", best_step(F.col("p"), F.col("q"), start, alphas).alias("r")).select("key", "r.alpha", F.col("r.best").alias("gain"))


def best_step(p: Column, q: Column, start: float = 0.0, alphas: tuple[float, ...] = ALPHAS) -> Column:
    """The search of line_search on its sums p and q, as a struct with alpha and best."""
    gain = lambda a: -(a * p + a * a * q / 2.0)
    steps = F.array(*[F.struct(F.lit(a).alias("alpha"), gain(F.lit(a)).alias("gain")) for a in alphas])
    first = F.struct(F.lit(0.0).alias("alpha"), F.lit(float(start)).alias("best"), F.lit(False).alias("done"))

    def step(acc: Column, s: Column) -> Column:
        stop = acc["done"] | (s["gain"] < acc["best"] - 1.0) | F.isnan(s["gain"])
        better = ~stop & (s["gain"] > acc["best"])
        return F.struct(F.when(better, s["alpha"]).otherwise(acc["alpha"]).alias("alpha"), F.when(better, s["gain"]).otherwise(acc["best"]).alias("best"), stop.alias("done"))

    return F.aggregate(steps, first, step)


def bounded_alpha(value: Column, step: Column, lower: Column, upper: Column, max_step: Column) -> Column:
    """Largest alpha in [0, 1] that respects a parameter's bounds and longest step."""
    size = F.abs(step)
    by_step = F.when(max_step.isNotNull() & (size > max_step), max_step / F.when(size > 0, size)).otherwise(1.0)
    room = F.when(step > 0, F.coalesce((upper - value) / F.when(step > 0, step), F.lit(1.0))).when(step < 0, F.coalesce((lower - value) / F.when(step < 0, step), F.lit(1.0))).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(by_step, room, F.lit(1.0)))


def _positive_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with Ax = b for a symmetric positive matrix by its Cholesky factor; the shortest least-squares answer where that fails."""
    try:
        low = np.linalg.cholesky(a)
        x = np.linalg.solve(low.T, np.linalg.solve(low, b))
        if np.isfinite(x).all() and np.abs(a @ x - b).max(initial=0.0) <= 1e-8 * max(1.0, np.abs(b).max(initial=0.0)):
            return x
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(a, b, rcond=None)[0]


def nonneg_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |Ax - b| with x >= 0 on normal equations, to the end or an error.

    Principal pivoting in blocks: all unknowns on the wrong side change sides at once while their
    number falls, one at a time otherwise. Where that doesn't settle, as on nearly singular
    matrices, the active set method goes on, which frees one unknown a round.
    """
    n = len(b)
    if not n:
        return np.zeros(0)
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    a, b = a / np.outer(scale, scale), b / scale
    near = 1e-10 * max(1e-300, np.abs(b).max())
    free, fewest, spare = np.ones(n, bool), n + 1, 3
    for _ in range(100 + 10 * n):
        x = np.zeros(n)
        x[free] = _positive_solve(a[np.ix_(free, free)], b[free])
        wrong = np.where(free, x < 0, b - a @ x > near)
        count = int(wrong.sum())
        if not count:
            return x / scale
        if count < fewest:
            fewest, spare = count, 3
        elif spare:
            spare -= 1
        else:
            wrong[: np.flatnonzero(wrong)[-1]] = False
        free ^= wrong
    return _active_set(a, b, near) / scale


def _active_set(a: np.ndarray, b: np.ndarray, near: float) -> np.ndarray:
    n = len(b)
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(100 + 10 * n):
        w = np.where(free, -np.inf, b - a @ x)
        if w.max() <= near:
            return x
        free[int(w.argmax())] = True
        while free.any():
            z = np.zeros(n)
            z[free] = _positive_solve(a[np.ix_(free, free)], b[free])
            if z[free].min() > 0:
                x = z
                break
            bad = free & (z <= 0)
            x = x + min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300)) * (z - x)
            free &= x > 1e-12
            x = np.where(free, x, 0.0)
    raise ArithmeticError(f"no non-negative solution of {n} unknowns after {100 + 10 * n} rounds")


def levenberg(residual, x0: np.ndarray, steps: int = 50, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Levenberg-Marquardt with numeric derivatives for a small dense problem."""
    x, lam = np.array(x0, float), 1e-3
    r = residual(x)
    cost = float(r @ r)
    for _ in range(steps):
        h = 1e-6 * np.maximum(1.0, np.abs(x))
        jac = np.stack([(residual(x + np.eye(len(x))[k] * h[k]) - r) / h[k] for k in range(len(x))], axis=1)
        a, g = jac.T @ jac, jac.T @ r
        moved = False
        for _ in range(12):
            dx = -np.linalg.lstsq(a + lam * np.diag(np.maximum(np.diag(a), 1e-12)), g, rcond=None)[0]
            rn = residual(x + dx)
            new = float(rn @ rn)
            if np.isfinite(new) and new < cost:
                done = cost - new <= tol * max(1.0, cost)
                x, r, cost, lam, moved = x + dx, rn, new, lam / 3, True
                break
            lam *= 4
        if not moved or done:
            break
    return x, cost


def levenberg_many(residual, slopes, x0: np.ndarray, steps: int = 50, tol: float = 1e-9) -> np.ndarray:
    """levenberg on many problems at once, each with its own damping, steps and end, with exact derivatives: parameters, a row a problem.

    residual(x, rows) -> (rows, n) of the problems `rows` at parameters x, filling has residuals of
    zero; slopes(x, rows) -> its derivatives (rows, parameters, n), of rows in the last residual at
    the same parameters.
    """
    x = np.array(x0, float)
    n, k = x.shape
    lam, taken, failed = np.full(n, 1e-3), np.zeros(n, int), np.zeros(n, int)
    a, g, diag = np.zeros((n, k, k)), np.zeros((n, k)), np.arange(k)

    def linear(rows: np.ndarray, r: np.ndarray) -> None:
        jac = slopes(x[rows], rows)
        a[rows], g[rows] = jac @ jac.transpose(0, 2, 1), (jac @ r[:, :, None])[:, :, 0]

    with np.errstate(all="ignore"):  # steps that lead nowhere are not taken
        live = np.arange(n)
        r = residual(x, live)
        cost = np.einsum("ij,ij->i", r, r)
        linear(live, r)
        while len(live):
            m = a[live]
            m[:, diag, diag] += lam[live, None] * np.maximum(m[:, diag, diag], 1e-12)
            to = x[live] - _damped(m, g[live])
            r = residual(to, live)
            new = np.einsum("ij,ij->i", r, r)
            better = np.isfinite(new) & (new < cost[live])
            done = better & (cost[live] - new <= tol * np.maximum(1.0, cost[live]))
            won, lost = live[better], live[~better]
            x[won], cost[won], lam[won] = to[better], new[better], lam[won] / 3
            taken[won] += 1
            failed[won] = 0
            lam[lost] *= 4
            failed[lost] += 1
            on = better & ~done & (taken[live] < steps)
            if on.any():
                linear(live[on], r[on])
            live = live[on | (~better & (failed[live] < 12))]
    return x


def _damped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of each Ax = b with a positive symmetric A, by elimination on all of them together; the shortest answer where that loses its digits."""
    size = np.sqrt(np.where(a.diagonal(axis1=1, axis2=2) > 0, a.diagonal(axis1=1, axis2=2), 1.0))
    s, y, x = a / (size[:, :, None] * size[:, None, :]), b / size, np.zeros_like(b)
    ok, k = np.ones(len(b), bool), b.shape[1]
    for j in range(k):
        ok &= s[:, j, j] > 1e-12
        f = s[:, j + 1 :, j] / s[:, j, j, None]
        s[:, j + 1 :, j + 1 :] -= f[:, :, None] * s[:, None, j, j + 1 :]
        y[:, j + 1 :] -= f * y[:, j, None]
    for j in range(k - 1, -1, -1):
        x[:, j] = (y[:, j] - np.einsum("ij,ij->i", s[:, j, j + 1 :], x[:, j + 1 :])) / s[:, j, j]
    x /= size
    bad = ~(ok & np.isfinite(x).all(axis=1))
    if bad.any():
        x[bad] = _shortest(a[bad], b[bad])
    return x


def _shortest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The shortest least-squares x of each symmetric Ax = b; NaN where a number is not finite."""
    ok = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    w, v = np.linalg.eigh(np.where(ok[:, None, None], a, 0.0))
    size = np.abs(w)
    on = size > np.finfo(float).eps * a.shape[1] * size.max(axis=1, keepdims=True)
    x = (v @ (np.where(on, (v.transpose(0, 2, 1) @ b[:, :, None])[:, :, 0] / np.where(on, w, 1.0), 0.0))[:, :, None])[:, :, 0]
    return np.where(ok[:, None], x, np.nan)


def gaussian_fits(x: np.ndarray, y: np.ndarray, v: np.ndarray, w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Flux, place, width and sky of a round Gaussian in each row of pixels (values v, inverse errors w, 0 for filling) by levenberg_many from `start`."""

    held: list[tuple[np.ndarray, ...]] = []  # of the last residual, whose problems slopes are taken of

    def residual(p: np.ndarray, k: np.ndarray) -> np.ndarray:
        every = len(k) == len(x)
        xk, yk, vk, wk = (c if every else c[k] for c in (x, y, v, w))
        by = 1.0 / np.maximum(p[:, 3:4] ** 2, 1e-6)
        dx, dy = xk - p[:, 1:2], yk - p[:, 2:3]
        d2, u = dx * dx, dy * dy
        d2 += u
        d2 *= by
        np.multiply(d2, -0.5, out=u)
        np.exp(u, out=u)
        u *= by / (2 * np.pi)
        held[:] = [(k, wk, by, dx, dy, d2, u)]
        out = u * p[:, :1]
        out += p[:, 4:]
        out -= vk
        out *= wk
        return out

    def slopes(p: np.ndarray, k: np.ndarray) -> np.ndarray:
        at, *rest = held[0]
        if len(k) < len(at):
            rows = np.searchsorted(at, k)  # both ascend
            rest = [c[rows] for c in rest]
        wk, by, dx, dy, d2, u = rest
        out = np.empty((len(k), 5, x.shape[1]))
        np.multiply(u, wk, out=out[:, 0])
        f = out[:, 0] * (p[:, :1] * by)
        np.multiply(f, dx, out=out[:, 1])
        np.multiply(f, dy, out=out[:, 2])
        np.subtract(d2, 2.0, out=out[:, 3])
        out[:, 3] *= f
        out[:, 3] *= np.where(p[:, 3:4] ** 2 > 1e-6, p[:, 3:4], 0.0)
        out[:, 4] = wk
        return out

    return levenberg_many(residual, slopes, start)


def image_fits(x: np.ndarray, y: np.ndarray, v: np.ndarray, w: np.ndarray, var: np.ndarray, img: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Flux and place of a round Gaussian of variance var in each row of pixels, and a sky for each image img (from 0), by levenberg_many from flux and place; an image without pixels has a sky of zero."""
    mine = (img[:, None] == np.arange(img.max(initial=0) + 1)[:, None]) * w[:, None]
    weight = np.einsum("rkn,rkn->rk", mine, mine)
    sky = np.einsum("rkn,rn->rk", mine, w * v) / np.where(weight > 0, weight, 1.0)

    def unit(p: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
        dx, dy = x[k] - p[:, 1:2], y[k] - p[:, 2:3]
        return dx, dy, np.exp(-0.5 * (dx * dx + dy * dy) / var[k]) / (2 * np.pi * var[k])

    def residual(p: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (p[:, :1] * unit(p, k)[-1] + np.take_along_axis(p[:, 3:], img[k], 1) - v[k]) * w[k]

    def slopes(p: np.ndarray, k: np.ndarray) -> np.ndarray:
        dx, dy, u = unit(p, k)
        u *= w[k]
        f = p[:, :1] / var[k] * u
        return np.concatenate([np.stack([u, f * dx, f * dy], axis=1), mine[k]], axis=1)

    return levenberg_many(residual, slopes, np.column_stack([start, sky]))


def lbfgs(f, x0: np.ndarray, steps: int = 100, memory: int = 8) -> tuple[np.ndarray, float]:
    """Limited-memory quasi-Newton with numeric gradients and backtracking."""

    def grad(x: np.ndarray) -> np.ndarray:
        h = 1e-6 * np.maximum(1.0, np.abs(x))
        return np.array([(f(x + np.eye(len(x))[k] * h[k]) - f(x - np.eye(len(x))[k] * h[k])) / (2 * h[k]) for k in range(len(x))])

    x = np.array(x0, float)
    fx, g = f(x), grad(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        t = 1.0
        while t > 1e-12 and not f(x - t * q) <= fx - 1e-4 * t * (g @ q):
            t /= 2
        if t <= 1e-12:
            break
        new = x - t * q
        gn = grad(new)
        if (new - x) @ (gn - g) > 1e-12:
            past = [*past, (new - x, gn - g)][-memory:]
        done = abs(fx - f(new)) < 1e-12
        x, fx, g = new, f(new), gn
        if done:
            break
    return x, float(fx)


def stretch_move(logp, start: np.ndarray, steps: int, seed: int = 1, a: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Ensemble sampling: halves of the walkers move along lines through walkers of the other half."""
    rng = np.random.default_rng(seed)
    x, n, d = start.copy(), len(start), start.shape[1]
    lp = np.array([logp(v) for v in x])
    chain = []
    for _ in range(steps):
        for mine, other in ((slice(0, n // 2), slice(n // 2, n)), (slice(n // 2, n), slice(0, n // 2))):
            m = x[mine]
            z = ((a - 1) * rng.random(len(m)) + 1) ** 2 / a
            partner = x[other][rng.integers(0, len(x[other]), len(m))]
            to = partner + z[:, None] * (m - partner)
            lt = np.array([logp(v) for v in to])
            take = np.log(rng.random(len(m))) < (d - 1) * np.log(z) + lt - lp[mine]
            x[mine] = np.where(take[:, None], to, m)
            lp[mine] = np.where(take, lt, lp[mine])
        chain.append(x.copy())
    return np.concatenate(chain), lp


def stretch_moves(logp, start: np.ndarray, steps: int, seed: int = 1, a: float = 2.0) -> np.ndarray:
    """stretch_move of one parameter for many problems (rows of start) at once: each takes the draws that it would take alone with this seed. logp maps (problems, walkers) to the same shape; the chain is (steps, problems, walkers)."""
    rng = np.random.default_rng(seed)
    x, n = start.copy(), start.shape[1]
    lp = logp(x)
    chain = np.empty((steps, *x.shape))
    for k in range(steps):
        for mine, other in ((slice(0, n // 2), slice(n // 2, n)), (slice(n // 2, n), slice(0, n // 2))):
            m, rest = x[:, mine], x[:, other]
            z = ((a - 1) * rng.random(m.shape[1]) + 1) ** 2 / a
            partner = rest[:, rng.integers(0, rest.shape[1], m.shape[1])]
            to = partner + z * (m - partner)
            lt = logp(to)
            take = np.log(rng.random(m.shape[1])) < lt - lp[:, mine]
            x[:, mine] = np.where(take, to, m)
            lp[:, mine] = np.where(take, lt, lp[:, mine])
        chain[k] = x
    return chain


def em_fit(stamp: np.ndarray, k: int, rounds: int = 100, alpha: float = 0.0, far: float = 100.0, sky: bool = False) -> np.ndarray:
    """Mixture of k Gaussians for a stamp by EM: rows (amp, mx, my, vxx, vxy, vyy). Squared distances from `far` on get no weight; with sky, a uniform component takes its share and all pixels at or below zero."""
    h, w = stamp.shape
    y, x = np.mgrid[:h, :w]
    p = np.maximum(stamp, 0).ravel() / max(1e-300, np.maximum(stamp, 0).sum())
    pos = np.stack([x.ravel(), y.ravel()], axis=1).astype(float)
    mu = np.repeat((p[:, None] * pos).sum(axis=0)[None], k, axis=0)
    base = max(0.5, float((p * ((pos - mu[0]) ** 2).sum(axis=1)).sum() / 2))
    var = np.stack([np.eye(2) * base * 4.0 ** (j - (k - 1) / 2) for j in range(k)])
    amp, flat = np.full(k, 1.0 / (k + sky)), 1.0 / (k + 1) if sky else 0.0
    for _ in range(rounds):
        dens = []
        for a, m, v in zip(amp, mu, var, strict=True):
            det = np.linalg.det(v)
            if det <= 0:
                raise ValueError("a component's variance has no positive determinant")
            d = pos - m
            d2 = np.einsum("ni,ij,nj->n", d, np.linalg.inv(v), d)
            dens.append(np.where(d2 < far, a / (2 * np.pi * np.sqrt(det)) * np.exp(-0.5 * np.minimum(d2, far)), 0.0))
        dens = np.array(dens)
        total = dens.sum(axis=0) + flat / len(p)
        r = p * dens / np.maximum(total, 1e-300)
        weight = r.sum(axis=1)
        for j in range(k):
            mu[j] = (r[j][:, None] * pos).sum(axis=0) / max(weight[j], 1e-300)
            d = pos - mu[j]
            var[j] = (alpha * np.eye(2) + (r[j][:, None, None] * d[:, :, None] * d[:, None, :]).sum(axis=0)) / (weight[j] + alpha)
        amp = weight
        flat = float((p * (flat / len(p)) / np.maximum(total, 1e-300)).sum()) if sky else 0.0
    return np.column_stack([amp, mu, var[:, 0, 0], var[:, 0, 1], var[:, 1, 1]])


def em_fits(stamps: np.ndarray, k: int, rounds: int = 100, alpha: float = 0.0, far: float = 100.0, chunk: int = 64) -> np.ndarray:
    """em_fit without a sky for each of many stamps (n, h, w): (n, k, 6). All stamps of a chunk take a round together, as products with the powers of the places up to the second."""
    n, h, w = stamps.shape
    if n > chunk:
        return np.concatenate([em_fits(stamps[i : i + chunk], k, rounds, alpha, far) for i in range(0, n, chunk)])
    cy, cx = (h - 1) / 2, (w - 1) / 2
    y, x = (a.ravel() for a in np.mgrid[:h, :w] - np.array([cy, cx])[:, None, None])
    powers = np.stack([np.ones(h * w), x, y, x * x, x * y, y * y])
    p = np.maximum(stamps, 0).reshape(n, -1)
    p = p / np.maximum(p.sum(axis=1), 1e-300)[:, None]
    s = p @ powers.T
    base = np.maximum(0.5, (s[:, 3] + s[:, 5] - (2 - s[:, 0]) * (s[:, 1] ** 2 + s[:, 2] ** 2)) / 2)
    wide = base[:, None] * 4.0 ** (np.arange(k) - (k - 1) / 2)
    mx, my = (np.repeat(s[:, c, None] + (s[:, :1] - 1) * z, k, axis=1) for c, z in ((1, cx), (2, cy)))  # no weight: at place 0
    vxx, vxy, vyy, amp = wide, np.zeros((n, k)), wide, np.full((n, k), 1.0 / k)
    for _ in range(rounds):
        det = vxx * vyy - vxy * vxy
        if (det <= 0).any():
            raise ValueError("a component's variance has no positive determinant")
        a, b, c = vyy / det, -vxy / det, vxx / det
        form = np.stack([a * mx * mx + 2 * b * mx * my + c * my * my, -2 * (a * mx + b * my), -2 * (b * mx + c * my), a, 2 * b, c], axis=2)
        d2 = form @ powers
        dens = np.where(d2 < far, (amp / (2 * np.pi * np.sqrt(det)))[:, :, None] * np.exp(-0.5 * np.minimum(d2, far)), 0.0)
        s = (dens * (p / np.maximum(dens.sum(axis=1), 1e-300))[:, None]) @ powers.T
        amp = s[:, :, 0]
        mx, my = ((s[:, :, c] + amp * z) / np.maximum(amp, 1e-300) - z for c, z in ((1, cx), (2, cy)))
        vxx, vxy, vyy = ((s[:, :, i] - amp * u * v + alpha * (i != 4)) / (amp + alpha) for i, u, v in ((3, mx, mx), (4, mx, my), (5, my, my)))
    return np.stack([amp, mx + cx, my + cy, vxx, vxy, vyy], axis=2)
