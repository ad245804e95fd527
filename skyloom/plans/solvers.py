"""Iterative solvers: a loop on the driver, one Spark job an evaluation over cached visibilities.

The image is the only thing that lives on the driver (``measure.MOST_PIXELS`` bounds it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import measure, objective
from .iterative import strong_wolfe


def cg_step(op: measure.Measurement, joint: bool = False) -> DataFrame:
    """The first conjugate-gradient iterate from zero: α b with α = b·b / b·Nb.

    Each channel is a system of its own with its own α; with ``joint`` the cube is one system, as in ``conjugate_gradient``.
    """
    b = objective.right_hand_side(op)
    n = objective.normal(op, b).select("chan", "y", "x", F.col("value").alias("n"))
    both = b.join(n, ["chan", "y", "x"])
    alpha = both.groupBy(*([] if joint else ["chan"])).agg((F.sum(F.col("value") * F.col("value")) / F.sum(F.col("value") * F.col("n"))).alias("alpha"))
    scaled = b.crossJoin(F.broadcast(alpha)) if joint else b.join(F.broadcast(alpha), "chan")
    return scaled.select("chan", "y", "x", (F.col("alpha") * F.col("value")).alias("value"))


def fista_first_step(op: measure.Measurement, step: float, positive: bool = False) -> DataFrame:
    """From zero: step times the right-hand side, projected if asked for."""
    x = step * F.col("value")
    return objective.right_hand_side(op).withColumn("value", F.greatest(x, F.lit(0.0)) if positive else x)


class Problem:
    """Weighted least squares with a Laplacian term, evaluated in one pass over the visibilities.

    Each task sums the loss and the adjoint of its samples on the image's pixels, so a job returns a number and
    H·W values a channel, whatever the number of visibilities.
    """

    def __init__(self, op: measure.Measurement, channels: list[int], lambda_r: float = 0.0, conjugate: bool = True, sigma_floor: float = 0.0):
        self.op, self.channels, self.lambda_r, self.floor = op, list(channels), lambda_r, sigma_floor
        self.shape = (len(channels), op.height, op.width)
        if np.prod(self.shape) > measure.MOST_PIXELS:
            raise ValueError("the image is too large for one driver")
        self.sign = -1.0 if conjugate else 1.0
        h, w = op.height, op.width
        self.maps: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        pb = {r["beam"]: np.zeros(h * w) for r in op.pb.select("beam").distinct().collect()}
        for r in op.pb.select("beam", "y", "x", "value").toLocalIterator():
            pb[r["beam"]][r["y"] * w + r["x"]] = r["value"]
        rows: dict[int, list] = {b: [] for b in pb}
        for r in op.weights.toLocalIterator():
            rows[r["beam"]].append((r["y_out"] * w + r["x_out"], r["y_in"] * w + r["x_in"], r["w"]))
        for b, e in rows.items():
            out, src, wt = (np.array(c) for c in zip(*e)) if e else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            self.maps[b] = (out.astype(int), src.astype(int), wt.astype(float), pb[b])

    def _pass(self, x: np.ndarray, with_data: bool) -> tuple[float, np.ndarray]:
        h, w, cell, maps, floor, sign = self.op.height, self.op.width, self.op.cell, self.maps, self.floor, self.sign
        place = {c: i for i, c in enumerate(self.channels)}
        sent = self.op.vis.sparkSession.sparkContext.broadcast(x)

        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            y, k = np.arange(h) - h // 2, np.arange(w) - w // 2
            loss, grad = np.zeros(len(place)), np.zeros((len(place), h * w))
            for pdf in batches:
                for (c, b), at in pdf.groupby(["chan", "beam"]).indices.items():
                    if c not in place or b not in maps:
                        continue
                    out, src, wt, pb = maps[b]
                    plane = np.bincount(out, wt * sent.value[place[c]].ravel()[src], h * w) * pb
                    back = np.zeros(h * w, complex)
                    for a in range(0, len(at), 4096):
                        p = pdf.iloc[at[a : a + 4096]]
                        ev = np.exp(-1j * np.outer(p.vr, y))
                        eu = np.exp(1j * np.outer(p.ur, k))
                        res = ((ev @ plane.reshape(h, w)) * eu).sum(1) * cell**2
                        if with_data:
                            res = res - (p.re.to_numpy() + sign * 1j * p.im.to_numpy())
                        var = np.maximum(p.sigma.to_numpy(), floor) ** 2
                        loss[place[c]] += 0.5 * (np.abs(res) ** 2 / var).sum()
                        back += (ev.conj() * (res / var)[:, None]).T.dot(eu.conj()).ravel() * cell**2
                    z = back.real * pb
                    grad[place[c]] += np.bincount(src, wt * z[out], h * w)
            for i in range(len(place)):
                yield pd.DataFrame({"c": i, "p": np.arange(-1, h * w), "v": np.concatenate(([loss[i]], grad[i]))})

        good = self.op.vis.where(~F.col("flag")).select("chan", "beam", "ur", "vr", "re", "im", "sigma")
        sums = good.mapInPandas(run, "c int, p int, v double").groupBy("c", "p").agg(F.sum("v").alias("v")).toPandas()
        total, grad = 0.0, np.zeros((len(place), h * w))
        if len(sums):
            first = sums.p < 0
            total = float(sums.v[first].sum())
            grad[sums.c[~first], sums.p[~first]] = sums.v[~first]
        sent.unpersist()
        return total, grad.reshape(self.shape)

    def _laplacian(self, x: np.ndarray) -> np.ndarray:
        return x - 0.25 * sum(np.roll(x, s, axis) for axis in (1, 2) for s in (1, -1))

    def _regularised(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        if not self.lambda_r:
            return 0.0, np.zeros_like(x)
        scale, lap = self.lambda_r * self.op.cell**4 * self.op.height * self.op.width, self._laplacian(x)
        return 0.5 * scale * float((lap * lap).sum()), scale * self._laplacian(lap)

    def loss_and_gradient(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        x = x.reshape(self.shape)
        (a, g), (b, h) = self._pass(x, True), self._regularised(x)
        return a + b, g + h

    def apply_normal_operator(self, x: np.ndarray) -> np.ndarray:
        x = x.reshape(self.shape)
        return self._pass(x, False)[1] + self._regularised(x)[1]

    def quadratic_rhs(self) -> np.ndarray:
        return -self._pass(np.zeros(self.shape), True)[1]


def conjugate_gradient(problem: Problem, x: np.ndarray, iterations: int = 20, tol: float = 1e-6, atol: float = 0.0) -> np.ndarray:
    """Stops where the residual's norm is at most max(atol, tol·|b|), or p·Np vanishes."""
    b = problem.quadratic_rhs()
    r = b - problem.apply_normal_operator(x)
    p, rr = r.copy(), float((r * r).sum())
    for _ in range(iterations):
        if np.sqrt(rr) <= max(atol, tol * float(np.linalg.norm(b))):
            break
        ap = problem.apply_normal_operator(p)
        curve = float((p * ap).sum())
        if abs(curve) < 1e-30:
            break
        x, r = x + rr / curve * p, r - rr / curve * ap
        new = float((r * r).sum())
        p, rr = r + new / rr * p, new
    return x


def lipschitz(problem: Problem, iterations: int = 10, seed: int = 0) -> float:
    """Largest eigenvalue of the normal operator by power iteration."""
    v, value = np.random.default_rng(seed).standard_normal(problem.shape), 1.0
    for _ in range(iterations):
        n = float(np.linalg.norm(v))
        if n == 0:
            return 1.0
        v = v / n
        nv = problem.apply_normal_operator(v)
        value, v = float((v * nv).sum()), nv
    return max(value, 1e-12)


def fista(problem: Problem, x: np.ndarray, iterations: int = 20, positive: bool = False, tol: float = 1e-6) -> np.ndarray:
    """Accelerated gradient steps of 1/(1.2 L); stops where the relative change is at most ``tol``."""
    step, b, y, t = 1 / (1.2 * lipschitz(problem)), problem.quadratic_rhs(), x.copy(), 1.0
    for _ in range(iterations):
        new = y - step * (problem.apply_normal_operator(y) - b)
        new = np.maximum(new, 0) if positive else new
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, change = new + (t - 1) / t_next * (new - x), float(np.linalg.norm(new - x))
        x, t = new, t_next
        if change <= tol * max(float(np.linalg.norm(x)), 1e-12):
            break
    return x


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, iterations: int = 20, memory: int = 7, positive: bool = False, tol: float = 1e-8, seen: list | None = None) -> np.ndarray:
    """Limited-memory BFGS. Steps fulfil both Wolfe conditions; with ``positive`` they are projected, held pixels are left out of the direction, and enough decrease will do.

    ``seen`` gets (step, loss before, slope before, loss, slope) of every step.
    """
    project = (lambda z: np.maximum(z, 0)) if positive else (lambda z: z)
    x = project(x)
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        free = ~((x <= 0) & (g > 0)) if positive else np.ones_like(x, bool)
        q = np.where(free, g, 0.0)
        if np.abs(q).max() <= tol:
            break
        d, used = q.copy(), []
        for s, y in reversed(pairs):
            a = float((s * d).sum()) / float((s * y).sum())
            used.append(a)
            d -= a * y
        if pairs:
            s, y = pairs[-1]
            d *= float((s * y).sum()) / float((y * y).sum())
        for (s, y), a in zip(pairs, reversed(used)):
            d += (a - float((y * d).sum()) / float((s * y).sum())) * s
        d = np.where(free, -d, 0.0)
        if float((d * g).sum()) >= 0:
            d, pairs = np.where(free, -g, 0.0), []
        slope, step = float((d * g).sum()), 1.0 if pairs else min(1.0, 1.0 / max(float(np.abs(g).sum()), 1e-300))

        def phi(t: float, x=x, d=d):
            new = project(x + t * d)
            new_value, new_g = f(new)
            return new_value, float((new_g * d).sum()), (new, new_g)

        if positive:
            found = None
            for _try in range(40):
                new_value, new_slope, (new, new_g) = phi(step)
                if new_value <= value + 1e-4 * float((g * (new - x)).sum()):
                    found = (step, new_value, new_slope, (new, new_g))
                    break
                step *= 0.5
        else:
            found = strong_wolfe(phi, value, slope, step)
        if found is None:
            break
        if seen is not None:
            seen.append((found[0], value, slope, found[1], found[2]))
        new_value, (new, new_g) = found[1], found[3]
        s, y = new - x, new_g - g
        if float((s * y).sum()) > 1e-12 * float((y * y).sum()):
            pairs = [*pairs, (s, y)][-memory:]
        x, value, g = new, new_value, new_g
    return x


def solve(problem: Problem, x: np.ndarray | None = None, solver: str = "lbfgs", positive: bool = False, iterations: int = 20) -> np.ndarray:
    """FISTA if asked for; else the projected quasi-Newton method under positivity; else the solver named."""
    x = np.zeros(problem.shape) if x is None else x.astype(float).reshape(problem.shape)
    if solver == "fista":
        return fista(problem, x, iterations, positive)
    if positive or solver == "lbfgs":
        return lbfgs(problem.loss_and_gradient, x, iterations, positive=positive)
    if solver == "cg":
        return conjugate_gradient(problem, x, iterations)
    raise ValueError(f"unknown solver {solver}")


class LowRankProblem:
    """A cube as Σ_k basis[k, chan] x_k: the unknowns are coefficient maps (k, H, W).

    The Laplacian term is taken on the coefficient maps, and negative cube values are penalised. ``continuum_only``
    channels have no line components (the first ``n_line`` of the basis), in the objective and in ``cube`` alike.
    Sigma is at least 1e-6.
    """

    def __init__(self, op: measure.Measurement, channels: list[int], basis: np.ndarray, lambda_r: float = 0.0, lambda_pos: float = 0.0, n_line: int | None = None, continuum_only: list[int] = ()):
        self.data = Problem(op, channels, sigma_floor=1e-6)
        if basis.shape[1] != len(channels):
            raise ValueError("the basis needs a column for each channel")
        self.basis = np.array(basis, float)
        for c in continuum_only:
            self.basis[: len(basis) if n_line is None else n_line, self.data.channels.index(c)] = 0.0
        self.lambda_r, self.lambda_pos = lambda_r, lambda_pos
        self.shape = (len(basis), op.height, op.width)
        self.smooth = Problem.__new__(Problem)
        self.smooth.op, self.smooth.lambda_r = op, lambda_r

    def cube(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("kc,kyx->cyx", self.basis, x.reshape(self.shape))

    def _to_coefficients(self, cube: np.ndarray) -> np.ndarray:
        return np.einsum("kc,cyx->kyx", self.basis, cube)

    def loss_and_gradient(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        x = x.reshape(self.shape)
        cube = self.cube(x)
        value, g = self.data._pass(cube, True)
        below = np.maximum(-cube, 0)
        value, g = value + self.lambda_pos * float((below * below).sum()), g - 2 * self.lambda_pos * below
        smooth, gs = self.smooth._regularised(x)
        return value + smooth, self._to_coefficients(g) + gs

    def apply_normal_operator(self, x: np.ndarray) -> np.ndarray:
        x = x.reshape(self.shape)
        return self._to_coefficients(self.data._pass(self.cube(x), False)[1]) + self.smooth._regularised(x)[1]

    def quadratic_rhs(self) -> np.ndarray:
        return -self._to_coefficients(self.data._pass(np.zeros(self.data.shape), True)[1])


def with_continuum(line_basis: np.ndarray, frequencies: np.ndarray, order: int = 0, reference: float | None = None) -> tuple[np.ndarray, int]:
    """A line basis with Taylor terms of a continuum below it, and the number of line rows."""
    ref = float(np.mean(frequencies)) if reference is None else reference
    rows = [((frequencies - ref) / ref) ** m for m in range(order + 1)]
    return np.vstack([line_basis, *rows]), len(line_basis)


def sweep(make: Callable[[float], Problem], values: list[float], **how) -> dict[float, np.ndarray]:
    """Solutions for a list of regularisation strengths, each started from the one before."""
    out: dict[float, np.ndarray] = {}
    x = None
    for v in values:
        out[v] = x = solve(make(v), x, **how)
    return out
