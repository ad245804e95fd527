"""Solvers whose vectors are tables: a few numbers an iteration reach the driver, and images only
where all their planes are small (``measure.SENT_PIXELS``) and are sent from there to the samples.

Vectors are DataFrames of a row a pixel, written to the shared folder once an iteration, which cuts lineage and lets a lost
executor's work be done again from the last iterate. Dot products are aggregates. L-BFGS keeps its pairs as two
arrays beside each pixel and works out its direction from their dot products alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import Objective, Point


def _sums(table: DataFrame, **columns: Column) -> dict[str, float]:
    row = table.agg(*[c.alias(n) for n, c in columns.items()]).first()
    return {n: row[n] or 0.0 for n in columns}


def _dot(a, b) -> Column:
    return F.sum(F.col(a) * F.col(b))


def conjugate_gradient(obj: Objective, start: DataFrame | None = None, iterations: int = 20, tol: float = 1e-6, atol: float = 0.0) -> DataFrame:
    """For linear models and quadratic terms. Stops where the residual's norm is at most max(atol, tol·|b|), or p·Np vanishes."""
    keys, scratch = obj.keys, obj.scratch
    flat = obj.flat()
    first = flat if start is None else obj.evaluate(start, False).table
    least = max(atol, tol * math.sqrt(_sums(flat, b=_dot("gradient", "gradient"))["b"]))
    state = first.select(*keys, F.col("value").alias("vx"), (-F.col("gradient")).alias("vr"), (-F.col("gradient")).alias("vp"))
    rr, held = _sums(state, rr=_dot("vr", "vr"))["rr"], None
    for _ in range(iterations):
        if math.sqrt(rr) <= least:
            break
        curve = obj.curvature(state.select(*keys, F.col("vp").alias("value"))).withColumnRenamed("value", "ap")
        now = scratch.save(state.join(curve, keys))
        if held is not None:
            scratch.drop(held)
        held, pap = now, _sums(now, pap=_dot("vp", "ap"))["pap"]
        if abs(pap) < 1e-30:
            state = now
            break
        alpha = rr / pap
        step = now.select(*keys, (F.col("vx") + alpha * F.col("vp")).alias("vx"), (F.col("vr") - alpha * F.col("ap")).alias("vr"), "vp")
        new = _sums(step, rr=_dot("vr", "vr"))["rr"]
        state = step.withColumn("vp", F.col("vr") + new / rr * F.col("vp"))
        rr = new
    return scratch.save(state.select(*keys, F.col("vx").alias("value")))


def lipschitz(obj: Objective, iterations: int = 10, seed: int = 0) -> float:
    """Largest eigenvalue of the Hessian by power iteration from a vector of hashes."""
    at = F.xxhash64(F.lit(seed), *obj.keys) / float(1 << 62)
    v, value, held = obj.scratch.save(obj.zeros().withColumn("value", at)), 1.0, None
    for _ in range(iterations):
        norm = math.sqrt(_sums(v, n=_dot("value", "value"))["n"])
        if norm == 0:
            return 1.0
        unit = v.withColumn("value", F.col("value") / norm)
        both = obj.scratch.save(unit.withColumnRenamed("value", "v").join(obj.curvature(unit), obj.keys))
        if held is not None:
            obj.scratch.drop(held)
        held, value, v = both, _sums(both, d=_dot("v", "value"))["d"], both.select(*obj.keys, "value")
    return max(value, 1e-12)


def fista(obj: Objective, start: DataFrame | None = None, iterations: int = 20, positive: bool = False, tol: float = 1e-6) -> DataFrame:
    """Accelerated gradient steps of 1/(1.2 L); stops where the relative change is at most ``tol``."""
    keys, step, t = obj.keys, 1 / (1.2 * lipschitz(obj)), 1.0
    value = F.col("value")
    state = (obj.zeros() if start is None else start).select(*keys, value.alias("vx"), value.alias("vy"))
    held = None
    for _ in range(iterations):
        at = obj.evaluate(state.select(*keys, F.col("vy").alias("value")), False).table
        new = value - step * F.col("gradient")
        new = F.greatest(new, F.lit(0.0)) if positive else new
        now = obj.scratch.save(state.select(*keys, "vx").join(at, keys).select(*keys, "vx", new.alias("new")))
        if held is not None:
            obj.scratch.drop(held)
        held, d = now, F.col("new") - F.col("vx")
        sums = _sums(now, change=F.sum(d * d), size=_dot("new", "new"))
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        state = now.select(*keys, F.col("new").alias("vx"), (F.col("new") + (t - 1) / after * d).alias("vy"))
        t = after
        if math.sqrt(sums["change"]) <= tol * max(math.sqrt(sums["size"]), 1e-12):
            break
    return obj.scratch.save(state.select(*keys, F.col("vx").alias("value")))


# ---------------------------------------------------------------- line search


def _cubic(a: float, fa: float, da: float, b: float, fb: float, db: float, low: float, high: float) -> float:
    """The least point of the cubic through two values and slopes, held between bounds; their middle if it has none."""
    if a > b:
        a, fa, da, b, fb, db = b, fb, db, a, fa, da
    bend = da + db - 3 * (fa - fb) / (a - b)
    inside = bend * bend - da * db
    if inside < 0:
        return (low + high) / 2
    root = math.sqrt(inside)
    wide = db - da + 2 * root
    at = b - (b - a) * ((db + root - bend) / wide) if wide else (low + high) / 2
    return min(max(at, low), high)


def strong_wolfe(phi: Callable, f0: float, slope0: float, step: float, c1: float = 1e-4, c2: float = 0.9, most: int = 25):
    """A step with enough decrease and a slope flat enough: (step, value, slope, what ``phi`` gave beside them).

    ``phi(t)`` gives (value, slope, more). Steps grow until the wanted ones are between two that were tried, then this
    bracket is narrowed by cubic interpolation; where ``most`` trials don't do, the best of them is taken.
    """
    before = (0.0, f0, slope0, None)
    tried = []
    enough = lambda t, f: f <= f0 + c1 * t * slope0
    low = high = None
    for k in range(most):
        at = (step, *phi(step))
        tried.append(at)
        _, f, slope, _more = at
        if not math.isfinite(f):
            low, high = before, at
            break
        if not enough(step, f) or (k and f >= before[1]):
            low, high = before, at
            break
        if abs(slope) <= -c2 * slope0:
            return at
        if slope >= 0:
            low, high = at, before
            break
        least, largest = step + 0.01 * (step - before[0]), 10 * step
        following = _cubic(before[0], before[1], before[2], step, f, slope, least, largest)
        before, step = at, following
    wide = math.inf
    while low is not None and len(tried) < most:
        a, b = sorted((low[0], high[0]))
        if b - a <= 1e-14 * max(b, 1e-300):
            break
        if math.isfinite(high[1]) and b - a <= 0.66 * wide:
            at = _cubic(low[0], low[1], low[2], high[0], high[1], high[2], a, b)
            margin = 1e-3 * (b - a)  # a trial at an end tells nothing
            at = min(max(at, a + margin), b - margin)
        else:  # the last trial hardly narrowed the bracket
            at = (a + b) / 2
        wide = b - a
        now = (at, *phi(at))
        tried.append(now)
        _, f, slope, _more = now
        if not math.isfinite(f) or not enough(at, f) or f >= low[1]:
            high = now
            continue
        if abs(slope) <= -c2 * slope0:
            return now
        if slope * (high[0] - low[0]) >= 0:
            high = low
        low = now
    good = [t for t in tried if math.isfinite(t[1]) and enough(t[0], t[1])]
    return min(good, key=lambda t: (t[1], abs(t[2]))) if good else None


# ---------------------------------------------------------------- L-BFGS


def _direction(n: int, dots: dict[str, float]) -> tuple[list[float], list[float], float]:
    """Two-loop recursion on coefficients: the direction is Σ cs_i s_i + Σ cy_i y_i + cq q, from dot products alone."""
    sy = lambda i, j: dots[f"s{i}y{j}"]
    cs, cy, cq = [0.0] * n, [0.0] * n, 1.0
    used = [0.0] * n
    for i in reversed(range(n)):
        along = dots[f"s{i}q"] * cq + sum(sy(i, j) * cy[j] for j in range(n))
        used[i] = along / sy(i, i)
        cy[i] -= used[i]
    if n:
        scale = sy(n - 1, n - 1) / dots[f"y{n - 1}y{n - 1}"]
        cy, cq = [scale * c for c in cy], scale * cq
    for i in range(n):
        yy = lambda j, i=i: dots[f"y{min(i, j)}y{max(i, j)}"]
        along = dots[f"y{i}q"] * cq + sum(yy(j) * cy[j] for j in range(n)) + sum(sy(j, i) * cs[j] for j in range(n))
        cs[i] += used[i] - along / sy(i, i)
    return [-c for c in cs], [-c for c in cy], -cq


def lbfgs(obj: Objective, start: DataFrame | None = None, iterations: int = 20, memory: int = 7, positive: bool = False, tol: float = 1e-8, seen: list | None = None) -> DataFrame:
    """Limited-memory BFGS. Steps fulfil both Wolfe conditions; with ``positive`` they are projected and need enough decrease.

    ``seen`` gets (step, loss before, slope before, loss, slope) of every step.
    """
    keys, scratch = obj.keys, obj.scratch
    x0 = obj.zeros() if start is None else start.select(*keys, "value")
    if positive:
        x0 = x0.withColumn("value", F.greatest("value", F.lit(0.0)))
    point = obj.evaluate(x0)
    none = F.array().cast("array<double>")
    state, n = point.table.select(*keys, F.col("value").alias("vx"), F.col("gradient").alias("vg"), none.alias("hs"), none.alias("hy")), 0
    result, made = point.table.select(*keys, "value"), [point.table]
    for _ in range(iterations):
        free = ~((F.col("vx") <= 0) & (F.col("vg") > 0)) if positive else F.lit(True)
        state = state.withColumn("q", F.when(free, F.col("vg")).otherwise(0.0))
        s, y, q = (lambda i: F.get("hs", F.lit(i))), (lambda i: F.get("hy", F.lit(i))), F.col("q")
        wanted = {"largest": F.max(F.abs(q)), "size": F.sum(F.abs(F.col("vg")))}
        for i in range(n):
            wanted |= {f"s{i}q": F.sum(s(i) * q), f"y{i}q": F.sum(y(i) * q)}
            wanted |= {f"s{i}y{j}": F.sum(s(i) * y(j)) for j in range(n)} | {f"y{i}y{j}": F.sum(y(i) * y(j)) for j in range(i, n)}
        dots = _sums(state, **wanted)
        if dots["largest"] <= tol:
            break
        cs, cy, cq = _direction(n, dots)
        d = F.when(free, sum((cs[i] * s(i) + cy[i] * y(i) for i in range(n)), cq * q)).otherwise(0.0)
        held = scratch.save(state.withColumn("d", d))
        slope = _sums(held, slope=_dot("d", "vg"))["slope"]
        if slope >= 0:
            scratch.drop(held)
            held, n = scratch.save(state.withColumns({"d": -q, "hs": none, "hy": none})), 0
            slope = _sums(held, slope=_dot("d", "vg"))["slope"]

        def phi(t: float, held=held, n=n):
            at = F.col("vx") + t * F.col("d")
            at = F.greatest(at, F.lit(0.0)) if positive else at
            new = obj.evaluate(held.select(*keys, at.alias("value")))
            made.append(new.table)
            both = held.join(new.table, keys)
            moved = _sums(both, slope=_dot("gradient", "d"), moved=F.sum(F.col("vg") * (F.col("value") - F.col("vx"))))
            return new.loss, moved["slope"], (new, moved["moved"])

        first = 1.0 if n else min(1.0, 1 / max(dots["size"], 1e-300))
        if positive:
            found, step = None, first
            for _try in range(40):
                f, sl, more = phi(step)
                if f <= point.loss + 1e-4 * more[1]:
                    found = (step, f, sl, more)
                    break
                step *= 0.5
        else:
            found = strong_wolfe(phi, point.loss, slope, first)
        if found is None:
            break
        if seen is not None:
            seen.append((found[0], point.loss, slope, found[1], found[2]))
        new: Point = found[3][0]
        both = held.join(new.table, keys)
        ds, dy = F.col("value") - F.col("vx"), F.col("gradient") - F.col("vg")
        size = _sums(both, sy=F.sum(ds * dy), yy=F.sum(dy * dy))
        keep = size["sy"] > 1e-12 * size["yy"]
        more = lambda a, v: F.slice(F.concat(a, F.array(v)), -min(n + 1, memory), memory) if keep else F.col(a)
        state = scratch.save(both.select(*keys, F.col("value").alias("vx"), F.col("gradient").alias("vg"), more("hs", ds).alias("hs"), more("hy", dy).alias("hy")))
        n = min(n + 1, memory) if keep else n
        scratch.drop(held, *[t for t in made if t is not new.table])
        made, point, result = [new.table], new, new.table.select(*keys, "value")
    return scratch.save(result)


def solve(obj: Objective, start: DataFrame | None = None, solver: str = "lbfgs", positive: bool = False, iterations: int = 20) -> DataFrame:
    """FISTA if asked for; else the projected quasi-Newton method under positivity; else the solver named: (keys, value)."""
    if solver == "fista":
        return fista(obj, start, iterations, positive)
    if positive or solver == "lbfgs":
        return lbfgs(obj, start, iterations, positive=positive)
    if solver == "cg":
        return conjugate_gradient(obj, start, iterations)
    raise ValueError(f"unknown solver {solver}")


def sweep(make: Callable[[float], Objective], values: list[float], start: DataFrame | None = None, **how) -> dict[float, DataFrame]:
    """Solutions for a list of strengths, each begun from the one before; ``make`` gives the objective of a strength."""
    out: dict[float, DataFrame] = {}
    for v in values:
        out[v] = start = solve(make(v), start, **how)
    return out
