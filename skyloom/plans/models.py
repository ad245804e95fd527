"""Imaging models as parts: what makes a cube of parameters, which terms the objective has, and its gradient.

Parameters, cubes and gradients are DataFrames of one row a pixel. A model gives the cube of its parameters and takes a
cube's gradient back to them; terms act on the cube or on the parameters. Any of them go together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fourier, images, measure, objective, spectral
from ..storage import Scratch

PIXEL = ("chan", "y", "x")


class Cube:
    """A plane of pixels for each channel, as they are."""

    keys, linear = PIXEL, True

    def __init__(self, channels: Iterable[int]):
        self.maps = sorted(channels)

    def cube(self, params: DataFrame) -> DataFrame:
        return params

    def back(self, params: DataFrame, gradient: DataFrame) -> DataFrame:
        return gradient


class LowRank:
    """Σ_k basis[k, chan] x_k: coefficient maps (k, y, x). ``continuum_only`` channels lack the first ``n_line`` maps."""

    keys, linear = ("k", "y", "x"), True

    def __init__(self, basis: DataFrame, n_line: int | None = None, continuum_only: Iterable[int] = ()):
        if list(continuum_only):
            basis = spectral.continuum_only(basis, list(continuum_only), 1 << 30 if n_line is None else n_line)
        self.basis = basis
        self.maps = sorted(r["k"] for r in basis.select("k").distinct().collect())

    def cube(self, params: DataFrame) -> DataFrame:
        return spectral.cube(params, self.basis)

    def back(self, params: DataFrame, gradient: DataFrame) -> DataFrame:
        b = self.basis.select("k", "chan", F.col("value").alias("weight"))
        return gradient.join(b, "chan").groupBy("k", "y", "x").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def with_continuum(lines: DataFrame, channels: DataFrame, order: int = 0, reference: float | None = None, continuum_only: Iterable[int] = ()) -> LowRank:
    """A line basis (k from 0) with Taylor terms of a continuum behind it, about the mean frequency if no other is given."""
    n = lines.select("k").distinct().count()
    ref = channels.agg(F.avg("frequency")).first()[0] if reference is None else reference
    taylor = spectral.continuum_basis(channels, order, ref, n)
    return LowRank(lines.select("k", "chan", "value").unionByName(taylor.select(F.col("k").cast("int").alias("k"), "chan", "value")), n, continuum_only)


class _PerPixel:
    """Nonlinear models: a pixel's parameters side by side, and a value and its derivatives for each channel."""

    keys, linear = ("k", "y", "x"), False

    def __init__(self, channels: DataFrame, n: int):
        self.channels, self.maps = channels, list(range(n))

    def values(self, p: list) -> tuple:
        """The value and its derivatives by the parameters ``p``, all columns."""
        raise NotImplementedError

    def _wide(self, params: DataFrame) -> DataFrame:
        return params.groupBy("y", "x").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("value"))), F.lit(0.0)).alias(f"p{k}") for k in self.maps])

    def _parameters(self) -> list:
        return [F.col(f"p{k}") for k in self.maps]

    def cube(self, params: DataFrame) -> DataFrame:
        at = self._wide(params).crossJoin(F.broadcast(self.channels.select("chan", "frequency")))
        return at.select("chan", "y", "x", self.values(self._parameters())[0].alias("value"))

    def back(self, params: DataFrame, gradient: DataFrame) -> DataFrame:
        at = gradient.join(F.broadcast(self.channels.select("chan", "frequency")), "chan").join(self._wide(params), ["y", "x"])
        slopes = self.values(self._parameters())[1]
        sums = at.groupBy("y", "x").agg(*[F.sum(F.col("value") * d).alias(f"d{k}") for k, d in zip(self.maps, slopes)])
        each = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"d{k}").alias("value")) for k in self.maps]))
        return sums.select("y", "x", each).select("k", "y", "x", "value")


class GaussianMixture(_PerPixel):
    """Free Gaussians along the channel numbers: maps 3i, 3i + 1, 3i + 2 are height, centre and width of component i.

    The width is at least 1e-3, and below that its derivative is 0.
    """

    LEAST = 1e-3

    def __init__(self, channels: DataFrame, components: int):
        super().__init__(channels, 3 * components)

    def values(self, p):
        value, slopes = F.lit(0.0), []
        for a, mu, sig in zip(p[0::3], p[1::3], p[2::3]):
            s = F.greatest(sig, F.lit(self.LEAST))
            z = (F.col("chan") - mu) / s
            g = F.exp(-0.5 * z * z)
            value = value + a * g
            slopes += [g, a * g * z / s, F.when(sig > self.LEAST, a * g * z * z / s).otherwise(0.0)]
        return value, slopes


class PowerLaw(_PerPixel):
    """Amplitude times (ν/ν₀)^-α: map 0 is the amplitude at ``reference``, map 1 is α."""

    def __init__(self, channels: DataFrame, reference: float):
        super().__init__(channels, 2)
        self.reference = reference

    def values(self, p):
        ratio = F.col("frequency") / self.reference
        g = F.pow(ratio, -p[1])
        return p[0] * g, [g, -p[0] * g * F.ln(ratio)]


def two_maps(channels: Iterable[int], spark) -> LowRank:
    """A sky of two maps that the data see as their sum: the second may have a power spectrum of its own (``Spectrum``)."""
    rows = [(k, c, 1.0) for k in (0, 1) for c in channels]
    return LowRank(spark.createDataFrame(rows, "k int, chan int, value double"))


# ---------------------------------------------------------------- terms: loss (one row) and gradient of a table (plane, y, x, value)


@dataclass
class Laplacian:
    """λ/2 Σ |cell² FFT(x·taper) |K||²."""

    lam: float
    radius: float = 0.98

    def loss(self, x, op):
        return objective.laplacian(x, op.height, op.width, op.cell, self.lam, self.radius).agg(F.sum("loss").alias("loss"))

    def gradient(self, x, op):
        return objective.laplacian_gradient(x, op.height, op.width, op.cell, self.lam, self.radius)


@dataclass
class Negativity:
    """λ Σ max(-x, 0)²."""

    lam: float

    def loss(self, x, op):
        return objective.negativity(x, self.lam).agg(F.sum("loss").alias("loss"))

    def gradient(self, x, op):
        return x.withColumn("value", -2 * self.lam * F.greatest(-F.col("value"), F.lit(0.0)))


@dataclass
class Ridge:
    """λ/2 Σ x²."""

    lam: float

    def loss(self, x, op):
        return objective.ridge(x, self.lam).agg(F.sum("loss").alias("loss"))

    def gradient(self, x, op):
        return x.withColumn("value", self.lam * F.col("value"))


@dataclass
class SingleDish:
    """λ/2 Σ |cell² FFT(x·taper) |B| - cell² FFT(sd)|² against a dish's cube (chan, y, x, value) and a beam's width in pixels."""

    sd: DataFrame
    fwhm: float
    lam: float
    radius: float = 0.98

    def loss(self, x, op):
        return objective.single_dish(x, self.sd, op.height, op.width, op.cell, self.fwhm, self.lam, self.radius, fourier.fft).agg(F.sum("loss").alias("loss"))

    def gradient(self, x, op):
        h, w, taper = op.height, op.width, images.taper(op.height, op.width, self.radius)
        beam = fourier.fft(images.gaussian_beam(x.sparkSession, h, w, self.fwhm).withColumn("chan", F.lit(0)), h, w)
        b = beam.select("y", "x", F.hypot("re", "im").alias("b"))
        s = fourier.fft(self.sd, h, w).select("chan", "y", "x", F.col("re").alias("s_re"), F.col("im").alias("s_im"))
        t = fourier.fft(x.withColumn("value", F.col("value") * taper), h, w).join(b, ["y", "x"]).join(s, ["chan", "y", "x"])
        share = lambda c: (F.nanvl(F.col(c) * F.col("b") - F.col(f"s_{c}"), F.lit(0.0)) * F.col("b")).alias(c)
        back = fourier.fft(t.select("chan", "y", "x", share("re"), share("im")), h, w, inverse=True)
        return back.select("chan", "y", "x", (self.lam * op.cell**4 * h * w * F.col("re") * taper).alias("value"))


@dataclass
class Spectrum:
    """λ/2 Σ_bins ((P - target)/(target + 1e-10))² of the map ``plane``, P being its mean power in the bins of ``spectra.linear_bins``.

    ``target`` is (bin, pk); a bin without frequencies has power 0.
    """

    target: DataFrame
    lam: float
    plane: int
    pixel_arcsec: float = 7.0

    def _bins(self, x, op):
        from ..operators import spectra

        h, w = op.height, op.width
        place, _ = spectra.linear_bin(h, w, self.pixel_arcsec, self.target.count())
        f = fourier.fft(x.where(F.col("chan") == self.plane), h, w).withColumn("bin", place)
        power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (h * w)
        found = f.groupBy("bin").agg(F.avg(power).alias("found"), F.count(F.lit(1)).alias("n"))
        both = self.target.select("bin", "pk").join(found, "bin", "left")
        return f, both.withColumn("off", (F.coalesce("found", F.lit(0.0)) - F.col("pk")) / (F.col("pk") + 1e-10))

    def loss(self, x, op):
        return self._bins(x, op)[1].agg((0.5 * self.lam * F.sum(F.col("off") * F.col("off"))).alias("loss"))

    def gradient(self, x, op):
        f, off = self._bins(x, op)
        # the mean power of n frequencies has the derivative 2/n times the inverse transform of these alone
        weight = off.select("bin", (2 * self.lam * F.col("off") / (F.col("pk") + 1e-10) / F.col("n")).alias("w"))
        t = f.join(weight.where("w is not null"), "bin").select("chan", "y", "x", (F.col("re") * F.col("w")).alias("re"), (F.col("im") * F.col("w")).alias("im"))
        return fourier.fft(t, op.height, op.width, inverse=True).select("chan", "y", "x", F.col("re").alias("value"))


# ---------------------------------------------------------------- the objective


@dataclass
class Point:
    """Parameters with their gradient, a table (keys, value, gradient), and the loss there."""

    table: DataFrame
    loss: float


class Objective:
    """Half the weighted squares of model minus data, and terms on the cube and on the parameters.

    Good samples are written once, with their weights. An evaluation is one pass over them (degrid, weigh, grid) and a
    few over pixels; only sums and small planes reach the driver. The data's loss follows from pixels too: x·Nx/2 - x·b + c.
    """

    def __init__(self, op: measure.Measurement, model, terms: Iterable = (), priors: Iterable = (), conjugate: bool = True, sigma_floor: float = 0.0):
        self.op, self.model, self.terms, self.priors = op, model, list(terms), list(priors)
        self.keys, self.spark = list(model.keys), op.vis.sparkSession
        self.scratch = Scratch(self.spark, "imaging")
        # beams and grids as tables: evaluations read them and not what they were made from
        self.op = op = op.with_beams(self.scratch.save(op.pb), self.scratch.save(op.grid))
        op.by_tasks = True
        sigma = F.greatest("sigma", F.lit(sigma_floor))
        im = -F.col("im") if conjugate else F.col("im")
        good = op.vis.where(~F.col("flag")).select("vis_id", "chan", "beam", "ur", "vr", "re", im.alias("im"), (1 / (sigma * sigma)).alias("iv"))
        self.good = self.scratch.save(good)
        iv = F.col("iv")
        self.constant = self.good.agg(F.sum(0.5 * iv * (F.col("re") * F.col("re") + F.col("im") * F.col("im")))).first()[0] or 0.0
        self.rhs = self.scratch.save(op.back(self.good.withColumns({"re": F.col("re") * iv, "im": F.col("im") * iv})).select(*PIXEL, F.col("re").alias("rhs")))
        self._flat: DataFrame | None = None

    def zeros(self) -> DataFrame:
        k = F.explode(F.array(*[F.lit(m) for m in self.model.maps])).alias(self.keys[0])
        return images.pixels(self.spark, self.op.height, self.op.width).select(k, "y", "x", F.lit(0.0).alias("value"))

    def _as_planes(self, params: DataFrame) -> DataFrame:
        return params.withColumnRenamed(self.keys[0], "chan")

    def evaluate(self, params: DataFrame, with_loss: bool = True) -> Point:
        """``params`` should be a table, or a projection of one: it is read several times."""
        return self._evaluate(params, with_loss, self.op.normal)

    def flat(self) -> DataFrame:
        """The gradient at zero: (keys, value, gradient). A linear model's cube is 0 there, so no sample is read."""
        if self._flat is None:
            nothing = lambda good, cube: cube.select(*PIXEL, F.lit(0.0).alias("value"))
            self._flat = self._evaluate(self.zeros(), False, nothing if self.model.linear else self.op.normal).table
        return self._flat

    def _evaluate(self, params: DataFrame, with_loss: bool, normal_of: Callable) -> Point:
        params = params.select(*self.keys, "value")
        cube, made = self.model.cube(params), []
        if not isinstance(self.model, Cube):
            made.append(cube := self.scratch.save(cube))
        data = cube.join(normal_of(self.good, cube).withColumnRenamed("value", "normal"), list(PIXEL), "left").join(self.rhs, list(PIXEL), "left")
        zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
        data = self.scratch.save(data.select(*PIXEL, "value", zero("normal"), zero("rhs")))
        made.append(data)
        flat, cube = self._as_planes(params), data.select(*PIXEL, "value")

        parts = [data.select(*PIXEL, (F.col("normal") - F.col("rhs")).alias("value")), *[t.gradient(cube, self.op).select(*PIXEL, "value") for t in self.terms]]
        gradient = self.model.back(params, _added(parts, PIXEL))
        parts = [gradient.select(*self.keys, "value"), *[p.gradient(flat, self.op).withColumnRenamed("chan", self.keys[0]).select(*self.keys, "value") for p in self.priors]]
        gradient = _added(parts, self.keys).withColumnRenamed("value", "gradient")
        table = self.scratch.save(params.join(gradient, self.keys, "left").select(*self.keys, "value", zero("gradient")))
        loss = float("nan")
        if with_loss:
            x, n = F.col("value"), F.col("normal")
            losses = [data.agg(F.sum(0.5 * x * n - x * F.col("rhs")).alias("loss")), *[t.loss(cube, self.op) for t in self.terms], *[p.loss(flat, self.op) for p in self.priors]]
            loss = self.constant + (reduce(DataFrame.unionByName, losses).agg(F.sum("loss")).first()[0] or 0.0)
        self.scratch.drop(*made)
        return Point(table, loss)

    def curvature(self, direction: DataFrame) -> DataFrame:
        """The Hessian times a direction, where the gradient is linear in the parameters: (keys, value)."""
        flat = self.flat().select(*self.keys, F.col("gradient").alias("flat"))
        t = self.evaluate(direction, False).table.join(flat, self.keys, "left")
        return t.select(*self.keys, (F.col("gradient") - F.col("flat")).alias("value"))

    def close(self) -> None:
        self.scratch.close()


def _added(parts: list[DataFrame], keys) -> DataFrame:
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("value").alias("value"))
