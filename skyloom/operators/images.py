"""Image operators on (chan, y, x, value) tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import units


def masked(image: DataFrame, pb: DataFrame, threshold: float) -> DataFrame:
    """The image seen by each beam, NaN where the beam is at most ``threshold``."""
    p = pb.select("beam", "y", "x", F.col("value").alias("pb"))
    return image.join(p, ["y", "x"]).withColumn("value", F.when(F.col("pb") > threshold, F.col("value")).otherwise(F.lit(float("nan"))))


def crop_centre(image: DataFrame, height: int, width: int, fraction: float) -> DataFrame:
    h, w = int(height * fraction), int(width * fraction)
    y0, x0 = (height - h) // 2, (width - w) // 2
    return image.where(F.col("y").between(y0, y0 + h - 1) & F.col("x").between(x0, x0 + w - 1))


def plane_at(image: DataFrame, channels: DataFrame, frequency: float) -> DataFrame:
    """The plane at a frequency, linear between the two channels around it; an error outside the axis.

    The last channel's own frequency is on the axis.
    """
    ends = channels.agg(F.min("frequency"), F.max("frequency")).first()
    if ends[0] is None or not ends[0] <= frequency <= ends[1]:
        raise ValueError(f"{frequency} Hz lies outside the axis {ends[0]}..{ends[1]}")
    w = Window.orderBy("frequency")  # the channel axis: one row a channel
    pair = channels.select("chan", "frequency", F.lead("chan").over(w).alias("next"), F.lead("frequency").over(w).alias("f1"))
    inside = (F.col("frequency") <= frequency) & (F.lit(frequency) < F.coalesce("f1", F.lit(float("inf"))))
    pair = pair.where(inside)
    pair = pair.select("chan", "next", F.coalesce((frequency - F.col("frequency")) / (F.col("f1") - F.col("frequency")), F.lit(0.0)).alias("w"))
    parts = pair.select(F.explode(F.array(F.struct("chan", (1 - F.col("w")).alias("w")), F.struct(F.col("next").alias("chan"), "w"))).alias("p")).select("p.*")
    return image.join(F.broadcast(parts), "chan").groupBy("y", "x").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def pixels(spark: SparkSession, height: int, width: int) -> DataFrame:
    """All (y, x) of an image."""
    return spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def taper_1d(i: Column, n: int, radius: float) -> Column:
    """Cosine taper of the outer ``n - fix(radius n)`` pixels at either end; a taper of one pixel is 1."""
    if not 0 < radius < 1:
        raise ValueError("the radius must lie between 0 and 1")
    d = n - int(radius * n)
    if d <= 1:
        return F.lit(1.0)
    step = math.pi / 2 / (d - 1)
    # where the two ends meet, the far end's taper holds
    return F.when(i >= n - d, F.cos((i - (n - d)) * step)).when(i < d, F.sin(i * step)).otherwise(1.0)


def taper(height: int, width: int, radius: float) -> Column:
    return taper_1d(F.col("y"), height, radius) * taper_1d(F.col("x"), width, radius)


def gaussian_beam(spark: SparkSession, height: int, width: int, fwhm: float) -> DataFrame:
    """A circular Gaussian centred on the image (the pixel n/2 for even n), of sum 1."""
    s = fwhm / units.FWHM
    dy, dx = F.col("y") - (height // 2 if height % 2 == 0 else (height - 1) / 2), F.col("x") - (width // 2 if width % 2 == 0 else (width - 1) / 2)
    g = pixels(spark, height, width).withColumn("g", F.exp(-0.5 * (dy * dy + dx * dx) / s**2))
    total = g.agg(F.sum("g").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("y", "x", (F.col("g") / F.col("total")).alias("value"))


def frequency_of(k: Column, n: int) -> Column:
    """Signed frequency number of row or column k of a discrete Fourier transform: -n/2 .. (n-1)/2."""
    return F.when(k >= (n + 1) // 2, k - n).otherwise(k)


def transfer(height: int, width: int, fwhm: float) -> Column:
    """Fourier transform of a Gaussian of that FWHM in pixels, over (y, x) as frequency numbers."""
    s = fwhm / units.FWHM
    ky, kx = frequency_of(F.col("y"), height) / height, frequency_of(F.col("x"), width) / width
    return F.exp(-2 * math.pi**2 * s**2 * (ky * ky + kx * kx))


def dft(image: DataFrame, height: int, width: int, inverse: bool = False) -> DataFrame:
    """Discrete Fourier transform of each plane, rows then columns: (chan, y, x, re, im), y and x now frequencies.

    Two joins with the frequencies of one axis, so a plane of n pixels gives n*(H+W) terms, not n². For one plane
    that fits a task, ``fft`` is faster.
    """
    sign = 1.0 if inverse else -1.0
    t = image if "im" in image.columns else image.select("chan", "y", "x", F.col("value").alias("re"), F.lit(0.0).alias("im"))
    for axis, n, other in (("x", width, "y"), ("y", height, "x")):
        a = F.col("k") * F.col(axis) % n * (sign * 2 * math.pi / n)
        c, s = F.cos(a), F.sin(a)
        wide = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
        t = wide.groupBy("chan", other, F.col("k").alias(axis)).agg(F.sum(F.col("re") * c - F.col("im") * s).alias("re"), F.sum(F.col("re") * s + F.col("im") * c).alias("im"))
    if inverse:
        t = t.withColumns({"re": F.col("re") / (height * width), "im": F.col("im") / (height * width)})
    return t.select("chan", "y", "x", "re", "im")


def fft(image: DataFrame, height: int, width: int, inverse: bool = False) -> DataFrame:
    """As ``dft``, a plane a task, by NumPy's FFT."""
    has_im = "im" in image.columns
    t = image if has_im else image.select("chan", "y", "x", F.col("value").alias("re"), F.lit(0.0).alias("im"))

    def one(pdf):
        import numpy as np
        import pandas as pd

        plane = np.zeros((height, width), complex)
        plane[pdf.y, pdf.x] = pdf.re + 1j * pdf.im
        out = np.fft.ifft2(plane) if inverse else np.fft.fft2(plane)
        y, x = np.indices(out.shape).reshape(2, -1)
        return pd.DataFrame({"chan": pdf.chan.iloc[0], "y": y, "x": x, "re": out.real.ravel(), "im": out.imag.ravel()})

    return t.select("chan", "y", "x", "re", "im").groupBy("chan").applyInPandas(one, "chan int, y int, x int, re double, im double")


def laplacian_of(image: DataFrame, height: int, width: int) -> DataFrame:
    """Periodic Laplacian (4, -1, -1, -1, -1)/4 of each plane, as each pixel's share given to its neighbours."""
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for dy, dx, w in ((0, 0, 1.0), (0, 1, -0.25), (0, -1, -0.25), (1, 0, -0.25), (-1, 0, -0.25))])
    given = image.select("chan", "y", "x", "value", F.explode(moves).alias("m"))
    y, x = (F.col("y") + F.col("m.dy") + height) % height, (F.col("x") + F.col("m.dx") + width) % width
    return given.groupBy("chan", y.alias("y"), x.alias("x")).agg(F.sum(F.col("value") * F.col("m.w")).alias("value"))


def feather(sd: DataFrame, interferometer: DataFrame, height: int, width: int, fwhm_sd: float, fwhm_int: float, transform=fft, alpha: float = 1.0, dc_from_sd: bool = True, dc_radius: float = 0) -> DataFrame:
    """F_i + T (α F_sd - F_i) with T = B_sd² / (B_sd² + B_i²): (chan, y, x, value).

    With ``dc_from_sd``, T is 1 at zero frequency and wherever the frequency's indices lie within ``dc_radius`` of it (indices as they
    are, not wrapped).
    """
    b, g = transfer(height, width, fwhm_sd), transfer(height, width, fwhm_int)
    t = b * b / (b * b + g * g + 1e-12)
    if dc_from_sd:
        t = F.when(F.col("y") * F.col("y") + F.col("x") * F.col("x") <= max(dc_radius, 0) ** 2, 1.0).otherwise(t)
    scaled = sd if alpha == 1 else sd.withColumn("value", alpha * F.col("value"))
    return _mixed(scaled, interferometer, height, width, t, transform)


def short_spacing(sd: DataFrame, interferometer: DataFrame, height: int, width: int, fwhm_sd: float, transform=fft) -> DataFrame:
    """F_sd B + F_i (1 - B), B being the modulus of the transform of the single dish's beam."""
    beam = transform(gaussian_beam(sd.sparkSession, height, width, fwhm_sd).withColumn("chan", F.lit(0)), height, width)
    b = beam.select("y", "x", F.hypot("re", "im").alias("b"))
    return _mixed(sd, interferometer, height, width, F.col("b"), transform, b)


def _mixed(sd, interferometer, height, width, share, transform, extra=None):
    clean = lambda t: t.select("chan", "y", "x", F.nanvl("value", F.lit(0.0)).alias("value"))
    a = transform(clean(sd), height, width).select("chan", "y", "x", F.col("re").alias("re_s"), F.col("im").alias("im_s"))
    both = transform(clean(interferometer), height, width).join(a, ["chan", "y", "x"])
    if extra is not None:
        both = both.join(extra, ["y", "x"])
    mixed = both.select("chan", "y", "x", (F.col("re") + share * (F.col("re_s") - F.col("re"))).alias("re"), (F.col("im") + share * (F.col("im_s") - F.col("im"))).alias("im"))
    return transform(mixed, height, width, inverse=True).select("chan", "y", "x", F.col("re").alias("value"))


def halved(image: DataFrame, factor: int = 2, height: int | None = None, width: int | None = None) -> DataFrame:
    """Down-sampling by a whole factor, bilinear about each new centre: the mean of two by two pixels, or one where the factor is odd.

    The image's ``height`` and ``width`` leave out a last row or column of fewer than ``factor`` pixels.
    """
    lo, hi = (factor - 1) // 2, factor // 2
    near = (F.col("y") % factor).between(lo, hi) & (F.col("x") % factor).between(lo, hi)
    for c, n in (("y", height), ("x", width)):
        near = near & (F.col(c) < n // factor * factor) if n is not None else near
    return image.where(near).groupBy("chan", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.avg("value").alias("value"))


def padded(image: DataFrame, height: int, width: int, fraction: float) -> DataFrame:
    """The image in the middle of zeros, (1 + fraction) times as large."""
    h, w = int(height * (1 + fraction)), int(width * (1 + fraction))
    y0, x0 = int(h / 2 - height / 2), int(w / 2 - width / 2)
    moved = image.select("chan", (F.col("y") + y0).alias("y"), (F.col("x") + x0).alias("x"), "value")
    everywhere = image.select("chan").distinct().crossJoin(pixels(image.sparkSession, h, w))
    return everywhere.join(moved, ["chan", "y", "x"], "left").select("chan", "y", "x", F.coalesce("value", F.lit(0.0)).alias("value"))


def depadded(image: DataFrame, height: int, width: int, fraction: float) -> DataFrame:
    """The middle of an image that was padded by ``fraction``; one pixel more than it had, by rounding."""
    h, w = int(height / (1 + fraction)) + 1, int(width / (1 + fraction)) + 1
    y0, x0 = int(height / 2 - h / 2), int(width / 2 - w / 2)
    inside = F.col("y").between(y0, y0 + h - 1) & F.col("x").between(x0, x0 + w - 1)
    return image.where(inside).select("chan", (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "value")


def elliptical_source(spark: SparkSession, height: int, width: int, cell: float, flux: float, major: float, minor: float, pa_deg: float = 0.0) -> DataFrame:
    """An elliptical Gaussian of total ``flux`` at the centre, in flux per squared arcsecond."""
    a, b, t = major / 2.3548 / cell, minor / 2.3548 / cell, math.radians(pa_deg)
    dx, dy = F.col("x") - width // 2, F.col("y") - height // 2
    u, v = dx * math.cos(t) + dy * math.sin(t), dy * math.cos(t) - dx * math.sin(t)
    g = pixels(spark, height, width).withColumn("g", F.exp(-0.5 * (F.pow(u / a, 2) + F.pow(v / b, 2))))
    total = g.agg(F.sum("g").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("y", "x", (flux * F.col("g") / (F.col("total") * cell**2)).alias("value"))


def delta_source(spark: SparkSession, height: int, width: int, cell: float, flux: float = 1.0) -> DataFrame:
    """All of ``flux`` in the central pixel, in flux per squared arcsecond."""
    centre = (F.col("y") == height // 2) & (F.col("x") == width // 2)
    return pixels(spark, height, width).select("y", "x", F.when(centre, flux / cell**2).otherwise(0.0).alias("value"))


def moments(image: DataFrame) -> DataFrame:
    """Sum, centroid and second moments of each plane, weights being the positive pixels."""
    w = F.greatest(F.col("value"), F.lit(0.0))
    s = image.select("chan", w.alias("w"), "y", "x").groupBy("chan").agg(*[F.sum(F.col("w") * e).alias(n) for n, e in (("m", F.lit(1.0)), ("mx", F.col("x")), ("my", F.col("y")), ("xx", F.col("x") * F.col("x")), ("yy", F.col("y") * F.col("y")), ("xy", F.col("x") * F.col("y")))])
    cx, cy = F.try_divide("mx", "m"), F.try_divide("my", "m")
    return s.select("chan", F.col("m").alias("flux"), cx.alias("cx"), cy.alias("cy"), (F.try_divide("xx", "m") - cx * cx).alias("sxx"), (F.try_divide("yy", "m") - cy * cy).alias("syy"), (F.try_divide("xy", "m") - cx * cy).alias("sxy"))


def rotated(image: DataFrame, height: int, width: int, angle_deg: float) -> DataFrame:
    """Each plane turned about its centre, bilinear, zero outside."""
    from ..functions import sky
    from . import measure

    dx, dy = F.col("x") - (width - 1) / 2, F.col("y") - (height - 1) / 2
    sx, sy = sky.rotated(dx, dy, -angle_deg)
    grid = pixels(image.sparkSession, height, width).select(F.lit(0).alias("beam"), "y", "x", (sx / ((width - 1) / 2)).alias("gx"), (sy / ((height - 1) / 2)).alias("gy"))
    return measure.reproject(image, measure.interp(grid, height, width), grid).select("chan", "y", "x", "value")


FIT = "chan int, flux double, cy double, cx double, major double, minor double, pa_deg double, misfit double"


def fit_elliptical(image: DataFrame, cell: float, iterations: int = 50) -> DataFrame:
    """Least-squares elliptical Gaussian of each plane (a task a plane): flux, centre, FWHM in arcsec, position angle.

    Levenberg-Marquardt from the moments of the positive pixels. The major axis is the longer; where the fit has them
    the other way round they change places and the angle turns by 90 degrees. A plane without positive pixels has nulls.
    """

    def fit(pdf):
        import numpy as np
        import pandas as pd

        y, x, v = (pdf[c].to_numpy(float) for c in ("y", "x", "value"))
        w = np.maximum(v, 0)
        if w.sum() <= 0:
            return pd.DataFrame([[pdf.chan.iloc[0], *[None] * 7]], columns=[c.split()[0] for c in FIT.split(", ")])
        cy, cx = (w * y).sum() / w.sum(), (w * x).sum() / w.sum()
        spread = max(np.sqrt((w * ((y - cy) ** 2 + (x - cx) ** 2)).sum() / w.sum() / 2), 0.5)
        p = np.array([v.max(), cy, cx, spread, spread * 0.8, 0.1])

        def model(p):
            a, cy, cx, s, t, th = p
            u, z = (x - cx) * np.cos(th) + (y - cy) * np.sin(th), (y - cy) * np.cos(th) - (x - cx) * np.sin(th)
            e = a * np.exp(-0.5 * ((u / s) ** 2 + (z / t) ** 2))
            du = u / s**2 * e
            dz = z / t**2 * e
            jac = np.stack([e / a, du * np.sin(th) + dz * np.cos(th), du * np.cos(th) - dz * np.sin(th), du * u / s, dz * z / t, -du * z + dz * u], 1)
            return e, jac

        damp = 1e-3
        e, jac = model(p)
        cost = ((v - e) ** 2).sum()
        for _ in range(iterations):
            a = jac.T @ jac
            step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), jac.T @ (v - e), rcond=None)[0]
            new = p + step
            if new[0] > 0 and min(abs(new[3]), abs(new[4])) > 1e-3:
                e2, jac2 = model(new)
                cost2 = ((v - e2) ** 2).sum()
                if cost2 <= cost:
                    small = cost - cost2 <= 1e-14 * max(cost, 1e-300)
                    p, e, jac, cost, damp = new, e2, jac2, cost2, damp / 5
                    if small:
                        break
                    continue
            damp *= 5
        a, cy, cx, s, t, th = p
        s, t = abs(s), abs(t)
        if t > s:
            s, t, th = t, s, th + np.pi / 2
        flux = a * 2 * np.pi * s * t * cell**2
        row = [pdf.chan.iloc[0], flux, cy, cx, s * units.FWHM * cell, t * units.FWHM * cell, np.degrees(th) % 180, cost]
        return pd.DataFrame([row], columns=[c.split()[0] for c in FIT.split(", ")])

    return image.select("chan", "y", "x", "value").groupBy("chan").applyInPandas(fit, FIT)
