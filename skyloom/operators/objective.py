"""Terms of the objective: weighted least squares, single-dish and Laplacian terms, penalties, and the gradient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import images
from .measure import Measurement


def chi2(vis: DataFrame) -> DataFrame:
    """Half the weighted sum of squares of the good samples, by beam and channel (the model being zero)."""
    good = vis.where(~F.col("flag"))
    return good.groupBy("beam", "chan").agg(F.count(F.lit(1)).alias("n"), (0.5 * F.sum((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("sigma") * F.col("sigma")))).alias("chi2"))


def chi2_ignoring_nan(vis: DataFrame) -> DataFrame:
    x = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("sigma") * F.col("sigma"))
    return vis.where(~F.col("flag")).groupBy("beam", "chan").agg((0.5 * F.sum(F.nanvl(x, F.lit(0.0)))).alias("chi2"))


def single_dish(image: DataFrame, sd: DataFrame, height: int, width: int, cell: float, fwhm: float, lam: float, radius: float = 0.98, transform=images.dft) -> DataFrame:
    """λ/2 Σ |cell² FFT(x·taper) |B| - cell² FFT(sd)|² of each plane: (chan, loss)."""
    tapered = image.withColumn("value", F.col("value") * images.taper(height, width, radius))
    beam = transform(images.gaussian_beam(image.sparkSession, height, width, fwhm).withColumn("chan", F.lit(0)), height, width)
    b = beam.select("y", "x", F.hypot("re", "im").alias("b"))
    s = transform(sd, height, width).select("chan", "y", "x", F.col("re").alias("s_re"), F.col("im").alias("s_im"))
    t = transform(tapered, height, width).join(b, ["y", "x"]).join(s, ["chan", "y", "x"])
    d2 = F.pow(F.col("re") * F.col("b") - F.col("s_re"), 2) + F.pow(F.col("im") * F.col("b") - F.col("s_im"), 2)
    return t.groupBy("chan").agg((0.5 * lam * cell**4 * F.sum(F.nanvl(d2, F.lit(0.0)))).alias("loss"))


def laplacian(image: DataFrame, height: int, width: int, cell: float, lam: float, radius: float = 0.98) -> DataFrame:
    """λ/2 Σ |cell² FFT(x·taper) |K||² of each plane; by Parseval, the stencil's squares times the pixels."""
    tapered = image.withColumn("value", F.col("value") * images.taper(height, width, radius))
    lap = images.laplacian_of(tapered, height, width)
    return lap.groupBy("chan").agg((0.5 * lam * cell**4 * height * width * F.sum(F.col("value") * F.col("value"))).alias("loss"))


def negativity(image: DataFrame, lam: float) -> DataFrame:
    return image.groupBy("chan").agg((lam * F.sum(F.pow(F.greatest(-F.col("value"), F.lit(0.0)), 2))).alias("loss"))


def ridge(image: DataFrame, lam: float) -> DataFrame:
    return image.groupBy("chan").agg((0.5 * lam * F.sum(F.col("value") * F.col("value"))).alias("loss"))


def laplacian_gradient(image: DataFrame, height: int, width: int, cell: float, lam: float, radius: float = 0.98) -> DataFrame:
    t = images.taper(height, width, radius)
    once = images.laplacian_of(image.withColumn("value", F.col("value") * t), height, width)
    twice = images.laplacian_of(once, height, width)
    return twice.withColumn("value", lam * cell**4 * height * width * F.col("value") * t)


def data_gradient(op: Measurement, image: DataFrame) -> DataFrame:
    """Aᴴ((A x - conj d)/σ²), its real part: (chan, y, x, value)."""
    return op.adjoint(op.residual(image)).select("chan", "y", "x", F.col("re").alias("value"))


def normal(op: Measurement, image: DataFrame) -> DataFrame:
    """Aᴴ W A x, real."""
    var = F.col("sigma") * F.col("sigma")
    t = op.vis.where(~F.col("flag")).drop("re", "im").join(op.forward(image), ["vis_id", "chan", "beam"])
    t = t.withColumns({"re": F.col("m_re") / var, "im": F.col("m_im") / var})
    return op.adjoint(t).select("chan", "y", "x", F.col("re").alias("value"))


def right_hand_side(op: Measurement) -> DataFrame:
    """Aᴴ W conj(d), real."""
    var = F.col("sigma") * F.col("sigma")
    t = op.vis.withColumns({"re": F.col("re") / var, "im": -F.col("im") / var})
    return op.adjoint(t).select("chan", "y", "x", F.col("re").alias("value"))
