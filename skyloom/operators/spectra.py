"""Power spectra and statistics of images."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch
from . import images


def power(a: DataFrame, b: DataFrame | None, height: int, width: int, transform=images.dft) -> DataFrame:
    """(chan, y, x, p_re, p_im): F_a conj(F_b) over the number of pixels; b defaults to a."""
    t = transform(a, height, width)
    n = height * width
    if b is None:
        return t.select("chan", "y", "x", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / n).alias("p_re"), F.lit(0.0).alias("p_im"))
    s = transform(b, height, width).select("chan", "y", "x", F.col("re").alias("re_b"), F.col("im").alias("im_b"))
    re, im = F.col("re") * F.col("re_b") + F.col("im") * F.col("im_b"), F.col("im") * F.col("re_b") - F.col("re") * F.col("im_b")
    return t.join(s, ["chan", "y", "x"]).select("chan", "y", "x", (re / n).alias("p_re"), (im / n).alias("p_im"))


def ring(height: int, width: int):
    """Radius of a frequency in units of the longer side, rounded half to even."""
    nf = max(height, width)
    ky, kx = images.frequency_of(F.col("y"), height) / height, images.frequency_of(F.col("x"), width) / width
    return F.bround(F.sqrt(ky * ky + kx * kx) * nf)


def rings(p: DataFrame, height: int, width: int, pixel: float = 1.0) -> DataFrame:
    """Azimuthal mean for rings 1 .. k_crit - 2: (chan, k, frequency, pk, n). Only the real part is kept."""
    crit = max(height, width) // 2
    t = p.withColumn("k", ring(height, width).cast("int")).where(F.col("k").between(1, crit - 2))
    return t.groupBy("chan", "k").agg(F.avg("p_re").alias("pk"), F.count(F.lit(1)).alias("n")).withColumn("frequency", F.col("k") / (2 * crit * pixel))


def autocorrelation(p: DataFrame, height: int, width: int, transform=images.dft) -> DataFrame:
    """Inverse transform of the power: (chan, y, x, value)."""
    return transform(p.select("chan", "y", "x", F.col("p_re").alias("re"), F.col("p_im").alias("im")), height, width, inverse=True).select("chan", "y", "x", F.col("re").alias("value"))


def linear_bin(height: int, width: int, pixel_arcsec: float, bins: int):
    """The equal bin of a frequency (y, x) between the least positive and the greatest, and the bins' edges.

    A bin is open below and closed above, so the least frequency is in none.
    """
    d = pixel_arcsec / 60.0
    fy, fx = images.frequency_of(F.col("y"), height) / (height * d), images.frequency_of(F.col("x"), width) / (width * d)
    low = 1 / (max(height, width) * d)
    high = math.hypot(height // 2 / (height * d), width // 2 / (width * d))
    edge = [low + (high - low) * i / bins for i in range(bins + 1)]
    edge[-1] = high
    k = F.sqrt(fy * fy + fx * fx)
    return sum(((k > e * (1 + 1e-12)).cast("int") for e in edge), F.lit(0)) - 1, edge


def linear_bins(p: DataFrame, height: int, width: int, pixel_arcsec: float, bins: int) -> DataFrame:
    """Mean power in equal bins of frequency (``linear_bin``): (chan, bin, centre, pk). A bin without pixels is 0."""
    place, edge = linear_bin(height, width, pixel_arcsec, bins)
    sums = p.withColumn("bin", place).groupBy("chan", "bin").agg(F.avg("p_re").alias("pk"))
    centres = F.explode(F.array(*[F.struct(F.lit(i).alias("bin"), F.lit((edge[i] + edge[i + 1]) / 2).alias("centre")) for i in range(bins)])).alias("b")
    every = p.select("chan").distinct().select("chan", centres).select("chan", "b.*")
    return every.join(sums, ["chan", "bin"], "left").select("chan", "bin", "centre", F.coalesce("pk", F.lit(0.0)).alias("pk"))


#: Bins of a pass, and passes at most: each narrows a wanted value's bracket that much, and doubles have 64 bits.
BINS, PASSES = 1024, 16


def _log(v):
    """Rises with any double, negative ones too: the logarithm of its size above the least double's, with its sign."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.ln(F.abs(v)) + 745.2))


def percentiles(image: DataFrame, low: float, high: float, key: str = "chan") -> DataFrame:
    """Display limits of each plane over its finite pixels, exact: (chan, lo, hi), linear between the two values around a rank.

    The wanted ranks are closed in on by histograms: a pass counts each plane's pixels in ``BINS`` bins between the values
    that still bracket a rank, and keeps the bin that holds it. A task holds counts, never a plane. A plane of NaN alone
    has null limits.
    """
    scratch = Scratch(image.sparkSession, "percentiles")
    rows = image.select(key, F.col("value").cast("double").alias("value")).where(~F.isnan("value") & F.col("value").isNotNull())
    size = scratch.save(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("a"), F.max("value").alias("b")))
    at = lambda p: p * (F.col("n") - 1)
    ranks = [(i, up, F.floor(at(p)) if not up else F.ceil(at(p))) for i, p in enumerate((low, high)) for up in (0, 1)]
    want = F.inline(F.array(*[F.struct(F.lit(2 * i + up).alias("want"), r.cast("long").alias("rank")) for i, up, r in ranks]))
    marks = scratch.save(size.select(key, "a", "b", F.lit(0).cast("long").alias("below"), want))
    for _ in range(PASSES):
        open_ = marks.where("a < b")
        if open_.isEmpty():
            break
        v, a, b = F.col("value"), F.col("a"), F.col("b")
        inside = rows.join(open_.drop("below", "rank"), key).where(v.between(a, b))
        # equal bins of the logarithm while a bracket spans orders of magnitude, then of the value
        part = F.when(_log(b) - _log(a) > 1e-3, (_log(v) - _log(a)) / (_log(b) - _log(a))).otherwise((v - a) / (b - a))
        place = F.when(v == b, BINS - 1).otherwise(F.least(F.floor(part * (BINS - 1)), F.lit(BINS - 2)))
        bins = inside.groupBy(key, "want", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
        until = F.sum("n").over(Window.partitionBy(key, "want").orderBy("bin"))  # at most BINS rows
        bins = bins.withColumn("until", until).join(open_.select(key, "want", "rank", "below"), [key, "want"])
        hit = bins.where((F.col("below") + F.col("until") > F.col("rank")) & (F.col("below") + F.col("until") - F.col("n") <= F.col("rank")))
        found = hit.select(key, "a", "b", (F.col("below") + F.col("until") - F.col("n")).alias("below"), "want", "rank")
        marks = scratch.save(marks.where("a >= b").unionByName(found))
    of = lambda w: F.max(F.when(F.col("want") == w, F.col("a")))
    ends = marks.groupBy(key).agg(*[of(w).alias(f"v{w}") for w in range(4)]).join(size.select(key, "n"), key)
    part = lambda i, p: (F.col(f"v{2 * i}") + (at(p) - F.floor(at(p))) * (F.col(f"v{2 * i + 1}") - F.col(f"v{2 * i}")))
    every = image.select(key).distinct()
    return every.join(ends.select(key, part(0, low).alias("lo"), part(1, high).alias("hi")), key, "left")


def noise_scale(signal: DataFrame, noise: DataFrame, above: float) -> DataFrame:
    """Least-squares factor Σ s n / Σ n² of two spectra (k, pk) beyond a frequency."""
    n = noise.select("k", F.col("pk").alias("n"))
    t = signal.join(n, "k").where(F.col("k") > above)
    return t.agg((F.sum(F.col("pk") * F.col("n")) / F.sum(F.col("n") * F.col("n"))).alias("factor"))


def gaussian_fit(spectrum: DataFrame, low: float, high: float, steps: int) -> DataFrame:
    """FWHM of the Gaussian transfer function that fits a spectrum (k, pk) best, on a grid: least squares of logarithms.

    The grid is a fixed list of trial widths for every row of a spectrum, grouped before it is compared.
    """
    width = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: low + i * ((high - low) / (steps - 1)))).alias("fwhm")
    t = spectrum.where("pk > 0").select(F.col("k").cast("double").alias("k"), F.ln("pk").alias("l"), width)
    model = -F.pow(math.pi * F.col("fwhm") * F.col("k"), 2) / (4 * math.log(2.0)) * 2
    t = t.withColumn("d", F.col("l") - model)
    # the amplitude is free, so the mean of the differences is taken off
    each = t.groupBy("fwhm").agg(F.var_pop("d").alias("misfit"))
    return each.agg(F.min(F.struct("misfit", "fwhm")).alias("best")).select("best.fwhm", "best.misfit")


def smoothed_channels(image: DataFrame) -> DataFrame:
    """Mean of each plane and the next, pixel by pixel."""
    w = Window.partitionBy("y", "x").orderBy("chan").rowsBetween(0, 1)
    return image.withColumn("value", F.avg("value").over(w))
