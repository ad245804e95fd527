"""Spectral models: low-rank cubes, continuum bases, and continuum subtraction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import measure, nufft


def cube(coef: DataFrame, basis: DataFrame) -> DataFrame:
    """Σ_k basis[k, chan] coef[k, y, x]: (chan, y, x, value)."""
    b = basis.select("k", "chan", F.col("value").alias("weight"))
    return coef.join(F.broadcast(b), "k").groupBy("chan", "y", "x").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def line_and_continuum(coef: DataFrame, basis: DataFrame, n_line: int) -> tuple[DataFrame, DataFrame]:
    return cube(coef.where(F.col("k") < n_line), basis), cube(coef.where(F.col("k") >= n_line), basis)


def continuum_basis(channels: DataFrame, order: int, reference: float, first_k: int = 0) -> DataFrame:
    """Taylor terms ((ν - ν₀)/ν₀)^m for m = 0..order: (k, chan, value)."""
    if order < 0 or reference <= 0:
        raise ValueError("the order must be 0 or more and the reference frequency positive")
    m = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("m")
    x = (F.col("frequency") - reference) / reference
    return channels.select("chan", "frequency", m).select((F.col("m") + first_k).alias("k"), "chan", F.when(F.col("m") == 0, 1.0).otherwise(F.pow(x, F.col("m"))).alias("value"))


def continuum_only(basis: DataFrame, channels: list[int], n_line: int) -> DataFrame:
    """Line components are zero in the given channels."""
    hit = F.col("chan").isin(channels) & (F.col("k") < n_line)
    return basis.withColumn("value", F.when(hit, 0.0).otherwise(F.col("value")))


def haar(k: Column, chan: Column, n: int) -> Column:
    """Orthonormal Haar basis of n (a power of two) channels; k = 0 is the mean."""
    if n & (n - 1):
        raise ValueError("the number of channels must be a power of two")
    level = F.floor(F.log2(F.greatest(k, F.lit(1)).cast("double")) + 1e-9)
    width = n / F.pow(F.lit(2.0), level)
    at = chan - (k - F.pow(F.lit(2.0), level)) * width
    wave = F.when((at >= 0) & (at < width / 2), 1.0).when((at >= width / 2) & (at < width), -1.0).otherwise(0.0)
    return F.when(k == 0, 1 / math.sqrt(n)).otherwise(wave / F.sqrt(width))


def gaussian_dictionary(channels: DataFrame, centres: list[float], widths: list[float]) -> DataFrame:
    """A Gaussian of each centre and width over the channel numbers: (k, chan, value)."""
    rows = [(c, s) for c in centres for s in widths]
    atoms = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(c)).alias("c"), F.lit(float(s)).alias("s")) for i, (c, s) in enumerate(rows)])).alias("a")
    t = channels.select("chan", atoms)
    return t.select("a.k", "chan", F.exp(-0.5 * F.pow((F.col("chan") - F.col("a.c")) / F.col("a.s"), 2)).alias("value"))


#: Basis maps that samples may be transformed with at once.
MOST_MAPS = 4096


def mixed_visibilities(vis: DataFrame, coef: DataFrame, basis: DataFrame, height: int, width: int, cell: float, kernel: str = "auto", spread: int = 8) -> DataFrame:
    """Visibilities of every channel from those of the basis maps.

    Where the operator is the same for all channels, A Σ ψ_k a_k = Σ ψ_k A a_k: one transform a basis map instead of one a
    channel, which pays when there are fewer maps than channels (see ``cheaper_first``). Each sample is asked of all maps
    at once: of their pixels where planes are small, of a grid beyond (``measure.degrid`` has the kernels). What moves is a
    row a sample, not one a sample, map and channel; maps of more than ``measure.SENT_PIXELS`` together are dealt by map.
    """
    maps = [r["k"] for r in coef.select("k").distinct().orderBy("k").limit(MOST_MAPS + 1).collect()]
    if len(maps) > MOST_MAPS:
        raise ValueError(f"more than {MOST_MAPS} basis maps")
    kind = coef.schema["k"].dataType
    of_maps = basis.withColumn("k", F.col("k").cast(kind))
    if maps and measure.chosen_kernel(kernel, height, width) == "nufft":
        model = nufft.forward(vis, coef, height, width, cell, (), spread, ("vis_id",), ("k", maps))
        return _mixed(model, of_maps, maps)
    if maps and len(maps) * height * width <= measure.SENT_PIXELS:
        return _mixed(_of_all_maps(vis, coef, maps, height, width, cell), of_maps, maps)
    each = vis.select("vis_id", "ur", "vr", F.explode(F.array(*[F.lit(k).cast(kind) for k in maps])).alias("k")) if maps else vis.select("vis_id", "ur", "vr", F.lit(None).cast(kind).alias("k")).limit(0)
    p = measure.phase(height, width)
    both = measure.with_pixels(each, coef.select("k", "y", "x", "value"), ["k"], height, width, len(maps))
    model = both.groupBy("vis_id", "k").agg((F.sum(F.col("value") * F.cos(p)) * cell**2).alias("m_re"), (F.sum(F.col("value") * F.sin(p)) * cell**2).alias("m_im"))
    model = model.groupBy("vis_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("m_re", "m_im").alias("m")))).alias("m"))
    in_order = F.array(*[F.lit(k).cast(kind) for k in maps])
    known = F.exists(F.map_values("m"), lambda m: m["m_re"].isNotNull())
    take = lambda c: F.when(known, F.transform(in_order, lambda k: F.coalesce(F.try_element_at("m", k)[c], F.lit(0.0)))).alias(c)
    return _mixed(model.select("vis_id", take("m_re"), take("m_im")), of_maps, maps)


def _of_all_maps(vis: DataFrame, coef: DataFrame, maps: list, height: int, width: int, cell: float) -> DataFrame:
    """Each id's sums over the pixels of each map: (vis_id, m_re, m_im), arrays in the order of ``maps``, which are small.

    Angles go to their id's place, in its order, and nothing moves after that.
    """
    planes = measure.sent_planes(coef, height, width, ["k"])
    shape = (height, width)
    stack = [planes.get((k,)) for k in maps]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        dense = np.stack([np.zeros(shape) if p is None else p for p in stack], 1).reshape(height, -1).astype(complex)
        y, x, most = np.arange(height) - height // 2, np.arange(width) - width // 2, max((1 << 21) // dense.shape[1], 1)

        def rows(ids, model, known):
            ends = pa.array(np.arange(len(ids) + 1, dtype="int32") * len(stack))
            lists = [pa.ListArray.from_arrays(ends, pa.array(part.ravel()), mask=pa.array(~known)) for part in (model.real, model.imag)]
            return pa.RecordBatch.from_arrays([ids, *lists], names=["vis_id", "m_re", "m_im"])

        held = None  # the last id, which the next batch may go on with
        for batch in (b.slice(a, most) for b in batches for a in range(0, b.num_rows, most)):
            ids, (ur, vr) = batch.column(0), (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            known = np.asarray(batch.column(1).is_valid()) & np.asarray(batch.column(2).is_valid())
            lines = (np.exp(-1j * np.outer(vr, y)) @ dense).reshape(-1, len(stack), width)
            model = np.einsum("nkx,nx->nk", lines, np.exp(1j * np.outer(ur, x))) * cell**2
            model[~known] = 0
            if held is not None:
                ids, model, known = pa.concat_arrays([held[0], ids]), np.vstack([held[1], model]), np.concatenate([held[2], known])
            code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.diff(code, prepend=-1))
            ids, model, known = ids.take(pa.array(first)), np.add.reduceat(model, first), np.logical_or.reduceat(known, first)
            held = ids[-1:], model[-1:], known[-1:]
            yield rows(ids[:-1], model[:-1], known[:-1])
        if held is not None:
            yield rows(*held)

    placed = vis.select("vis_id", "ur", "vr").repartition("vis_id").sortWithinPartitions("vis_id")
    return placed.mapInArrow(run, f"vis_id {vis.schema['vis_id'].dataType.simpleString()}, m_re array<double>, m_im array<double>")


def _mixed(model: DataFrame, basis: DataFrame, maps: list) -> DataFrame:
    """Samples with arrays over the maps, in each channel of the basis: nothing of a sample moves."""
    few = basis.select("k", "chan", "value").where(F.col("k").isin(maps)).repartition(1)  # which all tasks get
    own = few.groupBy("chan", "k").agg(F.sum("value").alias("weight"))
    own = own.groupBy("chan").agg(F.map_from_entries(F.collect_list(F.struct("k", "weight"))).alias("own"))
    kind = basis.schema["k"].dataType
    in_order = F.array(*[F.lit(k).cast(kind) for k in maps])
    weights = own.select("chan", F.transform(in_order, lambda k: F.coalesce(F.try_element_at("own", k), F.lit(0.0))).alias("w"))
    total = lambda c: F.aggregate(F.zip_with(c, "w", lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    return model.crossJoin(F.broadcast(weights)).select("vis_id", "chan", total("m_re").alias("re"), total("m_im").alias("im"))


def cheaper_first(n_basis: int, n_chan: int) -> str:
    return "transform" if n_basis < n_chan else "mix"


def w_bins(vis: DataFrame, planes: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``wc``, the centre of the sample's bin of equal width in w (wavelengths). One plane or less: w is 0; an even number is made odd. With ``keys``, bins of each key."""
    if planes <= 1:
        return vis.withColumn("wc", F.lit(0.0))
    planes += planes % 2 == 0
    from ..functions import units

    t = vis.withColumn("wl", units.to_lambda(F.col("ww"), F.col("frequency")))
    ends = t.groupBy(*keys).agg(F.min("wl").alias("lo"), F.max("wl").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / planes
    k = F.least(F.floor(F.coalesce(F.try_divide(F.col("wl") - F.col("lo"), step), F.lit(0.0))), F.lit(planes - 1))
    few = F.broadcast(ends)  # one row a key, or one row
    both = t.join(few, list(keys)) if keys else t.crossJoin(few)
    return both.withColumn("wc", F.col("lo") + (k + 0.5) * step).drop("lo", "hi", "wl")


def w_stacked(vis: DataFrame, image: DataFrame, height: int, width: int, cell: float, planes: int, keys: tuple[str, ...] = (), kernel: str = "auto", spread: int = 8) -> DataFrame:
    """Degridding with a phase π w r² for the bin's w, r in radians. With ``keys``, each key has its own bins, and its image if that has the column.

    Beyond small planes each bin has a screen multiplied into its image, and one gridded transform, from which its samples
    are read: samples meet no pixel. Screens are made where an image's columns are transformed, so the image moves once
    and not once a bin.
    """
    rad = cell * math.pi / 648000.0
    r2 = (F.pow(F.col("y") - height // 2, 2) + F.pow(F.col("x") - width // 2, 2)) * rad**2
    on = [k for k in keys if k in image.columns]
    pix = image.select(*on, "y", "x", "value", r2.alias("r2"))
    binned = w_bins(vis, planes, keys)
    ids = ["vis_id", *keys]
    if measure.chosen_kernel(kernel, height, width) == "nufft":
        def screen(wc, y, x):
            import numpy as np

            return np.exp(1j * math.pi * rad**2 * wc * ((y - height // 2) ** 2 + (x - width // 2) ** 2))

        return nufft.forward(binned, image.select(*on, "y", "x", "value"), height, width, cell, (*keys, "wc"), spread, tuple(ids), screen=("wc", screen))
    p = measure.phase(height, width) + F.col("wc") * math.pi * F.col("r2")
    both = measure.with_pixels(binned, pix, on, height, width)
    s = both.groupBy(*ids).agg(F.sum(F.col("value") * F.cos(p)).alias("m_re"), F.sum(F.col("value") * F.sin(p)).alias("m_im"))
    return s.withColumns({"m_re": F.col("m_re") * cell**2, "m_im": F.col("m_im") * cell**2})


def principal_basis(cube: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ``n`` principal spectra of a cube's pixels: basis (k, chan, value), mean spectrum (chan, value), (k, variance).

    Pixels' spectra are vectors, their covariance is summed over the cluster, and its eigenproblem, channels by channels,
    is the one small thing solved in one place. Channels that a pixel lacks count as 0; the largest entry of a
    basis spectrum is positive; variances are over pixels minus one.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    spark = cube.sparkSession
    channels = [r["chan"] for r in cube.select("chan").distinct().orderBy("chan").collect()]
    of = lambda c: F.coalesce(F.max(F.when(F.col("chan") == c, F.col("value"))), F.lit(0.0)).cast("double")
    spectra = cube.groupBy("y", "x").agg(F.array(*[of(c) for c in channels]).alias("s"))
    sums = spectra.agg(F.array(*[F.avg(F.get("s", F.lit(i))) for i in range(len(channels))]).alias("mean"), sum((F.var_samp(F.get("s", F.lit(i))) for i in range(len(channels))), F.lit(0.0)).alias("total")).first()
    model = PCA(k=n, inputCol="v", outputCol="p").fit(spectra.select(array_to_vector("s").alias("v")))
    axes = model.pc.toArray().T
    axes = [a * (1.0 if a[abs(a).argmax()] > 0 else -1.0) for a in axes]
    basis = spark.createDataFrame([(k, c, float(v)) for k, a in enumerate(axes) for c, v in zip(channels, a)], "k int, chan int, value double")
    mean = spark.createDataFrame([(c, float(m)) for c, m in zip(channels, sums["mean"])], "chan int, value double")
    variance = spark.createDataFrame([(k, float(v) * sums["total"]) for k, v in enumerate(model.explainedVariance)], "k int, variance double")
    return basis, mean, variance


def coefficients(cube: DataFrame, basis: DataFrame, mean: DataFrame | None = None) -> DataFrame:
    """Σ_chan basis[k, chan] (cube - mean): (k, y, x, value), for an orthonormal basis."""
    b = basis.select("k", "chan", F.col("value").alias("weight"))
    if mean is not None:
        b = b.join(mean.select("chan", F.col("value").alias("mean")), "chan")
        cube = cube.join(b, "chan").withColumn("value", F.col("value") - F.col("mean"))
    else:
        cube = cube.join(b, "chan")
    return cube.groupBy("k", "y", "x").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def power_law(amplitude: DataFrame, alpha: DataFrame, channels: DataFrame, reference: float) -> DataFrame:
    """amplitude (ν/ν₀)^-α of two maps (y, x, value): (chan, y, x, value)."""
    both = amplitude.select("y", "x", F.col("value").alias("a")).join(alpha.select("y", "x", F.col("value").alias("alpha")), ["y", "x"])
    at = both.crossJoin(F.broadcast(channels.select("chan", "frequency")))
    return at.select("chan", "y", "x", (F.col("a") * F.pow(F.col("frequency") / reference, -F.col("alpha"))).alias("value"))


def channel_overlaps(channels: DataFrame, n: int, start_kms: float, width_kms: float, rest_hz: float | None = None) -> DataFrame:
    """How far each channel (chan, frequency) lies in each of ``n`` velocity channels: (chan, to, overlap) in km/s.

    Channels end half way to their neighbours, the outer ones as far on the other side; new channel i is centred on
    ``start_kms`` + i ``width_kms``. The numbers of the new channels follow from a channel's ends, so nothing is searched.
    """
    from ..functions import units

    rest = units.REST_HZ if rest_hz is None else rest_hz
    w = Window.orderBy("frequency")  # the channel axis: one row a channel
    f = F.col("frequency")
    before, after = (f - F.lag("frequency").over(w)) / 2, (F.lead("frequency").over(w) - f) / 2
    t = channels.select("chan", (f - F.coalesce(before, after)).alias("f0"), (f + F.coalesce(after, before)).alias("f1"))
    t = t.select("chan", units.velocity(F.col("f1"), rest).alias("v0"), units.velocity(F.col("f0"), rest).alias("v1")).where("v1 > v0")
    edge = start_kms - width_kms / 2
    place = lambda v: F.floor((v - edge) / width_kms)
    first, last = F.greatest(place(F.col("v0")), F.lit(0)), F.least(place(F.col("v1")), F.lit(n - 1))
    t = t.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("to"))
    low = edge + F.col("to") * width_kms
    t = t.select("chan", F.col("to").cast("int").alias("to"), (F.least("v1", low + width_kms) - F.greatest("v0", low)).alias("overlap"))
    return t.where("overlap > 0")


def regrid(rows: DataFrame, channels: DataFrame, n: int, start_kms: float, width_kms: float, keys: list[str], values: list[str], rest_hz: float | None = None) -> DataFrame:
    """Samples or images on new velocity channels: (keys, chan, velocity, coverage, ``values`` and, where there is one, sigma).

    A value is the mean of what lies in the channel, weighted by overlap; times ``coverage`` (the share of the channel that has
    data) and width it sums to the flux of the old channels inside the new axis. Flagged rows are left out, errors add in
    squares, rows of a key in one channel are taken together, and new channels without data have no row.
    """
    good = rows.where(~F.col("flag")) if "flag" in rows.columns else rows
    each = good.groupBy(*keys, "chan").agg(*[F.avg(c).alias(c) for c in values], *([(F.sqrt(F.sum(F.pow("sigma", 2))) / F.count(F.lit(1))).alias("sigma")] if "sigma" in rows.columns else []))
    t = each.join(channel_overlaps(channels, n, start_kms, width_kms, rest_hz), "chan")
    w = F.col("overlap")
    sums = [(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in values]
    if "sigma" in rows.columns:
        sums.append((F.sqrt(F.sum(F.pow(F.col("sigma") * w, 2))) / F.sum(w)).alias("sigma"))
    out = t.groupBy(*keys, "to").agg((F.sum(w) / width_kms).alias("coverage"), *sums)
    return out.select(*keys, F.col("to").alias("chan"), (start_kms + F.col("to") * width_kms).alias("velocity"), "coverage", *[c for c in out.columns if c not in (*keys, "to", "coverage")])


def subtract_continuum(vis: DataFrame, line_free: list[int], keys: list[str]) -> DataFrame:
    """Line fitted over the line-free channels of each group, taken from every sample: adds ``line_re``, ``line_im``.

    A group with fewer than two line-free channels keeps its values.
    """
    free = F.col("chan").isin(line_free)
    fits = []
    for c in ("re", "im"):
        y, x = F.when(free, F.col(c)), F.when(free, F.col("chan"))
        fits += [F.regr_slope(y, x).alias(f"s_{c}"), F.regr_intercept(y, x).alias(f"i_{c}")]
    t = vis.join(vis.groupBy(*keys).agg(*fits), keys)
    for c in ("re", "im"):
        t = t.withColumn(f"line_{c}", F.col(c) - F.coalesce(F.col(f"s_{c}") * F.col("chan") + F.col(f"i_{c}"), F.lit(0.0)))
    return t.drop("s_re", "i_re", "s_im", "i_im")
