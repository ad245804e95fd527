"""The measurement operator and its adjoint: reprojection, primary beam and Fourier transform.

Complex numbers are pairs of columns. With u, v in radians per pixel, an image x of H by W pixels gives
V = cell² Σ x[j,k] exp(i(u(k - W/2) - v(j - H/2))).
"""

from __future__ import annotations

import copy
import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units
from . import nufft

#: Pixels of a plane up to which ``kernel="auto"`` sums over all of them; beyond, samples are gridded.
SUM_PIXELS = 64 * 64
#: Pixels of all planes together up to which a join sends them to the samples; of more, samples go to their planes.
SENT_PIXELS = 1 << 20
#: Error of a transform, as a share of its largest value, that callers get unless they ask for another.
TOLERANCE = 1e-7
#: The matrix form sends images to tasks; beyond this many pixels it refuses them (a dish map of 8192 by 8192 has 2**26).
MOST_PIXELS = 1 << 26


def radpix(vis: DataFrame, channels: DataFrame, cell_arcsec: float) -> DataFrame:
    """Adds ``ur`` and ``vr``, radians per pixel."""
    t = vis.join(F.broadcast(channels), "chan")
    to = lambda c: units.to_radpix(units.to_lambda(F.col(c), F.col("frequency")), cell_arcsec)
    return t.withColumns({"ur": to("uu"), "vr": to("vv")})


def phase(height: int, width: int) -> Column:
    return F.col("ur") * (F.col("x") - width // 2) - F.col("vr") * (F.col("y") - height // 2)


def chosen_kernel(kernel: str, height: int, width: int) -> str:
    """``auto`` as what it stands for."""
    if kernel not in ("auto", "join", "matrix", "nufft"):
        raise ValueError(f"unknown kernel {kernel}")
    if kernel == "auto":
        return "join" if height * width <= SUM_PIXELS else "nufft"
    return kernel


def _bounded(image: DataFrame, height: int, width: int) -> DataFrame:
    """A plane of few pixels to send to every task; larger ones are for gridding."""
    if height * width > SUM_PIXELS:
        raise ValueError(f"{height} by {width} pixels are too many to join with every sample")
    return F.broadcast(image)


def with_pixels(vis: DataFrame, pix: DataFrame, on: list[str], height: int, width: int, planes: int | None = None) -> DataFrame:
    """Each sample with the pixels of its plane, whose keys are ``on``.

    Samples stay where they are up to ``SENT_PIXELS`` pixels: dealt by plane, as many tasks as planes would hold them all.
    ``planes`` is how many there are at most; they are counted unless it is given.
    """
    one = _bounded(pix, height, width)
    if not on:
        return vis.crossJoin(one)
    most = SENT_PIXELS // (height * width)
    if planes is None:
        planes = pix.select(*on).distinct().limit(most + 1).count()
    return vis.join(one if planes <= most else pix, on)


def degrid(vis: DataFrame, image: DataFrame, height: int, width: int, cell: float, key: tuple[str, ...] = ("chan", "beam"), kernel: str = "auto", carried: tuple[str, ...] = ("vis_id", "chan", "beam"), tolerance: float = TOLERANCE, planes: int | None = None) -> DataFrame:
    """Model visibilities ``m_re``, ``m_im`` of each sample (``vis_id``, ``chan``, ``beam``, ``ur``, ``vr``), with its columns ``carried``.

    ``image`` has the columns of ``key`` that it depends on, y, x and value. The join form is a join on those keys and
    a sum, for planes of at most ``SUM_PIXELS``; the matrix form sends the image to the tasks and multiplies separable
    phase factors; ``nufft`` grids, with an error near ``tolerance`` of the largest value and work that grows with samples
    plus pixels. ``auto`` is the join, which is exact, for planes of few pixels, so results hold ``tolerance`` at any size.
    The join has ``planes`` planes at most (see ``with_pixels``).
    """
    kernel = chosen_kernel(kernel, height, width)
    if kernel == "nufft":
        return nufft.forward(vis, image, height, width, cell, key, nufft.spread_for(tolerance), carried)
    if kernel == "matrix":
        return _degrid_matrix(vis, image, height, width, cell, key)
    on = [k for k in key if k in image.columns]
    both = with_pixels(vis, image.select(*on, "y", "x", "value"), on, height, width, planes)
    p = phase(height, width)
    ids = ["vis_id", "chan", "beam"]
    rest = [F.first(c).alias(c) for c in carried if c not in ids]
    s = both.groupBy(*ids).agg(*rest, (F.sum(F.col("value") * F.cos(p)) * cell**2).alias("m_re"), (F.sum(F.col("value") * F.sin(p)) * cell**2).alias("m_im"))
    return s.select(*carried, "m_re", "m_im")


def _planes(image: DataFrame, height: int, width: int, on: list[str]) -> dict:
    """Dense planes by key, on the driver: bounded by MOST_PIXELS."""
    import numpy as np

    n = image.select(*on).distinct().count() if on else 1
    if n * height * width > MOST_PIXELS:
        raise ValueError(f"{n} planes of {height} by {width} pixels are too many to broadcast")
    out: dict = {}
    for r in image.select(*on, "y", "x", "value").toLocalIterator():
        plane = out.setdefault(tuple(r[k] for k in on), np.zeros((height, width)))
        plane[r["y"], r["x"]] = r["value"]
    return out


def sent_planes(image: DataFrame, height: int, width: int, on: list[str]) -> dict:
    """Dense planes by key, for tasks to have: all together at most ``SENT_PIXELS``. Pixels given twice add up, one outside its plane is an error."""
    import numpy as np

    pix = image.groupBy(*on, "y", "x").agg(F.sum(F.col("value").cast("double")).alias("value")).where("value is not null and y is not null and x is not null")
    pix = pix.limit(SENT_PIXELS + 1).toArrow().to_pandas()
    if len(pix) > SENT_PIXELS or not (pix.y.between(0, height - 1) & pix.x.between(0, width - 1)).all():
        raise ValueError(f"more than {SENT_PIXELS} pixels, or some outside {height} by {width}, can't be sent")
    out: dict = {}
    for key, own in pix.groupby(on) if len(pix) else ():
        plane = out.setdefault(tuple(key), np.zeros((height, width)))
        plane[own.y, own.x] = own.value
    return out


def _degrid_matrix(vis, image, height, width, cell, key):
    on = [k for k in key if k in image.columns]
    planes = vis.sparkSession.sparkContext.broadcast(_planes(image, height, width, on))

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        y, x = np.arange(height) - height // 2, np.arange(width) - width // 2
        for pdf in batches:
            model = np.zeros(len(pdf), complex)
            groups = pdf.groupby(on).indices.items() if on else [((), np.arange(len(pdf)))]
            for k, at in groups:
                plane = planes.value.get(k if isinstance(k, tuple) else (k,))
                if plane is None:
                    continue
                for a in range(0, len(at), 4096):
                    i = at[a : a + 4096]
                    ev = np.exp(-1j * np.outer(pdf.vr.to_numpy()[i], y))
                    eu = np.exp(1j * np.outer(pdf.ur.to_numpy()[i], x))
                    model[i] = ((ev @ plane) * eu).sum(1) * cell**2
            yield pdf[["vis_id", "chan", "beam"]].assign(m_re=model.real, m_im=model.imag)

    return vis.select("vis_id", "chan", "beam", "ur", "vr").mapInPandas(run, "vis_id long, chan int, beam int, m_re double, m_im double")


def grid_adjoint(vis: DataFrame, pixels: DataFrame, height: int, width: int, cell: float, keys: tuple[str, ...] = ("chan", "beam"), kernel: str = "auto", tolerance: float = TOLERANCE) -> DataFrame:
    """Adjoint of ``degrid`` for ``re``, ``im``: (keys, y, x, re, im). Partial sums a task, so one row a pixel and task is moved."""
    if chosen_kernel(kernel, height, width) == "nufft":
        return nufft.adjoint(vis, height, width, cell, keys, nufft.spread_for(tolerance), pixels)
    p = phase(height, width)
    both = vis.crossJoin(_bounded(pixels.select("y", "x"), height, width))
    s = both.groupBy(*keys, "y", "x").agg(F.sum(F.col("re") * F.cos(p) + F.col("im") * F.sin(p)).alias("re"), F.sum(F.col("im") * F.cos(p) - F.col("re") * F.sin(p)).alias("im"))
    return s.withColumns({"re": F.col("re") * cell**2, "im": F.col("im") * cell**2})


def summed_in_tasks(good: DataFrame, height: int, width: int, cell: float, planes: dict | None = None) -> DataFrame:
    """The adjoint of samples ``re``, ``im``, or of ``iv`` times the model of ``planes``: (chan, beam, y, x, re, im) of each task's samples, to be summed.

    Small planes only: a task holds a sum for each plane that it meets. A sample's phases are products of one by line and one by
    column; it is read once, moves nowhere and needs no id. Samples whose plane isn't given add nothing.
    """
    if height * width > SUM_PIXELS:
        raise ValueError(f"{height} by {width} pixels are too many to sum for every sample")
    used = ["chan", "beam", "ur", "vr", *(["re", "im"] if planes is None else ["iv"])]
    shape = (height, width)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        y, x, sums = np.arange(height) - height // 2, np.arange(width) - width // 2, {}
        for pdf in batches:
            for key, at in pdf.groupby(["chan", "beam"]).indices.items():
                if planes is not None and key not in planes:
                    continue
                total = sums.setdefault(key, np.zeros(shape, complex))
                for a in range(0, len(at), 4096):
                    u, v, *more = (pdf[c].to_numpy()[at[a : a + 4096]] for c in used[2:])
                    ev, eu = np.exp(-1j * np.outer(v, y)), np.exp(1j * np.outer(u, x))
                    value = more[0] + 1j * more[1] if planes is None else more[0] * cell**2 * ((ev @ planes[key]) * eu).sum(1)
                    total += (ev.conj() * value[:, None]).T @ eu.conj()
        ys, xs = np.indices(shape).reshape(2, -1)
        for (chan, beam), total in sums.items():
            yield pd.DataFrame({"chan": chan, "beam": beam, "y": ys, "x": xs, "re": total.real.ravel() * cell**2, "im": total.imag.ravel() * cell**2})

    known = functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in used))
    return good.where(known).select(*used).mapInPandas(run, "chan int, beam int, y int, x int, re double, im double")


def interp(grid: DataFrame, height: int, width: int) -> DataFrame:
    """Bilinear weights of a sampling grid in [-1, 1] (ends at pixel centres): (beam, y_out, x_out, y_in, x_in, w), corners outside left out."""
    px, py = 0.5 * (F.col("gx") + 1) * (width - 1), 0.5 * (F.col("gy") + 1) * (height - 1)
    t = grid.select("beam", F.col("y").alias("y_out"), F.col("x").alias("x_out"), px.alias("px"), py.alias("py"))
    fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    corner = lambda dy, dx: F.struct((F.floor("py") + dy).cast("int").alias("y_in"), (F.floor("px") + dx).cast("int").alias("x_in"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w"))
    t = t.select("beam", "y_out", "x_out", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("c")).select("beam", "y_out", "x_out", "c.*")
    return t.where(F.col("y_in").between(0, height - 1) & F.col("x_in").between(0, width - 1))


def reproject(image: DataFrame, weights: DataFrame, grid: DataFrame) -> DataFrame:
    """The image on each beam's grid, zero outside: (beam, [chan,] y, x, value)."""
    more = [c for c in ("chan", "k") if c in image.columns]
    pix = image.select(*more, F.col("y").alias("y_in"), F.col("x").alias("x_in"), "value")
    sums = weights.join(pix, ["y_in", "x_in"]).groupBy("beam", *more, F.col("y_out").alias("y"), F.col("x_out").alias("x")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    everywhere = grid.select("beam", "y", "x")
    if more:
        everywhere = everywhere.crossJoin(F.broadcast(image.select(*more).distinct()))
    return everywhere.join(sums, ["beam", *more, "y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def reproject_adjoint(z: DataFrame, weights: DataFrame) -> DataFrame:
    """Each output pixel's value given back to its four input pixels, beams summed: (chan, y, x, re, im)."""
    w = weights.select("beam", F.col("y_out").alias("y"), F.col("x_out").alias("x"), "y_in", "x_in", "w")
    more = [c for c in ("chan",) if c in z.columns]
    s = z.join(w, ["beam", "y", "x"]).groupBy(*more, "y_in", "x_in").agg(F.sum(F.col("w") * F.col("re")).alias("re"), F.sum(F.col("w") * F.col("im")).alias("im"))
    return s.withColumnsRenamed({"y_in": "y", "x_in": "x"})


class Measurement:
    """A and its adjoint over fixed visibilities: reprojection, primary beam and transform, by beam and channel.

    With ``by_tasks``, ``back`` and ``normal`` of small planes are NumPy's sums where samples are read, instead of joins.
    """

    by_tasks = False

    def __init__(self, vis: DataFrame, channels: DataFrame, pb: DataFrame, grid: DataFrame, height: int, width: int, cell: float, kernel: str = "auto", tolerance: float = TOLERANCE):
        self.vis, self.pb, self.grid, self.channels = radpix(vis, channels, cell), pb, grid, channels
        self.weights = interp(grid, height, width)
        self.height, self.width, self.cell, self.kernel, self.tolerance = height, width, cell, kernel, tolerance

    def with_beams(self, pb: DataFrame, grid: DataFrame) -> Measurement:
        """The same operator with its primary beams and grids read from other tables."""
        out = copy.copy(self)
        out.pb, out.grid, out.weights = pb, grid, interp(grid, self.height, self.width)
        out.__dict__.pop("_planes", None)
        return out

    @functools.cached_property
    def _planes(self) -> int | None:
        """Beams times channels, where samples are joined with pixels: short lists are counted, not the image."""
        if chosen_kernel(self.kernel, self.height, self.width) != "join":
            return None
        return self.channels.select("chan").distinct().count() * self.pb.select("beam").distinct().count()

    @property
    def in_tasks(self) -> bool:
        """Whether it is asked for, and the planes of all beams and channels are few enough to be sent to the samples."""
        return self.by_tasks and self._planes is not None and self._planes * self.height * self.width <= SENT_PIXELS

    def persist(self) -> Measurement:
        """Keep visibilities and weights between a solver's iterations."""
        self.vis, self.weights = self.vis.persist(), self.weights.persist()
        return self

    def unpersist(self) -> None:
        self.vis.unpersist()
        self.weights.unpersist()

    def beam_images(self, image: DataFrame) -> DataFrame:
        p = self.pb.select("beam", "y", "x", F.col("value").alias("pb"))
        t = reproject(image, self.weights, self.grid).join(p, ["beam", "y", "x"])
        return t.withColumn("value", F.col("value") * F.col("pb")).drop("pb")

    def forward(self, image: DataFrame) -> DataFrame:
        """(vis_id, chan, beam, m_re, m_im); flagged samples are 0."""
        good = self.vis.where(~F.col("flag"))
        model = degrid(good, self.beam_images(image), self.height, self.width, self.cell, kernel=self.kernel, tolerance=self.tolerance, planes=self._planes)
        out = self.vis.select("vis_id", "chan", "beam").join(model, ["vis_id", "chan", "beam"], "left")
        return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("m_re", "m_im")})

    def adjoint(self, vis: DataFrame) -> DataFrame:
        """(chan, y, x, re, im) of samples with ``re``, ``im``, ``ur``, ``vr``; flagged ones are left out."""
        return self.back(vis.where(~F.col("flag")))

    def adjoint_of(self, values: DataFrame) -> DataFrame:
        """The adjoint for values (vis_id, chan, beam, re, im) of all samples; values that lack one, or are one too many, are an error."""
        ids = ["vis_id", "chan", "beam"]
        if values.select(*ids).exceptAll(self.vis.select(*ids)).head(1) or self.vis.select(*ids).exceptAll(values.select(*ids)).head(1):
            raise ValueError("the values are not one for each sample")
        return self.adjoint(self.vis.drop("re", "im").join(values.select(*ids, "re", "im"), ids))

    def back(self, good: DataFrame) -> DataFrame:
        """The adjoint for samples of which none is flagged."""
        if self.in_tasks:
            return self._summed(good)
        return self._on_image(grid_adjoint(good, self.grid.select("y", "x").distinct(), self.height, self.width, self.cell, kernel=self.kernel, tolerance=self.tolerance))

    def _on_image(self, dirty: DataFrame) -> DataFrame:
        p = self.pb.select("beam", "y", "x", F.col("value").alias("pb"))
        z = dirty.join(p, ["beam", "y", "x"]).withColumns({"re": F.col("re") * F.col("pb"), "im": F.col("im") * F.col("pb")})
        return reproject_adjoint(z, self.weights)

    def _summed(self, good: DataFrame, planes: dict | None = None) -> DataFrame:
        parts = summed_in_tasks(good, self.height, self.width, self.cell, planes)
        return self._on_image(parts.groupBy("chan", "beam", "y", "x").agg(F.sum("re").alias("re"), F.sum("im").alias("im")))

    def normal(self, good: DataFrame, image: DataFrame) -> DataFrame:
        """Aᴴ W A image for good samples with their inverse variance ``iv``: (chan, y, x, value).

        Samples are joined with nothing. With ``in_tasks`` each is degridded, weighed and gridded where it is read.
        """
        if self.in_tasks:
            planes = sent_planes(self.beam_images(image), self.height, self.width, ["chan", "beam"])
            return self._summed(good, planes).select("chan", "y", "x", F.col("re").alias("value"))
        t = degrid(good, self.beam_images(image), self.height, self.width, self.cell, kernel=self.kernel, tolerance=self.tolerance, carried=("chan", "beam", "ur", "vr", "iv"), planes=self._planes)
        t = t.withColumns({"re": F.col("m_re") * F.col("iv"), "im": F.col("m_im") * F.col("iv")})
        return self.back(t).select("chan", "y", "x", F.col("re").alias("value"))

    def residual(self, image: DataFrame, conjugate: bool = True) -> DataFrame:
        """Samples with ``re``, ``im`` = model - data over sigma²; data are conjugated, as models expect."""
        data_im = -F.col("im") if conjugate else F.col("im")
        t = self.vis.where(~F.col("flag")).join(self.forward(image), ["vis_id", "chan", "beam"])
        var = F.col("sigma") * F.col("sigma")
        d_re, d_im = F.col("m_re") - F.col("re"), F.col("m_im") - data_im
        return t.withColumns({"chi2": 0.5 * (d_re * d_re + d_im * d_im) / var, "re": d_re / var, "im": d_im / var})


def noise(vis: DataFrame, seed: int = 0) -> DataFrame:
    """Samples of pure noise: real and imaginary parts normal with the sample's sigma."""
    return vis.withColumns({"re": F.randn(seed) * F.col("sigma"), "im": F.randn(seed + 1) * F.col("sigma")})


def dirty_noise(op: Measurement, seed: int = 0) -> DataFrame:
    """The map that the samples' noise alone makes: (chan, y, x, value), weighted by inverse variance."""
    var = F.col("sigma") * F.col("sigma")
    drawn = noise(op.vis, seed)
    t = op.adjoint(drawn.withColumns({"re": F.col("re") / var, "im": F.col("im") / var}))
    return t.select("chan", "y", "x", F.col("re").alias("value"))


def sampling_grid(pixels: DataFrame, target: dict, source: dict, kind: str = "SIN") -> DataFrame:
    """Where each target pixel (y, x) lies in a source image, in [-1, 1]: (y, x, gx, gy)."""
    from ..functions import sky

    ra, dec = sky.to_sky(F.col("x").cast("double"), F.col("y").cast("double"), target, kind)
    px, py = sky.to_pixel(ra, dec, source, kind)
    w, h = source["NAXIS1"], source["NAXIS2"]
    return pixels.select("y", "x", (2 * px / (w - 1) - 1).alias("gx"), (2 * py / (h - 1) - 1).alias("gy"))


def beams_on_target(pb: DataFrame, headers: dict[int, dict], pixels: DataFrame, target: dict, kind: str = "SIN") -> tuple[DataFrame, DataFrame]:
    """Primary beams and sampling grids of all beams on the target's pixels, NaN of the beams as 0: (pb, grid)."""
    from functools import reduce

    beams, grids = [], []
    for b, header in headers.items():  # a header a beam: a short list
        grid = sampling_grid(pixels, target, header, kind).withColumn("beam", F.lit(b))
        own = pb.where(F.col("beam") == b).select("y", "x", F.nanvl("value", F.lit(0.0)).alias("value"))
        beams.append(reproject(own, interp(grid, header["NAXIS2"], header["NAXIS1"]), grid).select("beam", "y", "x", "value"))
        grids.append(grid.select("beam", "y", "x", "gx", "gy"))
    return reduce(DataFrame.unionByName, beams), reduce(DataFrame.unionByName, grids)
