"""Discrete Fourier transforms of planes of any size: blocks of columns, then blocks of lines, as arrays between tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nufft import TILE, _flat, _typed


def fft(image: DataFrame, height: int, width: int, inverse: bool = False, keys: tuple[str, ...] = ("chan",)) -> DataFrame:
    """(keys, y, x, re, im) of ``value``, or of ``re`` and ``im``: as ``images.fft``, but no task holds a plane.

    Pixels not given are 0, pixels given twice add up; the inverse is over the number of pixels.
    """
    keys = list(keys)
    re, im = (F.col("value"), F.lit(0.0)) if "value" in image.columns else (F.col("re"), F.col("im"))
    kinds, blocks = _typed(image, keys), -(-height // TILE)

    def columns(pdf):
        import numpy as np
        import pandas as pd

        first = int(pdf.x.iloc[0]) // TILE * TILE
        n = min(TILE, width - first)
        block = np.zeros((height, n), complex)
        np.add.at(block, (pdf.y.to_numpy(), pdf.x.to_numpy() - first), pdf.re.to_numpy() + 1j * pdf.im.to_numpy())
        cut = np.split(np.fft.ifft(block, axis=0) if inverse else np.fft.fft(block, axis=0), range(TILE, height, TILE))
        return _flat(pd.DataFrame, keys, pdf, yb=np.arange(blocks), xb=np.full(blocks, first // TILE), re=[c.real.ravel() for c in cut], im=[c.imag.ravel() for c in cut])

    def lines(pdf):
        import numpy as np
        import pandas as pd

        first = int(pdf.yb.iloc[0]) * TILE
        n = min(TILE, height - first)
        block = np.zeros((n, width), complex)
        for xb, a, b in zip(pdf.xb, pdf.re, pdf.im):
            block[:, xb * TILE : (xb + 1) * TILE] = (np.asarray(a) + 1j * np.asarray(b)).reshape(n, -1)
        out = np.fft.ifft(block, axis=1) if inverse else np.fft.fft(block, axis=1)
        return _flat(pd.DataFrame, keys, pdf, y=np.repeat(first + np.arange(n), width), x=np.tile(np.arange(width), n), re=out.real.ravel(), im=out.imag.ravel())

    t = image.select(*keys, "y", "x", re.cast("double").alias("re"), im.cast("double").alias("im"))
    t = t.groupBy(*keys, F.floor(F.col("x") / TILE)).applyInPandas(columns, f"{kinds}, yb int, xb int, re array<double>, im array<double>")
    return t.groupBy(*keys, "yb").applyInPandas(lines, f"{kinds}, y int, x int, re double, im double")
