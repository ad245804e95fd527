"""The imager: from samples, beams and grids to a cube in the units asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import units
from ..operators import measure
from . import iterative, models


class Imager:
    def __init__(self, vis: DataFrame, channels: DataFrame, pb: DataFrame, grid: DataFrame, height: int, width: int, cell: float):
        self.op = measure.Measurement(vis, channels, pb, grid, height, width, cell)
        self.channels = channels

    def process(self, solver: str = "lbfgs", positive: bool = False, iterations: int = 20, lambda_r: float = 0.0, unit: str = "Jy/arcsec^2", start: DataFrame | None = None, model=None, terms=(), priors=()) -> DataFrame:
        """Solve for all channels together: (chan, y, x, value).

        ``model`` (of ``plans.models``) is a plane a channel unless another is given; ``lambda_r`` smooths the cube, with further
        ``terms`` on it and ``priors`` on the model's parameters. ``start`` and all iterates are tables: the image may be of any size.
        """
        if model is None:
            model = models.Cube(r["chan"] for r in self.channels.select("chan").collect())  # the channel axis
        smooth = [models.Laplacian(lambda_r)] if lambda_r else []
        obj = models.Objective(self.op, model, [*smooth, *terms], priors)
        params = iterative.solve(obj, start, solver, positive, iterations)
        return self.converted(model.cube(params), unit)

    def converted(self, image: DataFrame, unit: str) -> DataFrame:
        if unit == "Jy/beam":  # a restoring beam of three pixels
            return image.withColumn("value", F.col("value") * units.beam_area(3 * self.op.cell, 3 * self.op.cell))
        if unit == "K":
            t = image.join(F.broadcast(self.channels.select("chan", "frequency")), "chan")
            return t.withColumn("value", units.jy_arcsec2_to_k(F.col("value"), F.col("frequency"))).drop("frequency")
        if unit == "Jy/arcsec^2":
            return image
        raise ValueError(f"unknown unit {unit}")


def by_channel(vis: DataFrame, solve, schema: str = "chan int, y int, x int, value double") -> DataFrame:
    """Small images: a task solves a channel by itself. ``solve`` gets one channel's samples as pandas."""
    return vis.groupBy("chan").applyInPandas(solve, schema)


def by_cell(vis: DataFrame, work, schema: str) -> DataFrame:
    """The stream of (block, chan, beam) cells: ``work`` gets the key and a cell's samples as pandas, a cell a task's turn."""
    return vis.groupBy("block", "chan", "beam").applyInPandas(work, schema)
