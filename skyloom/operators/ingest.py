"""Ingest algebra: projections, flags, selections, and blocks put together.

A visibility table is in long form: a row a sample, with ``block``, ``beam``, ``ddid``, ``chan``, antennas,
``uu``, ``vv``, ``ww`` in metres, ``re``, ``im``, ``sigma`` and ``flag``. Nothing is padded, so an empty beam
is one without rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sky, units


def stokes_i(first: str = "p0", last: str = "p1") -> tuple[Column, Column]:
    """Half the sum of the first and the last polarisation."""
    return 0.5 * (F.col(f"{first}_re") + F.col(f"{last}_re")), 0.5 * (F.col(f"{first}_im") + F.col(f"{last}_im"))


def sigma_i(s0: Column, s1: Column) -> Column:
    return 0.5 * F.sqrt(s0 * s0 + s1 * s1)


def to_stokes(raw: DataFrame, weights: bool = False) -> DataFrame:
    """Stokes I of raw samples; sigma from weights where asked for."""
    re, im = stokes_i()
    s = [units.sigma_of_weight(F.col(c)) for c in ("w0", "w1")] if weights else [F.col("s0"), F.col("s1")]
    out = raw.withColumns({"re": re, "im": im, "sigma": sigma_i(*s), "flag": F.col("f0") | F.col("f1")})
    return out.drop("p0_re", "p0_im", "p1_re", "p1_im", "w0", "w1", "s0", "s1", "f0", "f1")


def cross_only(vis: DataFrame) -> DataFrame:
    return vis.where(F.col("ant1") != F.col("ant2"))


def baseline() -> Column:
    """Length in metres, the w term included."""
    return F.sqrt(F.col("uu") * F.col("uu") + F.col("vv") * F.col("vv") + F.col("ww") * F.col("ww"))


def flag_uv_range(vis: DataFrame, low: float, high: float) -> DataFrame:
    """Samples out of the range (ends included) stay, flagged and with infinite sigma."""
    inside = baseline().between(low, high)
    return vis.withColumns({"flag": F.col("flag") | ~inside, "sigma": F.when(inside, F.col("sigma")).otherwise(F.lit(float("inf")))})


def within_uv_lambda(vis: DataFrame, channels: DataFrame, low: float, high: float) -> DataFrame:
    """Samples whose (u, v) length in wavelengths lies in the range."""
    joined = with_channel(vis, channels)
    length = F.sqrt(F.pow(units.to_lambda(F.col("uu"), F.col("frequency")), 2) + F.pow(units.to_lambda(F.col("vv"), F.col("frequency")), 2))
    return joined.where(length.between(low, high))


def with_channel(vis: DataFrame, channels: DataFrame) -> DataFrame:
    """Join the channel axis: one row a channel, so it is small by design."""
    return vis.join(F.broadcast(channels), "chan")


def with_beam(vis: DataFrame, beams: DataFrame) -> DataFrame:
    """Join the beam list: one row a beam."""
    return vis.join(F.broadcast(beams), "beam")


def select_channels(vis: DataFrame, chosen: Sequence[int] | slice) -> DataFrame:
    """By list or slice: a predicate on ``chan``, so partitions and row groups are pruned."""
    c = F.col("chan")
    if isinstance(chosen, slice):
        start, step = chosen.start or 0, chosen.step or 1
        keep = (c >= start) & ((c - start) % step == 0)
        return vis.where(keep & (c < chosen.stop) if chosen.stop is not None else keep)
    if not len(chosen):
        raise ValueError("no channel is selected")
    return vis.where(c.isin(list(chosen)))


def select_beams(vis: DataFrame, chosen: int | slice | Sequence[int], n_beams: int) -> DataFrame:
    wanted = range(n_beams)[chosen] if isinstance(chosen, slice) else [chosen] if isinstance(chosen, int) else sorted(set(chosen))
    if any(not 0 <= b < n_beams for b in wanted):
        raise ValueError(f"beams must lie in 0..{n_beams - 1}")
    return vis.where(F.col("beam").isin(list(wanted)))


def nearest_channel(channels: DataFrame, frequency: float) -> DataFrame:
    """The channel closest to a frequency; the lowest of equals."""
    return channels.agg(F.min(F.struct(F.abs(F.col("frequency") - frequency).alias("off"), "chan", "frequency")).alias("best")).select("best.chan", "best.frequency")


def by_spw(vis: DataFrame, data_description: DataFrame, wanted: DataFrame) -> DataFrame:
    """Samples whose ddid belongs to the spectral window wanted for their beam (``beam``, ``spw``)."""
    pairs = data_description.join(F.broadcast(wanted), "spw").select("beam", "ddid")
    return vis.join(F.broadcast(pairs), ["beam", "ddid"], "left_semi")


def in_cone(beams: DataFrame, ra0: float, dec0: float, radius_deg: float) -> DataFrame:
    return beams.where(sky.separation(F.col("ra_deg"), F.col("dec_deg"), ra0, dec0) <= radius_deg)


def load_block(vis: DataFrame, beams: DataFrame) -> DataFrame:
    """Every beam with its number of samples and of good ones: beams without samples keep their place."""
    counts = vis.groupBy("beam").agg(F.count(F.lit(1)).alias("nvis"), F.count_if(~F.col("flag")).alias("ngood"))
    return beams.join(counts, "beam", "left").select("beam", F.coalesce("nvis", F.lit(0)).alias("nvis"), F.coalesce("ngood", F.lit(0)).alias("ngood"))


def beam_ranges(vis: DataFrame) -> DataFrame:
    """Where each beam's samples begin when they are put in order of beams, and how many they are: (beam, first, n).

    Beginnings are sums of counts, so samples needn't be numbered.
    """
    n = vis.groupBy("beam").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("beam").rowsBetween(Window.unboundedPreceding, -1))  # one row a beam
    return n.select("beam", F.coalesce(before, F.lit(0)).cast("long").alias("first"), "n")


def counts(vis: DataFrame) -> DataFrame:
    """Good samples of each channel and beam that has some."""
    return vis.where(~F.col("flag")).groupBy("chan", "beam").agg(F.count(F.lit(1)).alias("n"))


def first_blocks(vis: DataFrame, most: int) -> DataFrame:
    """The first ``most`` blocks: the block list is small, so it is ranked by itself."""
    blocks = vis.select("block").distinct()
    ranked = blocks.withColumn("r", F.dense_rank().over(Window.orderBy("block"))).where(F.col("r") <= most).drop("r")
    return vis.join(F.broadcast(ranked), "block", "left_semi")


class MismatchError(ValueError):
    """Blocks that can't be merged."""


def mismatched_centres(first: DataFrame, other: DataFrame, tolerance_deg: float) -> DataFrame:
    """Beams whose centres differ by more than the tolerance, or that one side lacks."""
    a = first.select("beam", F.col("ra_deg").alias("ra_a"), F.col("dec_deg").alias("dec_a"))
    b = other.select("beam", F.col("ra_deg").alias("ra_b"), F.col("dec_deg").alias("dec_b"))
    off = (F.abs(F.col("ra_a") - F.col("ra_b")) <= tolerance_deg) & (F.abs(F.col("dec_a") - F.col("dec_b")) <= tolerance_deg)
    return a.join(b, "beam", "full").where(~F.coalesce(off, F.lit(False))).select("beam")


def mismatched_channels(first: DataFrame, other: DataFrame, tolerance_hz: float = 1e-6) -> DataFrame:
    a, b = first.select("chan", F.col("frequency").alias("fa")), other.select("chan", F.col("frequency").alias("fb"))
    return a.join(b, "chan", "full").where(~F.coalesce(F.abs(F.col("fa") - F.col("fb")) <= tolerance_hz, F.lit(False))).select("chan")


def same_channels(axes: Sequence[DataFrame]) -> None:
    """An error if a channel axis (``chan``, ``frequency``) differs from the first."""
    for other in axes[1:]:
        if mismatched_channels(axes[0], other).limit(1).count():
            raise MismatchError("blocks differ in their frequencies")


def merge(blocks: Sequence[DataFrame], centres: Sequence[DataFrame] = (), tolerance_deg: float = 1e-6, axes: Sequence[DataFrame] = ()) -> DataFrame:
    """Samples of all blocks beam by beam; blocks must agree on beams, centres and channel axes."""
    same_channels(axes)
    for other in centres[1:]:
        bad = mismatched_centres(centres[0], other, tolerance_deg).limit(1).count()
        if bad:
            raise MismatchError("blocks differ in their beams' centres")
    return reduce(DataFrame.unionByName, blocks)


def numbered(rows: DataFrame, first: str, then: str, width_bits: int = 12) -> DataFrame:
    """Adds ``place``, from 1 in order of two whole-number columns, nulls last: no task sorts all rows.

    Rows are numbered within 2**width_bits values of ``then``, after the rows before; only the list of these ranges is in one place.
    """
    at = {"__first": F.coalesce(F.col(first).cast("long"), F.lit((1 << 63) - 1)), "__range": F.coalesce(F.shiftright(F.col(then).cast("long"), width_bits), F.lit((1 << 63) - 1))}
    ranges = list(at)
    t = rows.withColumns(at)
    n = F.col("n")
    before = F.sum(n).over(Window.orderBy(*ranges)) - n
    size = t.groupBy(*ranges).agg(F.count(F.lit(1)).alias("n")).select(*[F.col(c).alias(c) for c in ranges], before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(*ranges).orderBy(F.col(first).asc_nulls_last(), F.col(then).asc_nulls_last()))
    t = t.withColumn("__own", own).join(size, ranges)
    return t.withColumn("place", (F.col("__before") + F.col("__own")).cast("long")).drop(*ranges, "__own", "__before")


def beam_offsets(vis: DataFrame) -> DataFrame:
    """How many beams the blocks before each one have: (block, nbeam, offset)."""
    size = vis.groupBy("block").agg((F.max("beam") + 1).alias("nbeam"))
    before = F.coalesce(F.sum("nbeam").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return size.select("block", "nbeam", before.cast("long").alias("offset"))


def stack(vis: DataFrame) -> DataFrame:
    """Blocks side by side: each block's beams are numbered after those of the blocks before it."""
    offset = beam_offsets(vis).select("block", "offset")
    return vis.join(F.broadcast(offset), "block").withColumn("beam", (F.col("beam") + F.col("offset")).cast("int")).drop("offset")


def paired(first: DataFrame, second: DataFrame, by_first: str, by_second: str) -> DataFrame:
    """Two lists side by side, each in its own order, with their ``place`` from 0; lists of unequal lengths are an error."""
    n, m = first.count(), second.count()
    if n != m:
        raise MismatchError(f"{n} and {m} rows can't be paired")
    a = first.withColumn("place", F.row_number().over(Window.orderBy(by_first)) - 1)
    return a.join(second.withColumn("place", F.row_number().over(Window.orderBy(by_second)) - 1), "place")


def beam_files(names: DataFrame, column: str = "name") -> DataFrame:
    """The leave's letter, beam number and holography file of each set's name: (``names``, leave, beam, file).

    The letter is that of the last MS_M... part, the number that after "beam". A name without either is an error.
    """
    n = F.col(column)
    leave = F.element_at(F.regexp_extract_all(n, F.lit(r"MS_M[0-9+\-]+([ABC])_"), F.lit(1)), -1)
    number = F.nullif(F.regexp_extract(n, r"beam(\d+)", 1), F.lit(""))
    out = names.withColumns({"leave": F.when(F.regexp_count(n, F.lit(r"MS_M[0-9+\-]+[ABC]_")) > 0, leave), "beam": number.cast("int")})
    bad = out.where("leave is null or beam is null").select(column).head(1)
    if bad:
        raise ValueError(f"{bad[0][0]} has no beam number or leave letter")
    return out.withColumn("file", F.concat(F.lit("ASKAP_BEAM"), F.lpad(number, F.greatest(F.length(number), F.lit(2)), F.lit("0")), F.lit(".fits")))


def channel_offsets(cubes: DataFrame) -> DataFrame:
    """Where each cube of a list (cube, first, n) begins in the merged one: (cube, first, n, offset).

    Cubes go by their first channel in the survey; a gap between two of them or an overlap is an error.
    """
    w = Window.orderBy("first", "cube")  # a list of cubes: one row each
    end = F.lag(F.col("first") + F.col("n")).over(w)
    t = cubes.select("cube", "first", "n", end.alias("end"), F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("offset"))
    bad = t.where("end is not null and end <> first").orderBy("first").select("cube", "first", "end").head(1)
    if bad:
        raise MismatchError(f"cube {bad[0]['cube']} begins at channel {bad[0]['first']}, the one before ends before {bad[0]['end']}")
    return t.drop("end")


def merge_cubes(images: DataFrame, cubes: DataFrame) -> DataFrame:
    """Planes of several cubes (cube, chan, y, x, value), each numbered from 0, as one cube in the order of ``channel_offsets``."""
    at = channel_offsets(cubes).select("cube", "offset")
    return images.join(at, "cube").select((F.col("chan") + F.col("offset")).cast("int").alias("chan"), "y", "x", "value")


def common_columns(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of tables on the columns that all have."""
    shared = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return reduce(DataFrame.unionByName, [t.select(*shared) for t in tables])


def slabs(channels: DataFrame, size: int = 64) -> DataFrame:
    """Runs of contiguous channels of at most ``size``: (slab, c0, c1, n), slabs numbered from 0 in order."""
    island = channels.select("chan", (F.col("chan") - F.row_number().over(Window.orderBy("chan"))).alias("island"))
    part = F.floor((F.row_number().over(Window.partitionBy("island").orderBy("chan")) - 1) / size)
    runs = island.withColumn("part", part).groupBy("island", "part").agg(F.min("chan").alias("c0"), (F.max("chan") + 1).alias("c1"), F.count(F.lit(1)).alias("n"))
    return runs.select((F.row_number().over(Window.orderBy("c0")) - 1).alias("slab"), "c0", "c1", "n")


def beam_numbers(names: DataFrame, column: str = "name") -> DataFrame:
    """Natural order of file names: the number after C10, else after BEAM, else the first number."""
    n = F.col(column)
    number = lambda p: F.nullif(F.regexp_extract(n, p, 1), F.lit("")).cast("int")
    return names.withColumn("number", F.coalesce(number(r"C10[_-](\d+)"), number(r"(?i)BEAM[_-]?(\d+)"), number(r"(\d+)")))


def listed(names: DataFrame, column: str = "name", suffix: str = ".ms") -> DataFrame:
    """File names that end in ``suffix`` (any case) and don't start with a dot, numbered in order."""
    kept = names.where(F.lower(column).endswith(suffix) & ~F.col(column).startswith("."))
    return kept.withColumn("place", F.row_number().over(Window.orderBy(column)) - 1)


def order_is_strict(channels: DataFrame) -> DataFrame:
    """One row: whether frequencies strictly rise, or strictly fall, with the channel number."""
    step = channels.select((F.col("frequency") - F.lag("frequency").over(Window.orderBy("chan"))).alias("d")).where("d is not null")
    return step.agg(F.coalesce(F.bool_and(F.col("d") > 0), F.lit(True)).alias("rising"), F.coalesce(F.bool_and(F.col("d") < 0), F.lit(True)).alias("falling"))


def largest_drift(vis: DataFrame, channels: DataFrame) -> DataFrame:
    """Largest change of u or v, in wavelengths, from the first to the last channel: one row, ``drift``."""
    span = channels.agg((F.max("frequency") - F.min("frequency")).alias("span"))
    return vis.agg(F.max(F.greatest(F.abs("uu"), F.abs("vv"))).alias("longest")).crossJoin(span).select((F.col("longest") * F.col("span") / units.C).alias("drift"))


def subsample(vis: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """A random sample with replacement: this operator's purpose."""
    return vis.sample(True, fraction, seed)
