"""Visibility sets on disk: a folder a beam (``*.ms``), blocks as folders of those, tables as Parquet.

Each set has ``main`` (samples with arrays of polarisations), ``spectral_window``, ``field`` and ``data_description``.
``VisReader`` lists blocks and sets, and gives plans in which channel, beam and window selections reach the scan.
"""

from __future__ import annotations

import io
import os
import re
import tarfile
import warnings
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units
from ..operators import ingest


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder of any file system that Spark reads."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith("."))


def list_sets(spark: SparkSession, path: str) -> list[str]:
    """Sets of a block in order of their names; an error if there are none."""
    if path.rstrip("/").lower().endswith(".ms"):
        return [path]
    found = [f"{path}/{n}" for n in _children(spark, path) if n.lower().endswith(".ms")]
    if not found:
        raise FileNotFoundError(f"{path} has no set")
    return found


def natural(name: str) -> tuple:
    """Sort key: the number after C10, else after BEAM, then names with their numbers as numbers."""
    name = os.path.basename(name)
    m = re.search(r"C10[_-](\d+)", name) or re.search(r"BEAM[_-]?(\d+)", name, re.I)
    return (0, int(m.group(1)), name) if m else (1, *[(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", name)])


def list_sets_naturally(spark: SparkSession, path: str) -> list[str]:
    return sorted(list_sets(spark, path), key=natural)


def list_blocks(spark: SparkSession, root: str) -> list[str]:
    """The root itself if it holds sets, and each folder in it that does."""
    if root.rstrip("/").lower().endswith(".ms"):
        return [root]
    names = _children(spark, root)
    holds = lambda p: any(n.lower().endswith(".ms") for n in _children(spark, p))
    found = ([root] if any(n.lower().endswith(".ms") for n in names) else []) + [f"{root}/{n}" for n in sorted(names, key=natural) if not n.lower().endswith(".ms") and holds(f"{root}/{n}")]
    if not found:
        raise FileNotFoundError(f"{root} has no block")
    return found


def windows_of(spw: int | Sequence[int] | None, chosen: Sequence[int], n_sets: int) -> list[int | None]:
    """The window of each chosen beam: none, one for all, one each, or those of the chosen out of one a set."""
    if spw is None or isinstance(spw, int):
        return [spw] * len(chosen)
    if isinstance(spw, (str, bytes)) or not isinstance(spw, Sequence):
        raise TypeError("spw must be a number, a list of them or none")
    if len(spw) == len(chosen):
        return [int(x) for x in spw]
    if len(spw) == n_sets:
        return [int(spw[b]) for b in chosen]
    raise ValueError(f"spw must have {len(chosen)} numbers (selected beams) or {n_sets} (all sets), not {len(spw)}")


class VisReader:
    """Reads blocks into the long form. Selections are predicates, so that they reach the Parquet scan."""

    def __init__(self, spark: SparkSession, prefer_weights: bool = False, keep_autocorrelations: bool = False):
        self.spark, self.prefer_weights, self.keep = spark, prefer_weights, keep_autocorrelations

    def _table(self, path: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{path}/{name}")

    def windows(self, path: str) -> DataFrame:
        """(spw, nchan, fmin, fmax)."""
        return self._table(path, "spectral_window").groupBy("spw").agg(F.count(F.lit(1)).alias("nchan"), F.min("chan_freq").alias("fmin"), F.max("chan_freq").alias("fmax"))

    def data_descriptions(self, path: str, spw: int) -> list[int]:
        rows = self._table(path, "data_description").collect()  # a row a window and polarisation setup
        found = [r["ddid"] for r in rows if r["spw"] == spw]
        if not found:
            raise ValueError(f"no window {spw}; there are {sorted({r['spw'] for r in rows})}")
        return found

    def channels(self, path: str, spw: int = 0, rest_hz: float = units.REST_HZ) -> DataFrame:
        t = self._table(path, "spectral_window").where(F.col("spw") == spw)
        return t.select("chan", F.col("chan_freq").alias("frequency"), units.velocity(F.col("chan_freq"), rest_hz).alias("velocity"))

    def centre(self, path: str) -> DataFrame:
        """Phase centre of the first field, in degrees."""
        return self._table(path, "field").where("field = 0").select(F.degrees("ra").alias("ra_deg"), F.degrees("dec").alias("dec_deg"))

    def read_set(self, path: str, beam: int, channels: Sequence[int] | slice | None = None, spw: int | None = None) -> DataFrame:
        """One set's samples: a row a sample and channel."""
        main = self._table(path, "main")
        if spw is not None:
            main = main.where(F.col("ddid").isin(self.data_descriptions(path, spw)))
        if not self.keep:
            main = ingest.cross_only(main)
        if channels is not None:
            main = ingest.select_channels(main, channels)
        first, last = (lambda c: F.element_at(c, 1)), (lambda c: F.element_at(c, -1))
        by_weight = self.prefer_weights and "weight" in main.columns
        s = [units.sigma_of_weight(e("weight")) if by_weight else e("sigma") for e in (first, last)]
        one = F.size("data") == 1
        t = main.withColumns(
            {
                "beam": F.lit(beam),
                "re": F.when(one, first("data")["re"]).otherwise(0.5 * (first("data")["re"] + last("data")["re"])),
                "im": F.when(one, first("data")["im"]).otherwise(0.5 * (first("data")["im"] + last("data")["im"])),
                "flag": first("flags") | last("flags"),
                "sigma": F.when(one, s[0]).otherwise(ingest.sigma_i(*s)),
            }
        )
        return t.select("beam", "ddid", "chan", "ant1", "ant2", "uu", "vv", "ww", "re", "im", "sigma", "flag")

    def read_block(
        self, path: str, channels=None, beams: Sequence[int] | None = None, uv_range: tuple[float, float] | None = None, cone: tuple[float, float, float] | None = None, spw: int | Sequence[int] | None = None, skip_failed: bool = False
    ) -> DataFrame:
        """All sets of a block; beams out of the cone aren't read at all.

        ``spw`` is one window, or a list with one for each selected beam or for each set of the block. With ``skip_failed`` sets that can't
        be read are left out, with a warning; their beams' numbers stay free.
        """
        sets = list_sets(self.spark, path)
        chosen = list(range(len(sets))) if beams is None else sorted(set(beams))
        if any(not 0 <= b < len(sets) for b in chosen):
            raise ValueError(f"beams must lie in 0..{len(sets) - 1}")
        windows = dict(zip(chosen, windows_of(spw, chosen, len(sets))))
        parts, first = [], None
        for b in chosen:
            try:
                if cone is not None and not ingest.in_cone(self.centre(sets[b]), *cone).limit(1).count():
                    first = b if first is None else first
                    continue
                parts.append(self.read_set(sets[b], b, channels, windows[b]))
            except AnalysisException as e:  # a table that isn't there, or isn't Parquet
                if not skip_failed:
                    raise
                warnings.warn(f"{sets[b]} is left out: {str(e).splitlines()[0]}", stacklevel=2)
        if not parts:
            if first is None:
                raise FileNotFoundError(f"{path} has no set that can be read")
            parts = [self.read_set(sets[first], first, channels, windows[first]).limit(0)]
        out = reduce(DataFrame.unionByName, parts)
        return ingest.flag_uv_range(out, *uv_range) if uv_range else out

    def beams(self, path: str) -> DataFrame:
        rows = [(b, os.path.basename(p), *self.centre(p).first()) for b, p in enumerate(list_sets(self.spark, path))]
        return self.spark.createDataFrame(rows, "beam int, name string, ra_deg double, dec_deg double")

    def read_blocks(self, root: str, mode: str = "merge", most: int | None = None, **how) -> DataFrame:
        """Blocks put together: ``merge`` (beam by beam, centres must agree), ``stack`` or ``separate``.

        Merged and stacked blocks must have the same frequencies.
        """
        paths = list_blocks(self.spark, root)[:most]
        spw = how.get("spw")
        spw = (spw or 0) if spw is None or isinstance(spw, int) else spw[0]
        axes = [self.channels(list_sets(self.spark, p)[0], spw) for p in paths] if mode in ("merge", "stack") else []
        if how.get("channels") is not None:
            axes = [ingest.select_channels(a, how["channels"]) for a in axes]
        each = [self.read_block(p, **how).withColumn("block", F.lit(i)) for i, p in enumerate(paths)]
        if mode == "merge":
            return ingest.merge(each, [self.beams(p) for p in paths], 1e-6, axes)
        ingest.same_channels(axes)
        both = reduce(DataFrame.unionByName, each)
        if mode == "stack":
            return ingest.stack(both)
        if mode == "separate":
            return both
        raise ValueError(f"unknown mode {mode}")

    def iter_slabs(self, root: str, size: int = 64, **how) -> Iterator[tuple[int, int, DataFrame]]:
        """(first, end, samples) of each run of at most ``size`` contiguous channels."""
        first = list_sets(self.spark, list_blocks(self.spark, root)[0])[0]
        for r in ingest.slabs(self.channels(first), size).orderBy("slab").collect():
            yield r["c0"], r["c1"], self.read_blocks(root, channels=slice(r["c0"], r["c1"]), **how)


def write_set(path: str, main: DataFrame, channels: DataFrame, ra_deg: float, dec_deg: float, descriptions: Sequence[tuple[int, int]] = ((0, 0),)) -> None:
    """Write a set; ``main`` is laid out by channel, so that channel selections prune files."""
    spark = main.sparkSession
    main.write.partitionBy("chan").parquet(f"{path}/main")
    channels.select(F.lit(0).alias("spw"), "chan", F.col("frequency").alias("chan_freq")).write.parquet(f"{path}/spectral_window")
    spark.range(1).select(F.lit(0).alias("field"), F.radians(F.lit(ra_deg)).alias("ra"), F.radians(F.lit(dec_deg)).alias("dec")).write.parquet(f"{path}/field")
    spark.createDataFrame(list(descriptions), "ddid int, spw int").write.parquet(f"{path}/data_description")


def tar_members(spark: SparkSession, path: str, pattern: str = "*.tar") -> DataFrame:
    """(archive, name, content) of every file in the archives of a folder, an archive a task: for small ones. ``ranges.tar_pieces`` reads archives of any size, by range."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for archive, content in zip(pdf.path, pdf.content):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    rows = [(archive, m.name, tar.extractfile(m).read()) for m in tar if m.isfile()]
                yield pd.DataFrame(rows, columns=["archive", "name", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(run, "archive string, name string, content binary")
