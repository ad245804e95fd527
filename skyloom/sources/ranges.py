"""Files by byte range, through the file systems that Spark itself reads with.

Headers are looked at on the driver, through Hadoop's streams; the bytes behind them are records of one length that Spark's
input splits deal to tasks, each with its place in the file. So a file is read by many tasks, whatever its size, and any
path that Spark's own readers open will do.
"""

from __future__ import annotations

import bisect
import io
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a record at most, and of a piece of an archive's member.
RECORD, PIECE = 1 << 18, 1 << 22


class HadoopFile(io.RawIOBase):
    """A file of any of Spark's file systems as a Python file: for headers, which are small."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        self.size = fs.getFileStatus(p).getLen()
        self._stream, self._at = fs.open(p), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = max(0, offset + (0, self._at, self.size)[whence])
        return self._at

    def readinto(self, buffer) -> int:
        n = min(len(buffer), max(self.size - self._at, 0))
        if n:
            self._stream.seek(self._at)
            got = self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._stream, n)
            buffer[:n] = bytes(got)
            self._at += n
        return n

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


def files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """The file itself, or the files of a folder with that ending, by name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if fs.getFileStatus(p).isFile():
        return [path]
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().lower().endswith(suffix))


def records(spark: SparkSession, path: str, size: int, unit: int) -> DataFrame:
    """(at, bytes): a file's bytes in records with their offsets. ``unit`` divides ``size``; a record is a multiple of it."""
    if size % unit:
        raise ValueError(f"{path} is no multiple of {unit} bytes")
    n = size // unit
    length = unit * max(d for d in range(1, max(2, RECORD // unit + 1)) if n % d == 0) if n else unit
    kind = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    rdd = spark.sparkContext.newAPIHadoopFile(path, kind, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{kind}.recordLength": str(length)})
    return spark.createDataFrame(rdd.map(lambda kv: (kv[0] * length, bytes(kv[1]))), "at long, bytes binary")


def tar_members(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, offset, size) of an archive's files, from their headers alone."""
    with HadoopFile(spark, path) as raw, tarfile.open(fileobj=raw, mode="r:") as tar:
        return [(m.name, m.offset_data, m.size) for m in tar if m.isfile()]


def tar_pieces(spark: SparkSession, path: str, wanted: str | None = None) -> DataFrame:
    """(archive, name, size, offset, content): the files of archives (a path or a folder of ``*.tar``) in pieces.

    ``offset`` is a piece's place in its file; a piece has ``PIECE`` bytes at most and ends where a task's share does. A file of
    no bytes has one empty piece. ``wanted`` is a regular expression that names must match. Compressed archives can't be
    read by range.
    """
    import re

    out = None
    for archive in files(spark, path, ".tar"):
        members = [m for m in tar_members(spark, archive) if wanted is None or re.search(wanted, m[0])]
        held = sorted((m for m in members if m[2]), key=lambda m: m[1])
        starts = [m[1] for m in held]

        def pieces(batches, archive=archive, held=held, starts=starts) -> Iterator:
            import pyarrow as pa

            open_: list = [None, 0, []]  # member, offset in it, bytes

            def closed():
                member, offset, parts = open_
                open_[:] = [None, 0, []]
                name, _, size = held[member]
                return pa.RecordBatch.from_pydict({"archive": [archive], "name": [name], "size": [size], "offset": [offset], "content": [b"".join(parts)]})

            for batch in batches:
                for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    i = max(bisect.bisect_right(starts, at) - 1, 0)
                    while i < len(held) and starts[i] < at + len(raw):
                        lo, hi = max(at, starts[i]), min(at + len(raw), starts[i] + held[i][2])
                        while lo < hi:
                            member, offset, parts = open_
                            have = sum(map(len, parts))
                            if member is not None and (member != i or offset + have != lo - starts[i] or have >= PIECE):
                                yield closed()
                                continue
                            if member is None:
                                open_[:] = [i, lo - starts[i], []]
                                have = 0
                            take = min(hi - lo, PIECE - have)
                            open_[2].append(raw[lo - at : lo - at + take])
                            lo += take
                        i += 1
            if open_[0] is not None:
                yield closed()

        with HadoopFile(spark, archive) as f:
            size = f.size
        found = records(spark, archive, size, 512).mapInArrow(pieces, "archive string, name string, size long, offset long, content binary")
        empty = [(archive, n, 0, 0, b"") for n, _, s in members if not s]
        if empty:
            found = found.unionByName(spark.createDataFrame(empty, found.schema))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise FileNotFoundError(f"{path} has no archive")
    return out


def fits_pixels(spark: SparkSession, path: str, planes: list[int] | None = None, nan_to_zero: bool = False) -> DataFrame:
    """(path, chan, y, x, value) of FITS images by byte range: what the ``fits`` source gives, from any path that Spark reads.

    A plane of any size is read by many tasks; records outside the wanted ``planes`` are dropped as bytes.
    """
    from . import fits

    out = None
    for name in files(spark, path, ".fits"):
        with HadoopFile(spark, name) as f:
            raw, size = b"", f.size
            while True:
                block = f.read(fits.BLOCK)
                raw += block
                if not block or any(raw[k : k + 8] == b"END     " for k in range(len(raw) - len(block), len(raw), fits.CARD)):
                    break
        header, start = fits.parse_header(raw)
        part = _pixels(spark, name, size, header, start, planes, nan_to_zero)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"{path} has no image")
    return out


def _pixels(spark, name, size, header, start, planes, nan_to_zero) -> DataFrame:
    import numpy as np

    from . import fits

    n, h, w = fits.shape_of(header)
    kind, scale, zero = np.dtype(fits.DTYPES[header["BITPIX"]]), header.get("BSCALE", 1), header.get("BZERO", 0)
    end = start + n * h * w * kind.itemsize
    chosen = None if planes is None else np.array(sorted(planes))
    t = records(spark, name, size, fits.BLOCK)
    rows = t.where((F.col("at") + F.length("bytes") > start) & (F.col("at") < end))

    def pixels(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lo, hi = max(at, start), min(at + len(raw), end)
                value = np.frombuffer(raw, kind, (hi - lo) // kind.itemsize, lo - at).astype(float) * scale + zero
                place = (lo - start) // kind.itemsize + np.arange(len(value))
                chan = place // (h * w)
                if chosen is not None:
                    on = np.isin(chan, chosen)
                    value, place, chan = value[on], place[on], chan[on]
                if nan_to_zero:
                    value = np.nan_to_num(value, nan=0.0)
                ints = lambda a: pa.array(a.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(value), pa.string()), ints(chan), ints(place // w % h), ints(place % w), pa.array(value)], ["path", "chan", "y", "x", "value"])

    return rows.mapInArrow(pixels, fits.SCHEMA)
