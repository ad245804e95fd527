"""FITS images as a Spark data source, and a writer: no library needed.

``spark.read.format("fits").load(path)`` gives (path, chan, y, x, value), one task a plane; ``planes`` selects channels
before anything is read. Only the primary image of a file is read. NaN pixels become 0 where ``nan_to_zero`` is set.
This source opens files as Python does; ``ranges.fits_pixels`` reads any path that Spark reads, and planes of any size.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CARD, BLOCK = 80, 2880
#: The format's pixel types.
DTYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
SCHEMA = "path string, chan int, y int, x int, value double"


def parse_header(raw: bytes) -> tuple[dict, int]:
    """Keywords of the first header, and the offset of the data."""
    header: dict = {}
    for at in range(0, len(raw), CARD):
        card = raw[at : at + CARD].decode("ascii", "replace")
        key = card[:8].strip()
        if key == "END":
            return header, (at + CARD + BLOCK - 1) // BLOCK * BLOCK
        if card[8:10] != "= ":
            continue
        text = card[10:].strip()
        if text.startswith("'"):
            end = text.replace("''", "\0\0").find("'", 1)
            header[key] = text[1:end].replace("''", "'").rstrip()
            continue
        text = text.split("/")[0].strip()
        if text in ("T", "F"):
            header[key] = text == "T"
        elif text:
            try:
                header[key] = int(text)
            except ValueError:
                header[key] = float(text.replace("D", "E"))
    raise ValueError("the header has no END card")


def read_header(path: str) -> tuple[dict, int]:
    raw = b""
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            raw += block
            if any(raw[k : k + 8] == b"END     " for k in range(len(raw) - len(block), len(raw), CARD)):
                return parse_header(raw)
    raise ValueError(f"{path} is no FITS file")


def shape_of(header: dict) -> tuple[int, int, int]:
    """Planes, rows and columns; axes beyond the third must have length 1."""
    axes = [header[f"NAXIS{i}"] for i in range(1, header["NAXIS"] + 1)]
    if len(axes) < 2 or any(n != 1 for n in axes[3:]):
        raise ValueError("an image of two or three axes is needed")
    return (axes[2] if len(axes) > 2 else 1), axes[1], axes[0]


def read_plane(path: str, chan: int, nan_to_zero: bool = False) -> np.ndarray:
    header, start = read_header(path)
    _, h, w = shape_of(header)
    kind = np.dtype(DTYPES[header["BITPIX"]])
    with open(path, "rb") as f:
        f.seek(start + chan * h * w * kind.itemsize)
        plane = np.frombuffer(f.read(h * w * kind.itemsize), kind).reshape(h, w).astype(float)
    plane = plane * header.get("BSCALE", 1) + header.get("BZERO", 0)
    return np.nan_to_num(plane, nan=0.0) if nan_to_zero else plane


def _card(key: str, value) -> str:
    text = f"'{value:<8}'" if isinstance(value, str) else f"{'T' if value else 'F':>20}" if isinstance(value, bool) else f"{value!r:>20}"
    return f"{key:<8}= {text}".ljust(CARD)[:CARD]


def _head(shape: Sequence[int], header: dict | None) -> bytes:
    cards = {"SIMPLE": True, "BITPIX": -32, "NAXIS": len(shape)}
    cards |= {f"NAXIS{i + 1}": n for i, n in enumerate(reversed(shape))}
    cards |= {k: v for k, v in (header or {}).items() if k not in cards}
    head = "".join(_card(k, v) for k, v in cards.items()) + "END".ljust(CARD)
    return head.ljust((len(head) + BLOCK - 1) // BLOCK * BLOCK).encode("ascii")


def write(path: str, cube: np.ndarray, header: dict | None = None) -> None:
    """Write an array of two or three axes as 32-bit floats."""
    data = cube.astype(">f4").tobytes()
    with open(path, "wb") as f:
        f.write(_head(cube.shape, header))
        f.write(data + b"\0" * (-len(data) % BLOCK))


def cube_header(header: dict, n_chan: int, crval: float, cdelt: float) -> dict:
    """A header of an image made one of a cube with a velocity axis."""
    return header | {"NAXIS": 3, "NAXIS3": n_chan, "CTYPE3": "VRAD", "CUNIT3": "m/s", "CRPIX3": 1.0, "CRVAL3": crval, "CDELT3": cdelt}


def imaging_header(ra_deg: float, dec_deg: float, fov_deg: float, pixel_arcsec: float) -> dict:
    """A square image in the SIN projection about a position."""
    n = round(fov_deg * 3600 / pixel_arcsec)
    cell = pixel_arcsec / 3600
    return {"NAXIS": 2, "NAXIS1": n, "NAXIS2": n, "CTYPE1": "RA---SIN", "CTYPE2": "DEC--SIN", "CRPIX1": n / 2, "CRPIX2": n / 2, "CDELT1": -cell, "CDELT2": cell, "CRVAL1": ra_deg, "CRVAL2": dec_deg}


def downsampled_header(header: dict, factor: int) -> dict:
    return header | {f"NAXIS{i}": header[f"NAXIS{i}"] // factor for i in (1, 2)} | {f"CDELT{i}": header[f"CDELT{i}"] * factor for i in (1, 2)}


class _Plane(InputPartition):
    def __init__(self, path: str, chan: int):
        super().__init__((path, chan))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path, chosen = options["path"], options.get("planes")
        names = sorted(n for n in os.listdir(path) if n.lower().endswith(".fits")) if os.path.isdir(path) else [""]
        self.paths = [os.path.join(path, n) if n else path for n in names]
        self.planes = {int(x) for x in chosen.split(",")} if chosen else None
        self.clean = options.get("nan_to_zero", "false").lower() == "true"

    def partitions(self) -> Sequence[InputPartition]:
        return [_Plane(p, c) for p in self.paths for c in range(shape_of(read_header(p)[0])[0]) if self.planes is None or c in self.planes]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        path, chan = partition.value
        plane = read_plane(path, chan, self.clean)
        h, w = plane.shape
        for y in range(0, h, 256):
            part = plane[y : y + 256]
            n = part.size
            yy, xx = np.indices(part.shape, np.int32).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, chan, np.int32)), pa.array(yy + np.int32(y)), pa.array(xx), pa.array(part.ravel())], ["path", "chan", "y", "x", "value"])


class _Writer(DataSourceArrowWriter):
    """Each task puts its pixels where they belong in a file of the right length; the header comes last, when all are there.

    The same pixels written again by another attempt are the same bytes in the same place. The file must lie in a
    folder that all executors share.
    """

    def __init__(self, options: dict):
        self.path, self.shape = options["path"], tuple(int(options[k]) for k in ("n_planes", "height", "width"))
        self.header = json.loads(options.get("header", "{}"))
        self.part = f"{self.path}.part"
        self.head = _head(self.shape if self.shape[0] > 1 else self.shape[1:], self.header)
        size = int(np.prod(self.shape)) * 4
        with open(self.part, "wb") as f:  # zeros: a pixel without a row is 0
            f.truncate(len(self.head) + size + -size % BLOCK)

    def write(self, batches: Iterator) -> WriterCommitMessage:
        n, h, w = self.shape
        file = np.memmap(self.part, ">f4", "r+", len(self.head), (n, h, w))
        for batch in batches:
            c, y, x, v = (batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for name in ("chan", "y", "x", "value"))
            file[c, y, x] = v
        file.flush()
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        with open(self.part, "r+b") as f:
            f.write(self.head)
        os.replace(self.part, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsSource)


def export(image: DataFrame, path: str, height: int, width: int, header: dict | None = None) -> None:
    """Write (chan, y, x, value) as one file of 32-bit floats, planes in the order of their channels; tasks write their pixels.

    ``path`` must lie in a folder that the executors share. Pixels go to tasks by blocks of lines, so a task's writes lie
    together.
    """
    spark = image.sparkSession
    register(spark)
    chans = [r["chan"] for r in image.select("chan").distinct().orderBy("chan").collect()]  # the channel axis
    place = spark.createDataFrame([(c, i) for i, c in enumerate(chans)], "chan int, place int")
    rows = image.join(F.broadcast(place), "chan").select(F.col("place").alias("chan"), "y", "x", F.col("value").cast("float").alias("value"))
    rows = rows.repartition("chan", F.floor(F.col("y") / 256)).sortWithinPartitions("chan", "y", "x")
    how = {"n_planes": max(len(chans), 1), "height": height, "width": width, "header": json.dumps(header or {})}
    rows.write.format("fits").options(**how).mode("append").save(path)
