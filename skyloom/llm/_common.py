"""Shared helpers of the training-data operators.

Tables that must outlive an executor are written as Parquet below the folder named by
``spark.checkpoint.dir``; nothing is kept on machine-local disks.
"""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, one below the session's warehouse, which all executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/skyloom-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that operators write inside are deleted at the end: for results that are written themselves meanwhile."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            discard(spark, path)


def saved(df: DataFrame, label: str, dictionary: bool = True) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    out = spark.read.parquet(path)
    out.saved_at = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null text as empty: other columns can't clash with ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def own(docs: DataFrame) -> list:
    """All columns of ``docs``, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def free_name(docs: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores after it until no column of ``docs`` has that name."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def let(value, body):
    """Bind an expression to a lambda variable, so that ``body`` uses it without evaluating it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Bits of a membership filter: 4 MB, whatever the input.
FILTER_BITS = 1 << 25


def maybe_among(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``among``: false only where ``column`` is surely none of ``keys``.

    A bitmap of hashed keys is broadcast, so rows aren't moved to find the few that a join needs.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(7)), F.lit(FILTER_BITS).cast("long"))
    bits = keys.groupBy(F.bitmap_bucket_number(place(key)).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(key))).alias("__bits"))
    spot = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place(column)) == F.col("__bucket"), "left")
    return joined.select(*rows.columns, F.coalesce(F.getbit(byte, (spot % 8).cast("int")) == 1, F.lit(False)).alias("among"))


#: A key of more rows than this is spread over SALTS tasks in ``hot_join``.
HOT, SALTS = 4096, 64


def hot_join(rows: DataFrame, few: DataFrame, on: list[str], n: str, spread: str, hot: int = HOT) -> DataFrame:
    """``rows`` left-joined with ``few``, which has a row a key and in ``n`` how many rows have that key.

    A key of more than ``hot`` rows is spread by ``spread`` over ``SALTS`` tasks: its row of ``few`` goes to each of them.
    A bitmap tells on both sides which keys those are, so the others are moved once and as they are.
    """
    key = F.xxhash64(*on)
    many = few.where(F.col(n) > hot).select(key.alias("__key"))
    rows, few = (maybe_among(t.withColumn("__key", key), "__key", many, "__key").drop("__key") for t in (rows, few))
    salt = F.pmod(F.xxhash64(F.col(spread), F.lit(3)), F.lit(SALTS).cast("long")).alias("__salt")
    side = lambda t, among: t.where(F.col("among") == among).drop("among")
    plain = side(rows, False).join(side(few, False), on, "left")
    copies = side(few, True).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__salt"))
    return plain.unionByName(side(rows, True).select("*", salt).join(copies, [*on, "__salt"], "left").drop("__salt"))


# ---------------------------------------------------------------- byte-level kernels (NumPy)

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        m = max(n, _BLOCK + 4096)
        with np.errstate(over="ignore"):
            have = np.full(m, base, np.uint64)
            have[0] = 1
            have = np.cumprod(have, dtype=np.uint64)
        if m <= 2 * _BLOCK:
            _powers[int(base)] = have
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


#: Byte classes; every byte of a multi-byte character is 0x80 or more, so classes of bytes give classes of characters.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and where each text's words begin (one entry more than texts)."""
    inside = word_bytes[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    at = edges[edges < len(data)]
    first[at] = inside[at]
    at = edges[edges > 0] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of a polynomial over bounded blocks."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = starts[i]
            j = max(int(np.searchsorted(ends, base + _BLOCK, "right")), i + 1)
            n = int(ends[j - 1] - base)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((data[base : base + n].astype(np.uint64) + np.uint64(1)) * _power_table(_P, n)[:n], out=sums[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix64((sums[e] - sums[s]) * _power_table(_P_INV, n)[s] + (e - s).astype(np.uint64))
            i = j
    return out


def slices(offsets: np.ndarray, most: int = 4 << 20):
    """Ranges of rows of about ``most`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1, i + 1)
        yield i, min(j, n)
        i = j


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def discard(spark: SparkSession, *tables: str | DataFrame) -> None:
    """Delete tables (paths, or what ``saved`` gave) that no returned DataFrame reads."""
    for path in tables:
        _delete(spark, path if isinstance(path, str) else path.saved_at)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
