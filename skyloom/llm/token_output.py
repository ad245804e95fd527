"""Token-id files: canonical length-limited Huffman codes from global counts, in independent blocks.

A file folder holds ``header`` (one row: code length of each id) and ``blocks`` (a row a block: the ids of
whole documents in ascending ``doc_id`` order, their packed bits, and the bit offset of every 64th id, so
that many places of a block are decoded side by side by table look-up).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from ._common import discard, new_path, table

MAX_BITS = 16
BLOCK = 1 << 16
STEP = 64
BLOCKS = "part int, block int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, offsets array<long>, bits binary"


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << most:
        raise ValueError("more ids than codes")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(most):
        both = np.concatenate((weights, packages))
        place = np.argsort(both, kind="stable")
        levels.append(place < len(weights))
        both = both[place]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take, found = 2 * len(weights) - 2, np.zeros(len(weights), np.int64)
    for single in reversed(levels):
        n = int(single[:take].sum())
        found[:n] += 1
        take = 2 * (take - n)
    lengths[order] = found
    return lengths


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, as numbers of ``lengths`` bits."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    steps = 1 << (MAX_BITS - size)
    codes[order] = (np.cumsum(steps) - steps) >> (MAX_BITS - size)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for each value of the next 16 bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    ids, size = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.int64)
    if len(order):
        span = 1 << (MAX_BITS - lengths[order].astype(np.int64))
        ids[: span.sum()] = np.repeat(order, span)
        size[: span.sum()] = np.repeat(lengths[order], span)
    return ids, size


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids`` and the bit offset of every 64th.

    Codes are put together in 64-bit words; the last code of a word may end in the next one.
    """
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    for a in range(0, len(ids), 16 * BLOCK):  # bounded memory for a very long document
        n, end = size[a : a + 16 * BLOCK], ends[a : a + 16 * BLOCK]
        code, start = codes[ids[a : a + 16 * BLOCK]], end - n
        word, room = start >> 6, 64 - (start & 63) - n
        here = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[first]] |= np.bitwise_or.reduceat(here, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: -(-total // 8)], (ends - size)[::STEP]


def unpack(bits: bytes, offsets: np.ndarray, n: int, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ``n`` ids of a block: all checkpoints advance together, an id a step."""
    raw = np.frombuffer(bits + b"\0\0\0", np.uint8).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    out = np.zeros((STEP, len(offsets)), np.uint32)
    at, last = offsets.astype(np.int64), len(window) - 1
    for k in range(STEP):
        v = (window[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[k] = ids[v]
        at = at + size[v]
    return out.T.reshape(-1)[:n]


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) and write their ids below ``path``.

    Null text is empty: its document has the end id alone. Rows are in ascending doc_id (nulls first; equal ids
    in any order). An empty table gives a header and no block. A long document is one block, whatever its size.
    """
    spark = docs.sparkSession
    kept = new_path(spark, "ids")
    tokens.id_table(docs, tokenizer).write.option("compression", "zstd").parquet(kept)
    ids = spark.read.parquet(kept)
    lengths = code_lengths(tokens.counts_of(ids))
    ids = ids.where("ids is not null")
    packed_lengths = lengths.tobytes()

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        lengths = np.frombuffer(packed_lengths, np.uint8)
        codes, part = codes_of(lengths), TaskContext.get().partitionId()
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        state = {"block": 0, "start": 0}
        held: list[tuple] = []

        def flush():
            flat = np.concatenate([np.frombuffer(x[1], "<u2") for x in held])
            bits, offsets = pack(flat, codes, lengths)
            row = [part, state["block"], state["start"], len(flat), [x[0] for x in held], [len(x[1]) // 2 for x in held], offsets, bits]
            state["block"], state["start"] = state["block"] + 1, state["start"] + len(flat)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        n = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((doc_id, raw.as_py()))
                n += len(held[-1][1]) // 2
                if n >= BLOCK:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    header = spark.range(1).select(F.unhex(F.lit(packed_lengths.hex())).alias("code_lengths"), F.lit(MAX_BITS).alias("max_bits"))
    header.write.parquet(f"{path}/header")
    discard(spark, kept)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (if asked for) the ids, decoded from the files below ``path``."""
    packed_lengths = bytes(spark.read.parquet(f"{path}/header").first()["code_lengths"])
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row a part, as many as the writing job had tasks
    size = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = size.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, size = decode_table(np.frombuffer(packed_lengths, np.uint8))
        for batch in batches:
            for row in range(batch.num_rows):
                start, n, docs, lengths, offsets, bits = (batch.column(k)[row] for k in range(6))
                flat = unpack(bits.as_py(), offsets.values.to_numpy(), n.as_py(), ids, size).astype("<u4")
                lengths = lengths.values.to_numpy()
                ends = np.cumsum(lengths)
                each = [flat[e - k : e] for e, k in zip(ends, lengths)]
                made = [docs.values, pa.array(start.as_py() + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                made += [pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(made, [x.split()[0] for x in out.split(", ")])

    placed = blocks.join(F.broadcast(before), "part")
    placed = placed.select((F.col("start") + F.col("before")).alias("start"), "n_tokens", "doc_ids", "lengths", "offsets", "bits")
    return placed.mapInArrow(decode, out)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-output")
    write(table(spark, sf_dir, "documents"), path, tokens.vocabulary_path("byte_bpe_50k.json"))
    return read(spark, path, with_ids=False)
