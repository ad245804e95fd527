"""Lexical retrieval packing: a sharded BM25 inverted index gives unused neighbours for each seed document.

Documents become token ids once. Full windows of a long document stand alone; what is left of each document goes to
a shard of documents like it: by the nearest of ``CENTRES`` directions of its ids' idf, then by two weighted min-hashes
of its ids, so that documents that share their rarer ids lie together. Each shard has an inverted index of its
documents, with idf from counts over all documents. Some seeds at a time are scored against all unused documents of
their shard, and their windows take the best ones one after another; a window whose list runs out asks again. When the
next doesn't fit, it is cut, and its rest is a seed later on.

A shard is bounded (``SHARD_ROWS``, ``SHARD_IDS``), so the work grows with the input. To ask every shard for every
seed grows with its square; README.md has both ways' figures and what a shard's neighbours are worth against those
of a brute force over all documents.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from ._common import id_text, mix64, saved, table

WINDOW = 4096
#: Rests of documents a shard, and their ids: so 32 MB of ids and as many postings at most. A task's last shard has up to half as much again.
SHARD_ROWS, SHARD_IDS = 16384, 1 << 24
#: Seeds scored at once, and the length of their lists.
SEEDS, NEIGHBOURS = 64, 64
#: A shard's terms in more than this share of its documents are multiplied as a matrix, up to so many.
COMMON, MOST_COMMON = 1 / 24, 2048
K1, B = 1.2, 0.75
#: Directions that shards are made by, and the rests of documents that they and the tasks' bounds are fitted on (about so many; every rest goes by them).
CENTRES, SAMPLE = 64, 1 << 14
#: A null doc_id among the bounds of tasks.
NULL = -(1 << 63)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    """BM25 idf of each id from counts over all documents."""
    return np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)


def signs(weights: np.ndarray) -> np.ndarray:
    """For each id its idf with 64 signs drawn by its hash: sums over a document's ids keep the angles between documents."""
    bits = mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(3 << 32)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return (np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1) * weights[:, None]


def directions(docs: list[np.ndarray], drawn: np.ndarray) -> np.ndarray:
    """A unit vector of each document's distinct ids."""
    sums = np.array([drawn[np.unique(x)].sum(0) for x in docs], np.float32).reshape(-1, drawn.shape[1])
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


def draws(weights: np.ndarray) -> list[np.ndarray]:
    """Exponential draws of each id by its squared idf: the least one's id is a weighted min-hash."""
    w = np.maximum(weights.astype(np.float64), 1e-6) ** 2
    return [-np.log((mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(s << 32)) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54) / w for s in (1, 2)]


def min_hashes(docs: list[np.ndarray], draw: list[np.ndarray]) -> list[list[int]]:
    return [[int(x[np.argmin(d[x])]) for x in docs] for d in draw]


def centres(vectors: np.ndarray) -> np.ndarray:
    """Spherical k-means, the centres in a chain from each to the nearest one left, so that neighbours in it are alike."""
    if not len(vectors):
        return np.zeros((1, 64), np.float32)
    vectors = np.unique(vectors, axis=0)
    c = vectors[np.unique(np.linspace(0, len(vectors) - 1, CENTRES).astype(np.int64))]
    for _ in range(10):
        own = (vectors @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c).astype(np.float32)
    left, chain = list(range(1, len(c))), [0]
    while left:
        chain.append(left.pop(int((c[left] @ c[chain[-1]]).argmax())))
    return c[chain]


class Shard:
    """Inverted index of a shard's documents (arrays of ids) and the packing of their windows."""

    def __init__(self, docs: list[np.ndarray], weights: np.ndarray, mean: float):
        self.docs, n = docs, len(docs)
        self.lengths = np.array([len(x) for x in docs], np.int64)
        each = [np.unique(x, return_counts=True) for x in docs]
        self.own_at = np.concatenate(([0], np.cumsum([len(t) for t, _ in each])))
        self.own, tf = (np.concatenate([x[k] for x in each]) for k in (0, 1))
        del each
        order = np.argsort(self.own, kind="stable")
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.own_at))[order]
        term, tf, norm = self.own[order], tf[order], K1 * (1 - B + B * self.lengths / mean)
        score = (weights[term] * tf * (K1 + 1) / (tf + norm[owner])).astype(np.float32)
        self.first, self.unused = np.zeros(n, np.int64), np.ones(n, bool)
        self._index(np.arange(n), term, owner, score)

    def _index(self, listed: np.ndarray, term: np.ndarray, owner: np.ndarray, score: np.ndarray) -> None:
        """Postings of the documents ``listed``; owners are places in that list."""
        self.listed, self.term, self.owner, self.score = listed, term, owner, score
        self.ends = np.searchsorted(term, np.arange((1 << 16) + 1))
        count = np.diff(self.ends)
        common = np.flatnonzero(count > max(COMMON * len(listed), 1))
        common = common[np.argsort(-count[common], kind="stable")[:MOST_COMMON]]
        self.row = np.full(1 << 16, -1)
        self.row[common] = np.arange(len(common))
        here = self.row[term] >= 0
        self.matrix = np.zeros((len(common), len(listed)), np.float32)
        self.matrix[self.row[term[here]], owner[here]] = score[here]

    def _forget_used(self) -> None:
        """Take documents in use out of the index, once they are a quarter of it."""
        left = self.unused[self.listed]
        if 4 * np.count_nonzero(left) < 3 * len(left):
            keep = left[self.owner]
            self._index(self.listed[left], self.term[keep], (np.cumsum(left) - 1)[self.owner[keep]], self.score[keep])

    def neighbours(self, seeds: list[int]) -> list[np.ndarray]:
        """For each seed the best unused documents by BM25 of the seed's terms, best first; ties by place."""
        self._forget_used()
        left = np.flatnonzero(self.unused[self.listed])
        if not len(left):
            return [left] * len(seeds)
        wide, size = len(self.listed), np.diff(self.own_at)[seeds]
        seed = np.repeat(np.arange(len(seeds)), size)
        t = np.concatenate([self.own[self.own_at[s] : self.own_at[s + 1]] for s in seeds])
        dense = self.row[t] >= 0
        asked = np.zeros((len(seeds), len(self.matrix)), np.float32)
        asked[seed[dense], self.row[t[dense]]] = 1
        seed, t = seed[~dense], t[~dense]
        lo, n = self.ends[t], self.ends[t + 1] - self.ends[t]
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = np.bincount(np.repeat(seed * wide, n) + self.owner[at], weights=self.score[at], minlength=len(seeds) * wide)
        scores = (asked @ self.matrix)[:, left] + found.reshape(-1, wide)[:, left].astype(np.float32)
        most, out = min(NEIGHBOURS, len(left)), []
        bound = np.partition(scores, len(left) - most, axis=1)[:, len(left) - most]
        for s, b in zip(scores, bound):
            best = np.flatnonzero(s >= b)
            out.append(self.listed[left[best[np.lexsort((best, -s[best]))][:most]]])
        return out

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Windows of (document, first, length), each full but the last."""
        open_: list[tuple[int, list]] = []  # seed, pieces
        cut: list[int] = []

        def take(window: list, d: int, n: int) -> None:
            window.append((d, int(self.first[d]), n))
            self.first[d] += n
            self.unused[d] = False

        room = lambda window: WINDOW - sum(x[2] for x in window)
        while True:
            self.unused[cut] = True
            left = np.flatnonzero(self.unused)
            if not len(left):
                yield from (w for _, w in open_)
                return
            ids = int((self.lengths[left] - self.first[left]).sum())
            more = max(1, min(SEEDS, ids // WINDOW // 4)) - len(open_)
            if more > 0:
                new = cut[:more]
                spread = left[np.unique(np.linspace(0, len(left) - 1, max(more - len(new), 0)).astype(np.int64))]
                for d in dict.fromkeys([*new, *spread.tolist()]):
                    open_.append((d, []))
                    take(open_[-1][1], d, int(self.lengths[d] - self.first[d]))
            cut = []
            still = []
            for (seed, window), best in zip(open_, self.neighbours([s for s, _ in open_])):
                unfit, free = -1, room(window)
                for d in best[self.unused[best]].tolist():
                    n = int(self.lengths[d] - self.first[d])
                    if n <= free:
                        take(window, d, n)
                        free -= n
                    elif unfit < 0:
                        unfit = d
                    if not free:
                        break
                if free and unfit >= 0:
                    take(window, unfit, free)
                    cut.append(unfit)
                    free = 0
                if free:
                    still.append((seed, window))
                else:
                    yield window
            open_ = still


ENCODED = "doc_id long, n_tokens long, crcs array<long>, rest binary, counts binary"


def _encode(path: str):
    """Per document its number of ids, the checksums of its full windows and the ids after them; then a row of document counts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, last = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        names = [x.split()[0] for x in ENCODED.split(", ")]
        for doc_ids, ids, at in tokens.encoded(batches, path):
            crcs, rest = [], []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                mine, place = ids[x:y], np.arange(y - x)
                last[mine] = place  # an id counts where it stands last
                total[mine[last[mine] == place]] += 1
                z = y - (y - x) % WINDOW
                crcs.append([_crc(ids[a : a + WINDOW]) for a in range(x, z, WINDOW)])
                rest.append(ids[z:y].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(at)), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.binary()), pa.nulls(len(rest), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())], pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return run


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row a piece, as ``PIECES`` says: every id of every row lies in one piece, a sequence has at most 4096.

    Null text is empty: its document is the end id alone. Rows with equal or null doc_id are documents of their
    own. An empty table gives no rows. Nothing is dropped: a document of any length is cut into windows. Other
    columns of ``docs`` aren't read.
    """
    spark = docs.sparkSession
    made = saved(id_text(docs).mapInArrow(_encode(tokenizer), ENCODED), "packing-ids")
    ids = made.where("n_tokens is not null")
    rest = F.col("n_tokens") % WINDOW
    total = ids.agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.count_if(rest > 0).alias("rests"), F.sum(rest).alias("rest_ids")).first()
    n_docs, mean = total["n"], (total["t"] or 0) / max(total["n"], 1)
    shared = spark.sparkContext.broadcast(idf(tokens.counts_of(made), n_docs))  # 65,536 numbers

    def vectors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        drawn, draw = signs(shared.value), draws(shared.value)
        for batch in batches:
            rest = [np.frombuffer(raw.as_buffer(), "<u2") for raw in batch.column(1)]
            v = pa.array([x.astype("<f4").tobytes() for x in directions(rest, drawn)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), v, *(pa.array(k, pa.int32()) for k in min_hashes(rest, draw))], ["doc_id", "v", "k1", "k2"])

    # a task a shard, but at most as many as the session has shuffle partitions, each with as many shards as its rows make
    shards = max(-(-total["rests"] // SHARD_ROWS), -(-(total["rest_ids"] or 0) // SHARD_IDS), 1)
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    some = ids.where((rest > 0) & (F.rand(7) < SAMPLE / max(total["rests"], 1))).select("doc_id", "rest").mapInArrow(vectors, "doc_id long, v binary, k1 int, k2 int").collect()  # 300 bytes a row
    v = np.array([np.frombuffer(x.v, "<f4") for x in some], np.float32).reshape(-1, 64)
    middle = centres(v)
    keys = sorted((c, x.k1, x.k2, NULL if x.doc_id is None else x.doc_id) for c, x in zip((v @ middle.T).argmax(1).tolist(), some))
    bounds = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []

    def rests(batches: Iterator) -> Iterator:
        import pyarrow as pa

        drawn, draw = signs(shared.value), draws(shared.value)
        for batch in batches:
            rest = [np.frombuffer(raw.as_buffer(), "<u2") for raw in batch.column(2)]
            keys = [(directions(rest, drawn) @ middle.T).argmax(1).tolist(), *min_hashes(rest, draw)]
            part = [bisect.bisect_right(bounds, (c, k1, k2, NULL if d is None else d)) for c, k1, k2, d in zip(*keys, batch.column(0).to_pylist())]
            keys = [pa.array(x, pa.int32()) for x in (*keys, part)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *keys], ["doc_id", "doc_tokens", "ids", "centre", "k1", "k2", "part"])

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        total = 0

        def flush(some: list[tuple]):
            nonlocal number
            docs = [np.frombuffer(x[2], "<u2") for x in some]
            rows = []
            for window in Shard(docs, shared.value, mean).windows():
                offset = 0
                for d, first, n in window:
                    doc_id, size, _ = some[d]
                    rows.append((doc_id, size - len(docs[d]) + first, n, _crc(docs[d][first : first + n]), size, 2 * number, offset))
                    offset += n
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], _NAMES)

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held.append(row)
                total += len(row[2]) // 2
                if 2 * len(held) >= 3 * SHARD_ROWS or 2 * total >= 3 * SHARD_IDS:
                    at = np.searchsorted(np.cumsum([len(x[2]) // 2 for x in held]), SHARD_IDS, "right")
                    at = max(1, min(SHARD_ROWS, int(at)))
                    yield flush(held[:at])
                    held = held[at:]
                    total = sum(len(x[2]) // 2 for x in held)
        if held:
            yield flush(held)

    window = F.lit(WINDOW).cast("long")
    long = ids.where(F.col("n_tokens") >= WINDOW).select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.posexplode("crcs").alias("place", "ids_crc32"))
    long = long.select("doc_id", (F.col("place") * window).alias("start"), window.alias("length"), "ids_crc32", "doc_tokens", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = ids.where(F.col("n_tokens") % WINDOW > 0).select("doc_id", "n_tokens", "rest").mapInArrow(rests, "doc_id long, doc_tokens long, ids binary, centre int, k1 int, k2 int, part int")
    short = short.repartitionById(parts, "part").sortWithinPartitions("centre", "k1", "k2", "doc_id", F.crc32("ids"))
    return long.unionByName(short.select("doc_id", "doc_tokens", "ids").mapInArrow(fill, PIECES))


def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokens.vocabulary_path("word_bpe_49k.json"))
