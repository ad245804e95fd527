"""Near duplicates by MinHash with sequential Bayesian verification.

1. Each text becomes its set of 5-word shingles (64-bit hashes), a 128-bit fingerprint of the set, a
   signature of 120 min-hashes (a byte each) and 24 band keys of 5 min-hashes. Equal sets collapse to one node.
2. Nodes that share a band key are compared in blocks of bounded size: signatures batch by batch, dropping a
   pair when the posterior chance that its similarity reaches the threshold falls under ``MISS``. Only nodes
   that still have a partner go on, with the bucket in which they met first; pairs are never emitted.
3. Blocks of those nodes, now with their full sets, are verified exactly. Each block returns a spanning forest
   of its verified links, and skips pairs that its own links already join.
4. Components of the forests' links are found by repeated joins.

A pair at the threshold shares no band with chance (1 - t^5)^24, under 1e-6 at 0.85.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import SPACE_WORD, column_bytes, discard, free_name, hot_join, id_text, lower_ascii, mix64, new_path, own, saved, slices, table, word_bounds, word_hashes

WORDS = 5
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
BATCH = 24
MISS = 1e-5
#: Nodes of a bucket that one task compares with as many others.
BLOCK = 512
#: Shingles of a block whose full sets a task holds: 32 MB, and of a text that has more by itself.
BLOCK_SHINGLES = 1 << 22
#: Pairs looked at together: what they gather of signatures and keys is some 30 MB.
PAIRS = 1 << 16
_MULTIPLIERS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACES = mix64(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    raw = lower_ascii(data)
    starts, ends, at = word_bounds(raw, offsets, SPACE_WORD)
    h = word_hashes(raw, starts, ends)
    with np.errstate(over="ignore"):
        n = max(len(h) - words + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for k in range(words):
            rolled += mix64(h[k : k + n] + _PLACES[k]) * _PLACES[k]
        rolled = mix64(rolled)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                yield mix64(np.array([int((mix64(h[a:b] + _PLACES[: b - a]) * _PLACES[: b - a]).sum(dtype=np.uint64)) ^ (b - a)], np.uint64))
            else:
                yield h[:0]


def signature(shingles: np.ndarray) -> tuple[bytes, list[int]]:
    """A byte of each min-hash, and the band keys."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 2048):
            np.minimum(least, (shingles[a : a + 2048, None] * _MULTIPLIERS).min(0), out=least)
        mixed = mix64(least)
        keys = mix64((mixed.reshape(BANDS, ROWS) * _PLACES[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return (mixed & np.uint64(255)).astype(np.uint8).tobytes(), keys.view(np.int64)


def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """For 0..HASHES compared: matches under which P(similarity >= threshold) < miss, for a uniform prior.

    A byte matches with c = s + (1-s)/256; P(c >= x | m of n) = P(Binomial(n+1, x) <= m).
    """
    x, out = threshold + (1 - threshold) / 256, np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * x**m * (1 - x) ** (n + 1 - m)
            if total >= miss:
                out[n] = m
                break
    return out


def _survivors(i: np.ndarray, j: np.ndarray, sig: np.ndarray, size: np.ndarray, ratio: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs whose sizes allow the threshold and whose signatures don't rule it out, with their matches."""
    keep = np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j])
    i, j = i[keep], j[keep]
    matches = np.zeros(len(i), np.int64)
    for a in range(0, HASHES, BATCH):
        matches += (sig[i, a : a + BATCH] == sig[j, a : a + BATCH]).sum(1)
        keep = matches >= least[min(a + BATCH, HASHES)]
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j, matches


def _pairs(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with equal ``group`` (sorted): i<j, and of two sides where a group has both sides 0 and 1.

    Side 2 marks a block compared with itself. At most about PAIRS at once.
    """
    n = len(group)
    ends = np.searchsorted(group, group, "right")
    count = ends - np.arange(n) - 1
    a = 0
    upto = np.cumsum(count)
    while a < n:
        b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")), a + 1)
        c = count[a:b]
        i = np.repeat(np.arange(a, b), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        keep = (side[i] == 2) | (side[i] != side[j])
        yield i[keep], j[keep]
        a = b


def _groups(batches: Iterator, key: int) -> Iterator:
    """Arrow tables that hold whole groups of the (sorted) key column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        last = held.column(key)[-1]
        first = pc.index(held.column(key), last).as_py()
        if first:
            yield held.slice(0, first).combine_chunks()
            held = held.slice(first)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _matrix(column, width: int, dtype) -> np.ndarray:
    data, _ = column_bytes(column.combine_chunks() if hasattr(column, "combine_chunks") else column)
    return np.frombuffer(data.tobytes(), dtype).reshape(-1, width)


def blocks(buckets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Deal each bucket's nodes (``bucket``, ``n`` members, ``node``, ...) to tasks ``task``, one for each pair of its blocks.

    With ``weight``, the shingles of the bucket's nodes together, blocks are also bounded by them: about BLOCK_SHINGLES each.

    A bucket of one block is one task; of g blocks, each node goes to g tasks. ``side`` is 2 in a block compared with
    itself, else 0 or 1.
    """
    g = F.ceil(F.col("n") / block).cast("int")
    if "weight" in buckets.columns:
        g = F.least(F.greatest(g, F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int")), F.col("n").cast("int"))
    own = F.pmod(F.xxhash64("node", F.lit(17)), F.col("g").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")
    out = buckets.withColumn("g", g).withColumn("own", own).select("*", other)
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    task = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    return out.withColumn("side", side).withColumn("task", task).drop("g", "own", "other")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "task").sortWithinPartitions("task", "bucket")


def links(docs: DataFrame, percent: int = 85, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(nodes, forest): every row's ``doc_id``, ``n_shingles`` and ``node`` (least doc_id with the same set), and
    verified links (``a`` < ``b``) between nodes whose components are those of all links.

    Empty sets have node null. A null doc_id has node null and is linked with nothing. Rows that share a doc_id are
    one node, linked through the set of either.
    """
    spark = docs.sparkSession
    ratio = percent / 100
    least = least_matches(ratio)

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in slices(offsets):
                lo = offsets[a]
                n, f1, f2, sigs, keys = [], [], [], [], []
                for s in shingle_sets(data[lo : offsets[b]], offsets[a : b + 1] - lo, words):
                    sig, key = signature(s)
                    with np.errstate(over="ignore"):
                        f1.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
                        f2.append(int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    n.append(len(s))
                    sigs.append(sig)
                    keys.append(key.tobytes())
                columns = [pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *columns], ["doc_id", "n_shingles", "f1", "f2", "sig", "bands"])

    signed = saved(id_text(docs).mapInArrow(sign, "doc_id long, n_shingles long, f1 long, f2 long, sig binary, bands binary"), "near-dup-signatures")
    usable = signed.where("doc_id is not null and n_shingles > 0")
    same = ["n_shingles", "f1", "f2"]
    sets = saved(usable.groupBy(*same).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "near-dup-sets")
    # a set may have a third of all rows: its copies are spread over tasks
    nodes = hot_join(signed.select("doc_id", *same), sets, same, "copies", "doc_id")
    nodes = nodes.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))

    # the row of each node: keys with the doc_id are never hot
    node_rows = usable.withColumnRenamed("doc_id", "node").join(sets.drop("copies"), ["node", *same]).dropDuplicates(["node", *same])
    node_rows = saved(node_rows.select("node", "n_shingles", "sig", "bands"), "near-dup-nodes")

    def keys(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            k = _matrix(batch.column(1), BANDS, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(k))), pa.array(k.reshape(-1))], ["node", "band", "bucket"])

    bands = node_rows.select("node", "bands").mapInArrow(keys, "node long, band int, bucket long")
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("band").alias("band")).where("n > 1")
    members = saved(bands.select("node", "bucket").join(shared, "bucket"), "near-dup-buckets")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t in _groups(batches, 0):
            task, bucket, node, side, band, size = (np.asarray(t.column(k)) for k in range(6))
            sig, key = _matrix(t.column(6), HASHES, np.uint8), _matrix(t.column(7), BANDS, np.int64)
            met = np.zeros(len(node), bool)
            for i, j in _pairs(task, side):
                more = ~(met[i] & met[j])  # where both go on with this bucket already, their pair tells nothing new
                i, j, _ = _survivors(i[more], j[more], sig, size, ratio, least)
                same = key[i] == key[j]
                first = (same.argmax(1) == band[i]) & (bucket[i] == bucket[j]) & (node[i] != node[j])
                met[i[first]] = met[j[first]] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[met]) for x in (bucket, node, size)], ["bucket", "node", "n_shingles"])

    dealt = _dealt(blocks(members.join(node_rows, "node"))).select("task", "bucket", "node", "side", "band", "n_shingles", "sig", "bands")
    met = dealt.mapInArrow(compare, "bucket long, node long, n_shingles long").distinct()
    met = saved(met, "near-dup-met")

    def full(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in slices(offsets):
                lo = offsets[a]
                got = [s.tobytes() for s in shingle_sets(data[lo : offsets[b]], offsets[a : b + 1] - lo, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(got, pa.binary())], ["node", "shingles"])

    wanted = met.select(F.col("node").alias("doc_id")).distinct()
    texts = id_text(docs).join(wanted, "doc_id", "left_semi")
    sized = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
    full_sets = texts.mapInArrow(full, "node long, shingles binary")
    ready = met.drop("n_shingles").join(sized, "bucket").join(node_rows.select("node", "sig"), "node").join(full_sets, "node")

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t in _groups(batches, 0):
            task, node, side = (np.asarray(t.column(k)) for k in range(3))
            sig = _matrix(t.column(3), HASHES, np.uint8)
            data, off = column_bytes(t.column(4).combine_chunks())
            rows = [np.frombuffer(data[off[k] : off[k + 1]].tobytes(), np.uint64) for k in range(len(node))]
            size = np.array([len(r) for r in rows], np.int64)
            root, label = list(range(len(node))), np.arange(len(node))

            def find(x: int) -> int:
                while root[x] != x:  # noqa: B023
                    root[x] = root[root[x]]  # noqa: B023
                    x = root[x]  # noqa: B023
                return x

            out = []
            for i, j in _pairs(task, side):
                for x in np.unique(np.concatenate([i, j])).tolist():
                    label[x] = find(x)
                more = label[i] != label[j]  # links found so far join most of a large group
                i, j, matches = _survivors(i[more], j[more], sig, size, ratio, least)
                order = np.argsort(-matches, kind="stable")
                for x, y in zip(i[order].tolist(), j[order].tolist()):
                    if node[x] == node[y] or (p := find(x)) == (q := find(y)):
                        continue
                    both = np.intersect1d(rows[x], rows[y], assume_unique=True).size
                    if 100 * both >= percent * (size[x] + size[y] - both):
                        root[p] = q
                        out.append((min(node[x], node[y]), max(node[x], node[y])))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    forest = _dealt(blocks(ready)).select("task", "node", "side", "sig", "shingles").mapInArrow(verify, "a long, b long").distinct()
    out = saved(forest, "near-dup-links")
    discard(spark, node_rows, members, met)
    return nodes, out


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``): the least node reachable, for each node of ``edges`` (``a``, ``b``).

    Each round takes the least label among neighbours and then the label's own label; rounds end when none changes.
    """
    spark = edges.sparkSession
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "component-edges")
    label = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component"))
    path = new_path(spark, "component-labels")
    label.write.parquet(path)
    while True:
        label = spark.read.parquet(path)
        near = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        better = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        better = better.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component"))
        new = new_path(spark, "component-labels")
        better.write.parquet(new)
        done = spark.read.parquet(new)
        changed = done.where("component <> old").limit(1).count()
        discard(spark, path)
        path = new
        if not changed:
            discard(spark, both)
            return done.select("node", "component")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept (it is its component's least doc_id).

    Null or empty text (or one without a word): no shingles, its own component, kept. Null doc_id: component null,
    kept. A repeated row (same doc_id) has the same answer; use ``keep`` to choose rows. An empty table gives no rows.
    """
    nodes, forest = links(docs, percent, words)
    found = components(forest)
    out = nodes.join(found, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85, words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each component: its least doc_id, and of rows that repeat it, one.

    Rows with a null doc_id all stay.
    """
    kept = near_duplicates(docs, percent, words).where("kept and doc_id is not null").select("doc_id").distinct()
    out = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
    name = free_name(docs, "__place")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    out = out.withColumn(name, place).where(F.col(name) == 1)
    return out.select(*own(docs)).unionByName(docs.where(F.col("doc_id").isNull()))


def op10_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]'), lambda x: x <> '') as w from documents),
h as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g from d),
s as (select doc_id, len(g) as n, unnest(g) as g from h),
link as (select a.doc_id as x, b.doc_id as y from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select doc_id, doc_id as root from documents union select link.y, reach.root from reach join link on link.x = reach.doc_id)
select h.doc_id, len(g) as n_shingles, c.component_id, h.doc_id = c.component_id as kept from h join (select doc_id, min(root) as component_id from reach group by doc_id) c using (doc_id)
"""
