"""Benchmark decontamination: a BM25 index of the test items, queried with every training passage.

Passages are windows of 64 words, one every 32. An item's score is divided by its own threshold, a share of
what the item scores against itself, so that 1 is the bar for all. Items are grouped into blocks; a term's
largest impact in each block bounds what a passage can score there. This is block-max WAND, for all passages of a
batch at once: a passage whose terms' largest impacts don't reach 1 together is skipped; of the others, the terms
in order of those impacts have a pivot, where the sum reaches 1, and an item needs a term from the pivot on, so
only blocks that hold one are looked at; only passage and block pairs whose bound reaches 1 are scored exactly. All
items at 1 or more are retrieved. A retrieved item counts as leaked where n-grams of its question and of its
answer stand in the text around the passage.

The index of one round is built from at most about ``ROUND_BYTES`` of item text; more items take more rounds, each a
scan of the documents. Counts of terms, the number of items and their lengths are those of all items, so scores
don't depend on the rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ALNUM_WORD, column_bytes, discard, free_name, id_text, lower_ascii, own, saved, slices, table, word_bounds, word_hashes

HALF = 32
SHARE = 0.6
OVERLAP = 0.5
NGRAM = 5
K1, B = 1.2, 0.75
ROUND_BYTES = 8 << 20
MOST_BLOCKS, LEAST_BLOCK = 64, 8
PASSAGES = 1024
HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
_NAMES = [x.split()[0] for x in HITS.split(", ")]


def text_hashes(text: str) -> np.ndarray:
    data = lower_ascii(np.frombuffer(text.encode("utf-8"), np.uint8))
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), ALNUM_WORD)
    return word_hashes(data, starts, ends)


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last line; in a text of one line, the last sentence; else there is none."""
    text = text.strip()
    if "\n" in text:
        q, _, a = text.rpartition("\n")
    else:
        head, dot, a = text[:-1].rpartition(". ")
        q, a = (head + dot, a + text[-1:]) if dot else (text, "")
    return (q, a) if len(text_hashes(q)) and len(text_hashes(a)) else (text, "")


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
        return out


def overlap(part: np.ndarray, around: np.ndarray) -> float:
    """Share of the part's n-grams found in the words around; a part without words counts as found."""
    n = min(NGRAM, len(part))
    if not n:
        return 1.0
    return float(np.isin(ngrams(part, n), ngrams(around, n)).mean())


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Totals(NamedTuple):
    """Statistics of all items: their number, mean and greatest length in words, and how many items hold each term."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, words: list[np.ndarray]) -> Totals:
        terms, counts = np.unique(np.concatenate([np.unique(w) for w in words] or [np.zeros(0, np.uint64)]), return_counts=True)
        return cls(len(words), sum(map(len, words)) / max(len(words), 1), max(map(len, words), default=0), terms, counts)


class Index:
    """Inverted index of items: impacts over the item's threshold, and their maxima by block of items."""

    def __init__(self, items: list[tuple[int, str]], totals: Totals | None = None):
        self.ids = [i for i, _ in items]
        self.parts = [tuple(map(text_hashes, question_and_answer(t or ""))) for _, t in items]
        words = [text_hashes(t or "") for _, t in items]
        totals = totals or Totals.of(words)
        self.longest, mean = totals.longest, totals.mean or 1.0
        each = [np.unique(w, return_counts=True) for w in words]
        self.terms, inverse = np.unique(np.concatenate([t for t, _ in each] or [np.zeros(0, np.uint64)]), return_inverse=True)
        counts = totals.counts[np.searchsorted(totals.terms, self.terms)]
        idf = np.log1p((totals.n - counts + 0.5) / (counts + 0.5))
        owner = np.repeat(np.arange(len(words)), [len(t) for t, _ in each])
        tf = np.concatenate([c for _, c in each] or [np.zeros(0)])
        length = np.array([len(w) for w in words], float)
        impact = idf[inverse] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / mean)) if len(owner) else np.zeros(0)
        own = np.bincount(owner, weights=impact, minlength=len(words))
        bar = SHARE * own * np.minimum(1.0, HALF / np.maximum(length, 1))
        impact = impact / bar[owner]
        size = max(LEAST_BLOCK, math.ceil(len(items) / MOST_BLOCKS))
        order = np.lexsort((owner, inverse))
        self.owner, self.impact, at = owner[order], impact[order], inverse[order]
        self.ends = np.searchsorted(at, np.arange(len(self.terms) + 1))
        self.block_of, self.n_blocks = np.arange(len(items)) // size, math.ceil(len(items) / size) or 1
        key, first = np.unique(at * self.n_blocks + self.block_of[self.owner], return_index=True)
        self.block, self.most = key % self.n_blocks, np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.block_ends = np.searchsorted(key // self.n_blocks, np.arange(len(self.terms) + 1))
        self.highest = np.maximum.reduceat(self.impact, self.ends[:-1]) if len(self.terms) else np.zeros(0)

    def search(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """(text, item, score, first word of the passage) of all items at the bar or above, for each passage.

        ``words`` are the texts' word hashes one after another, ``at`` where each text's begin.
        """
        if not len(self.terms) or not len(words):
            return
        n_words = np.diff(at)
        halves = -(-n_words // HALF)
        half_at = np.concatenate(([0], np.cumsum(halves)))
        term = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        here = np.flatnonzero(self.terms[term] == words)
        text = np.searchsorted(at, here, "right") - 1
        half = half_at[text] + (here - at[text]) // HALF
        pairs = np.unique(half * len(self.terms) + term[here])
        half, term = pairs // len(self.terms), pairs % len(self.terms)
        term_at = np.searchsorted(half, np.arange(half_at[-1] + 1))
        # a passage is a half and the next of the same text; a text of one half is one passage
        owner = np.repeat(np.arange(len(n_words)), halves)
        last = np.append(owner[1:] != owner[:-1], True)
        p = np.flatnonzero(~last | (halves[owner] == 1))
        follows = np.where(last[p], 0, 1)
        for a in range(0, len(p), PASSAGES):
            f, more = p[a : a + PASSAGES], follows[a : a + PASSAGES]
            lo, n = term_at[f], term_at[f + 1 + more] - term_at[f]
            row, t = np.repeat(np.arange(len(f)), n), term[_expand(lo, n)]
            pairs = np.unique(row * len(self.terms) + t)
            row, t = pairs // len(self.terms), pairs % len(self.terms)
            keep = np.bincount(row, weights=self.highest[t], minlength=len(f))[row] >= 1 - 1e-9
            row, t = row[keep], t[keep]
            order = np.lexsort((self.highest[t], row))
            row, t = row[order], t[order]
            upto = np.cumsum(self.highest[t])
            first = np.searchsorted(row, np.arange(len(f)))
            pivot = upto - np.concatenate(([0.0], upto))[first[row]] >= 1 - 1e-9
            n = self.block_ends[t + 1] - self.block_ends[t]
            e = _expand(self.block_ends[t], n)
            cell = np.repeat(row, n) * self.n_blocks + self.block[e]
            reached = np.zeros(len(f) * self.n_blocks, bool)
            reached[cell[np.repeat(pivot, n)]] = True
            some = reached[cell]
            bound = np.bincount(cell[some], weights=self.most[e[some]], minlength=len(f) * self.n_blocks)
            open_ = bound.reshape(len(f), self.n_blocks) >= 1 - 1e-9
            keep = open_.any(1)[row]
            row, t = row[keep], t[keep]
            n = self.ends[t + 1] - self.ends[t]
            e, row = _expand(self.ends[t], n), np.repeat(row, n)
            keep = open_[row, self.block_of[self.owner[e]]]
            key, where = np.unique(row[keep] * len(self.ids) + self.owner[e[keep]], return_inverse=True)
            score = np.bincount(where, weights=self.impact[e[keep]], minlength=len(key)) if len(key) else np.zeros(0)
            for k in np.flatnonzero(score >= 1 - 1e-9).tolist():
                h = f[key[k] // len(self.ids)]
                yield int(owner[h]), int(key[k] % len(self.ids)), float(score[k]), int((h - half_at[owner[h]]) * HALF)


def _scan(docs: DataFrame, index) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ix: Index = index.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in slices(offsets):
                raw = lower_ascii(data[offsets[a] : offsets[b]])
                starts, ends, at = word_bounds(raw, offsets[a : b + 1] - offsets[a], ALNUM_WORD)
                words, best = word_hashes(raw, starts, ends), {}
                for text, item, score, first in ix.search(words, at):
                    if (text, item) in best and best[text, item][0] >= score:
                        continue
                    lo = max(at[text], at[text] + first - ix.longest)
                    around = words[lo : min(at[text + 1], at[text] + first + 2 * HALF + ix.longest)]
                    q, ans = (overlap(x, around) for x in ix.parts[item])
                    if q >= OVERLAP and ans >= OVERLAP:
                        best[text, item] = (score, q, ans, first)
                rows = [(ids[a + t], ix.ids[i], *x) for (t, i), x in sorted(best.items())]
                columns = zip(*rows) if rows else [[] for _ in _NAMES]
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)

    return id_text(docs).mapInArrow(run, HITS)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` and item that it leaks: ids, best score (1 is the bar), overlaps, the passage's first word.

    Documents without a leak have no row. Null or empty texts leak nothing, null or empty items are never leaked;
    repeated rows are reported each. Whole texts are searched. Without items or documents the result is empty.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(items["text"], F.lit("")).alias("text"))
    items = items.where(F.length(F.trim("text")) > 0)
    hashed = saved(items.select("item_id", "text", _item_key().alias("key")).mapInArrow(_item_terms, "key long, n long, b long, terms array<long>"), "items")
    size = hashed.agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    rounds = max(1, math.ceil((size["b"] or 0) / ROUND_BYTES))
    in_round = lambda key, k: F.pmod(key, F.lit(rounds).cast("long")) == k
    counts = hashed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    out = []
    for k in range(rounds):
        mine = items.where(in_round(_item_key(), k)).orderBy("item_id", "text")
        rows = [(r["item_id"], r["text"]) for r in mine.collect()]  # about ROUND_BYTES of text
        wanted = hashed.where(in_round(F.col("key"), k)).select(F.explode("terms").alias("term")).distinct()
        found = np.array([(r["term"], r["n"]) for r in counts.join(wanted, "term", "left_semi").collect()], np.int64).reshape(-1, 2)
        terms = found[:, 0].view(np.uint64) if len(found) else np.zeros(0, np.uint64)
        order = np.argsort(terms)
        index = spark.sparkContext.broadcast(Index(rows, Totals(size["n"], size["mean"] or 0.0, size["longest"] or 0, terms[order], found[order, 1])))
        out.append(saved(_scan(docs, index), "leaks"))  # a row a leak; the round's index can go
        index.unpersist()
    discard(spark, hashed)
    return reduce(DataFrame.unionByName, out)


def _item_key():
    return F.xxhash64("item_id", "text")


def _item_terms(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        words = [text_hashes(t) for t in batch.column(1).to_pylist()]
        terms = [np.unique(w).view(np.int64) for w in words]
        size = [len(t.encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(map(len, words), pa.int64()), pa.array(size, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["key", "n", "b", "terms"])


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item, null doc_ids among them; rows that share a doc_id go by their text.

    Null and empty texts stay. Other columns stay as they are, whatever their names.
    """
    doc, text = free_name(docs, "__doc"), free_name(docs, "__text")
    keyed = docs.select(*own(docs), F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit(""))).alias(doc))
    found = leaks(keyed.select(F.col(doc).alias("doc_id"), F.col("text")), items).select(F.col("doc_id").alias(text)).distinct()
    return keyed.join(found, keyed[doc] == found[text], "left_anti").select(*own(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
