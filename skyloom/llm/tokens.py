"""Token ids of whole texts by the tokenizers library, and a table of them.

Both vocabularies cut a text into pieces by a pattern and then merge inside each piece, so a piece has the
same ids wherever it stands. Where a text has only characters whose classes are beyond doubt (ASCII and
Latin letters) and no added token's string, it is cut here, all texts of a batch at once by classes of
characters, and new pieces are merged by the rules of the library's model, many at once; any other text goes to
the library whole. Pieces are known by a 64-bit hash; the table of known pieces is bounded.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import column_bytes, id_text, mix64, slices, word_hashes

END = 2
#: Letters, digits and spaces among the characters that the short way covers, as ranges of code points.
_LETTERS = "AZ az ªª µµ ºº ÀÖ Øö øį ıſ"
_DIGITS = "09 ²³ ¹¹ ¼¾"
_SPACES = (0x09, 0x0A, 0x0D, 0x20)
_COVERED = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0x12F), (0x131, 0x17F))
#: What may follow an apostrophe that starts a piece, in the patterns of the two public vocabularies.
_SHORT = ("s", "t", "re", "ve", "m", "ll", "d")
#: Vocabulary: whether texts are lower-cased, a space belongs to the piece after it, digits stand alone.
_KINDS = {"byte_bpe_50k.json": (False, True, False), "word_bpe_49k.json": (True, False, True)}
#: Pieces that a worker remembers; beyond them, a new piece is forgotten after its batch.
MOST_PIECES = 1 << 20
#: Bytes of text encoded at once; a longer text stands alone.
BATCH = 2 << 20
_SPACE, _LETTER, _DIGIT, _OTHER, _UNCOVERED = range(5)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """The class of each code point up to 0x180, which stands for all that follow."""
    out = np.full(0x181, _UNCOVERED, np.uint8)
    for a, b in _COVERED:
        out[a : b + 1] = _OTHER
    for ranges, kind in ((_LETTERS, _LETTER), (_DIGITS, _DIGIT)):
        for a, b in ranges.split():
            out[ord(a) : ord(b) + 1] = kind
    out[list(_SPACES)] = _SPACE
    return out


_CLASS = _classes()
_LOWER = np.array([ord(chr(i).lower()) if _CLASS[i] != _UNCOVERED else i for i in range(0x181)], np.uint16)


def cut(chars: np.ndarray, edges: np.ndarray, spaced: bool, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every piece of covered texts, given as code points one after another and where each begins.

    ``spaced``: a space before other characters belongs to their piece, and spaces are pieces of their own.
    ``single``: each digit is a piece.
    """
    n = len(chars)
    kind = _CLASS[chars]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    if single:
        first |= kind == _DIGIT
    text = np.zeros(n + 1, bool)
    text[edges] = True
    first |= text[:-1]
    # an apostrophe that starts a run of others, no space before it in its piece, and one of the short endings
    mark = np.flatnonzero((chars == 0x27) & first)
    if spaced:
        mark = mark[text[mark] | (chars[mark - 1] != 0x20)]
    mark = mark[mark < n - 1]
    after = lambda k: np.where((mark + k < n) & ~text[mark + 1] & (~text[np.minimum(mark + k, n)] | (k < 2)), chars[np.minimum(mark + k, n - 1)], 0)
    one, two = after(1), after(2)
    size = np.zeros(len(mark), np.int64)
    for end in _SHORT:
        hit = (one == ord(end[0])) & (len(end) == 1 or two == ord(end[-1]))
        size[hit] = len(end)
    mark, size = mark[size > 0], size[size > 0]
    first[mark + 1] = False
    at = mark + 1 + size
    inside = at < n
    first[at[inside]] = True
    if not spaced:
        starts = np.flatnonzero(first)
        words = kind[starts] != _SPACE
        return starts[words], np.append(starts[1:], n)[words]
    # of several spaces before other characters, the last stands apart; if it is a blank, it joins them
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~text[1:-1])
    first[last] = True
    blank = last[chars[last] == 0x20]
    first[blank + 1] = False
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], n)


class Known:
    """Numbers of 64-bit hashes: open addressing, many look-ups at once."""

    def __init__(self, bits: int = 16):
        self.n, self.bits = 0, bits
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's number, -1 if it isn't known. No hash may be 0."""
        mask = len(self.keys) - 1
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        have = self.keys[slot]
        out = np.where(have == hashes, self.values[slot], -1)
        left = np.flatnonzero((have != hashes) & (have != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            have, wanted = self.keys[slot[left]], hashes[left]
            hit = have == wanted
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (have != 0)]
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """New and distinct hashes."""
        if 2 * (self.n + len(hashes)) > len(self.keys):
            old = self.keys != 0
            hashes, values = np.concatenate((self.keys[old], hashes)), np.concatenate((self.values[old], values))
            self.n, self.bits = 0, max(16, int(2 * len(hashes)).bit_length() + 1)
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        mask, self.n = len(self.keys) - 1, self.n + len(hashes)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = self.keys[slot[left]] == 0
            some = left[free]
            self.keys[slot[some]] = hashes[some]
            mine = self.keys[slot[left]] == hashes[left]
            done = left[mine]
            self.values[slot[done]] = values[done]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & mask


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class Merges:
    """The merge rules of a library's byte-level model, applied to many pieces at once."""

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[letters[b] + end] for b in range(256)], np.int64)
        rules = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.made = np.array([vocabulary[a + b] for a, b in rules], np.int64)
        self.rank = Known()
        left, right = (np.array([vocabulary[x[k]] for x in rules], np.int64) for k in (0, 1))
        self.rank.add(self._key(left, right), np.arange(len(rules), dtype=np.int32))

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A pair as one number, its bits spread one to one."""
        return mix64(((left << 32) | right).astype(np.uint64) + np.uint64(1))

    def apply(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces given as bytes one after another; the number of each piece's.

        A round merges, in every piece that still has a rule, its pair of the earliest rule, the leftmost of them.
        """
        ids, piece = self.inner[raw], np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last[raw[ends]]
        none, done = len(self.made), []
        while len(ids):
            rank = np.full(len(ids), none, np.int64)
            inside = np.flatnonzero(piece[1:] == piece[:-1])
            found = self.rank.find(self._key(ids[inside], ids[inside + 1]))
            rank[inside] = np.where(found < 0, none, found)
            first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            best = np.minimum.reduceat(rank, first)
            each = np.repeat(best, np.diff(np.append(first, len(ids))))
            over = each == none
            done.append((piece[over], ids[over]))
            at = np.flatnonzero((rank == each) & ~over)
            at = at[np.append(True, piece[at[1:]] != piece[at[:-1]])] if len(at) else at
            ids[at] = self.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            ids, piece = ids[keep], piece[keep]
        piece, ids = (np.concatenate([x[k] for x in done] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return ids[np.argsort(piece, kind="stable")].astype(np.uint32), np.bincount(piece, minlength=len(sizes))


class Encoder:
    """Ids of whole texts; the same as ``Tokenizer.encode(text, add_special_tokens=False)`` gives.

    Two pieces of one hash would get the same ids: with a million pieces, a chance of about 3e-8 a worker.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = _KINDS.get(os.path.basename(path))
        self.merges = Merges(self.tokenizer) if self.kind else None
        self.known = Known()
        self.pool, self.used = np.empty(1 << 18, np.uint32), 0
        self.start, self.length, self.pieces = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32), 0

    def _learn(self, pieces: list[str]) -> None:
        """New and distinct pieces are merged by the model's rules."""
        for a in range(0, len(pieces), 1 << 14):
            some = pieces[a : a + (1 << 14)]
            each = [p.encode() for p in some]
            ids, n = self.merges.apply(np.frombuffer(b"".join(each), np.uint8), np.fromiter(map(len, each), np.int64, len(each)))
            k = self.pieces
            while k + len(some) > len(self.start):
                self.start, self.length = (np.concatenate((x, np.empty_like(x))) for x in (self.start, self.length))
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
            self.pool[self.used : self.used + len(ids)] = ids
            self.start[k : k + len(some)] = self.used + np.cumsum(n) - n
            self.length[k : k + len(some)] = n
            self.used += len(ids)
            self.pieces += len(some)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of each text's."""
        if self.kind is None:
            return self._merged(texts, np.zeros(len(texts), bool), None)
        joined = "".join(texts)
        at = np.cumsum([0, *map(len, texts)])
        short = np.ones(len(texts), bool)
        if any(t in joined for t in self.added):
            short = ~np.array([any(t in x for t in self.added) for x in texts])
        chars = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), 0x180).astype(np.uint16)
        bad = np.flatnonzero(_CLASS[chars] == _UNCOVERED)
        short[np.searchsorted(at, bad, "right") - 1] = False
        if not short.all():
            keep = np.repeat(short, np.diff(at))
            chars, joined = chars[keep], "".join(x for x, s in zip(texts, short) if s)
            at = np.concatenate(([0], np.cumsum(np.diff(at)[short])))
        return self._merged(texts, short, self._pieced(joined, chars, at))

    def _pieced(self, joined: str, chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(chars):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        lowered, spaced, single = self.kind
        if lowered:
            chars = _LOWER[chars]
            joined = chars.astype("<u2").tobytes().decode("utf-16-le")
        starts, ends = cut(chars, at, spaced, single)
        hashes = np.maximum(word_hashes(chars, starts, ends), np.uint64(1))
        k, had, used = self.known.find(hashes), self.pieces, self.used
        new = np.flatnonzero(k < 0)
        if len(new):
            distinct, where, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            place = new[where]
            self._learn([joined[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist())])
            k[new] = had + inverse
            if self.pieces <= MOST_PIECES:
                self.known.add(distinct, np.arange(had, self.pieces, dtype=np.int32))
        lengths = self.length[k].astype(np.int64)
        done = np.cumsum(lengths)
        total = int(done[-1]) if len(done) else 0
        ids = self.pool[np.repeat(self.start[k] - (done - lengths), lengths) + np.arange(total)]
        if self.pieces > MOST_PIECES:
            self.pieces, self.used = had, used
        ends_at = np.concatenate(([0], done))[np.searchsorted(starts, at)]
        return ids, np.diff(ends_at)

    def _merged(self, texts: list[str], short: np.ndarray, made: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        if made is not None and short.all():
            return made
        at = np.concatenate(([0], np.cumsum(made[1]))) if made is not None else np.zeros(1, np.int64)
        parts, i = [np.zeros(0, np.uint32)], 0
        for text, s in zip(texts, short.tolist()):
            if s:
                parts.append(made[0][at[i] : at[i + 1]])
                i += 1
            else:
                parts.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
        return np.concatenate(parts), np.array([len(x) for x in parts[1:]], np.int64)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """A worker process keeps its encoder from task to task."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by the end id."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    kept = np.ones(len(out), bool)
    kept[np.cumsum(counts + 1) - 1] = False
    out[kept] = ids
    return out, counts + 1


TOKENS = "doc_id long, n_tokens long, ids binary, counts binary"


def encoded(batches: Iterator, path: str, end: int = END) -> Iterator:
    """From batches of (doc_id, text): doc_ids, all ids with end ids, and where each document's begin; about ``BATCH`` bytes of text at once."""
    e = encoder(path)
    if e.tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("the vocabulary has ids over 16 bits")
    for batch in batches:
        _, offsets = column_bytes(batch.column(1))
        for a, b in slices(offsets, BATCH):
            ids, counts = with_end(*e.encode(batch.column(1)[a:b].to_pylist()), end)
            yield batch.column(0)[a:b], ids, np.concatenate(([0], np.cumsum(counts)))


def id_table(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, n_tokens, ids (16-bit little-endian) of every row; null text is empty and has the end id alone.

    Each task ends with a row of its own that has ``counts`` alone: 65,536 numbers, how often each id occurs.
    """

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(1 << 16, np.int64)
        names = [x.split()[0] for x in TOKENS.split(", ")]
        for doc_ids, ids, at in encoded(batches, path, end):
            total += np.bincount(ids, minlength=1 << 16)
            raw, n = ids.astype("<u2").tobytes(), len(doc_ids)
            made = pa.array([raw[x:y] for x, y in zip((2 * at[:-1]).tolist(), (2 * at[1:]).tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(at)), made, pa.nulls(n, pa.binary())], names)
        last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(last, names)

    return id_text(docs).mapInArrow(encode, TOKENS)


def _summed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.frombuffer(x.as_buffer(), "<i8")
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])


def counts_of(table_of_ids: DataFrame) -> np.ndarray:
    """The sum of all tasks' counts: at most 65,536 rows reach the driver, whatever the input."""
    rows = table_of_ids.where("counts is not null").select("counts").mapInArrow(_summed, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 16, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out
