"""License scans: fuzzy search of short notices in whole texts.

Base phrases are found exactly, word by word. For the notices, a text that holds one with at most k edits
holds one of its k+1 parts unchanged (pigeonhole), so an Aho-Corasick pass over the parts gives candidate
places; there the regex library's bounded-error matching verifies the notice and reports span and edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import ALNUM_WORD, column_bytes, id_text, lower_ascii, slices, table, word_bounds

#: Fixed values of the base contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: (notice as normalised words, label). Edits are counted in characters of words joined by one space. What stands in brackets
#: tells the license from its siblings and must be found as it is.
NOTICES = (
    ("released under the [mit] license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the [apache] license version [2 0]", "apache-2.0"),
    ("this work is licensed under the [gnu general public license] version [3]", "gpl-3.0"),
    ("licensed under [cc by nc 4 0]", "cc-by-nc-4.0"),
    ("licensed under [cc by 4 0]", "cc-by-4.0"),
    ("licensed under [cc by sa 4 0]", "cc-by-sa-4.0"),
    ("licensed under a creative commons [attribution license]", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the [mozilla public] license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: One edit for each so many characters of a notice.
CHARS_PER_EDIT = 12
OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def split_parts(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits+1 parts of about equal length, with their places: one of them survives that many edits."""
    n, k = len(notice), edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def _pattern(notice: str, edits: int) -> str:
    """Bracketed words as they are, whole; the stretches around them with ``edits`` at most."""
    parts = re.split(r"\[(.*?)\]", notice)
    return "".join(f"(?<![^ ]){p}(?![^ ])" if i % 2 else f"(?:{p}){{e<={edits}}}" for i, p in enumerate(parts) if p)


class Finder:
    """Notices with their allowed edits; ``find`` gives (notice, start, end, edits) in a normalised text."""

    def __init__(self, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex

        plain = [(re.sub(r"[\[\]]", "", text), label) for text, label in notices]
        self.notices = [(text, label, len(text) // chars_per_edit) for text, label in plain]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (text, _, k) in enumerate(self.notices):
            for place, part in split_parts(text, k):
                seeds.setdefault(part, []).append((i, place))
        self.automaton = ahocorasick.Automaton()
        for part, at in seeds.items():
            self.automaton.add_word(part, (len(part), at))
        self.automaton.make_automaton()
        # BESTMATCH: the fewest edits in a range; whole words only
        self.patterns = [regex.compile(f"(?be)(?<![^ ]){_pattern(text, k)}(?![^ ])") for (text, _), (_, _, k) in zip(notices, self.notices)]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        ranges: dict[int, list[list[int]]] = {}
        for end, (n, at) in self.automaton.iter(text):
            for i, place in at:
                notice, _, k = self.notices[i]
                start = end + 1 - n - place
                a, b = max(0, start - k - 1), min(len(text), start + len(notice) + k + 1)
                have = ranges.setdefault(i, [])
                if have and a <= have[-1][1]:  # hits come in order of their ends; one range for those that meet
                    have[-1][0], have[-1][1] = min(a, have[-1][0]), max(b, have[-1][1])
                else:
                    have.append([a, b])
        found = []
        for i, spans in ranges.items():
            for a, b in spans:
                found += self._all(i, text, text.rfind(" ", 0, a) + 1, b if (space := text.find(" ", b)) < 0 else space)
        return [x for run in _runs(sorted(found, key=lambda x: (x[1], x[2], x[0]))) for x in self._closest(run)]

    def _all(self, i: int, text: str, a: int, b: int) -> list[tuple[int, int, int, int]]:
        """Matches of a notice between ``a`` and ``b``, both at ends of words: the best, then those before and after it."""
        notice, _, k = self.notices[i]
        found, ranges = [], [(a, b)]
        while ranges:
            a, b = ranges.pop()
            # stretches between exact words have k edits each in the pattern, so their sum is held to k here
            if b - a >= len(notice) - k and (m := self.patterns[i].search(text, a, b)):
                if sum(m.fuzzy_counts) <= k:
                    found.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                ranges += [(a, m.start()), (max(m.end(), m.start() + 1), b)]
        return found

    def _closest(self, run: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Of matches that overlap, the one with the smallest share of edits stays, then the longest."""
        kept: list[tuple[int, int, int, int]] = []
        for x in sorted(run, key=lambda x: (x[3] / len(self.notices[x[0]][0]), x[1] - x[2], x)):
            if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: x[1])


def _runs(found: list[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
    """Matches, sorted by start, in runs that overlap one another."""
    run: list[tuple[int, int, int, int]] = []
    end = 0
    for x in found:
        if run and x[1] >= end:
            yield run
            run = []
        end = max(x[2], end) if run else x[2]
        run.append(x)
    if run:
        yield run


_PHRASES = {p: re.compile(f"(?<![^ ]){p}(?![^ ])") for p in BASE}


def normalised(raw: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Texts with each run of bytes outside words turned into one space, and their new offsets."""
    inside = ALNUM_WORD[raw]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    return np.where(inside, raw, 32).astype(np.uint8)[keep].tobytes(), np.concatenate(([0], np.cumsum(keep)))[offsets]


def scan(docs: DataFrame) -> DataFrame:
    """Per row: word count, base places, labels of base phrases and of notices, a score and the notices' spans.

    Words are runs of digits, letters and anything beyond ASCII, A-Z lower-cased. ``spans`` has
    label:first word:end word:edits of each notice (end exclusive), comma-joined in order. ``score`` is 1 where a
    base phrase stands, else the best notice's share of unchanged characters, else 0. Null text is empty: no words,
    no labels, score 0. Each row is scanned by itself, whole, repeated rows too.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        finder = Finder()
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in slices(offsets):
                lo, hi = offsets[a], offsets[b]
                raw, off = lower_ascii(data[lo:hi]), offsets[a : b + 1] - lo
                _, _, at = word_bounds(raw, off, ALNUM_WORD)
                flat, cuts = normalised(raw, off)
                columns: list[list] = [[] for _ in _NAMES[1:]]
                for i in range(b - a):
                    text = flat[cuts[i] : cuts[i + 1]].decode("utf-8", "replace")
                    lead = text.startswith(" ")
                    places, base, more, score = [], set(), [], 0.0
                    starts = {p: [m.start() for m in pattern.finditer(text)] for p, pattern in _PHRASES.items() if p in text}
                    notices = finder.find(text)
                    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32) if starts or notices else []
                    word = lambda p: int(np.searchsorted(spaces, p)) - lead  # noqa: E731, B023
                    for phrase, hits in starts.items():
                        if hits:
                            base.add(BASE[phrase])
                            places += map(word, hits)
                    for n, s, e, edits in notices:
                        notice, label, _ = finder.notices[n]
                        more.append((label, word(s), word(e - 1) + 1, edits))
                        score = max(score, 1 - edits / len(notice))
                    labels = sorted(base | {x[0] for x in more})
                    spans = ",".join(":".join(map(str, x)) for x in more)
                    row = [at[i + 1] - at[i], len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), 1.0 if base else score, spans]
                    for c, v in zip(columns, row):
                        c.append(v)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *[pa.array(c, k) for c, k in zip(columns, kinds)]], _NAMES)

    return id_text(docs).mapInArrow(run, OUT)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
