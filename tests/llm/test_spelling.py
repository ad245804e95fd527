import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skyloom.llm import spelling

from .data import ODD, frame, put


def one_apart(a, b):
    """By the definition: one replaced, added or deleted code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    form, out = {}, set()
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def texts(seed, n=120):
    """Few letters, so that many words are near; runs of one letter; frequent words and rare spoilt ones."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 12))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "bbbbbbbb"]
    common = ["Königreich", "kingdom×s", "abaabaa"]
    out = []
    for _ in range(n):
        words = rng.choices(stems, k=25) + rng.choices(common, k=40)
        for w in rng.choices(stems + common, k=6):
            i = rng.randrange(len(w) + 1)
            words.append(rng.choice([w[:i] + rng.choice("abÉ") + w[i:], w[:i] + w[i + 1 :], w[:i] + "b" + w[i + 1 :]]))
        rng.shuffle(words)
        out.append(" ".join(words) + rng.choice(["", "1x", "-", "Š"]))
    return out


@pytest.mark.parametrize("group_words", [spelling.GROUP_WORDS, 4])
def test_equals_brute_force(spark, group_words):
    """Also with groups split down to gaps of one letter."""
    rows = texts(3) + ODD
    got = spelling.variants(frame(spark, rows), group_words).collect()
    assert len(got) == len({r.word for r in got})
    assert {tuple(r) for r in got} == brute(enumerate(rows))
    assert any(r.form and r.root != r.form for r in got) or any(r.form for r in got)


def test_query_and_columns(spark, tmp_path):
    got = spelling.op12_spelling_variants(spark, put(spark, tmp_path, texts(5, 30)))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == brute(enumerate(texts(5, 30)))


def test_null_ids_repeated_rows_and_none(spark):
    rows = [(None, "abcdefgh abcdefgh abcdefgx abcdefgx"), (None, None), (3, "abcdefgh"), (3, "abcdefgh"), (None, "abcdefgh abcdefgh abcdefgx abcdefgx")]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as key"))
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, ["short words only", None])).count() == 0


def test_chains_of_forms(spark):
    """Three forms in a row are followed to the last."""
    pieces = {"abcdefghi": 3000, "abcdefghj": 250, "abcdefgkj": 20, "abcdefmkj": 2}
    rows = [(i, w) for w, n in pieces.items() for i in range(n)]
    rows = [(i, w) for i, w in rows if zlib.crc32(f"{i}:{w}".encode()) % 31]
    want = brute(rows)
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and ("abcdefgkj", "abcdefghj", "abcdefghi") in {r[:3] for r in got}


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(3, 7))) for _ in range(60)})
    rows = np.array([[ord(c) - 96 for c in w] + [0] * (8 - len(w)) for w in words], np.uint8)
    a = spelling.Automaton(rows)
    for i, r in enumerate(rows):
        state = number = 0
        for d, c in enumerate(r):
            go, add = a.step(d)
            number += add[state * spelling.LETTERS + c]
            state = go[state * spelling.LETTERS + c]
        assert number == i and state == 0
    filled = [tuple(r) for r in rows]
    for d, (begin, *_rest) in enumerate(a.edges):
        rests = {frozenset(w[d:] for w in filled if w[:d] == p) for p in {w[:d] for w in filled}}
        assert len(begin) - 1 == len(rests)  # a state for each set of endings


def test_long_runs(spark):
    long = "ab" * 2000
    rows = [(1, long), (2, long), (3, long + "c"), (4, long + "c"), (5, long[:100] + "x" + long[101:]), (6, long[:100] + "x" + long[101:])]
    assert {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)
