import math
import random
import re
from collections import Counter

import numpy as np

from skyloom.llm import decontam

from .data import ODD, frame

ITEMS = "item_id long, text string, doc_id long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


def items(rng, n=60):
    return [(i, words(rng, rng.choice([8, 20, 45, 150])) + rng.choice([".\n", ". "]) + words(rng, rng.choice([1, 4, 12])) + ".", i) for i in range(n)]


def test_search_equals_brute_force():
    rng = random.Random(1)
    some = [(i, t) for i, t, _ in items(rng)]
    ix = decontam.Index(some)
    texts = [words(rng, rng.choice([0, 3, 31, 32, 33, 64, 65, 300])) for _ in range(40)] + [t for _, t in some[:20]]
    hashes = [decontam.text_hashes(t) for t in texts]
    got = {(t, i, f): s for t, i, s, f in ix.search(np.concatenate(hashes), np.concatenate(([0], np.cumsum([len(h) for h in hashes]))))}
    impact = np.zeros((len(ix.terms), len(some)))
    for t in range(len(ix.terms)):
        impact[t, ix.owner[ix.ends[t] : ix.ends[t + 1]]] = ix.impact[ix.ends[t] : ix.ends[t + 1]]
    want = {}
    for k, h in enumerate(hashes):
        n = -(-len(h) // 32)
        for f in range(max(n - 1, min(n, 1))):
            total = impact[np.isin(ix.terms, h[32 * f : 32 * f + 64])].sum(0)
            want |= {(k, int(i), 32 * f): total[i] for i in np.flatnonzero(total >= 1)}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_planted_items_are_found_and_clean_texts_left(spark):
    rng = random.Random(2)
    rows = items(rng)
    texts, planted = [], set()
    for k in range(300):
        t = words(rng, rng.choice([5, 60, 400]), 5000)
        if k % 3 == 0:
            i = rng.randrange(len(rows))
            planted.add((k, i))
            t += " " + rng.choice([str, str.upper, lambda x: x.replace(" ", "  ").replace(".", ";")])(rows[i][1]) + " " + words(rng, rng.choice([0, 50]), 5000)
        texts.append(t)
    docs = frame(spark, texts + ODD)
    bench = spark.createDataFrame(rows + [(900, None, 0), (901, "", 0), (902, " . ", 0)], ITEMS)
    got = decontam.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= planted
    assert {r.doc_id for r in got} == {k for k, _ in planted}
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == len(texts) + len(ODD) - len({k for k, _ in planted})


def brute_leaks(texts, rows):
    """Every passage against every item by the formula, then the overlap of n-grams as sets of words."""
    words_of = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    items = [(i, words_of(t), [words_of(x) for x in decontam.question_and_answer(t)]) for i, t, _ in rows]
    df = Counter(w for _, ws, _ in items for w in set(ws))
    mean = sum(len(ws) for _, ws, _ in items) / len(items)
    longest = max(len(ws) for _, ws, _ in items)
    idf = {w: math.log1p((len(items) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    impact = [{w: idf[w] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, c in Counter(ws).items()} for _, ws, _ in items]
    bar = [0.6 * sum(x.values()) * min(1, 32 / len(ws)) for x, (_, ws, _) in zip(impact, items)]
    grams = lambda ws, n: [tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)]
    found = set()
    for d, t in enumerate(texts):
        ws = words_of(t)
        halves = -(-len(ws) // 32)
        for f in range(0, max(halves - 1, min(halves, 1)) * 32, 32):
            passage, around = set(ws[f : f + 64]), ws[max(0, f - longest) : f + 64 + longest]
            for k, (i, _, parts) in enumerate(items):
                if sum(v for w, v in impact[k].items() if w in passage) < bar[k]:
                    continue
                shares = []
                for part in parts:
                    n = min(5, len(part))
                    have = set(grams(around, n))
                    shares.append(sum(g in have for g in grams(part, n)) / max(len(part) - n + 1, 1) if n else 1)
                if min(shares) >= 0.5:
                    found.add((d, i))
    return found


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    rows = items(rng, 40)
    texts = []
    for _ in range(120):
        t = rng.choice(rows)[1].split()
        for _ in range(rng.choice([0, 0, 2, 8, 20])):  # edited copies, on both sides of the bar
            t[rng.randrange(len(t))] = f"w{rng.randrange(400)}"
        texts.append(words(rng, rng.choice([0, 20, 90])) + " " + " ".join(t[: rng.choice([len(t), len(t) // 2 + 1])]) + " " + words(rng, rng.choice([0, 40])))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, texts), spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == brute_leaks(texts, rows) and 20 < len(got)


def test_rows_without_an_id_and_clashing_columns(spark):
    rows = [(1, "one two three four five six seven eight.\nthe answer nine", 0)]
    docs = spark.createDataFrame([(None, rows[0][1], "a"), (None, "clean", "b"), (5, rows[0][1], "c"), (5, "clean too", "d")], "doc_id long, text string, __doc string")
    left = decontam.clean(docs, spark.createDataFrame(rows, ITEMS))
    assert left.columns == docs.columns and sorted(r["__doc"] for r in left.collect()) == ["b", "d"]


def test_rounds_and_empty_tables(spark, monkeypatch):
    rng = random.Random(3)
    rows = items(rng, 20)
    docs = frame(spark, [t for _, t, _ in rows])
    want = sorted(map(tuple, decontam.leaks(docs, spark.createDataFrame(rows, ITEMS)).collect()))
    monkeypatch.setattr(decontam, "ROUND_BYTES", 2000)
    got = sorted(map(tuple, decontam.leaks(docs, spark.createDataFrame(rows, ITEMS)).collect()))
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want]  # scores are those of all items
    assert np.allclose([x[2] for x in got], [x[2] for x in want])
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, spark.createDataFrame(rows, ITEMS)).collect()} >= {(i, i) for i in range(20)}
    assert decontam.leaks(docs, spark.createDataFrame([], ITEMS)).count() == 0
    assert decontam.leaks(frame(spark, []), spark.createDataFrame(rows, ITEMS)).count() == 0
