import random
import re

import pytest

from skyloom.llm import near_dup

from .data import ODD, frame, put

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts, percent=85):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def texts(seed=8, groups=12, copies=25):
    rng, out = random.Random(seed), list(ODD)
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            out.append(rng.choice([" ", "\n", "  "]).join(w).upper() if rng.random() < 0.1 else " ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_equals_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(near_dup.blocks, "__defaults__", (block,))
    rows = texts()
    got = sorted(tuple(r) for r in near_dup.op10_minhash_near_dup(spark, put(spark, tmp_path, rows)).collect())
    assert got == brute(rows)


def test_hot_sets_long_sets_and_repeated_rows(spark, tmp_path, monkeypatch):
    """Copies over the bound of a hot key, blocks bounded by shingles, rows that share a doc_id."""
    monkeypatch.setattr(near_dup.hot_join, "__defaults__", (20,))
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 300)
    rows = texts(9, 6, 20)
    rows += [rows[30]] * 90 + ["one and the same text of some words"] * 60
    got = sorted(tuple(r) for r in near_dup.op10_minhash_near_dup(spark, put(spark, tmp_path, rows)).collect())
    assert got == brute(rows)
    same = spark.createDataFrame([(1, "a b c d e f g"), (1, "other words than those of it"), (2, "a b c d e f g"), (3, "other words than those of it")], "doc_id long, text string")
    assert sorted({r.component_id for r in near_dup.near_duplicates(same).collect()}) == [1]
    kept = near_dup.keep_one(same.selectExpr("*", "'x' as __place", "1 as node"))
    assert kept.columns == ["doc_id", "text", "__place", "node"] and [r.doc_id for r in kept.collect()] == [1]


def test_chain_has_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 3)], "a long, b long")
    got = {r.node: r.component for r in near_dup.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90}


def test_posterior_bound_keeps_pairs_at_the_threshold():
    least = near_dup.least_matches(0.85)
    assert 70 < least[120] < 102 and all(least[n] <= least[n + 1] for n in range(120))


def test_null_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, near_dup.near_duplicates(rows).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (None, 2, None, True)]
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
