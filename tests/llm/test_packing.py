import zlib
from collections import defaultdict

import numpy as np
import pytest

from skyloom.llm import packing, tokens

from .data import ODD, put
from .test_tokens import texts


def check(rows, want):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == want.keys()
    for d, ids in want.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    used = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        used += at
    return 1 - used / (4096 * len(sequences))


def ids_of(some):
    e = tokens.Encoder(tokens.vocabulary_path("word_bpe_49k.json"))
    return {i: np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], np.uint32) for i, t in enumerate(some)}


def test_every_id_lies_in_one_piece(spark, tmp_path):
    some = [*ODD, *texts(5)]
    rows = packing.op7_retrieval_packing(spark, put(spark, tmp_path, some)).collect()
    assert check(rows, ids_of(some)) < 0.2


def brute_scores(docs, seed, weights, mean):
    q, out = np.unique(docs[seed]), []
    for x in docs:
        tf = np.array([np.count_nonzero(x == t) for t in q])
        out.append(float((weights[q] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))).sum()))
    return np.array(out)


@pytest.mark.parametrize("common", [1 / 24, 0.9])
def test_neighbours_are_the_brute_force_best(monkeypatch, common):
    monkeypatch.setattr(packing, "COMMON", common)
    rng = np.random.default_rng(1)
    docs = [rng.zipf(1.4, rng.integers(5, 60)).clip(0, 300).astype(np.uint16) for _ in range(200)]
    weights, mean = np.linspace(5, 1, 1 << 16).astype(np.float32), 30.0
    shard = packing.Shard(docs, weights, mean)
    for used in (slice(0, 200, 3), slice(0, 100)):  # a few, then enough that the index forgets them
        shard.unused[used] = False
        seeds = list(range(0, 200, 17))
        for seed, got in zip(seeds, shard.neighbours(seeds)):
            scores = brute_scores(docs, seed, weights, mean)
            best = np.sort(scores[shard.unused])[::-1][: len(got)]
            assert len(got) == min(packing.NEIGHBOURS, shard.unused.sum()) == len(set(got.tolist()))
            assert shard.unused[got].all() and np.allclose(scores[got], best, rtol=1e-4)


def test_windows_of_a_shard_are_full_and_hold_neighbours():
    rng = np.random.default_rng(2)
    topics = [rng.integers(0, 5000, 120).astype(np.uint16) for _ in range(8)]
    of = rng.integers(0, 8, 300)
    docs = [rng.choice(topics[k], rng.integers(50, 1500)) for k in of]
    shard = packing.Shard(docs, np.ones(1 << 16, np.float32), 700.0)
    windows = list(shard.windows())
    assert sum(sum(x[2] for x in w) < 4096 for w in windows) <= 1
    pieces = sorted(x for w in windows for x in w)
    for d, ids in enumerate(docs):
        at = 0
        for _, first, n in (x for x in pieces if x[0] == d):
            assert first == at and n > 0
            at += n
        assert at == len(ids)
    alike = [np.mean([of[x[0]] == of[w[0][0]] for x in w]) for w in windows]
    assert np.mean(alike) > 0.7  # by chance 1/8


def test_directions_keep_documents_of_a_topic_together():
    rng = np.random.default_rng(3)
    topics = [rng.integers(0, 1 << 16, 400).astype(np.uint16) for _ in range(12)]
    of = rng.integers(0, 12, 600)
    docs = [rng.choice(topics[k], rng.integers(100, 900)) for k in of]
    drawn = packing.signs(np.ones(1 << 16, np.float32))
    v = packing.directions(docs, drawn)
    middle = packing.centres(np.concatenate([v[:300], np.repeat(v[:1], 500, axis=0)]))  # copies have no more weight
    own = (v @ middle.T).argmax(1)
    assert len(middle) == packing.CENTRES and np.allclose(np.linalg.norm(middle, axis=1), 1, atol=1e-3)
    pure = sum(np.bincount(of[own == c]).max() for c in set(own.tolist()))
    assert pure >= 0.95 * len(docs)
    assert len(packing.centres(v[:0])) == 1 and packing.directions([], drawn).shape == (0, 64)


def test_many_small_shards_cover_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 8)
    monkeypatch.setattr(packing, "SHARD_IDS", 20_000)
    some = [*ODD, *(" ".join(t.split()) * 12 for t in texts(5)[:200])]
    check(packing.op7_retrieval_packing(spark, put(spark, tmp_path, some)).collect(), ids_of(some))


def test_empty_table(spark, tmp_path):
    assert packing.op7_retrieval_packing(spark, put(spark, tmp_path, [])).count() == 0
