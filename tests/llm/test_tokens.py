import os
import random
import zlib

import numpy as np
import pytest

from skyloom.llm import token_output, tokens

from .data import ODD, put


def texts(seed=3):
    rng = random.Random(seed)
    bits = ["the", " The", "  ", "\n", "\t", "'s", "'", "''s", "'ll", "12", "3", "²½", "É", "ñandú", "ſ", "straße", "!!", " ?", "###", "<|endoftext|>", "漢字", "é", "\xa0", "\x85", "\x1c", "İ", "🎉", "_", "don't", "DON'T", "a\r\nb", "   x"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(600)] + [t for t in ODD if t]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    path = tokens.vocabulary_path(name)
    e, some = tokens.Encoder(path), texts()
    ids, counts = e.encode(some)
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, t in enumerate(some):
        assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name, want", [("byte_bpe_50k.json", [505, 220, 50256, 734]), ("word_bpe_49k.json", [637, 49407, 1237])])
def test_added_tokens_are_matched_as_by_a_fresh_tokenizer(name, want):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path(name)
    fresh, some = Tokenizer.from_file(path), ["one <|endoftext|> two", "<|startoftext|>a", "<|ENDOFTEXT|>", *texts(6)]
    ids, counts = tokens.Encoder(path).encode(some)
    assert ids[: counts[0]].tolist() == want
    assert ids.tolist() == sum((fresh.encode(t, add_special_tokens=False).ids for t in some), [])


def test_code_lengths_are_limited_and_optimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 3000):
        counts = np.maximum((rng.pareto(0.3, n) * 3).clip(0, 1e9).astype(np.int64), 0)
        lengths = token_output.code_lengths(counts)
        used = counts > 0
        assert (lengths[~used] == 0).all() and (lengths[used] > 0).all() and lengths.max(initial=0) <= 16
        if used.sum() > 1:
            assert np.sum(2.0 ** -lengths[used].astype(float)) == 1.0
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    assert token_output.code_lengths(np.array(fib)).max() == 16


def test_pack_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 70_000):
        ids = rng.zipf(1.3, n).clip(0, 999).astype(np.uint16)
        lengths = token_output.code_lengths(np.bincount(ids, minlength=1 << 16))
        bits, offsets = token_output.pack(ids, token_output.codes_of(lengths), lengths)
        back = token_output.unpack(bits, offsets, n, *token_output.decode_table(lengths))
        assert (back == ids).all()


def test_files_round_trip(spark, tmp_path):
    rows = [*ODD, *texts(4)]
    folder = put(spark, tmp_path, rows)
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    token_output.write(spark.read.parquet(f"{folder}/documents.parquet"), f"{tmp_path}/files", path)
    got = sorted(token_output.read(spark, f"{tmp_path}/files").collect(), key=lambda r: r.doc_id)
    e, start = tokens.Encoder(path), 0
    assert [r.doc_id for r in got] == list(range(len(rows)))
    for r, t in zip(got, rows):
        want = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (start, len(want), zlib.crc32(want.tobytes()), want.tolist())
        start += len(want)
    assert os.path.isdir(f"{tmp_path}/files/blocks")


def test_empty_table(spark, tmp_path):
    assert token_output.op3_token_output(spark, put(spark, tmp_path, [])).count() == 0


def test_a_full_table_of_pieces_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 20)
    e, some = tokens.Encoder(tokens.vocabulary_path("byte_bpe_50k.json")), texts(9)
    for a in range(0, len(some), 50):
        ids, counts = e.encode(some[a : a + 50])
        want = [x.ids for x in e.tokenizer.encode_batch(some[a : a + 50], add_special_tokens=False)]
        assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))
    assert e.pieces <= 20 and e.known.n <= 20


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cutting_and_merging_equal_the_library(name):
    from tokenizers import Tokenizer

    rng, path = random.Random(5), tokens.vocabulary_path(name)
    bits = [*"a b'stremvld '' \n\t  1²é!?#.,AŚ", "'s", "'re", "'ll", "'VE", " '", "  ", "\r\n", "<|", "x" * 300, "aaaa"]
    some = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    ids, counts = tokens.Encoder(path).encode(some)
    want = Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)
    assert counts.tolist() == [len(w.ids) for w in want] and ids.tolist() == sum((w.ids for w in want), [])


def test_known_hashes():
    rng, known = np.random.default_rng(1), tokens.Known(4)
    keys = np.unique(rng.integers(1, 1 << 63, 5000).astype(np.uint64))
    for a in range(0, len(keys), 700):
        known.add(keys[a : a + 700], np.arange(a, min(a + 700, len(keys)), dtype=np.int32))
    assert (known.find(keys) == np.arange(len(keys))).all() and (known.find(keys + np.uint64(1 << 63)) == -1).all()
