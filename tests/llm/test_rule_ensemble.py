import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyloom.llm import rule_ensemble as ens

from .data import ODD, frame

DATA = "/root/testdata/sf0.01"


def brute(t):
    """The statistics by plain loops over code points, words and lines."""
    t = t or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if x]
    windows = list(zip(words, words[1:], words[2:]))
    over = lambda a, b: a / max(b, 1)
    share = lambda c: over(sum(x in c for x in t), len(t))
    plain = lambda w: all(c.isascii() and c.isalpha() or not c.isascii() for c in w[:-1]) and (w[-1] in ".,;:" and len(w) > 1 or w[-1].isascii() and w[-1].isalpha() or not w[-1].isascii())
    return {
        "lower_share": share("abcdefghijklmnopqrstuvwxyz"),
        "upper_share": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digit_share": share("0123456789"),
        "stop_share": share(".,;:"),
        "shout_share": share("!?"),
        "symbol_share": share("#$%&*|<>=@~^_+/\\{}[]`"),
        "wide_share": over(sum(not c.isascii() for c in t), len(t)),
        "space_share": share(" \t\n\x0b\x0c\r"),
        "n_chars": len(t),
        "n_words": len(words),
        "mean_word_chars": over(sum(map(len, words)), len(words)),
        "longest_word": max(map(len, words), default=0),
        "one_char_word_share": over(sum(len(w) == 1 for w in words), len(words)),
        "plain_word_share": over(sum(map(plain, words)), len(words)),
        "distinct_word_share": over(len(set(words)), len(words)),
        "repeated_window_share": over(len(windows) - len(set(windows)), len(windows)),
        "mean_line_words": over(len(words), len(lines)),
        "repeated_line_share": over(len(lines) - len(set(lines)), len(lines)),
    }


def test_statistics_equal_plain_loops(spark):
    rng = random.Random(2)
    parts = ["a", "The", "é", "漢字", "x.", "7", "#", "!", "under_score", "\n", "\n\n", "\t", "🎉", "ß,", ".", "a b c "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 80))) for _ in range(150)] + ODD
    got = {r.doc_id: r.statistics.asDict() for r in ens.with_statistics(frame(spark, texts), ["doc_id"]).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute(t)), repr(t)


def test_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", [1])], "doc_id long, text string, statistics string, `od``d.name` array<int>")
    out = ens.with_statistics(docs, ["statistics", "od`d.name", "doc_id"], "found")
    assert out.columns == ["statistics", "od`d.name", "doc_id", "found"] and out.first()[:3] == ("mine", [1], 1)


def good(rng):
    return " ".join(rng.choice(["over", "hills", "the", "river", "ran", "quiet", "stone,", "morning"]) + ("" if rng.random() < 0.8 else "s") for _ in range(60))


def bad(rng):
    return " ".join(rng.choice(["$$$", "BUY!!", "a|b", "x#"]) for _ in range(60))


def table_of(spark, n, seed=1):
    rng = random.Random(seed)
    docs = [(i, good(rng) if i % 3 else bad(rng)) for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string"), [(i, int(i % 3 > 0), 0) for i in range(n)]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_rows_teach_nothing(spark):
    docs, labels = table_of(spark, 300)
    out, model = ens.classify(docs, labels_of(spark, labels))
    got = {r.doc_id: r for r in out.collect()}
    held = {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {i for i, r in got.items() if r.held_out} == held and 0 < len(held) < 300
    assert all(got[i].predicted == int(i % 3 > 0) for i in held)
    flipped = [(i, 1 - q if i in held else q, t) for i, q, t in labels]
    again = {r.doc_id: r.score for r in ens.classify(docs, labels_of(spark, flipped))[0].collect()}
    assert again == {i: r.score for i, r in got.items()}
    # rules are conjunctions over statistics, few have weight, and they are plain columns
    assert model.rules and len(model.rules) < 40 and all(s in ens.STATISTICS for r in model.rules for s, *_ in r.bounds)
    assert all(w for w in model.weights) and str(model).count(" if ") == len(model.rules)
    plan = docs.sparkSession.range(1).select(model.score(lambda s: F.lit(0.0)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_compiled_score_equals_the_rules(spark):
    model = ens.RuleModel((ens.Rule((("n_words", 2.0, 5.0), ("n_chars", float("-inf"), 9.0))), ens.Rule((("n_words", 3.0, float("inf")),))), (1.5, -2.0), 0.25)
    rows = spark.createDataFrame([(float(w), float(c)) for w in range(8) for c in (8, 9, 10)], "n_words double, n_chars double")
    for r in rows.select("*", model.score(F.col).alias("score")).collect():
        total = 0.25 + 1.5 * (2 < r.n_words <= 5 and r.n_chars <= 9) - 2 * (r.n_words > 3)
        assert r.score == pytest.approx(1 / (1 + 2.718281828459045**-total))
    assert str(model.rules[0]) == "2 < n_words <= 5 and n_chars <= 9"


def test_odd_rows(spark):
    docs, labels = table_of(spark, 90)
    odd = spark.createDataFrame([(None, "x"), (None, None), (1000, None), (1000, ""), (5, good(random.Random(3)))], "doc_id long, text string")
    labels = labels + labels[:10] + [(None, 1, None), (1000, None, 1), (7, 9, 0)]
    out, _ = ens.classify(docs.union(odd), labels_of(spark, labels))
    rows = out.collect()
    assert len(rows) == 95 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert Counter(r.held_out for r in rows if r.doc_id is None) == {False: 2}
    assert ens.classify(frame(spark, []), labels_of(spark, []))[0].count() == 0
    none = ens.classify(docs, labels_of(spark, []))[0].select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    one = ens.classify(docs, labels_of(spark, [(i, 1, 0) for i in range(90)]))[0].select("score").distinct().collect()
    assert len(one) == 1 and one[0].score > 0.9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    out = ens.op11_rule_ensemble(spark, DATA)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    ones, zeros = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) >= 0.98 * len(ones) * len(zeros)
