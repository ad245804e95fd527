import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from skyloom.llm import filter_audit as audit

from .data import ODD


def failing(rows):
    """The failed filters of each row, by their definitions."""
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        f += "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        out.append(f + "E" * any(o is not None and doc_id is not None and o < doc_id and (x or "") == t for o, x, _ in rows))
    return out


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    fails, parts = failing(rows), {lang or "" for *_, lang in rows}
    removed, out = Counter(), {}
    for part in parts:
        mine = [(f, i in good and i is not None, i in toxic and i is not None) for (i, _, lang), f in zip(rows, fails) if (lang or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, c in enumerate(order, 1):
                gone = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                early = sum(c in f for f, *_ in mine) - len(gone)
                removed[part, c] += len(gone)
                out[part, order, k] = [len(left), len(gone), early, sum(f == c for f, *_ in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
    return {(*key, *v, removed[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def make(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as mask", "2 as part", "3 as n", "4 as good")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text", "'y' as good")


def test_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "B", "Cc", "d", f"w{rng.random()}", f"w{rng.random()}", f"v{rng.random()}"]) for _ in range(rng.choice([50, 120, 200]))) + rng.choice(["", "", "#", " |"]) for _ in range(40)] + ODD
    rows = [(rng.randrange(90), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(150)]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (5, texts[1], "en"), (5, texts[1], "en"), (5, texts[1], "de"), (4, texts[1], "fr"), (900, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    got = audit.audit(*make(spark, rows, labels)).collect()
    assert len(got) == 600 * len({lang or "" for *_, lang in rows})
    assert {tuple(r) for r in got} == brute(rows, labels)


def test_sums_invert_exactly(spark):
    """32 signed sums give back counts of any size, zeros and large ones alike."""
    rng = random.Random(6)
    want = [rng.choice([0, 1, 7, 10**15 + 3]) for _ in range(32)]
    counts = spark.createDataFrame([("p", False, False, m, n) for m, n in enumerate(want)], "part string, good boolean, toxic boolean, mask int, n long")
    sums = audit.parity_sums(counts).where(F.col("group") == "every")
    assert sums.first().sums == [sum(n * (-1) ** (m & t).bit_count() for m, n in enumerate(want)) for t in range(32)]
    assert sums.select(audit.cells(F.col("sums")).alias("c")).first().c == want


def test_empty_table_and_no_python(spark):
    docs, labels = make(spark, [], [])
    assert audit.audit(docs, labels).count() == 0
    docs, labels = make(spark, [(1, "a", "en")], [])
    out = audit.audit(docs, labels)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 600 and out.agg(F.sum("good_lost")).first()[0] == 0
