import random
import re

import corpus_pipeline
from skyloom.llm import decontam, quality

from .data import ODD
from .test_line_dedup import brute as brute_lines
from .test_near_dup import brute as brute_near
from .test_near_dup import texts as near_texts
from .test_packing import check, ids_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STOPS = sorted({w for ws in quality.STOP_WORDS.values() for w in ws.split()})


def sentence(rng, n):
    return " ".join(rng.choice(STOPS[:12]) if rng.random() < 0.3 else f"{rng.choice('bcdfgm')}{rng.choice('aeiou')}{rng.randrange(2000):x}" for _ in range(n))


def corpus(seed=5):
    rng = random.Random(seed)
    items = [(i, sentence(rng, 25) + ".\n" + sentence(rng, 6) + ".") for i in range(10)]
    texts, bad = list(ODD), set(range(len(ODD)))
    for _ in range(60):
        t = "\n".join(sentence(rng, rng.randint(20, 40)) for _ in range(rng.randint(3, 6)))
        kind = rng.randrange(6)
        if kind == 0:
            t += "\n" + rng.choice(items)[1]
        if kind == 1:
            bad.add(len(texts))
            t = re.sub(r"(\w+)", r"\1###", t)
        if kind == 2:
            t = sentence(rng, 4) + "\n" + t
            texts.append(t.replace("\n", " \n"))
        if kind == 3:
            texts.append(" ".join(t.split()) + " extra")
            t = t.replace("\n", " ")
        if kind == 4:
            t += "\n" + "one line that the documents share, of the corpus."
        texts.append(t)
    return items, texts, bad


def test_run_equals_brute_force(spark, tmp_path):
    items, texts, bad = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    ids = [i for i in range(len(texts)) if i not in bad]
    now = [texts[i] for i in ids]
    drops = brute_lines(now)
    now = ["\n".join(x for j, x in enumerate(t.split("\n")) if j not in {j for j, _ in drops.get(k, [])}) for k, t in enumerate(now)]
    left = [k for k, t in enumerate(now) if k not in drops or len(t.split()) >= 50]
    assert len(left) < len(now)  # what lost its lines and is short now has gone
    ids, now = [ids[k] for k in left], [now[k] for k in left]
    kept = [k for k, (_, _, _, keep) in enumerate(brute_near(now, 80)) if keep]
    flat = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    kept = [k for k in kept if not any(flat(t) in flat(now[k]) for _, t in items)]
    assert len(kept) < len(now) < len(texts)
    want = {ids[k]: v for k, v in zip(kept, ids_of([now[k] for k in kept]).values())}
    assert check(rows, want) < 0.5


def test_stages_take_nulls_repeated_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(8)
    long = [" ".join(f"{w} the" for w in sentence(rng, 60).split()) for _ in range(4)]
    rows = [(None, long[0], "q", "s"), (None, None, None, None), (1, long[1], "q", None), (1, long[1], "q", None), (1, long[2], "r", "s"), (2, long[1], None, "s"), (3, "", "q", "s"), (4, long[3] + " x" * 400_000, "long", "s")]
    names = "doc_id long, text string, quality string, line_dedup string, __doc string, shard string, `a.b` int"
    docs = spark.createDataFrame([(*r, "d", "h", 1) for r in rows], names)
    spark.createDataFrame([(1, "nothing of that. stands here", 0)], "item_id long, text string, doc_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {(r["__doc"], r["shard"], r["a.b"]) for r in out.collect()} == {("d", "h", 1)}, name
        assert any(r.doc_id is None for r in out.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(rows)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
    assert decontam.HITS


def test_near_copies_from_80_percent_on_are_dropped(spark):
    words = [f"w{k}" for k in range(60)]
    other = [*words[:30], "x", *words[31:]]  # 51 of 61 shingles are shared: 0.836
    far = [*words[:20], "y", *words[21:40], "z", *words[41:]]  # 46 of 66: 0.697
    texts = [*(" ".join(w) for w in (words, other, far)), *near_texts()]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.near_deduplication(spark, docs, "").collect()}
    assert kept == {i for i, _, _, keep in brute_near(texts, 80) if keep}
    assert {0, 2} <= kept and 1 not in kept
