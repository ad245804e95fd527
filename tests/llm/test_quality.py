import random
import re
from collections import Counter

from skyloom.llm import quality, sharding

from .data import ODD, frame, put

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(zip(w, w[1:], w[2:]))
    again = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_base_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    parts = ["a", "bb", "the", "é", "漢", "#", "*$", " ", "  ", "\n", "\t", "\x0b", "\xa0", "x | y", "🎉"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 120))) for _ in range(200)] + ODD
    got = {r.doc_id: r for r in quality.op9_quality_rules(spark, put(spark, tmp_path, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)
        assert not (r.base_failed and r.kept)


def test_verdict_and_one_projection(spark):
    good = "The story of the town is told by the people that live in it and " * 2 + " ".join(f"place{i} and name{i} of it" for i in range(20))
    texts = [good, good.upper(), " ".join(w + "%%%" for w in good.split()), " ".join(f"xqz{i} yyq{i}" for i in range(60))]
    out = quality.score(frame(spark, texts))
    assert [r.quality_.kept for r in out.orderBy("doc_id").collect()] == [True, False, False, False]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert quality.score(frame(spark, [])).count() == 0


def test_sharding(spark, tmp_path):
    shards = [f"s{i}" for i in range(11)]
    table = sharding.lookup_table(shards, 1009)
    share = Counter(table)
    assert set(share) == set(range(11)) and max(share.values()) - min(share.values()) <= 1
    less = sharding.lookup_table(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, less) if a != 10)
    assert moved < 0.1 * 1009  # besides the lost shard's slots few change hands
    docs = frame(spark, ODD + ["x"] * 30)
    out = sharding.place(docs, "doc_id", shards, 1009).collect()
    assert len(out) == docs.count() and all(r.placement_.shard == shards[table[r.placement_.slot]] for r in out)
    assert {r.placement.shard for r in sharding.place(docs.selectExpr("cast(null as long) as doc_id", "text", "slot")).collect()} != {None}
    assert sharding.place(frame(spark, [])).count() == 0
    sharding.write_shards(docs, f"{tmp_path}/out", shards=shards, size=1009)
    assert spark.read.parquet(f"{tmp_path}/out").count() == docs.count()


def test_clashing_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "mine", "p", "q"), (None, None, None, None, None)], "doc_id long, text string, shard string, placement string, quality string")
    placed = sharding.place(rows)
    assert placed.columns == [*rows.columns, "placement_"] and {r.placement for r in placed.collect()} == {"p", None}
    sharding.write_shards(rows, f"{tmp_path}/out", files_per_shard=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {r["shard"] for r in back.collect()} == {"mine", None} and set(back.columns) == {*rows.columns, "shard_"}
    scored = quality.score(rows)
    assert scored.columns == [*rows.columns, "quality_"] and {r.quality for r in scored.collect()} == {"q", None}
    assert quality.keep(rows).columns == rows.columns


def test_sql_has_the_same_words(spark, tmp_path):
    """Every space of the contract between words, against DuckDB."""
    import duckdb

    texts = ["a" + c + "b" + c * 2 + "c\nd" + c + "e" for c in " \t\x0b\x0c\r\n\xa0\x1c"] * 2 + ODD
    folder = put(spark, tmp_path, texts)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.execute(quality.OP9_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = quality.op9_quality_rules(spark, folder).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.columns.tolist() == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_upper"]
    assert (got == want[got.columns]).all().all()
