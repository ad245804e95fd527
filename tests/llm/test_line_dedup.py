import random

from pyspark.sql import functions as F

from skyloom.llm import line_dedup

from .data import ODD, frame, put


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edit(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abé漢x") + s[i:], s[:i] + rng.choice("abcé") + s[i + 1 :]])
    return s


def lines(seed=1, n=60):
    rng, out = random.Random(seed), []
    for _ in range(n):
        base = "".join(rng.choice("abcdeé 漢") for _ in range(rng.choice([0, 1, 2, 5, 18, 20, 21, 23, 40, 90])))
        out += [base, *(edit(rng, base, rng.choice([0, 1, 2, 3, 4])) for _ in range(rng.randint(0, 4)))]
    return out


def test_automaton_equals_edit_distance(spark):
    some = lines()
    rng = random.Random(4)
    pairs = [(a, edit(rng, a, rng.choice([0, 1, 2, 3]))) for a in some] + [(rng.choice(some), rng.choice(some)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        got = df.select("a", "b", line_dedup.near_equal(line_dedup.chars(F.col("a")), line_dedup.chars(F.col("b")), edits).alias("near")).collect()
        assert [r.near for r in got] == [distance(r.a, r.b) <= edits for r in got]


def brute(texts, edits=2, least=20):
    seen, dropped = [], {}
    for i, t in enumerate(texts):
        for j, x in enumerate((t or "").split("\n")):
            x = x.strip(" \t\n\x0b\x0c\r")
            if not x:
                continue
            equal, near = any(x == y for y in seen), any(max(len(x), len(y)) >= least and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits for y in seen)
            if equal or near:
                dropped.setdefault(i, []).append((j, near and not equal))
            seen.append(x)
    return dropped


def documents(seed=2):
    rng, some = random.Random(seed), lines(seed)
    rng.shuffle(some)
    out = ["\n".join(rng.choice(["", " ", "\t"]) + x for x in some[k : k + 5]) for k in range(0, len(some), 5)]
    return out + ["\n".join(rng.choice(some) for _ in range(4)) for _ in range(10)] + ODD


def test_drops_equal_brute_force(spark, tmp_path):
    texts = documents()
    want = brute(texts)
    got = {r.doc_id: r for r in line_dedup.op5_line_dedup(spark, put(spark, tmp_path, texts)).collect()}
    assert len(got) == len(texts)
    assert sum(near for x in want.values() for _, near in x) > 20
    for i, t in enumerate(texts):
        w = want.get(i, [])
        assert (got[i].n_lines, got[i].dropped_lines) == ((t or "").count("\n") + 1, ",".join(str(j) for j, _ in w)), t
        assert got[i].n_near == sum(near for _, near in w)


def test_texts_lose_those_lines_only(spark):
    texts = documents(3)
    want = brute(texts)
    docs = frame(spark, texts)
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        gone = {j for j, _ in want.get(r.doc_id, [])}
        t = texts[r.doc_id]
        assert r.text == (t if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone))


def test_rows_of_one_id_and_of_none_get_their_own_lines(spark, tmp_path):
    line, short = "a line that is long enough to count", "short"
    rows = [(None, f"{line}\n{short}\n{line}"), (None, short), (1, line), (1, f"x\n{line}"), (2, None), (2, short)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_lines, r.dropped_lines) for r in line_dedup.op5_line_dedup(spark, str(tmp_path)).collect())
    # which of the rows without an id comes first is by their hashes
    assert [g for g in got if g[0] != "None"] == [("1", 1, "0"), ("1", 2, "1"), ("2", 1, ""), ("2", 1, "0")]
    assert [g for g in got if g[0] == "None"] in ([("None", 1, ""), ("None", 3, "1,2")], [("None", 1, "0"), ("None", 3, "2")])


def test_other_columns_stay_and_emptied_rows_may_go(spark):
    line = "a line that is long enough to count"
    rows = [(1, line, "mine", 7), (2, line, "yours", 8), (3, line + "\n" + "more words " * 5, "his", 9), (4, "few words", "hers", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line_dedup string, `k.x` int")
    out = line_dedup.with_drops(docs)
    assert out.columns == [*docs.columns, "line_dedup_"] and sorted(r.line_dedup for r in out.collect()) == ["hers", "his", "mine", "yours"]
    out = line_dedup.dedup(docs, least_words=5)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, line, "mine", 7), (3, "more words " * 5, "his", 9), (4, "few words", "hers", 1)]


def test_repeated_rows_and_empty_tables(spark):
    line = "a line that is long enough to count"
    rows = [(None, line), (1, line + "\n" + line + "!"), (1, line + "\n" + line + "!"), (1, "other words that are long enough\n" + line)]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, line), (1, ""), (1, ""), (1, "other words that are long enough")], key=str)
    assert line_dedup.dedup(frame(spark, [])).count() == 0
