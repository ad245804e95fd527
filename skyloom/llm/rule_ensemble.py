"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Shallow random trees are grown on labelled rows; each way from a root to a node is a conjunctive rule. A logistic
regression with lasso weights keeps few of them. What is left is compiled into one Spark column expression, so a
model scores any number of rows without further code. Labels, ids and other columns are no inputs of a score.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE_WORD, column_bytes, mix64, saved, slices, table, word_bounds, word_hashes

#: Classes of bytes that are counted; a multi-byte character counts by its first byte, under "wide".
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:",
    "shout": b"!?",
    "symbol": b"#$%&*|<>=@~^_+/\\{}[]`",
    "newline": b"\n",
    "blank": b" \t\x0b\x0c\r",
    "wide": bytes(range(0xC0, 0x100)),
    "rest": bytes(range(0x80, 0xC0)),  # following bytes of a character
}
#: Shares are of characters or of words, lines or windows of three words, 0 where there are none.
STATISTICS = (
    *(f"{c}_share" for c in CLASSES if c not in ("rest", "newline", "blank")),
    "space_share",
    "n_chars",
    "n_words",
    "mean_word_chars",
    "longest_word",
    "one_char_word_share",
    "plain_word_share",
    "distinct_word_share",
    "repeated_window_share",
    "mean_line_words",
    "repeated_line_share",
)
#: Trees, their depth, and the lasso's weight.
TREES, DEPTH, LASSO = 24, 3, 0.002
#: Rows whose checksum has this remainder by three are held out.
HELD_OUT, FOLDS = 1, 3

_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _i
_LETTER = np.zeros(256, bool)
_LETTER[[*CLASSES["lower"], *CLASSES["upper"], *range(0x80, 0x100)]] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _repeats(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each owner, how many of its hashes are unlike all before them."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return np.bincount(o[new], minlength=n)


def _share(a, b) -> np.ndarray:
    return np.asarray(a, float) / np.maximum(b, 1)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of texts given as UTF-8 bytes and offsets."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    text = np.repeat(np.arange(n), sizes)
    counts = np.bincount(text * (len(CLASSES) + 1) + _CLASS[data], minlength=n * (len(CLASSES) + 1)).reshape(n, -1)
    of = {c: counts[:, i] for i, c in enumerate(CLASSES)}
    chars = sizes - of["rest"]
    out = {f"{c}_share": _share(of[c], chars) for c in CLASSES if c not in ("rest", "newline", "blank")}
    out["space_share"] = _share(of["newline"] + of["blank"], chars)
    out["n_chars"] = chars.astype(float)

    starts, ends, first = word_bounds(data, offsets, SPACE_WORD)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    following = np.concatenate([[0], np.cumsum(_CLASS[data] == list(CLASSES).index("rest"))])
    lengths = (ends - starts) - (following[ends] - following[starts])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    # plain words are letters but for one closing mark
    plain = letters[ends] - letters[starts] >= np.maximum(ends - starts - 1, 1)
    closing = np.isin(data[np.maximum(ends - 1, 0)], list(b".,;:")) if len(ends) else np.zeros(0, bool)
    plain &= closing | (letters[ends] - letters[starts] == ends - starts)
    sums = lambda x: np.bincount(owner, x, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, lengths)
    out |= {
        "n_words": words.astype(float),
        "mean_word_chars": _share(sums(lengths), words),
        "longest_word": longest,
        "one_char_word_share": _share(sums(lengths == 1), words),
        "plain_word_share": _share(sums(plain), words),
    }
    hashes = word_hashes(data, starts, ends)
    out["distinct_word_share"] = _share(_repeats(owner, hashes, n), words)
    with np.errstate(over="ignore"):
        windows = mix64(hashes[:-2] + np.uint64(3) * mix64(hashes[1:-1] + np.uint64(5) * mix64(hashes[2:]))) if len(hashes) > 2 else hashes[:0]
    whole = owner[:-2] == owner[2:] if len(hashes) > 2 else np.zeros(0, bool)
    n_windows = np.bincount(owner[:-2][whole], minlength=n) if len(whole) else np.zeros(n, np.int64)
    out["repeated_window_share"] = _share(n_windows - _repeats(owner[:-2][whole], windows[whole], n) if len(whole) else n_windows, n_windows)

    starts, ends, first = word_bounds(data, offsets, _LINE)
    lines = np.diff(first)
    out["mean_line_words"] = _share(words, lines)
    out["repeated_line_share"] = _share(lines - _repeats(np.repeat(np.arange(n), lines), word_hashes(data, starts, ends), n), lines)
    return {s: out[s] for s in STATISTICS}


def with_statistics(docs: DataFrame, keep: list[str], name: str = "statistics") -> DataFrame:
    """The columns ``keep`` of ``docs`` and a struct of the statistics of ``text``; null text counts as empty, one of 0 throughout."""
    import pyarrow as pa

    # numbered columns on the way: a name may hold dots or backticks
    rows = docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in keep], docs["text"].alias("__text")).toDF(*[f"c{i}" for i in range(len(keep) + 1)])
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"found struct<{', '.join(f'{s}: double' for s in STATISTICS)}>"])

    def measured(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets):
                found = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                struct = pa.StructArray.from_arrays([pa.array(v) for v in found.values()], list(found))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[:-1]], struct], [*batch.schema.names[:-1], "found"])

    return rows.mapInArrow(measured, schema).toDF(*keep, name)


# ---------------------------------------------------------------- rules


class Rule(NamedTuple):
    """True where each named statistic is above ``low`` and at most ``high``."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, of) -> Column:
        tests = []
        for s, low, high in self.bounds:
            tests += [of(s) > F.lit(low)] if low > -math.inf else []
            tests += [of(s) <= F.lit(high)] if high < math.inf else []
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def __str__(self) -> str:
        text = {(False, True): "{0} <= {2:.4g}", (True, False): "{0} > {1:.4g}", (True, True): "{1:.4g} < {0} <= {2:.4g}"}
        return " and ".join(text[low > -math.inf, high < math.inf].format(s, low, high) for s, low, high in self.bounds)


class RuleModel(NamedTuple):
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, of) -> Column:
        """The probability of label 1; ``of`` gives the column of a statistic."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            total = total + F.when(rule.column(of), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def __str__(self) -> str:
        lines = sorted(zip(self.weights, map(str, self.rules)), key=lambda x: -abs(x[0]))
        return "\n".join([f"{self.intercept:+.3f}", *(f"{w:+.3f} if {r}" for w, r in lines)])


def tree_rules(root, names: tuple[str, ...]) -> set[Rule]:
    """A rule for each node below a tree's root (a JVM node); of two sides of the first split one is enough."""
    out = set()

    def walk(node, bounds: dict):
        if bounds:
            out.add(Rule(tuple((s, *bounds[s]) for s in names if s in bounds)))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        s, cut = names[split.featureIndex()], float(split.threshold())
        low, high = bounds.get(s, (-math.inf, math.inf))
        walk(node.leftChild(), bounds | {s: (low, min(high, cut))})
        if bounds or node.rightChild().subtreeDepth():
            walk(node.rightChild(), bounds | {s: (max(low, cut), high)})

    walk(root, {})
    return out


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> RuleModel:
    """The model of ``rows``: (statistics, label), label 1 or 0. Everything is fitted on Spark, on all rows.

    Without rows the score is 0.5, with one label only it is the rule of succession.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    of = lambda s: F.col(f"statistics.{s}")
    ones, total = rows.agg(F.sum("label"), F.count("label")).first()
    if not total or ones in (0, total):
        p = ((ones or 0) + 1) / (total + 2)
        return RuleModel((), (), math.log(p / (1 - p)))
    label = F.col("label").cast("double").alias("label")
    vectors = rows.select(array_to_vector(F.array(*[of(s) for s in STATISTICS])).alias("features"), label)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=10, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed).fit(vectors)
    rules = sorted(set().union(*[tree_rules(t._call_java("rootNode"), STATISTICS) for t in forest.trees]))
    if not rules:
        return RuleModel((), (), math.log(ones / (total - ones)))
    held = F.array(*[F.when(r.column(of), 1.0).otherwise(0.0) for r in rules])
    lassoed = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=100).fit(rows.select(array_to_vector(held).alias("features"), label))
    some = [(r, float(w)) for r, w in zip(rules, lassoed.coefficients) if w]
    return RuleModel(tuple(r for r, _ in some), tuple(w for _, w in some), float(lassoed.intercept))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(statistics, label) of rows that aren't held out and have a label; of several labels of an id the largest counts. Null ids have none."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    mine = stats.where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != HELD_OUT))
    return mine.join(known, "doc_id").select("statistics", "label")


def classify(docs: DataFrame, labels: DataFrame, **how) -> tuple[DataFrame, RuleModel]:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, and the model behind it.

    Statistics are taken once, of whole texts, and written. A null doc_id isn't held out and has no label; null and empty
    texts have statistics of 0 and a score as any other; repeated rows each have one; an empty table gives no row.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    stats = saved(with_statistics(ids, ["doc_id"]), "text-statistics")
    model = fit(saved(labelled(stats, labels), "labelled-statistics"), **how)
    out = stats.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), model.score(lambda s: F.col(f"statistics.{s}")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), model


def op11_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))[0]
