"""Filter interaction audit by Walsh-Hadamard sums (no Python on the data path).

Each text has a mask: one bit for every filter that it fails. Per part and label group the masks are summed with the 32
signs of their parities, the Walsh-Hadamard transform of their histogram; inverting it gives the exact count of each
mask. Every order of the filters is then evaluated on 32 counts, and the Shapley sum is in closed form: a text
that fails k filters is removed by each of them in 120/k of the 120 orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import let, table

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
CELLS = 1 << len(FILTERS)
#: Label groups: all texts, those of good quality, toxic ones.
GROUPS = ("every", "good", "toxic")


def text_mask(text: Column) -> Column:
    """Bits of the failed filters A to D, which look at the text alone: few words, few distinct words, capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")

    def bits(w: Column) -> Column:
        failed = [
            F.size(w) < 100,
            100 * F.size(F.array_distinct(w)) < 80 * F.size(w),
            100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
            text.rlike(r"[#$%&*|]"),
        ]
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))

    return let(words, bits)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``; null ids have no label. Several labels of an id count as one: any 1 stands."""
    one = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, True)), F.lit(False)).alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("good"), F.col("toxic")).where("doc_id is not null")
    known = known.groupBy("doc_id").agg(one("good"), one("toxic"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    found = rows.where("doc_id is not null").join(known, "doc_id", "left").select(*rows.columns, flag("good"), flag("toxic"))
    return found.unionByName(rows.where("doc_id is null").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n): how many rows of ``docs`` fail which filters; a mask may have several rows.

    A text fails E if a row with a smaller doc_id has the same text, anywhere in ``docs``. Rows of one doc_id aren't
    smaller than each other; a null doc_id neither is nor has a smaller one. Texts are told apart by SHA-256; copies are
    counted in each task before they meet, so a text that a third of all rows have is no heavier than another.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"], F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text_mask(text).alias("mask"))
    rows = rows.groupBy("doc_id", "same", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = _labelled(rows, labels)

    own_id = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    rows = rows.groupBy("same", "part", "good", "toxic", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), F.min(own_id).alias("first"))
    # a group's rows of its least id are first ones only if no other part or label group has a lesser
    least = F.min("first.doc_id").over(Window.partitionBy("same"))
    firsts = F.col("no_id") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    rows = rows.withColumn("firsts", firsts)
    side = lambda mask, n: F.struct(mask.alias("mask"), n.alias("n"))
    both = F.array(side(F.col("mask"), F.col("firsts")), side(F.col("mask") + COPY, F.col("n") - F.col("firsts")))
    return rows.select("part", "good", "toxic", F.inline(both))


def parity(a: Column, b) -> Column:
    """1 or -1: the sign of Walsh function ``b`` at ``a``."""
    return 1 - 2 * (F.bit_count(a.bitwiseAND(F.lit(b))) % 2)


def parity_sums(counts: DataFrame) -> DataFrame:
    """(part, group, sums): the 32 signed sums of each part and label group; a group without rows has zeros."""
    sums = lambda held: F.array(*[F.coalesce(F.sum(F.when(held, F.col("n") * parity(F.col("mask"), t))), F.lit(0)) for t in range(CELLS)])
    held = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    wide = counts.groupBy("part").agg(*[sums(held[g]).alias(g) for g in GROUPS])
    return wide.select("part", F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.col(g).alias("sums")) for g in GROUPS])).alias("x")).select("part", "x.*")


def cells(sums: Column) -> Column:
    """Counts by mask from their 32 signed sums: the transform again, over its size, both exact in integers."""

    def paired(s: Column, bit: int) -> Column:
        return F.transform(s, lambda x, i: F.when(i.bitwiseAND(F.lit(bit)) == 0, x + F.get(s, i + bit)).otherwise(F.get(s, i - bit) - x))

    for i in range(len(FILTERS)):
        sums = let(sums, lambda s: paired(s, 1 << i))
    return F.transform(sums, lambda x: F.floor(x / CELLS).cast("long"))


def _steps() -> Column:
    """All orders and steps: (filter_order, step, own bit, bits before)."""
    bit = {c: 1 << i for i, c in enumerate(FILTERS)}
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    number = lambda s: sum((F.when(s.contains(c), b).otherwise(0) for c, b in bit.items()), F.lit(0))
    of = lambda o: [F.struct(o.alias("filter_order"), F.lit(k + 1).alias("step"), number(F.substring(o, k + 1, 1)).alias("own"), number(F.substring(o, 1, k)).alias("before")) for k in range(len(FILTERS))]
    return F.flatten(F.transform(orders, lambda o: F.array(*of(o))))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a part of ``docs`` (its lang; null: empty), order and step of the five filters, zeros included.

    Null text counts as empty, repeated rows count again, other columns are no matter; an empty table has no part and
    gives no row. Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    found = parity_sums(mask_counts(docs, labels)).withColumn("cells", cells(F.col("sums")))
    found = found.groupBy("part").agg(*[F.max(F.when(F.col("group") == g, F.col("cells"))).alias(g) for g in GROUPS])
    steps = found.select("*", F.inline(_steps()))
    masks = F.sequence(F.lit(0), F.lit(CELLS - 1))

    def total(group: str, holds, weigh=lambda n, m: n) -> Column:
        term = lambda m: F.when(holds(m), weigh(F.get(F.col(group), m), m)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(masks, F.lit(0).cast("long"), lambda s, m: s + term(m))

    own = lambda m: m.bitwiseAND(F.col("own")) != 0
    before = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: own(m) & ~before(m)
    share = lambda n, m: n * F.floor(factorial(len(FILTERS)) / F.bit_count(m)).cast("long")
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("every", lambda m: ~own(m) & ~before(m)).alias("kept"),
        total("every", here).alias("removed"),
        total("every", lambda m: own(m) & before(m)).alias("redundant"),
        F.get("every", F.col("own")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("every", own, share).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda x: x <> '') as w from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  (case when len(w) < 100 then 'A' else '' end) || (case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end)
  || (case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) then 'C' else '' end)
  || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end) || (case when d.doc_id > min(d.doc_id) over (partition by t) then 'E' else '' end) as fails
 from d left join l using (doc_id)),
c as (select unnest(string_split('ABCDE', '')) as c),
o as (select a.c || b.c || x.c || y.c || z.c as filter_order from c a, c b, c x, c y, c z where len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
s as (select filter_order, unnest(range(1, 6)) as step from o),
g as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
r as (select part, fails, n, good, toxic, filter_order, step, contains(fails, substr(filter_order, step, 1)) as own,
  list_has_any(string_split(fails, ''), string_split(substr(filter_order, 1, step - 1), '')) and step > 1 and fails <> '' as before from g cross join s),
q as (select part, substr(filter_order, step, 1) as letter, sum(n) as shapley from r where own and not before group by all)
select r.part as part, filter_order, cast(step as int) as step, cast(sum(case when not own and not before then n else 0 end) as bigint) as kept,
 cast(sum(case when own and not before then n else 0 end) as bigint) as removed, cast(sum(case when own and before then n else 0 end) as bigint) as redundant,
 cast(sum(case when fails = substr(filter_order, step, 1) then n else 0 end) as bigint) as unique_fails,
 cast(sum(case when own and not before then good else 0 end) as bigint) as good_lost, cast(sum(case when own and not before then toxic else 0 end) as bigint) as toxic_lost,
 cast(coalesce(any_value(q.shapley), 0) as bigint) as shapley
from r left join q on q.part = r.part and q.letter = substr(filter_order, step, 1) group by r.part, filter_order, step
"""
