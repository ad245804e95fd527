"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import free_name, let, own, table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = {
    "en": "the of and to in is that for it with was on are be this by from or at an as not",
    "es": "de la que el en los del se las por un para con una su al lo es no",
    "fr": "de la le et les des en un du une que est pour qui dans sur pas au",
    "de": "der die und in den von zu das mit sich des auf ist im nicht ein eine auch",
}

#: (rule, metric, least, most); None leaves a side open. A text is kept if every metric lies in its range.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("length", "n_words", 50, None),
    ("repeated_words", "repeat_ratio", None, 0.5),
    ("word_length", "mean_word_chars", 2.0, 12.0),
    ("symbols", "symbol_ratio", None, 0.2),
    ("upper_case", "upper_ratio", None, 0.4),
    ("stop_words", "stop_ratio", 0.04, None),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_stop_words", "n_upper")


def words_of(text: Column) -> Column:
    """Runs of characters other than space, tab, newline, vertical tab, form feed and carriage return."""
    return F.filter(F.split(F.translate(text, SPACES[1:], " " * 5), " "), lambda x: x != F.lit(""))


def _gone(text: Column, chars: str) -> Column:
    """Code points of ``text`` without ``chars``."""
    return F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more.

    Windows are sorted by hash and place, neighbours of one hash compared word by word.
    """
    word = lambda i: F.get(words, i)
    windows = F.when(F.size(words) < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h"), i.alias("i")))
    )
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (word(x["i"]) == word(y["i"])) & (word(x["i"] + 1) == word(y["i"] + 1)) & (word(x["i"] + 2) == word(y["i"] + 2)), F.lit(False))

    def covered(s: Column) -> Column:
        again = lambda x, k: ((k > 0) & same(x, F.get(s, k - 1))) | same(x, F.get(s, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(F.filter(s, again), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return let(F.sort_array(windows), covered)


def metrics(text: Column, words: Column) -> dict[str, Column]:
    """Metric columns of a text and of its array of words; ``words`` must be a column or a bound variable."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: _gone(x, SPACES) > 0)
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    n_stop = F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(stops)))
    n, upper = F.size(words), F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))
    return {
        "n_words": n.cast("long"),
        "word_chars": _gone(text, SPACES).cast("long"),
        "n_symbols": (F.length(text) - _gone(text, SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_repeat_words": _repeat_words(words).cast("long"),
        "n_stop_words": n_stop.cast("long"),
        "n_upper": upper.cast("long"),
    }


def verdict(fields: dict[str, Column], rules=RULES) -> Column:
    """The rule table as one boolean expression over metric columns."""
    over = lambda a, b: fields[a] / F.greatest(fields[b], F.lit(1))
    ratios = {
        "n_words": fields["n_words"],
        "repeat_ratio": over("n_repeat_words", "n_words"),
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "upper_ratio": over("n_upper", "word_chars"),
        "stop_ratio": over("n_stop_words", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
    }
    tests = []
    for _, metric, least, most in rules:
        tests += [ratios[metric] >= F.lit(least)] if least is not None else []
        tests += [ratios[metric] <= F.lit(most)] if most is not None else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def score(docs: DataFrame, rules=RULES, name: str = "quality") -> DataFrame:
    """Every row of ``docs`` with its metrics in a last column ``quality``, a struct.

    A column of that name stays as it is: the struct's then has an underscore more. Null text counts as empty: no
    words, and so not kept. Nothing is joined, grouped or cut; a repeated row is scored again; an empty table gives none.
    """
    name = free_name(docs, name)
    text = F.coalesce(docs["text"], F.lit(""))
    found = let(text, lambda t: let(words_of(t), lambda w: F.struct(*[c.alias(k) for k, c in metrics(t, w).items()])))
    out = docs.select(*own(docs), found.alias(name))
    fields = {k: F.col(f"{name}.{k}") for k in (*METRICS, *MORE)}
    base = (fields["n_words"] < 50) | (100 * fields["n_repeat_words"] > 50 * fields["n_words"])
    return out.withColumn(name, F.struct(f"{name}.*", base.alias("base_failed"), (~base & verdict(fields, rules)).alias("kept")))


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    scored = score(docs, rules)
    return scored.where(F.col(f"{scored.columns[-1]}.kept")).select(*own(docs))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *[f"quality.{k}" for k in (*METRICS, "base_failed", "kept", *MORE)])


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda x: x <> '')"
_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
OP9_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
m as (
 select doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l,
  length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) as n_upper,
  len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) in ({_STOPS}))) as n_stop_words
 from d),
g as (select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select doc_id, count(distinct i + k) as n_repeat_words from
  (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) cross join (values (0), (1), (2)) v(k) where c > 1 group by doc_id),
f as (select m.doc_id, n_words, word_chars, n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words, n_stop_words, n_upper from m left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, n_upper,
 n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
 n_words >= 50 and 100 * n_repeat_words <= 50 * n_words and word_chars / greatest(n_words, 1) between 2.0e0 and 12.0e0
  and n_symbols / greatest(n_words, 1) <= 0.2e0 and n_upper / greatest(word_chars, 1) <= 0.4e0
  and n_stop_words / greatest(n_words, 1) >= 0.04e0 and n_dup_lines / greatest(n_lines, 1) <= 0.5e0 as kept
from f
"""
