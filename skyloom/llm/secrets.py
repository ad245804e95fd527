"""Secret scans in Spark SQL: base patterns plus a battery of randomness tests (no Python on the data path).

Base kinds: ``assign``, ``access`` and ``hex``; every leftmost non-overlapping match is found, then short
ones are dropped. The battery looks at all other tokens of 20 or more characters. Each token's encoding is
inferred from its characters (hex, base32, alphanumeric, base64), and three p-values are taken under "its
characters are independent and uniform over that alphabet": chi-squared uniformity, number of runs above and
below the alphabet's middle, and lag-1 serial correlation; a token that one of them rejects isn't random.

What is reported as kind ``random`` are discoveries against ordinary tokens. The null hypothesis is a text model:
characters drawn by letter frequencies, in one of three styles (lower case, upper case, digits). The token's
likelihood under a uniform alphabet over that under the model has mean 1 for ordinary tokens, so its inverse is a
p-value of any length's tokens that holds without approximation. Tokens that the battery rejects count with p = 1.
A Benjamini-Hochberg procedure over the whole table, apart in each length class, then bounds the share of ordinary
tokens among those reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import id_text, let, saved, table

#: Fixed values of the base contract: (kind, pattern, group, least characters of the group).
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
)
#: A cheap test that any text with a span of the kind passes; the costly expressions run on such texts only.
_HINTS = {"assign": r"[A-Za-z]{3}[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
#: Same leftmost matches once the short ones are dropped, but few of them: a run is taken whole in either form.
_FAST = {"assign": BASE[0][1], "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}
SPAN = "array<struct<start:int,kind:int,end:int>>"

#: Tokens of the battery.
_TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: encoding, pattern, alphabet in the order that gives a character its number.
_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", "[0-9a-f]+|[0-9A-F]+", _DIGIT + "abcdef"),
    ("base32", "[A-Z2-7]+=*", _UPPER + "234567"),
    ("alnum", "[A-Za-z0-9]+", _UPPER + _LOWER + _DIGIT),
    ("base64", "[A-Za-z0-9+/_-]+=*", _UPPER + _LOWER + _DIGIT + "+/"),
)
#: Length classes of the false-discovery control, by their least length.
CLASSES = (20, 24, 32, 48, 64)
#: Greatest share of ordinary tokens among the reported ones, and the battery's level.
LEVEL, BATTERY_LEVEL = 0.05, 0.01
#: p-values are counted in bins of a tenth of a decade, the last one for all below.
BINS_A_DECADE, LAST_BIN = 10, 1_000
#: Percentages of the letters a to z in English text.
LETTER_SHARES = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Styles of ordinary tokens: shares of upper-case letters, lower-case letters, digits and the two signs.
STYLES = ((0.04, 0.86, 0.06, 0.04), (0.86, 0.04, 0.06, 0.04), (0.04, 0.04, 0.88, 0.04))


def _matches(text: Column, pattern: str, group: int, least: int, kind: int, hint: str) -> Column:
    """Spans of a pattern's matches: places follow from the lengths of what lies between them."""

    def spans(gaps: Column, found: Column, values: Column) -> Column:
        step = lambda acc, i: let(
            acc["at"] + F.length(F.get(gaps, i)),
            lambda start: F.struct(
                (start + F.length(F.get(found, i))).alias("at"),
                F.when(
                    F.length(F.get(values, i)) >= least,
                    F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(F.get(found, i))).alias("end")))),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
        )
        last, size = F.size(found) - 1, 256  # appended in pieces: an array is copied whenever it grows

        def piece(at: Column, k: Column) -> Column:
            zero = F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))
            return F.aggregate(F.sequence(k * size, F.least(k * size + size - 1, last)), zero, step)

        more = lambda acc, k: let(piece(acc["at"], k), lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["out"])).alias("out")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor(last / size).cast("int")), zero, more, lambda acc: F.flatten(acc["out"]))

    none = F.array().cast(SPAN)
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else None

    def found(m: Column) -> Column:
        v = values if group else m
        body = let(v, lambda vv: let(F.split(text, pattern, -1), lambda g: spans(g, m, vv)))
        return F.when(F.size(m) == 0, none).otherwise(body)

    return F.when(text.rlike(hint), let(whole, found)).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed, in code points, ends exclusive."""
    return F.sort_array(F.concat(*[_matches(text, _FAST[kind], group, least, KINDS[kind], _HINTS[kind]) for kind, _, group, least in BASE]))


def _normal_tail(z: Column) -> Column:
    """Two-sided normal tail of |z|: the rational approximation of the error function to 1.5e-7."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(F.least(poly * F.exp(-x * x), F.lit(1.0)), F.lit(0.0))


def _upper_tail(z: Column) -> Column:
    return F.when(z > 0, _normal_tail(z) / 2).otherwise(1 - _normal_tail(z) / 2)


def _battery(body: Column, alphabet: str) -> Column:
    k = len(alphabet)
    mean, var = (k - 1) / 2, (k * k - 1) / 12
    chars = F.filter(F.split(F.lower(body) if k == 16 else F.translate(body, "_-", "/+"), ""), lambda c: c != F.lit(""))
    places = F.transform(chars, lambda c: (F.position(c, F.lit(alphabet)) - 1).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    def tests(v: Column) -> Column:
        n = F.size(v).cast("double")
        pairs = lambda f: total(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), f))
        squares = total(F.transform(F.array_distinct(v), lambda a: F.pow(F.size(F.filter(v, lambda b: b == a)).cast("double"), 2)))
        # the statistic's own variance under uniform characters, 2(k-1)(1-1/n), holds for few expected a cell too
        z_chi = (squares * k / n - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (1 - 1 / n))
        z_runs = (pairs(lambda a, b: ((a > mean) != (b > mean)).cast("double")) - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        z_lag = pairs(lambda a, b: (a - mean) * (b - mean)) / (var * F.sqrt(n - 1))
        return F.least(F.lit(1.0), 3 * F.least(_upper_tail(z_chi), _normal_tail(z_runs), _normal_tail(z_lag)))

    return let(places, tests)


def p_value(token: Column) -> Column:
    """Three times the least of the three p-values (Bonferroni) under uniform characters of the inferred encoding."""
    body = F.regexp_replace(token, "=+$", "")
    out = F.lit(0.0)
    for _, pattern, alphabet in reversed(ENCODINGS):
        out = F.when(token.rlike(f"^(?:{pattern})$"), _battery(body, alphabet)).otherwise(out)
    return out


def ordinary_p(token: Column) -> Column:
    """A p-value under the text model: likelihood by the styles, each as likely, over that of a uniform alphabet."""
    alphabet = dict((name, chars) for name, _, chars in ENCODINGS)["base64"]
    total = sum(LETTER_SHARES)
    letters = [math.log(x / total) for x in LETTER_SHARES]

    def logs(upper: float, lower: float, digit: float, sign: float) -> Column:
        values = [math.log(upper) + x for x in letters] + [math.log(lower) + x for x in letters] + [math.log(digit / 10)] * 10 + [math.log(sign / 2)] * 2
        return F.array(*[F.lit(x) for x in values])

    body = F.regexp_replace(token, "=+$", "")
    size = F.lit(float(len(alphabet)))
    for _, pattern, chars in reversed(ENCODINGS):
        size = F.when(body.rlike(f"^(?:{pattern})$"), F.lit(float(len(chars)))).otherwise(size)
    chars = F.filter(F.split(F.translate(body, "_-", "/+"), ""), lambda c: c != F.lit(""))
    places = F.transform(chars, lambda c: F.position(c, F.lit(alphabet)) - 1)

    def likelihood(p: Column, values: Column) -> Column:
        return F.aggregate(p, F.lit(0.0), lambda acc, i: acc + F.get(values, i))

    def ratio(p: Column) -> Column:
        sums = F.array(*[likelihood(p, logs(*s)) for s in STYLES])
        # the sum of the styles' likelihoods, by the greatest of them
        return let(sums, lambda s: F.array_max(s) + F.log(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max(s))) / len(STYLES)) + F.size(p) * F.log(size))

    return F.exp(F.least(let(places, ratio), F.lit(0.0)))


def _length_class(n: Column) -> Column:
    return sum(((n >= c).cast("int") for c in CLASSES[1:]), F.lit(0))


def scan(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``base`` and ``spans``, arrays of (start, kind, end).

    Offsets count code points, ends are exclusive, spans are sorted by start, then kind. Null text is empty and
    has no spans; repeated rows, null ids too, are scanned each; a text is never cut; other columns aren't read; an empty
    table gives no rows. Random spans that meet a base span are left out. The only statistics gathered are counts of
    p-values by length class and bin: a fixed number.
    """
    none = F.array().cast("array<struct<start:int,end:int,p:double>>")

    def tokens(t: Column) -> Column:
        spans = _matches(t, _TOKEN, 0, CLASSES[0], KINDS["random"], "[A-Za-z0-9+/_-]{20}")
        with_text = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substring(t, x["start"] + 1, x["end"] - x["start"]).alias("v")))
        # the battery where the text model leaves room for a discovery
        p = lambda v: let(ordinary_p(v), lambda q: F.when((q <= level) & (p_value(v) < BATTERY_LEVEL), 1.0).otherwise(q))
        return F.transform(with_text, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), p(x["v"]).alias("p")))

    text = id_text(docs)
    found = saved(
        text.select(
            "doc_id",
            base_spans(F.col("text")).alias("base"),
            F.when(F.col("text").rlike("[A-Za-z0-9+/_-]{20}"), let(F.col("text"), tokens)).otherwise(none).alias("tokens"),
        ),
        "secrets",
    )
    clear = F.filter("tokens", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    found = found.select("doc_id", "base", clear.alias("tokens"))

    bin_of = lambda p: F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_A_DECADE), F.lit(LAST_BIN))
    bins = found.select(F.explode("tokens").alias("x")).groupBy(_length_class(F.col("x.end") - F.col("x.start")).alias("c"), bin_of(F.col("x.p")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("c").orderBy(F.desc("bin"))
    passed = bins.select("c", "bin", F.sum("n").over(running).alias("upto"), F.sum("n").over(Window.partitionBy("c")).alias("all"))
    # all p-values of a bin count as its greatest
    passed = passed.where(F.col("all") * F.pow(F.lit(10.0), -F.col("bin") / BINS_A_DECADE) <= level * F.col("upto"))
    cut = passed.groupBy("c").agg(F.min("bin").alias("bin"))
    cut = cut.agg(F.map_from_entries(F.collect_list(F.struct("c", "bin"))).alias("cut"))  # one row, a number a class

    def added(x: Column) -> Column:
        return bin_of(x["p"]) >= F.coalesce(F.element_at("cut", _length_class(x["end"] - x["start"])), F.lit(LAST_BIN + 1))

    random = F.transform(F.filter("tokens", added), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS["random"]).alias("kind"), x["end"].alias("end")))
    return found.crossJoin(F.broadcast(cut)).select("doc_id", "base", F.sort_array(F.concat("base", random)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS[kind])).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
