"""Line deduplication by a segment-partition edit join (no Python on the data path).

Two lines are near equal if their edit distance is at most ``EDITS``. Each distinct line is split into
EDITS+1 segments: a line within the distance holds one of them unchanged, near its place. Lines put their
segments into an index by length and segment number; each line probes it with the substrings of its own that
the position bounds for each length difference allow, and pairs that meet are verified by a banded
bit-parallel automaton. Counts of ten letters, carried with the keys, drop hopeless pairs inside the join.

A line is dropped where an equal or near-equal line occurs earlier, by doc_id and then line number. Equal lines of
any length count, blank ones apart; near-equal ones where the longer has ``LEAST_CHARS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE_WORD, discard, free_name, let, maybe_among, own, saved, table
from .quality import words_of

EDITS = 2
#: Two lines that are both shorter are near equal only if they are equal.
LEAST_CHARS = 20
#: Letters counted for the filter, six bits each; an edit changes the counts by two together at most.
LETTERS = "etaonirshd"
SHORTER = 6 * len(LETTERS)
LONG = SHORTER + 1
_SPACES = "".join(chr(i) for i in range(128) if not SPACE_WORD[i])


def near_equal(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether the edit distance of two strings (arrays of characters) is at most ``edits``.

    One register of 2*edits+1 bits for each number of errors: bit d+edits of register e says that the first
    j characters of ``b`` and j+d of ``a`` are within e edits. Each character of ``b`` moves all bits at once.
    """
    band, full = range(-edits, edits + 1), (1 << (2 * edits + 1)) - 1
    names = [f"r{e}" for e in range(edits + 1)]
    start = F.struct(*[F.lit(sum(1 << (d + edits) for d in range(0, e + 1))).alias(n) for e, n in enumerate(names)])

    def step(s: Column, j: Column) -> Column:
        c = F.get(b, j - 1)
        equal = sum((F.when(F.get(a, j - 1 + d) == c, 1 << (d + edits)).otherwise(0) if d >= 0 else F.when((j + d > 0) & (F.get(a, F.greatest(j - 1 + d, F.lit(0))) == c), 1 << (d + edits)).otherwise(0)) for d in band)

        def moved(eq: Column) -> Column:
            def build(e: int, before: Column | None, done: list) -> Column:
                if e > edits:
                    return F.struct(*[x.alias(n) for x, n in zip(done, names)])
                now = s[names[e]].bitwiseAND(eq)
                if e:
                    less = s[names[e - 1]]
                    now = now.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(before, 1)).bitwiseAND(F.lit(full))
                return let(now, lambda r: build(e + 1, r, [*done, r]))

            return build(0, None, [])

        return let(equal, moved)

    end = F.aggregate(F.sequence(F.lit(1), F.size(b)), start, step, lambda s: F.getbit(s[names[-1]], F.size(a) - F.size(b) + edits) == 1)
    far = F.abs(F.size(a) - F.size(b)) > edits
    return F.when(far, F.lit(False)).when(F.size(b) == 0, F.lit(True)).otherwise(end)


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != F.lit(""))


def _specs(rows: list[tuple[int, int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in rows])).alias("spec")


def index_specs(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of a line's own segments."""
    return [(0, i, 0) for i in range(1, edits + 2)]


def probe_specs(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """The substrings that may equal a segment of a line as long or up to ``edits`` shorter, with the bounds from both ends."""
    return [
        (less, i, shift)
        for less in range(edits + 1)
        for i in range(1, edits + 2)
        for shift in range(max(-(i - 1), less - (edits + 1 - i)), min(i - 1, less + (edits + 1 - i)) + 1)
    ]


def segment_keys(lines: DataFrame, specs: list[tuple[int, int, int]], edits: int = EDITS) -> DataFrame:
    """(key, id, letters): hashes of (length, segment number, substring); bit SHORTER of letters tells probes of shorter lines. The last ``length % parts`` segments have one more character."""
    parts, i = edits + 1, F.col("spec.i")
    t = lines.select("id", "letters", "line", "n", _specs(specs))
    t = t.withColumn("other", F.col("n") - F.col("spec.less"))
    t = t.withColumns({"base": F.floor(F.col("other") / parts).cast("int"), "short": parts - F.col("other") % parts})
    t = t.withColumns({"at": F.col("base") * (i - 1) + F.greatest(i - 1 - F.col("short"), F.lit(0)) + 1 + F.col("spec.shift"), "size": F.col("base") + (i > F.col("short")).cast("int")})
    t = t.where((F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.col("n")))
    key = F.xxhash64("other", i, F.substring(F.col("line"), F.col("at"), F.col("size")))
    shorter = F.shiftleft((F.col("spec.less") > 0).cast("long"), SHORTER)
    return t.select(key.alias("key"), "id", F.col("letters").bitwiseOR(shorter).alias("letters"))


def letter_counts(line: Column) -> Column:
    out = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft((n % 64).cast("long"), 6 * i))
    return out


def letters_apart(a: Column, b: Column) -> Column:
    """A lower bound of twice the edit distance."""
    total = F.lit(0)
    for i in range(len(LETTERS)):
        d = F.abs(F.shiftright(a, 6 * i).bitwiseAND(F.lit(63)) - F.shiftright(b, 6 * i).bitwiseAND(F.lit(63)))
        total = total + F.least(d, 64 - d)
    return total


def row_key(docs: DataFrame) -> Column:
    """Tells apart rows with the same doc_id and other texts."""
    return F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")))


def _lines(docs: DataFrame, least_chars: int, edits: int) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("k"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    rows = rows.where("line <> ''").withColumn("line", F.btrim("line", F.lit(_SPACES)))
    rows = rows.withColumn("n", F.length("line")).where("n > 0")
    letters = letter_counts(F.col("line")).bitwiseOR(F.shiftleft((F.col("n") >= least_chars).cast("long"), LONG))
    letters = F.when(F.col("n") >= least_chars - edits, letters)
    return rows.withColumns({"id": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line"), "letters": letters})


def dropped_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, k, line_no, near): the lines to drop; ``near`` if no equal line is earlier, only a near-equal one.

    ``k`` tells apart rows with the same doc_id and other texts (``row_key``). Rows that repeat doc_id and text are the
    same document: their lines are no copies of one another. Null doc_ids come first.
    """
    lines = saved(_lines(docs, least_chars, edits), "lines", dictionary=False)
    at = F.struct("doc_id", "k", "line_no")
    same_line = ["id", "h2", "n"]
    copied = saved(lines.groupBy(*same_line).agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "line-copies")

    # one row a distinct line: those without a copy as they are, the rest grouped
    text = maybe_among(lines.select(*same_line, "line", "letters"), "id", copied, "id")
    grouped = text.where("among").groupBy(*same_line).agg(F.min("line").alias("line"), F.min("letters").alias("letters"))
    distinct = text.where("not among").drop("among").unionByName(grouped).where("letters is not null")

    index = segment_keys(distinct, index_specs(edits), edits).select("key", F.col("id").alias("a"), F.col("letters").alias("la"))
    probes = segment_keys(distinct, probe_specs(edits), edits).select("key", F.col("id").alias("b"), F.col("letters").alias("lb"))
    # lines of one length meet twice: once is enough
    alike = ((F.col("a") < F.col("b")) | (F.getbit("lb", F.lit(SHORTER)) == 1)) & (F.getbit(F.col("la").bitwiseOR(F.col("lb")), F.lit(LONG)) == 1)
    alike = alike & (letters_apart(F.col("la"), F.col("lb")) <= 2 * edits)
    pairs = index.join(probes, (index["key"] == probes["key"]) & alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = saved(pairs, "line-pairs")

    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    found = maybe_among(lines, "id", wanted, "id").where("among")
    found = found.groupBy(*same_line).agg(F.min(F.struct(at.alias("at"), F.col("line"))).alias("x")).select(*same_line, "x.at", "x.line")
    side = lambda s: found.select(*[F.col(c).alias(f"{c}_{s}") for c in (*same_line, "at", "line")])
    both = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    same = let(chars(F.col("line_a")), lambda x: let(chars(F.col("line_b")), lambda y: near_equal(x, y, edits)))
    later = F.col("at_a") > F.col("at_b")
    near = both.where(same).select(*[F.when(later, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(c) for c in (*same_line, "at")]).distinct()

    marked = near.withColumn("near", F.lit(True)).unionByName(copied.withColumn("near", F.lit(False)))
    marked = saved(marked.groupBy(*same_line, "at").agg(F.bool_or("near").alias("near")), "line-marks")
    discard(lines.sparkSession, copied, pairs)
    hits = maybe_among(lines.select("doc_id", "k", "line_no", *same_line), "id", marked, "id").where("among").join(marked, same_line)
    first = at == F.col("at")
    # a first place is dropped only for a near-equal line before it
    return hits.where(F.col("near") | ~first).select("doc_id", "k", "line_no", (F.col("near") & first).alias("near")).distinct()


def _joined(rows: DataFrame, key: str, docs: DataFrame, edits: int, least_chars: int, name: str) -> DataFrame:
    """``rows`` with ``name``, the drops of the row of ``docs`` whose ``row_key`` is the column ``key``: (dropped, n_near)."""
    drops = dropped_lines(docs, edits, least_chars).groupBy("doc_id", "k").agg(F.sort_array(F.collect_list("line_no")).alias("dropped"), F.count_if("near").alias("n_near"))
    own_key, found = free_name(rows, "__k"), F.struct("dropped", "n_near").alias(name)
    drops = drops.select(F.col("k").alias(own_key), found)  # k holds the doc_id too
    out = rows.join(drops, rows[key] == drops[own_key], "left")
    none = F.struct(F.array().cast("array<int>").alias("dropped"), F.lit(0).cast("long").alias("n_near"))
    return out.withColumn(name, F.coalesce(name, none)).drop(own_key)


def with_drops(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with a last column ``line_dedup``: a struct of the dropped lines' numbers and how many were near equal.

    A column of that name stays as it is: the struct's then has an underscore more. Null text has no lines and stays
    null; blank lines are never dropped; a row never goes. Each row with a null doc_id or one that other rows have gets
    its own lines' numbers. An empty table gives no rows.
    """
    key, name = free_name(docs, "__own"), free_name(docs, "line_dedup")
    return _joined(docs.select(*own(docs), row_key(docs).alias(key)), key, docs, edits, least_chars, name).drop(key)


def dedup(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, least_words: int = 0) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text``; other columns as they are (``n_chars`` follows, if there).

    A row that loses lines and has fewer than ``least_words`` words left goes; a row that loses none stays.
    """
    out = with_drops(docs, edits, least_chars)
    drops = f"{out.columns[-1]}.dropped"
    some = F.size(drops) > 0
    # dropped numbers and lines side by side: no look-up in a list for each line
    gone = F.map_from_arrays(F.col(drops), F.col(drops))
    left = F.array_join(let(gone, lambda g: F.filter(F.split("text", "\n", -1), lambda x, i: F.element_at(g, i).isNull())), "\n")
    out = out.withColumn("text", F.when(some, left).otherwise(F.col("text")))
    if least_words:
        out = out.where(F.when(some, F.size(words_of(F.col("text"))) >= least_words).otherwise(F.lit(True)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*own(docs))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_lines, n_dropped, n_near, dropped_lines (numbers from 0, comma-joined)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"), row_key(docs).alias("k"))
    out = _joined(rows, "k", docs, EDITS, LEAST_CHARS, "d")
    numbers = F.array_join(F.transform("d.dropped", lambda x: x.cast("string")), ",")
    return out.select("doc_id", "n_lines", F.size("d.dropped").cast("long").alias("n_dropped"), "d.n_near", numbers.alias("dropped_lines"))


OP5_SQL = f"""
with l as (select doc_id, unnest(range(0, len(x))) as line_no, unnest(x) as line from
  (select doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as x from documents)),
d as (select line, length(line) as n, min((doc_id, line_no)) as at from l where length(line) > 0 group by line),
near as (select distinct b.line from d a join d b on a.n between b.n - {EDITS} and b.n + {EDITS} and a.at < b.at where greatest(a.n, b.n) >= {LEAST_CHARS} and levenshtein(a.line, b.line) <= {EDITS}),
g as (select doc_id, line_no, (doc_id, line_no) = d.at as first, near.line is not null as near from l join d using (line) left join near using (line)),
s as (select doc_id, count(*) as n, count_if(near and first) as near, string_agg(cast(line_no as varchar), ',' order by line_no) as lines from g where near or not first group by doc_id)
select documents.doc_id, len(string_split(coalesce(text, ''), chr(10))) as n_lines, coalesce(s.n, 0) as n_dropped, cast(coalesce(s.near, 0) as bigint) as n_near, coalesce(s.lines, '') as dropped_lines
from documents left join s using (doc_id)
"""
