"""Spelling variants: words one edit apart, found with minimal automata read forwards and backwards.

A word is cut in two halves. A word that differs from it in one code point has the first half or the second unchanged,
so it is found by matching that half exactly and completing the word with one error: with an automaton of the words
where the first half is exact, with one of the reversed words where the second is. Both are minimal, acyclic and
number their words by counts on the edges (a perfect hash); each pair is found at one position of its error only.

Words that share a half and a length meet in one group; groups are dealt to buckets of bounded size. A group of more than
``GROUP_WORDS`` is split: its open half is cut again, and one of the two parts is exact as well.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, id_text, maybe_among, saved, table

LEAST_CHARS, LEAST_COUNT = 7, 2
#: How many times as frequent a word's form is at least.
MUCH_MORE = 10
#: One run in so many loses a code point.
SPOIL = 31
#: Words that share their exact part, beyond which its group is split; and rows a bucket holds on average.
GROUP_WORDS, BUCKET_ROWS = 1 << 15, 1 << 15
#: Distinct words that a task counts before it passes them on, and queries that are searched at a time.
COUNTED, SEARCHED = 1 << 18, 1 << 12
#: Letters are numbered a-z, then U+00C0-U+00FF, from 1: the order of code points. 0 fills up.
LETTERS = 1 + 26 + 64

_RUN = re.compile(rf"[a-zÀ-ÿ]{{{LEAST_CHARS},}}")
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def runs_of(doc_id: int | None, text: str) -> Counter:
    """Counts of a text's lower-cased runs of seven letters or more, one in ``SPOIL`` of them with a code point gone."""
    found = Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % SPOIL == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_CHARS:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with two occurrences or more. Tasks add up their own words first."""
    import pyarrow as pa

    def counts(batches):
        held = Counter()

        def rows():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.update(runs_of(doc_id, text.as_py()))
                if len(held) >= COUNTED:
                    yield rows()
                    held.clear()
        yield rows()

    out = id_text(docs).mapInArrow(counts, "word string, n long")
    return out.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- groups of words that share their exact part


def _key() -> Column:
    """Of the length class ``l``, the gap [a, b) and all that lies outside it; words of the class have l letters or one more."""
    return F.xxhash64("l", "a", "b", F.expr("substring(word, 1, a)"), F.expr("substring(word, length(word) - (l - b) + 1, l - b)"))


def grouped(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n, l, a, b, key): each word with the gaps where it and another word of its key may differ.

    A word of length L is in the classes L and L - 1, where it is the longer one, with an open second and an open first
    half. While a key has more than ``group_words`` words its gap is halved; a gap of one letter stays, as there are only
    so many letters.
    """
    size = F.length("word")
    rows = words.select("word", "n", F.inline(F.array(*[F.struct((size - less).alias("l")) for less in (0, 1)])))
    gaps = lambda *ab: F.inline(F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in ab]))
    half = F.floor(F.col("l") / 2).cast("int")
    rows = rows.select("word", "n", "l", gaps((half, F.col("l")), (F.lit(0), half))).withColumn("key", _key())
    done, tables = None, []
    while True:
        large = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > group_words)), "large-groups")
        tables.append(large)
        if large.isEmpty():
            break
        told = maybe_among(rows, "key", large, "key")
        told = told.withColumn("among", F.col("among") & (F.col("b") - F.col("a") > 1))
        small = told.where("not among").drop("among")
        done = small if done is None else done.unionByName(small)
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        rows = saved(told.where("among").select("word", "n", "l", gaps((F.col("a"), middle), (middle, F.col("b")))).withColumn("key", _key()), "split-groups")
        tables.append(rows)
    out = rows if done is None else done.unionByName(rows)
    out.tables = tables
    return out


# ---------------------------------------------------------------- automata (NumPy, one class of a bucket at a time)


def letters(column, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of an Arrow column of words, a row of ``length`` each, and the words' lengths."""
    from ._common import column_bytes

    data, offsets = column_bytes(column)
    lead = data == 0xC3
    before = np.concatenate([[0], np.cumsum(lead)])
    starts = offsets - before[offsets]
    data = data[~lead].astype(np.int16)
    data = np.where(data < 0x80, data - 96, data - 0x80 + 27).astype(np.uint8)
    sizes = np.diff(starts)
    out = np.zeros((len(sizes), length), np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(data)) - starts[row]] = data
    return out, sizes


class Automaton:
    """The minimal acyclic automaton of distinct words, given as sorted rows of letter numbers filled up with 0.

    All words have one length with the zeros, so states of different depths differ and each depth is minimised from
    the last up. ``edges[d]`` holds, by state and letter, (first edge of each state, letters, next states, numbers):
    the numbers of the edges on a word's way add up to its place among the rows.
    """

    def __init__(self, rows: np.ndarray):
        n, length = rows.shape
        apart = np.ones((n, length), bool)
        apart[1:] = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
        self.edges = [None] * length
        # after the last letter each row is a node, as rows are distinct, and all are one state
        below, state, counts = np.arange(n), np.zeros(n, np.int64), np.ones(1, np.int64)
        for d in range(length - 1, -1, -1):
            first = np.flatnonzero(apart[:, d])  # an edge a node below: its first row
            letter, to = rows[first, d].astype(np.int64), state[below[first]]
            node = np.cumsum(apart[:, d - 1]) - 1 if d else np.zeros(n, np.int64)
            of = node[first]
            start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
            state, keep = _same_edges(start, letter, to)
            size = np.diff(np.append(start, len(letter)))
            kept_edges = _ranges(start[keep], size[keep])
            letter, to = letter[kept_edges], to[kept_edges]
            begin = np.concatenate([[0], np.cumsum(size[keep])])
            held = counts[to]
            total = np.concatenate([[0], np.cumsum(held)])
            number = total[:-1] - np.repeat(total[begin[:-1]], np.diff(begin))
            counts = total[begin[1:]] - total[begin[:-1]]
            self.edges[d] = (begin, letter, to, number)
            below = node

    def step(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Next state (-1: none) and number by state * LETTERS + letter."""
        begin, letter, to, number = self.edges[d]
        at = np.repeat(np.arange(len(begin) - 1), np.diff(begin)) * LETTERS + letter
        go, add = np.full((len(begin) - 1) * LETTERS, -1, np.int64), np.zeros((len(begin) - 1) * LETTERS, np.int64)
        go[at], add[at] = to, number
        return go, add


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, starts[1] .. and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _same_edges(start: np.ndarray, letter: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state of each node, nodes with the same edges being one, and for each state a node that has it.

    Nodes are refined edge by edge: (state so far, k-th edge) pairs are numbered anew until the longest list is read.
    """
    size = np.diff(np.append(start, len(letter)))
    edge = letter * (int(to.max(initial=0)) + 1) + to
    _, state = np.unique(size, return_inverse=True)
    alive, k = np.arange(len(start)), 0
    while len(alive):
        code = state[alive] * (int(edge.max(initial=0)) + 1) + edge[start[alive] + k]
        _, new = np.unique(code, return_inverse=True)
        state[alive] = new + int(state.max(initial=0)) + 1
        k += 1
        alive = alive[size[alive] > k]
    _, keep, state = np.unique(state, return_index=True, return_inverse=True)
    return state, keep


def one_error(automaton: Automaton, words: np.ndarray, sizes: np.ndarray, exact: np.ndarray, end: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, number of a word of the automaton) one replaced or one added letter apart.

    The first ``exact`` letters match; the error lies before letter ``end`` (forwards: an added letter stands before one of
    the letters from ``exact`` to ``end`` - 1, or at the very end if ``end`` is the size; backwards: after one of the
    letters ``exact`` to ``end`` - 1). An added letter that repeats the one it stands before (in reading order of the
    word) is counted at the end of that run alone, so no pair comes twice.
    """
    q = np.arange(len(words))
    none = np.zeros(0, np.int64)
    way, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    swapped = added = (none, none, none)
    for d in range(words.shape[1]):
        begin, letter, to, number = automaton.edges[d]
        go, add = automaton.step(d)

        def follow(found, wanted):
            who, at, sum_ = found
            place = at * LETTERS + wanted
            on = go[place] >= 0
            return who[on], go[place[on]], sum_[on] + add[place[on]]

        own = words[:, d]
        swapped = follow(swapped, own[swapped[0]])
        added = follow(added, words[added[0], d - 1])
        # errors at this letter: all edges of the states on the way
        open_ = np.flatnonzero((exact <= d) & (d <= np.minimum(end, sizes)) & (way >= 0))
        if len(open_):
            s = way[open_]
            size = begin[s + 1] - begin[s]
            edges = _ranges(begin[s], size)
            who = np.repeat(open_, size)
            other = letter[edges] != own[who]
            swap = other & (d < end[who]) & (letter[edges] > 0)
            if back:
                more = (d > exact[who]) & (letter[edges] != words[who, d - 1])
            else:
                more = other & ((d < end[who]) | (end[who] == sizes[who]))
            more &= letter[edges] > 0
            new = lambda m: (who[m], to[edges[m]], total[who[m]] + number[edges[m]])
            swapped = tuple(np.concatenate(x) for x in zip(swapped, new(swap)))
            added = tuple(np.concatenate(x) for x in zip(added, new(more)))
        place = np.where(way >= 0, way, 0) * LETTERS + own
        total, way = total + add[place], np.where(way >= 0, go[place], -1)
    return np.concatenate([swapped[0], added[0]]), np.concatenate([swapped[2], added[2]])


def _search(words: np.ndarray, sizes: np.ndarray, n: np.ndarray, exact: np.ndarray, end: np.ndarray, asks: np.ndarray, back: bool):
    """(row, near rows, its near row of largest n) over rows of one class and direction; -1: none.

    Only words of the class's own length ask; a pair with a longer word counts for both.
    """
    at = words
    if back:
        turned = np.arange(words.shape[1])[None, :]
        place = sizes[:, None] - 1 - turned
        at = np.where(place >= 0, np.take_along_axis(words, np.maximum(place, 0), 1), 0).astype(np.uint8)
    order = np.lexsort(at.T[::-1])
    kept = order[np.concatenate([[True], (at[order][1:] != at[order][:-1]).any(1)])] if len(order) else order
    automaton = Automaton(at[kept])
    near, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
    # a word may have rows of several gaps: one of them is found for all
    for i in range(0, len(asks), SEARCHED):
        some = asks[i : i + SEARCHED]
        a, b = one_error(automaton, at[some], sizes[some], exact[some], end[some], back)
        a, b = some[a], kept[b]
        longer = sizes[b] > sizes[a]
        a, b = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
        near += np.bincount(a, minlength=len(words))
        a, b = np.concatenate([a, np.flatnonzero(best >= 0)]), np.concatenate([b, best[best >= 0]])
        rank = np.lexsort((*words[b].T[::-1], -n[b], a))
        lead = rank[np.concatenate([[True], a[rank][1:] != a[rank][:-1]])] if len(rank) else rank
        best[a[lead]] = b[lead]
    return near, best


def near_words(rows: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): every word with how many words are near it and the most frequent of them.

    Buckets of groups are searched side by side; a bucket's counts of a word are added up at the end, pairs are never rows.
    """
    import pyarrow as pa

    total = rows.count()
    buckets = F.pmod(F.col("key"), F.lit(-(-total // BUCKET_ROWS) or 1).cast("long"))

    def search(t: pa.Table) -> pa.Table:
        out = []
        classes = t.column("l").to_numpy()
        for l in np.unique(classes):  # noqa: E741
            part = t.filter(pa.array(classes == l))
            column = part.column("word").combine_chunks()
            words, sizes = letters(column, int(l) + 1)
            n, a, b = (part.column(c).to_numpy().astype(np.int64) for c in ("n", "a", "b"))
            near, best = np.zeros(len(n), np.int64), np.full(len(n), -1)
            for back in (False, True):
                mine = np.flatnonzero((a == 0) == back)
                asks = np.flatnonzero(sizes[mine] == l)
                exact, end = (l - b, l - a) if back else (a, b)
                found, top = _search(words[mine], sizes[mine], n[mine], exact[mine], end[mine], asks, back)
                near[mine] = found
                best[mine[top >= 0]] = mine[top[top >= 0]]
            # each word once without a find: in its own class, with the second half open
            own = (near > 0) | ((sizes == l) & (b == l))
            at = pa.array(np.flatnonzero(own))
            form = pa.array(best[own], mask=best[own] < 0)
            out.append(pa.table({"word": column.take(at), "n": pa.array(n[own]), "n_near": pa.array(near[own]), "form": column.take(form), "form_n": pa.array(n).take(form)}))
        return pa.concat_tables(out)

    found = rows.select("word", "n", "l", "a", "b", buckets.alias("bucket")).groupBy("bucket").applyInArrow(search, "word string, n long, n_near long, form string, form_n long")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form"))))
    found = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form, n): forms followed to the last.

    Each form is ``MUCH_MORE`` times as frequent, so ways are short; each round of the join doubles what is followed.
    """
    most = links.agg(F.max("form_n")).first()[0] or 0
    longest, n = 0, LEAST_COUNT
    while n <= most:
        longest, n = longest + 1, n * MUCH_MORE
    now = saved(links.select("word", F.col("form").alias("root")), "roots")
    reached = 1
    while reached < longest:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = saved(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        discard(now.sparkSession, now)
        now, reached = then, reached * 2
    return now


def variants(docs: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of seven letters or more that occurs twice or more.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if it is ten times as frequent or
    more, ``root`` the last of the forms that follow one another. Null texts have no word; a null doc_id counts as empty in
    the checksum that picks the runs to spoil; repeated rows count again; other columns are no matter; an empty table
    gives no row. The work on a word grows with its length, by about 0.2 ms a letter and direction in a bucket that holds it: a run
    of 20,000 letters takes some seconds, one of 100,000 a minute or more.
    """
    words = saved(word_counts(docs), "words")
    rows = grouped(words, group_words)
    near = saved(near_words(rows), "near-words")
    spark = near.sparkSession
    discard(spark, words, *rows.tables)
    form = F.when(F.col("form_n") >= MUCH_MORE * F.col("n"), F.col("form"))
    near = near.withColumns({"form": form, "form_n": F.when(form.isNotNull(), F.col("form_n"))})
    last = roots(near.where("form is not null"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


_MAPPED = "".join(chr(c) for c in range(0xC0, 0x100))
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F) if not 97 <= c < 123)[: len(_MAPPED)].replace("'", "''")
OP12_SQL = rf"""
with recursive t as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as crc),
d as (select coalesce(cast(doc_id as varchar), '') || ':' as id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]{{{LEAST_CHARS},}}')) as run from documents),
r as (select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as n from d group by 1, 2),
b as (select w, n, hex(encode(id || w)) as x from r),
h as (select w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: cast('0x' || x[2 * i + 1 : 2 * i + 2] as bigint))), lambda c, v: xor(t.crc[(xor(c, v) & 255) + 1], c >> 8))) as h from b, t),
s as (select case when h % {SPOIL} = 0 then w[: h % length(w)] || w[h % length(w) + 2 :] else w end as word, sum(n) as n from h group by 1),
w as (select word, cast(n as bigint) as n, translate(word, '{_MAPPED}', '{_PLAIN}') as m from s where length(word) >= {LEAST_CHARS} and n >= {LEAST_COUNT}),
p as (select a.word, a.n, b.word as near, b.n as near_n from w a join w b on length(b.m) between length(a.m) - 1 and length(a.m) + 1 and a.word <> b.word and levenshtein(a.m, b.m) = 1),
f as (select word, count(*) as n_near, first(near order by near_n desc, near) as form, max(near_n) as form_n from p group by word),
g as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= {MUCH_MORE} * w.n then form end as form, case when form_n >= {MUCH_MORE} * w.n then form_n end as form_n from w left join f using (word)),
c as (select word, word as root, 0 as k from g union all select c.word, g.form, k + 1 from c join g on c.root = g.word where g.form is not null)
select g.word, form, arg_max(c.root, c.k) as root, n, n_near, form_n from g join c on c.word = g.word group by g.word, form, n, n_near, form_n
"""
