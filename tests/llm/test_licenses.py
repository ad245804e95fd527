import random
import re

from skyloom.llm import licenses

from .data import ODD, frame, put
from .test_line_dedup import distance

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def texts():
    rng = random.Random(6)
    parts = ["CC", "BY", "cc-by", "cc by", "accby", "General Public License", "general--public\nlicense", "All rights reserved.", "all rights", "reserved", "é", "漢字", "cc\xa0by", "x1", " ", ", ", "\n", "_", "ALL RIGHTS reservedé"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "-"]) for _ in range(rng.randint(1, 30))) for _ in range(400)] + ODD


def test_base_equals_brute_force(spark, tmp_path):
    rows = texts()
    got = {r.doc_id: r for r in licenses.op8_license_scan(spark, put(spark, tmp_path, rows)).collect()}
    for i, t in enumerate(rows):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), repr(t)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(1, len(text) - 1)
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "z" + text[i + 1 :]])
    return text


def edited_notice(rng, notice, n):
    """``n`` edits outside the words that tell siblings apart."""
    parts = re.split(r"\[(.*?)\]", notice)
    for _ in range(n):
        i = rng.choice([i for i in range(0, len(parts), 2) if len(parts[i]) > 3])
        lead, tail = parts[i][:1], parts[i][-1:]
        parts[i] = lead + edited(rng, "^" + parts[i][1:-1] + "$", 1).strip("^$") + tail
    return " ".join("".join(parts).split())


def test_edited_notices_are_found(spark):
    rng = random.Random(7)
    cases = [(edited_notice(rng, n, len(n) // licenses.CHARS_PER_EDIT - 1), label) for n, label in licenses.NOTICES for _ in range(10)]
    plain = ["the license of the ship was under water", "released the dog under the table", "apache horses and public works"]
    rows = ["lorem ipsum " * 5 + c + " dolor" for c, _ in cases] + plain
    got = licenses.scan(frame(spark, rows)).orderBy("doc_id").collect()
    found = [label in r.labels.split(",") for r, (_, label) in zip(got, cases)]
    assert sum(found) >= 0.97 * len(cases)  # an edit may split a word at an end of the notice
    assert [r.labels for r in got[len(cases) :]] == [""] * 3


def test_siblings_get_no_wrong_label(spark):
    """One edit would do for each of these, but it would be another license."""
    rows = {
        "licensed under cc by nd 4 0": "cc-by", "licensed under cc by 3 0": "cc-by", "cc by sa 3 0 is what it is licensed under cc by sa 3 0": "cc-by",
        "licensed under the apache license version 1 0": "", "licensed under the apache license version 1 1": "", "licensed under the apache licence version 2 0": "apache-2.0",
        "this work is licensed under the gnu general public license version 2": "gpl", "this work is licensed under the gnu lesser general public license version 3": "gpl",
        "released under the mpl license": "", "released under the isc license": "", "this source code form is subject to the terms of the eclipse public license": "",
        "licensed under a creative commons attribution sharealike license": "", "licenced under cc by nc 4 0": "cc-by,cc-by-nc-4.0", "licensed undr cc by sa 4 0": "cc-by,cc-by-sa-4.0",
    }
    got = licenses.scan(frame(spark, [f"We say: {t}, and more." for t in rows])).orderBy("doc_id").collect()
    assert {t: r.labels for t, r in zip(rows, got)} == rows


def test_span_words(spark):
    (r,) = licenses.scan(frame(spark, ["- One two, Released under the MIT licence. End"])).collect()
    assert r.spans == "mit:2:7:1" and r.labels == "mit" and 0.9 < r.score < 1


def test_all_notices_of_a_range_are_found(spark):
    worse, exact = "released under the mit licence", "released under the mit license"
    rows = [f"{worse} {exact}", f"{exact} {worse} {exact}", " ".join(["licensed under the apache licence version 2 0"] * 3 + ["licensed under the apache license version 2 0"]), f"{worse} and more {worse}"]
    got = licenses.scan(frame(spark, rows)).orderBy("doc_id").collect()
    assert [r.spans for r in got] == ["mit:0:5:1,mit:5:10:0", "mit:0:5:0,mit:5:10:1,mit:10:15:0", "apache-2.0:0:8:1,apache-2.0:8:16:1,apache-2.0:16:24:1,apache-2.0:24:32:0", "mit:0:5:1,mit:7:12:1"]


def test_spans_equal_brute_force():
    """Every whole-word stretch of a text against every notice by edit distance: each one in bounds meets a reported span."""
    rng, finder = random.Random(9), licenses.Finder([(re.sub(r"[\[\]]", "", n), label) for n, label in licenses.NOTICES[:3]])
    for _ in range(25):
        parts = [rng.choice([edited(rng, n, rng.choice([0, 1, 2])), "the cat sat on a mat"]) for n, _, _ in (rng.choice(finder.notices) for _ in range(4))]
        text = " ".join(" ".join(parts).split())
        found = finder.find(text)
        for i, s, e, edits in found:
            assert distance(finder.notices[i][0], text[s:e]) == edits <= finder.notices[i][2]
        cuts = [0, *(m.end() for m in re.finditer(" ", text))]
        for i, (notice, _, k) in enumerate(finder.notices):
            for s in cuts:
                for e in (m.start() for m in re.finditer(" |$", text)):
                    if abs(e - s - len(notice)) <= k and distance(notice, text[s:e]) <= k:
                        assert any(s < y and x < e for _, x, y, _ in found), (notice, text[s:e])


def test_the_closest_of_like_notices_is_reported(spark):
    (r,) = licenses.scan(frame(spark, ["Licensed under CC BY-NC 4.0."])).collect()
    assert (r.base_labels, r.labels, r.spans, r.score) == ("cc-by", "cc-by,cc-by-nc-4.0", "cc-by-nc-4.0:0:7:0", 1.0)


def test_empty_table(spark):
    assert licenses.scan(frame(spark, [])).count() == 0
