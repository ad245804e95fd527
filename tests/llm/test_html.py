import itertools
import random

from skyloom.llm import html_text

A = "The first paragraph tells a story with many words &amp; it goes on for a while."
B = "A second\n paragraph&nbsp;has <b>bo</b>ld and <a href='/x'>a link</a> inside it, and it ends."
WANT = "Title here The first paragraph tells a story with many words & it goes on for a while. A second paragraph has bold and a link inside it, and it ends. Short."
NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
MENU = "<div class='main-menu'><a href=/a>Home page</a> <a href=/b>All the news</a></div>"
SIDE = "<div id=sidebar><h3>More</h3><p>Read some other things that we have written on other days.</p></div>"
COMMENTS = "<section class='comments'><h2>Comments</h2><div class=comment><p>I liked this story a lot, and I want to say so in many words here.</p></div></section>"
FORM = "<form action=/s><label>Mail</label><input name=q><button>Send it</button></form>"
COOKIE = "<div class='cookie-notice'>We use cookies on this page to make it better for all of you.</div>"
SCRIPT = "<script>if (a < b) { document.write('<p>no</p>'); }</script><style>p > a {x: y}</style><!-- a <p>comment</p> -->"


def pages():
    bodies = [f"<h1>Title here</h1><p>{A}</p><p>{B}</p><p>Short.</p>", f"<h1>Title here</h1><p>{A}<p>{B}<p>Short.", f"<h1>Title here</h1><div>{A}<br></div>{SCRIPT}<div>{B}</div><div class=ad>Buy this thing now</div>{FORM}<p>Short.</p>"]
    boxes = ["<article>{}</article>", "<main><article class=post>{}</article>" + COMMENTS + "</main>", "<div class='content no-sidebar'>{}</div>", "<div id=main><div class=text>{}</div></div>", "<main>{}</main>"]
    befores = ["", f"<header><p>Site name and claim</p></header>{NAV}", MENU + COOKIE, f"<div class=header>Site</div>{NAV}<!-- x -->"]
    afters = ["", SIDE + COMMENTS, f"<aside><p>Some more text in the aside that is not part.</p></aside><footer><p>&copy; 2024 All of us</p></footer>", COMMENTS + FORM + SCRIPT]
    return ["<!DOCTYPE html><html><head><title>Title here</title></head><body>" + b + x.format(t) + a + "</body></html>" for t, x, b, a in itertools.product(bodies, boxes, befores, afters)]


def test_templates():
    for page in pages():
        assert html_text.extract(page) == WANT, page


def test_best_run_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        x = [rng.choice([-3, -1, -0.5, 0.25, 1, 2.5]) for _ in range(rng.randint(0, 12))]
        best = max([sum(x[i : j + 1]) for i in range(len(x)) for j in range(i, len(x))] + [0])
        a, b = html_text.best_run(x)
        assert sum(x[a : b + 1]) == best or best <= 0 and b < a


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<<<>>><p", "x"), (4, "u", "just plain words without a tag", "x"), (None, "u", "<p>" * 5000 + "deep words", "x"), (4, "u", "just plain words without a tag", "x")]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 6
    assert [r.text for r in got if r.page_id == 4] == ["just plain words without a tag"] * 2
    assert all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert [r.text for r in got if r.page_id is None] == ["deep words"]
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quotes_count_only_where_they_start_a_value():
    lexed = lambda page: [m.group() for m in html_text._LEX.finditer(page)]
    assert lexed("<a href=/it's>one</a> it's <b>two</b>") == ["<a href=/it's>", "one", "</a>", " it's ", "<b>", "two", "</b>"]
    assert lexed("<a title=\"x > y\" alt= 'p > q'>z") == ["<a title=\"x > y\" alt= 'p > q'>", "z"]
    assert lexed("<a =" * 3000) is not None and lexed("<p 'q>r") == ["<p 'q>", "r"]


def test_names_that_an_article_may_carry():
    """Words of menus and so on that only qualify another word mark nothing; heads that say nothing are passed over."""
    for name in ("search-results-summary", "related-work", "form-of-government", "popular-science", "footnote", "comment-on-law", "adventure"):
        for box in ("<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>"):
            page = f"{NAV}{box.format(f'<h1>Title here</h1><p>{A}</p><section class={name}><p class={name}>{A}</p></section><p>Short.</p>')}{SIDE}"
            want = html_text.extract(page.replace(f" class={name}", ""))
            assert want.count("first paragraph") == 2 and html_text.extract(page) == want, (name, box)
    for name in ("comment-list", "sidebar-left", "share-buttons", "cookieBanner", "ad-300x250", "footer_links", "related-posts", "main-menu"):
        page = f"<article><h1>Title here</h1><p>{A}</p><div class={name}><p>Other words that are of no matter here.</p></div><p>{B}</p><p>Short.</p></article>"
        assert html_text.extract(page) == WANT, name


def test_a_heading_of_comments_ends_the_article():
    for head in ("Comments", "12 Comments", "Kommentare (3)", "Leave a reply", "Commentaires"):
        mine = f"<h1>Title here</h1><p>{A}</p><p>{B}</p><p>Short.</p>"
        readers = f"<h3>{head}</h3><div class='css-2'><p>I liked this story a lot, and I want to say so in many words here.</p></div><p class=css-3>Me too.</p>"
        assert html_text.extract(f"<article>{mine}{readers}</article>") == WANT
        assert html_text.extract(f"<main>{NAV}<div class=x>{mine}</div><section class=css-1>{readers}</section></main>") == WANT
    assert "Comments on the law" in html_text.extract(f"<article><h2>Comments on the law</h2><p>{A}</p></article>")


def test_time_grows_with_the_page_however_deep():
    import time

    def took(n):
        page = "".join(f"<div><p>Some words in paragraph {i}</i> and <a href=x>a link</a></b>" for i in range(n))
        began = time.process_time()
        assert html_text.extract(page).count("paragraph") == n
        return time.process_time() - began

    took(500)
    assert took(8000) < 40 * max(took(500), 0.01)  # sixteen times the page
