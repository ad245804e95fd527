"""Main text of web pages: a maximum-scoring run of words and tags, then the blocks of its container.

A page is read into words and tags. Words score positive and tags negative, with weights that are log-odds of
each token class inside and outside the article, counted on labelled pages. One linear scan finds the
contiguous run of the greatest score. The run is then closed to whole blocks: the smallest element that holds
it all, without menus, headers, footers, sidebars, notices, adverts, forms and comments inside.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: One pass over a page: comments, raw-text elements, declarations, tags, text. A quote counts only where it starts a value.
_LEX = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?[a-zA-Z](?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+>|[^<]+|<",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(.*?)(/?)>\Z", re.S)
_HINT = re.compile(r"""\b(?:id|class|role|aria-label|data-role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold article text.
DROPPED = frozenset("nav aside form footer button dialog menu object canvas video audio map head script style".split())
CONTENT = frozenset("main body html".split())
#: Elements that an open element of the same row closes.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of id, class or role values that mark what is no article.
NO_ARTICLE = frozenset(
    "ad ads adv advert advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside widget widgets rail related recommended recommendations trending popular share sharing social"
    " comment comments disqus respond replies reply discussion footer foot masthead topbar toolbar search form contentinfo complementary copyright disclaimer skip".split()
)


#: Words that say nothing by themselves: what stands before them tells what an element is.
PLAIN_HEADS = frozenset(
    "wrapper wrap container box block area section item items list links link inner outer content body bar button buttons group row col column panel slot unit zone region"
    " posts post articles stories story module component text title header heading top bottom left right main primary secondary small large icon icons toggle count author meta avatar thread card cards".split()
)
#: A heading of these words opens the readers' part of its element.
_COMMENTS = re.compile(r"(?:\d+\s+)?(?:reader\s+)?(?:comments?|repl(?:y|ies)|responses?|leave a (?:comment|reply)|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?\s*:?", re.I)


class Node:
    """An element: whether it can't be article text, and whether it lies in a link or in an article's element."""

    __slots__ = ("tag", "parent", "bad", "order", "end", "linked", "content")

    def __init__(self, tag: str, parent: Node | None, bad: bool):
        self.tag, self.parent, self.bad, self.order, self.end = tag, parent, bad, 0, 0
        self.linked = tag == "a" or (parent is not None and parent.linked)
        self.content = tag in ("article", "main") or (parent is not None and parent.content)


def _marked(rest: str) -> bool:
    """Whether an id, class or role names what is no article: by its last word, plain ones like "list" apart."""
    for m in _HINT.finditer(rest):
        value = next(filter(None, m.groups()), "")
        for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w.isalpha()]
            if not words or words[0] in ("no", "has", "with", "without"):
                continue
            while len(words) > 1 and words[-1] in PLAIN_HEADS:
                words.pop()
            if words[-1] in NO_ARTICLE:
                return True
    return False


def parse(page: str) -> tuple[list[tuple[str, str, Node]], list[tuple[Node, str]]]:
    """Tokens (kind, text, element) and blocks (element, text) of a page.

    Kinds: ``word`` once a run of text with its words, and the classes of tags. Blocks end at block elements only.
    Elements carry what is asked of them, so the work grows with the page, however deep it is nested.
    """
    root = Node("#root", None, False)
    here, tokens, blocks, text = root, [], [], []
    nodes, opened = [root], {}

    def open_(tag: str, bad: bool) -> Node:
        node = Node(tag, here, bad)
        node.order = len(nodes)
        nodes.append(node)
        opened[tag] = opened.get(tag, 0) + 1
        return node

    def closed(name: str, within: tuple[str, ...] = ()) -> Node:
        """The parent of the nearest open ``name``; ``here`` itself where none is open (inside ``within``)."""
        if not opened.get(name):
            return here
        node = here
        while node.tag != name:
            if node.parent is None or node.tag in within:
                return here
            node = node.parent
        gone = here
        while gone is not node.parent:
            opened[gone.tag] -= 1
            gone = gone.parent
        return node.parent

    def flush() -> Node:
        joined = _SPACE.sub(" ", "".join(text)).strip()
        text.clear()
        if joined:
            blocks.append((here, joined))
            # what follows a heading of comments belongs to the readers, to the end of its element
            if here.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not here.bad and _COMMENTS.fullmatch(joined):
                here.bad = True
                return here
        return root

    for m in _LEX.finditer(page):
        piece = m.group()
        if m.group(1) is not None or piece.startswith(("<!", "<?")):
            continue
        t = _TAG.match(piece) if piece[0] == "<" and len(piece) > 2 else None
        if t is None:
            plain = html.unescape(piece)
            text.append(plain)
            if n := len(plain.split()):
                tokens.append(("link" if here.linked else "word", n, here))
            continue
        closing, name, rest, single = t.group(1), t.group(2).lower(), t.group(3), t.group(4)
        if name in INLINE:
            tokens.append(("a" if name == "a" else "inline", 1, here))
            if name in ("a",):
                if closing:
                    here = closed("a")
                elif not single:
                    here = open_("a", here.bad or _marked(rest))
            elif name in ("span", "b", "i", "em", "strong", "small", "label", "font") and not closing and _marked(rest) and not single:
                here = open_(name, True)
            elif closing and here.tag == name:
                here = closed(name)
            continue
        if name in ("br", "wbr"):
            text.append(" ")
            tokens.append(("inline", 1, here))
            continue
        heading = flush()
        kind = "item" if name in ("li", "ul", "ol", "dl", "dt", "dd") else "p" if name == "p" else "head" if name in ("h1", "h2", "h3", "h4", "h5", "h6") else "block"
        if closing:
            tokens.append((kind, 1, here))
            here = closed(name)
            if heading.bad and here is heading.parent:
                here = open_("#comments", True)
        else:
            if name in _P_ENDERS:
                here = closed("p", ("td", "th", "li", "div", "article", "section", "main", "body", "blockquote"))
            for other in _CLOSES.get(name, ()):
                here = closed(other, ("ul", "ol", "table", "dl", "div", "article", "section", "body", "tr" if other in ("td", "th") and name != "tr" else "table"))
            if name not in VOID and not single:
                bad = here.bad or name in DROPPED or (name not in CONTENT and _marked(rest)) or (name == "header" and not here.content)
                here = open_(name, bad)
            tokens.append((kind, 1, here))
    flush()
    for node in reversed(nodes):
        node.end = max(node.end, node.order)
        if node.parent is not None:
            node.parent.end = max(node.parent.end, node.end)
    return tokens, blocks


#: Labelled pages: (html, the article's element id). Menus, adverts and so on stand outside it.
_SENTENCE = "Some words that tell a longer story go on in this place and end here."
LABELLED = tuple(
    f"<body><header><a href=/>Site</a></header><nav><ul>{'<li><a href=x>Item</a></li>' * n}</ul></nav><div class=w><p>Short notice.</p></div>"
    f"<article id=main><h1>A title of words</h1>{f'<p>{_SENTENCE * k} <b>Bold</b> and <a href=y>one link</a>.</p>' * n}<ul><li>A point that has words.</li></ul></article>"
    f"<aside><h3>More</h3><ul>{'<li><a href=z>Other page</a></li>' * k}</ul></aside><footer><p>Terms of use</p><a href=q>Contact</a></footer></body>"
    for n in (2, 5, 9)
    for k in (1, 3, 6)
)


@functools.lru_cache(1)
def weights() -> dict[str, float]:
    """Log-odds of each token class in the article against the rest of the labelled pages; tags at most -0.1."""
    count = {True: {}, False: {}}
    for page in LABELLED:
        for kind, n, node in parse(page)[0]:
            side = count[node.content]
            side[kind] = side.get(kind, 0) + n
    kinds = ("word", "link", "a", "inline", "item", "p", "head", "block")
    total = {s: sum(c.values()) + len(kinds) for s, c in count.items()}
    out = {k: math.log((count[True].get(k, 0) + 1) / total[True]) - math.log((count[False].get(k, 0) + 1) / total[False]) for k in kinds}
    return {k: max(v, 0.1) if k == "word" else min(v, -0.1) for k, v in out.items()}


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last place of the contiguous run of the greatest sum; (0, -1) if none is positive."""
    best, found, total, start = 0.0, (0, -1), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, found = total, (start, i)
    return found


def extract(page: str | None) -> str:
    """The article's text. Null, empty or wordless pages give an empty string."""
    tokens, blocks = parse(page or "")
    w = weights()
    scores, left = [], 0.0  # what can't be article counts against a run, a stretch of it as ten words at most
    for kind, n, node in tokens:
        if node.bad:
            cost = min(left, n * w["word"])
            scores.append(-cost)
            left -= cost
        else:
            scores.append(n * w[kind])
            left = 10 * w["word"]
    a, b = best_run(scores)
    holders = {id(t[2]): t[2] for t in tokens[a : b + 1] if t[0] in ("word", "link") and not t[2].bad}
    if not holders:
        return ""
    box = _common(list(holders.values()))
    while box.parent is not None and (box.tag in INLINE or box.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "section", "header", "table", "tbody", "tr", "td", "dl", "pre", "figure")):
        box = box.parent  # a part of an article, not the whole
    for node in _up(box):
        if node.tag in ("article", "main") and not node.bad:
            box = node
            break
    inside = [text for node, text in blocks if not node.bad and _within(node, box)]
    if box.tag not in ("article", "main"):
        inside = _headline(blocks, box) + inside
    return " ".join(inside)


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _within(node: Node, box: Node) -> bool:
    return box.order <= node.order <= box.end


def _common(nodes: list[Node]) -> Node:
    first, last = min(n.order for n in nodes), max(n.order for n in nodes)
    box = min(nodes, key=lambda n: n.order)
    while not box.order <= first <= last <= box.end:
        box = box.parent
    return box


def _headline(blocks: list[tuple[Node, str]], box: Node) -> list[str]:
    """A main heading right before the content's element, in the same parent."""
    before: list[tuple[Node, str]] = []
    for node, text in blocks:
        if _within(node, box):
            break
        if not node.bad:
            before.append((node, text))
    if before and box.parent is not None and any(n.tag in ("h1", "h2") and _within(n, box.parent) for n in _up(before[-1][0])):
        return [before[-1][1]]
    return []


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row (null html is empty); each row by itself, whole."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                texts = [extract(x) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
