"""Main text of web pages by wrapper induction.

Pages of a host are parsed to trees of elements.  All trees are merged from the root into the host's
template: equal siblings (by element and class, wherever they stand among the others) fall together,
and what a page has alone is added, so no single page decides a host.  Nodes whose text is the same on
nearly all pages that have text in that place are template, the others are slots.  Only slots are content.  Inside a marked article a
block is template if all its own text is, so constant words in a sentence that varies stay; an article
whose whole text is constant stays as it is.  Menus, headers, footers, notices, adverts, forms and
comments are known by their element or class too, but a class (or a form) never hides html, body or
what holds the article: an element with a mark of an article in it and half of the page's text.

Hosts are the groups of the exchange; a host of more than ``PART`` bytes of markup is cut into parts
by hash of its pages, and each part has a template of its own.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import stage_table

#: bytes of markup of one part of a host
PART = 8 << 20
#: a node is template when so many distinct pages, and this share of those with text in its place, have its text
ALIKE_PAGES, ALIKE_SHARE = 3, 0.8

#: Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BORDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
PARAGRAPH_BORDERS = set("article aside blockquote body button caption dd div figure footer form header html li main nav section table td th".split())
#: elements, and words of a class, id or role, that aren't the article
APART = set("head nav footer aside form script style noscript template iframe button select textarea title svg menu dialog object".split())
APART_WORDS = set("ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
                  "comment comments cookie cookies notice consent gdpr share sharing social related newsletter subscribe popup modal widget login signup".split())
#: elements that hide what they hold whatever that is; the others of ``APART`` may hold the article
HIDDEN = APART - {"form", "dialog"}
WHOLE = {"html", "body"}
PAGE_OWN = {"html", "body", "main", "article"}
ARTICLE_WORDS = {"article", "main", "content", "post", "entry", "story"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_DIGIT = re.compile("[0-9]")


class Node:
    __slots__ = ("tag", "words", "parts", "elements", "apart", "constant")

    def __init__(self, tag: str, words: frozenset[str]):
        self.tag, self.words = tag, words
        self.parts: list = []  # texts and nodes in order
        self.elements: list[Node] = []
        self.apart = tag in APART or (tag not in WHOLE and not words.isdisjoint(APART_WORDS))
        self.constant = False

    def own_text(self) -> str:
        return " ".join(" ".join(p for p in self.parts if isinstance(p, str)).split())


def parse(page: str) -> Node:
    """The page's tree; unclosed, crossed and stray tags are mended as browsers do in the common cases."""
    root = Node("#", frozenset())
    stack, at, end = [root], 0, len(page)

    def text(piece: str) -> None:
        if piece:
            stack[-1].parts.append(entities.unescape(piece) if "&" in piece else piece)

    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        _close_before(stack, tag)
        named = _NAMED.findall(found[3]) if "=" in found[3] else ()
        node = Node(tag, frozenset(w for n in named for w in _WORDS.findall(n.lower())))
        stack[-1].parts.append(node)
        stack[-1].elements.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
            stack.append(node)
        elif tag not in VOID and not found[3].endswith("/"):
            stack.append(node)
    return root


def _close_before(stack: list[Node], tag: str) -> None:
    """Close what the start of ``tag`` ends: a paragraph before a block, an item before the next."""
    if tag in CLOSES_ITSELF:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in BORDERS[tag]:
                break
            if stack[i].tag in CLOSES_ITSELF[tag]:
                del stack[i:]
                break
    if tag in BLOCK:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in PARAGRAPH_BORDERS:
                break


def _kind(n: Node) -> tuple[str, frozenset[str]]:
    """What makes siblings equal; numbers in ids and classes, and the classes of a page or article, differ from page to page."""
    if n.tag in PAGE_OWN:
        return n.tag, frozenset()
    return n.tag, frozenset(w for w in n.words if not _DIGIT.search(w))


def mark_constants(trees: list[Node]) -> None:
    """Merge the trees of distinct pages into one template and mark the nodes that belong to it."""
    places: dict[tuple, int] = {}  # (place of the parent, kind) -> place
    pages: list[int] = [0]  # with text in the place
    last: list[int] = [-1]
    seen: dict[tuple[int, str], list] = {}  # (place, text) -> [pages, the last of them, nodes]
    for number, tree in enumerate(trees):
        todo = [(tree, 0)]
        while todo:
            n, place = todo.pop()
            text = n.own_text()
            if text:
                if last[place] != number:
                    last[place] = number
                    pages[place] += 1
                found = seen.setdefault((place, text), [0, -1, []])
                if found[1] != number:
                    found[0], found[1] = found[0] + 1, number
                found[2].append(n)
            for e in n.elements:
                if not e.apart:
                    inner = places.setdefault((place, _kind(e)), len(pages))
                    if inner == len(pages):
                        pages.append(0)
                        last.append(-1)
                    todo.append((e, inner))
    for (place, _), (some, _, nodes) in seen.items():
        if some >= max(ALIKE_PAGES, ALIKE_SHARE * pages[place]):
            for n in nodes:
                n.constant = True


def open_holders(root: Node) -> None:
    """What holds the article isn't apart: by class or as a form, with an article's mark in it and half of the page's text."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(e for e in n.elements if e.tag not in HIDDEN)
    if not any(n.apart for n in order):
        return
    length, marks, prose = {}, set(), set()
    for n in reversed(order):  # what an element holds comes before it
        inner = [e for e in n.elements if e.tag not in HIDDEN]
        length[id(n)] = sum(len(p.strip()) for p in n.parts if isinstance(p, str)) + sum(length[id(e)] for e in inner)
        if n.tag == "p" or any(id(e) in prose for e in inner):
            prose.add(id(n))
    for n in reversed(order):
        # words alone could be a menu's ("main-nav"): with them counts only an element with paragraphs
        own = n.tag in ("article", "main") or (not n.words.isdisjoint(ARTICLE_WORDS) and (not n.apart or id(n) in prose))
        if own or any(id(e) in marks for e in n.elements):
            if n.apart and length[id(n)] and 2 * length[id(n)] >= length[id(root)]:
                n.apart = False
            if not n.apart:
                marks.add(id(n))


def _articles(root: Node) -> list[Node]:
    """The topmost elements that mark an article: by element, else by class."""
    for fits in (lambda n: n.tag == "article", lambda n: n.tag == "main" or "main" in n.words, lambda n: not n.words.isdisjoint(ARTICLE_WORDS)):
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.apart:
                continue
            if fits(n) and n is not root:
                found.append(n)
            else:
                todo.extend(reversed(n.elements))
        if found:
            return found
    return []


def _is_template(block: Node) -> bool:
    """Whether all text of the block outside inner blocks is constant."""
    todo = [block]
    while todo:
        n = todo.pop()
        if not n.constant and n.own_text():
            return False
        todo.extend(e for e in n.elements if not e.apart and e.tag not in BLOCK)
    return True


def _text(starts: list[Node], marked: bool, whole: bool = False) -> str:
    """Text of the elements without template; ``whole`` keeps it.  In a marked article blocks are template, elsewhere elements."""
    out: list[str] = []
    todo: list = [(n, False) for n in reversed(starts)]
    while todo:
        n, dropped = todo.pop()
        if n is None:
            out.append(" ")
        elif isinstance(n, str):
            out.append(n)
        elif not n.apart and (marked or n.tag != "header"):
            block = n.tag in BLOCK
            if not marked:
                dropped = n.constant
            elif block:
                dropped = not whole and _is_template(n)
            parts = [(p, dropped) for p in n.parts if not (dropped and isinstance(p, str))]
            if block or n.tag == "br":
                parts = [(None, dropped), *parts, (None, dropped)]
            todo.extend(reversed(parts))
    return " ".join("".join(out).split())


def content(root: Node) -> str:
    """The text of the page's content, blocks in order, white space as single spaces."""
    articles = _articles(root)
    if not articles:
        return _text([root], False)
    return _text(articles, True) or _text(articles, True, whole=True)


def _extract(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["url", "page_id", "html"], ignore_index=True)
    trees = {h: parse(h) for h in dict.fromkeys(frame["html"])}
    for tree in trees.values():
        open_holders(tree)
    mark_constants(list(trees.values()))
    found = {h: content(t) for h, t in trees.items()}
    out = pd.DataFrame({"page_id": frame["page_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "url": frame["raw_url"], "text": frame["html"].map(found)})
    out["n_chars"] = out["text"].str.len()
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", part: int = PART) -> DataFrame:
    """page_id, url, text, n_chars; one row per row of ``pages``.

    Null html is empty and gives an empty text, as a page without content does.  Pages whose url is
    null or has no host share a template.  Copies of a page count once for the template.
    An empty table gives no rows; other columns aren't read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("raw_url"), F.coalesce(url_col, F.lit("")).alias("url"),
                        F.coalesce(html_col, F.lit("")).alias("html"), host.alias("host"))
    # one row per large host: there are at most (all bytes / part) of them
    large = rows.groupBy("host").agg(F.ceil(F.sum(F.octet_length("html")) / part).alias("parts")).where("parts > 1")
    large = stage_table(large, "large")
    placed = rows.join(large, "host", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("parts")), F.lit(0)))
    return placed.groupBy("host", "part").applyInPandas(_extract, "page_id long, url string, text string, n_chars long")


def op8_html(spark, sf_dir: str) -> DataFrame:
    """The query of contract 8 over the whole table ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
