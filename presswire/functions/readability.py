"""Main content of web pages: what a reader would call the article."""

from __future__ import annotations

import logging
import re
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BLANK_CHARACTERS

log = logging.getLogger(__name__)

_SKIP = {"script", "style", "noscript", "template", "svg", "iframe", "form", "button", "select", "textarea"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "section", "article", "main", "li", "ul", "ol", "td", "tr", "table", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "dd", "dt", "dl", "body", "aside", "header", "footer", "nav"}
# Class-name hints: fixed values, a shorter form of those of Arc90's Readability (Apache License 2.0).
_AWAY = re.compile(r"\bad-|\bads?\b|banner|breadcrumb|combx|comment|community|cookie|disqus|footer|header|menu|nav|promo|related|remark|rss|share|shoutbox|sidebar|social|sponsor|subscribe|tool", re.I)
_STAY = re.compile(r"article|body|content|entry|hentry|main|page|post|text|story", re.I)
_BOILERPLATE = {"nav", "footer", "aside", "header"}
_REFERENCE = re.compile(r"&(?:(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)?")


class _Node:
    __slots__ = ("children", "hint", "parent", "tag")

    def __init__(self, tag, parent, hint=""):
        self.tag, self.parent, self.hint, self.children = tag, parent, hint, []

    def text(self) -> str:
        out: list[str] = []
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                if n.tag in _BLOCK or n.tag == "br":
                    stack.append("\n")
                stack.extend(reversed(n.children))
                if n.tag in _BLOCK:
                    out.append("\n")
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("root", None)
        self.meta: dict[str, str] = {}
        self.lang, self.title, self.skipping = "", "", ""
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if self.skipping:
            return
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "meta":
            if name := (a.get("property") or a.get("name") or "").lower():
                self.meta.setdefault(name, a.get("content", ""))
        elif tag == "title":
            self.in_title = True
        elif tag in _SKIP:
            self.skipping = tag
        elif tag == "br":
            self.at.children.append("\n")
        elif tag not in _VOID:
            if tag == "p":  # a paragraph ends where the next begins
                n = self.at
                while n is not None and n.tag not in ("p", "div", "article", "section", "root"):
                    n = n.parent
                if n is not None and n.tag == "p":
                    self.at = n.parent
            node = _Node(tag, self.at, f"{a.get('class', '')} {a.get('id', '')}")
            self.at.children.append(node)
            self.at = node

    def handle_endtag(self, tag):
        if self.skipping:
            if tag == self.skipping:
                self.skipping = ""
        elif tag == "title":
            self.in_title = False
        else:
            n = self.at
            while n is not None and n.tag != tag:
                n = n.parent
            if n is not None and n.parent is not None:
                self.at = n.parent

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skipping:
            self.at.children.append(data)


def _tidy(text: str) -> str:
    lines = (re.sub(r"[ \t\r\f\v ]+", " ", x).strip(BLANK_CHARACTERS) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def _link_density(node: _Node) -> float:
    total, inside = 0, 0
    stack = [(node, False)]
    while stack:
        n, link = stack.pop()
        for c in n.children:
            if isinstance(c, str):
                k = len(c.strip())
                total += k
                inside += k * link
            else:
                stack.append((c, link or c.tag == "a"))
    return inside / total if total else 0.0


def _prune(node: _Node) -> None:
    stack = [node]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or not (c.tag in _BOILERPLATE or (_AWAY.search(c.hint) and not _STAY.search(c.hint)))]
        stack.extend(c for c in n.children if not isinstance(c, str))


def _paragraphs(root: _Node) -> list[tuple[_Node, str]]:
    """Elements that hold text of their own, in the order of the page, with that text: of an
    element around other paragraphs only what stands outside of them, so nesting costs nothing."""
    out: list[tuple[_Node, str]] = []
    stack = [root]
    while stack:
        n = stack.pop()
        own = n.tag in ("p", "pre", "td", "blockquote")
        if own or (n.tag in ("div", "article", "section", "body") and sum(len(c.strip()) for c in n.children if isinstance(c, str)) >= 25):
            parts = [c if isinstance(c, str) else c.text() for c in n.children if isinstance(c, str) or c.tag not in _BLOCK]
            out.append((n, _tidy("".join(parts))))
        stack.extend(c for c in reversed(n.children) if not isinstance(c, str))
    return out


def extract(html: str | None) -> dict[str, str] | None:
    """Article fields of a page; null if nothing on it reads like content."""
    if not html:
        return None
    tree = _Tree()
    tree.feed(html)
    tree.close()
    _prune(tree.root)
    scores: dict[_Node, float] = {}
    paragraphs = _paragraphs(tree.root)
    for p, own in paragraphs:
        if len(own) < 25:
            continue
        points = 1 + own.count(",") + min(len(own) // 100, 3)
        up, level = p.parent or p, 0
        while up is not None and level < 3:
            base = 10 if up.tag == "article" else 5 if up.tag in ("main", "section", "div") else 0
            base += 25 * bool(_STAY.search(up.hint)) - 25 * bool(_AWAY.search(up.hint))
            scores[up] = scores.get(up, base) + points / (1, 2, 6)[level]
            up, level = up.parent, level + 1
    best = max(scores, key=lambda n: scores[n] * (1 - _link_density(n)), default=None)
    content = _tidy((best or tree.root).text())
    if not content:
        return None
    meta = lambda *names: next((tree.meta[n].strip() for n in names if tree.meta.get(n, "").strip()), "")
    first = next((own for _, own in paragraphs if own and (best is None or own in content)), "")
    return {
        "siteName": meta("og:site_name"),
        "publishedTime": meta("article:published_time", "datepublished", "date"),
        "title": meta("og:title", "twitter:title") or " ".join(tree.title.split()),
        "byline": meta("author", "article:author", "dc.creator"),
        "lang": tree.lang,
        "excerpt": meta("og:description", "description") or (content.split("\n")[0] if first == "" else first.split("\n")[0]),
        "textContent": content,
    }


_FIELDS = ["siteName", "publishedTime", "title", "byline", "lang", "excerpt", "textContent"]


def close_references(html: str | None) -> str | None:
    """The page with each ``&`` that begins no reference ended by a semicolon as ``&amp;``. HTML reads some names without
    one too (``&amp`` is ``&``, ``&copy`` is ``©``), so text cut inside a reference changes; after this it stays as it is."""
    return html and _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or f"{m[1]};" in html5) else f"&amp;{m[0][1:]}", html)


def _extracted(html: str | None) -> dict[str, str] | None:
    try:
        return extract(html)
    except Exception:  # a page that cannot be read is left out like one that cannot be fetched
        log.warning("a page of %d characters could not be read", len(html or ""), exc_info=True)
        return None


def articles(pages: DataFrame, open_references: bool = True) -> DataFrame:
    """``url, thumbnail, html`` to articles; pages without content, and pages that cannot be read, are left out. Nothing is
    shuffled; write filters on pages before this, Catalyst does not move them through it. ``open_references``: read
    references without a semicolon as HTML does; else they stay as text (see :func:`close_references`)."""
    if "thumbnail" not in pages.columns:
        pages = pages.withColumn("thumbnail", F.lit(None).cast("string"))

    def run(batches):
        for b in batches:
            got = [_extracted(h if open_references else close_references(h)) for h in b.column("html").to_pylist()]
            keep = [i for i, g in enumerate(got) if g]
            at = pa.array(keep, pa.int64())
            columns = [b.column("url").take(at), b.column("thumbnail").take(at)] + [pa.array([got[i][f] for i in keep], pa.string()) for f in _FIELDS]
            yield pa.RecordBatch.from_arrays(columns, ["url", "thumbnail", *_FIELDS])

    raw = pages.select("url", "thumbnail", "html").mapInArrow(run, "url string, thumbnail string, " + ", ".join(f"{f} string" for f in _FIELDS))
    text = lambda c: F.coalesce(c, F.lit(""))
    return raw.select(
        "url",
        "thumbnail",
        text(F.col("siteName")).alias("source"),
        text(F.col("publishedTime")).alias("publishedAt"),
        text(F.col("title")).alias("title"),
        text(F.col("byline")).alias("author"),
        text(F.col("lang")).alias("lang"),
        text(F.col("excerpt")).alias("description"),
        text(F.col("textContent")).alias("content"),
    )
