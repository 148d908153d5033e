"""HTML and plain text as documents: text with links, and blocks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..functions.spans import exploded
from ..functions.text import WS, trim_url

# Tags by what they mean for text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = {"script", "style", "head", "title", "noscript"}
BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "table", "blockquote", "pre", "figure", "figcaption", "section", "article"}
KEPT = {"b", "strong", "i", "em", "u", "code", "sub", "sup", "mark"}
# Entities of text nodes; the order is part of the meaning.
ENTITIES = [("&nbsp;|&#160;", " "), ("&amp;|&#38;", "&"), ("&lt;|&#60;", "<"), ("&gt;|&#62;", ">"), ("&quot;|&#34;", '"'), ("&#0?39;|&apos;|&rsquo;|&#8217;", "'"), ("&mdash;|&#8212;|&ndash;|&#8211;", " "), ("&hellip;|&#8230;", "...")]
# (types are spelled out, as workers that import this module have no session to parse them)
_S, _I = StringType(), IntegerType()
LINK = StructType([StructField("href", _S), StructField("anchor_text", _S), StructField("offset", _I)])
EXTRACTED = StructType([StructField("text", _S), StructField("links", ArrayType(LINK)), StructField("format", _S), StructField("inline_boundaries", ArrayType(_I))])
BLOCK = ArrayType(StructType([StructField("type", _S), StructField("level", _I), StructField("ordered", BooleanType()), StructField("text", _S), StructField("items", ArrayType(_S)), StructField("rows", ArrayType(ArrayType(_S))), StructField("src", _S), StructField("caption", _S)]))


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def find(self, *tags: str):
        """Descendants with one of the tags, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            if n.tag in tags:
                yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs})
        if tag in ("p", "li", "tr", "td", "th") and self.open[-1].tag == tag:
            self.open.pop()  # these close themselves
        self.open[-1].children.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def _text(self, text):
        own = self.open[-1].children
        if own and isinstance(own[-1], str):
            own[-1] += text
        else:
            own.append(text)

    def handle_data(self, data):
        self._text(data)

    def handle_entityref(self, name):
        self._text(f"&{name};")

    def handle_charref(self, name):
        self._text(f"&#{name};")


def tree(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def decoded(text: str) -> str:
    for pattern, to in ENTITIES:
        text = re.sub(pattern, to, text)
    text = re.sub(r"&#(\d+);", lambda m: chr(int(m[1])) if 31 < int(m[1][:8]) < 0x110000 else " ", text)
    return re.sub("(?i)&[a-z]+;", " ", text)


def extract(html: str) -> tuple[str, list[tuple[str, str, int]], list[int]]:
    """Text, links and the places where inline markup joins text without a space (places in the final text)."""
    out: list[str] = []
    size = 0
    links: list[tuple[str, int, int]] = []
    joints: list[int] = []
    last = ""

    def add(s: str) -> None:
        nonlocal size, last
        if s:
            out.append(s)
            size += len(s)
            last = s[-1]

    def walk(n) -> None:
        if isinstance(n, str):
            t = re.sub(r"\s+", " ", decoded(n))
            if t.strip():
                add(t)
            elif t and size and not last.isspace():
                add(" ")
            return
        if n.tag in SKIPPED:
            return
        if n.tag == "br":
            add("\n")
            return
        start, before = size, last
        for c in n.children:
            walk(c)
        if n.tag == "a":
            links.append((n.attrs.get("href", "").strip(), start, size))
        elif n.tag in BLOCKS:
            if size and last != "\n":
                add("\n")
        elif n.tag and size > start:
            if start and not before.isspace():
                joints.append(start)
            joints.append(size)

    walk(tree(html))
    raw = "".join(out)
    # cleaning, with a map of places
    gone = sorted({i for m in re.finditer(r"[ \t]+(?=\n)", raw) for i in range(m.start(), m.end())})
    kept = [i for i in range(len(raw)) if i not in set(gone)] if gone else list(range(len(raw)))
    text = "".join(raw[i] for i in kept) if gone else raw
    more = sorted({i for m in re.finditer(r"\n{3,}", text) for i in range(m.start() + 2, m.end())})
    if more:
        drop = set(more)
        kept = [k for i, k in enumerate(kept) if i not in drop]
        text = "".join(c for i, c in enumerate(text) if i not in drop)
    text = text.rstrip()
    import bisect

    place = lambda p: min(bisect.bisect_left(kept, p), len(text))
    found = [(href, raw[a:b].strip(), a) for href, a, b in links]
    anchored = []
    for href, anchor, a in found:
        if href and anchor:
            at = place(a)
            if not text.startswith(anchor, at):
                near = text.find(anchor, max(0, at - 64))
                at = near if near >= 0 else at
            anchored.append((href, anchor, at))
    return text, anchored, sorted({place(j) for j in joints})


def _escape(t: str) -> str:
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def inline(n: Node) -> str:
    """Text of a node with the kept inline tags; raw text is escaped."""
    out = ""
    for c in n.children:
        if isinstance(c, str):
            out += _escape(c)
        elif c.tag == "br":
            out += " "
        else:
            inner = inline(c)
            out += f"<{c.tag}>{inner}</{c.tag}>" if c.tag in KEPT else inner
    return re.sub("[ \t]+", " ", out).strip()


def _raw(n: Node) -> str:
    return "".join(c if isinstance(c, str) else _raw(c) for c in n.children)


def to_blocks(html: str) -> list[dict]:
    out: list[dict] = []

    def image(n: Node) -> None:
        if n.attrs.get("src"):
            out.append({"type": "image", "src": n.attrs["src"], "caption": n.attrs.get("alt") or None})

    def walk(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                if c.strip():
                    out.append({"type": "paragraph", "text": _escape(c.strip())})
            elif re.fullmatch("h[1-6]", c.tag):
                if text := inline(c):
                    out.append({"type": "heading", "level": min(3, int(c.tag[1])), "text": text})
            elif c.tag == "p":
                for img in list(c.find("img"))[:1]:
                    image(img)
                if text := inline(c):
                    out.append({"type": "paragraph", "text": text})
            elif c.tag in ("ul", "ol"):
                items = [x for x in map(inline, c.find("li")) if x]
                if items:
                    out.append({"type": "list", "ordered": c.tag == "ol", "items": items})
            elif c.tag == "blockquote":
                if text := inline(c):
                    out.append({"type": "quote", "text": text})
            elif c.tag == "pre":
                if (text := decoded(_raw(c))).strip():
                    out.append({"type": "code", "text": text})
            elif c.tag == "table":
                rows = [r for r in ([inline(d) for d in tr.find("th", "td")] for tr in c.find("tr")) if r]
                if rows:
                    out.append({"type": "table", "rows": rows})
            elif c.tag == "img":
                image(c)
            elif c.tag != "br":
                walk(c)

    walk(tree(html))
    return out


FIELDS = ("type", "level", "ordered", "text", "items", "rows", "src", "caption")


@F.pandas_udf(BLOCK)
def _blocks(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [{f: b.get(f) for f in FIELDS} for b in to_blocks(h or "")])


@F.pandas_udf(EXTRACTED)
def _extract(html: pd.Series) -> pd.DataFrame:
    rows = [extract(h or "") for h in html]
    return pd.DataFrame({"text": [r[0] for r in rows], "links": [[{"href": a, "anchor_text": b, "offset": c} for a, b, c in r[1]] for r in rows], "format": "html", "inline_boundaries": [r[2] for r in rows]})


def looks_like_html(content: str | Column) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return c.rlike(rf"(?i)<[a-z][a-z0-9-]*([{WS}][^>]*)?>")


def html_blocks(pages: DataFrame, html: str = "html", key: str = "doc_id") -> DataFrame:
    b = pages.select(key, F.posexplode(_blocks(html)).alias("block_no", "b"))
    return b.select(key, "block_no", *[f"b.{f}" for f in FIELDS])


def extract_html(docs: DataFrame, html: str = "content", key: str = "doc_id") -> DataFrame:
    return docs.select(key, _extract(html).alias("x")).select(key, "x.*")


MD_LINK = rf"\[[^\]]+\]\([^){WS}]+\)"
BARE_URL = rf"https?://[^{WS}<>()\[\]]+"


def plain_links(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, href, anchor_text, offset): Markdown links, and bare URLs outside them."""
    m = exploded(docs, text, MD_LINK, "doc_id")
    md = m.select("doc_id", trim_url(F.regexp_extract("text", rf"\]\(([^){WS}]+)\)$", 1)).alias("href"), F.trim(F.regexp_extract("text", r"^\[([^\]]+)\]", 1)).alias("anchor_text"), F.col("start").alias("offset"))
    u = exploded(docs, text, BARE_URL, "doc_id").alias("u")
    inside = (F.col("u.doc_id") == F.col("m.doc_id")) & (F.col("u.start") >= F.col("m.start")) & (F.col("u.start") < F.col("m.end"))
    bare = u.join(m.alias("m"), inside, "left_anti").select("doc_id", trim_url("text").alias("href"), trim_url("text").alias("anchor_text"), F.col("start").alias("offset"))
    return md.unionByName(bare)


def extract_content(docs: DataFrame) -> DataFrame:
    """(doc_id, text, format, inline_boundaries) of docs (doc_id, content, format: auto, plain or html);
    blank content is empty plain text. Only HTML goes through Python."""
    kind = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty").when(F.col("format") == "plain", "plain").when((F.col("format") == "html") | looks_like_html("content"), "html").otherwise("plain")
    d = docs.select("doc_id", "content", kind.alias("kind"))
    none = F.array().cast("array<int>")
    plain = d.where("kind <> 'html'").select("doc_id", F.when(F.col("kind") == "empty", "").otherwise(F.col("content")).alias("text"), F.lit("plain").alias("format"), none.alias("inline_boundaries"))
    return extract_html(d.where("kind = 'html'")).select("doc_id", "text", "format", "inline_boundaries").unionByName(plain)
