"""HTML pages to units, with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What is no content of a page.
BOILERPLATE_TAGS = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg", "iframe", "template", "button"}
BOILERPLATE_NAMES = re.compile(r"\b(?:nav|menu|footer|header|sidebar|breadcrumbs?|cookie|banner|share|social|ads?|advert\w*|promo|related|comments?)\b", re.IGNORECASE)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "li", "tr", "table", "ul", "ol", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dd", "dt", "body"}
HEADINGS = {"h1", "h2", "h3", "h4"}
CONTAINERS = {"div", "section", "article", "main", "td"}
LANDMARKS = {"main", "article"}
LEAST_LANDMARK, LEAST_SHARE = 120, 0.4


class Node:
    """An element: tag, attributes and children, of which strings are text."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        """The element and all below, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        """Text with a break around blocks and single blanks."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag == "br":
                out.append("\n")
            else:
                edge = ["\n"] if x.tag in BLOCKS else []
                stack += edge + x.children[::-1] + edge
        lines = [re.sub(r"\s+", " ", line).strip() for line in "".join(out).split("\n")]
        return "\n".join(line for line in lines if line)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def strip_boilerplate(root: Node) -> Node:
    """Takes out boilerplate, but never what a landmark stands in."""
    keep = set()
    for node in root.walk():
        if node.tag in LANDMARKS or node.attrs.get("role") == "main":
            while node is not None:
                keep.add(id(node))
                node = node.parent
    for node in list(root.walk()):
        names = " ".join(node.attrs.get(a, "") for a in ("class", "id", "role"))
        if node.parent is not None and id(node) not in keep and node.tag != "body" and (node.tag in BOILERPLATE_TAGS or BOILERPLATE_NAMES.search(names)):
            node.parent.children = [c for c in node.parent.children if c is not node]
    return root


def main_region(root: Node) -> Node:
    """A landmark with enough text, else of the containers with enough of all text the one with most text for
    each of its elements, else the body."""
    nodes = list(root.walk())
    for node in nodes:
        if (node.tag in LANDMARKS or node.attrs.get("role") == "main") and len(node.text()) >= LEAST_LANDMARK:
            return node
    body = next((n for n in nodes if n.tag == "body"), root)
    total = len(body.text())
    sizes = [(len(n.text()), n) for n in nodes if n.tag in CONTAINERS]
    dense = [(size / (1 + sum(1 for _ in n.walk())), n) for size, n in sizes if size >= max(LEAST_SHARE * total, LEAST_LANDMARK)]
    return max(dense, key=lambda x: x[0])[1] if dense else body  # the first of equals


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")[:60] or "section"


def table_text(node: Node) -> str:
    """One line for each row, cells joined by bars."""
    rows = [[c.text().replace("\n", " ") for c in r.walk() if c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
    return "\n".join(" | ".join(cells) for cells in rows if any(cells))


def units(html: str | None) -> list[dict]:
    """anchor, heading, kind and text: headings open units, tables stand alone."""
    out: list[dict] = []
    used: dict[str, int] = {}
    heading, lines = "", []

    def add(kind: str, text: str) -> None:
        if text:
            base = slug(heading) if heading else "top"
            used[base] = used.get(base, 0) + 1
            out.append({"anchor": base if used[base] == 1 else f"{base}.{used[base]}", "heading": heading, "kind": kind, "text": text})

    def visit(node: Node) -> None:
        nonlocal heading
        for c in node.children:
            if isinstance(c, str):
                lines.append(c)
            elif c.tag in HEADINGS:
                flush()
                heading = c.text().replace("\n", " ")
            elif c.tag == "table":
                flush()
                add("table", table_text(c))
            elif c.tag == "br":
                lines.append("\n")
            else:
                edge = "\n" if c.tag in BLOCKS else ""
                lines.append(edge)
                visit(c)
                lines.append(edge)

    def flush() -> None:
        text = "\n".join(x for x in (re.sub(r"\s+", " ", y).strip() for y in "".join(lines).split("\n")) if x)
        lines.clear()
        add("prose", text)

    visit(main_region(strip_boilerplate(parse(html))))
    flush()
    return out


def page_units(html: Column) -> Column:
    @F.pandas_udf("array<struct<anchor:string,heading:string,kind:string,text:string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(units)

    return run(html)


def page_text(html: Column) -> Column:
    """The main region's text."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: main_region(strip_boilerplate(parse(h))).text())

    return run(html)


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def doc_id(url: Column) -> Column:
    """The last two parts of a URL's path, joined by a hyphen."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(path, "/", -1), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), "-")


def canonical(url: Column) -> Column:
    return F.regexp_replace(F.lower(url), r"[?#].*$", "")
