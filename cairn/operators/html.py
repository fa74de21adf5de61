"""Structured extraction from HTML in one parser pass: links, tables, JSON-LD, metadata, elements to watch.

The standard parser is a tokeniser; a small tree keeps text, visibility and source offsets. Hidden parts (``hidden``,
``aria-hidden``, inline styles, script, style, noscript, template) give neither links nor tables.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



@dataclass(frozen=True)
class Limits:
    """Bounds of what is taken from a page, for responses of bounded size; none by default. A page that meets one is ``truncated``."""

    chars: int | None = None
    links: int | None = None
    tables: int | None = None
    rows: int | None = None
    cells: int | None = None
    json_ld_bytes: int | None = None
    items: int | None = None
    per_field: int | None = None
    candidates: int | None = None


#: The bounds that an interactive service uses.
SERVICE_LIMITS = Limits(1 << 20, 100, 20, 100, 1000, 1 << 16, 4, 8, 48)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style noscript template".split())
#: Elements with an implied role.
ROLES = {"a": "link", "button": "button", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "nav": "navigation", "main": "main", "table": "table", "img": "img", "article": "article", "form": "form"}
ARTICLES, PRODUCT = ("Article", "NewsArticle", "BlogPosting", "TechArticle", "Report"), "Product"
METADATA_NAMES = {"author": "author", "article:author": "author", "description": "description", "og:title": "title", "og:url": "declared_canonical_url", "article:published_time": "published_at", "article:modified_time": "modified_at", "date": "published_at", "last-modified": "modified_at", "og:locale": "language"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "texts", "hidden", "start", "end")

    def __init__(self, tag: str, attrs: dict, parent: Node | None, hidden: bool, start: int):
        self.tag, self.attrs, self.parent, self.hidden, self.start, self.end = tag, attrs, parent, hidden, start, start
        self.children: list[Node] = []
        self.texts: list[str | Node] = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def text(self, seen_only: bool = True) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif not (seen_only and x.hidden):
                stack.extend(reversed(x.texts))
        return " ".join("".join(out).split())


def _is_hidden(tag: str, attrs: dict) -> bool:
    style = (attrs.get("style") or "").replace(" ", "").lower()
    return tag in UNSEEN or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


class Tree(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0]
        for m in re.finditer("\n", source):
            self.lines.append(m.end())
        self.source = source
        self.root = self.here = Node("", {}, None, False, 0)
        try:
            self.feed(source)
            self.close()
        except (AssertionError, ValueError):
            pass

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        node = Node(tag, a, self.here, self.here.hidden or _is_hidden(tag, a), self._at())
        node.end = node.start + len(self.get_starttag_text() or "")
        self.here.children.append(node)
        self.here.texts.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.here = self.here.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        node = self.here
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is self.root:
            return
        close = self.source.find(">", self._at())
        while True:
            last, self.here = self.here, self.here.parent
            last.end = close + 1 if close >= 0 else len(self.source)
            if last is node:
                return

    def handle_data(self, data: str) -> None:
        self.here.texts.append(data)


def links(tree: Node, base: str) -> list[tuple]:
    """Visible links to http(s) targets: href, text, title, rel, external, start, end."""
    out, home = [], urlsplit(base).hostname
    for n in tree.walk():
        if n.tag != "a" or n.hidden or not n.attrs.get("href", "").strip():
            continue
        try:
            href = urljoin(base, n.attrs["href"].strip())
            parts = urlsplit(href)
        except ValueError:
            continue
        if parts.scheme in ("http", "https") and parts.hostname:
            out.append((href, n.text(), n.attrs.get("title"), n.attrs.get("rel"), parts.hostname != home, n.start, n.end))
    return out


def _span(value: str | None) -> int:
    return min(100, max(1, int(value))) if value and value.strip().isdigit() else 1


def tables(tree: Node, limits: Limits = Limits()) -> list[tuple]:  # noqa: B008
    """(table, row, column, header, text, rowspan, colspan) of visible tables."""
    out = []
    for k, table in enumerate([n for n in tree.walk() if n.tag == "table" and not n.hidden][: limits.tables]):
        cells = 0
        for r, row in enumerate([n for n in table.walk() if n.tag == "tr" and not n.hidden][: limits.rows]):
            for c, cell in enumerate(x for x in row.children if x.tag in ("td", "th")):
                cells += 1
                if limits.cells is None or cells <= limits.cells:
                    out.append((k, r, c, cell.tag == "th", cell.text(), _span(cell.attrs.get("rowspan")), _span(cell.attrs.get("colspan"))))
    return out


def flat(value: object, depth: int = 0, items: int | None = None) -> str | None:
    """Text of a JSON-LD value: scalars, name/@value/@id of objects, the items of lists (the first ``items``)."""
    if depth > 4 or value is None or isinstance(value, bool):
        return None
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, (int, float)):
        return str(value) if value == value and abs(value) != float("inf") else None
    if isinstance(value, list):
        parts = [x for x in (flat(v, depth + 1, items) for v in value[:items]) if x]
        return ", ".join(parts) or None
    if isinstance(value, dict):
        return next((x for x in (flat(value.get(k), depth + 1, items) for k in ("name", "@value", "@id")) if x), None)
    return None


def json_ld(tree: Node, limits: Limits = Limits()) -> list[dict]:  # noqa: B008
    """Article and product objects of JSON-LD scripts, @graph included."""
    out = []
    for n in tree.walk():
        if n.tag == "script" and "ld+json" in n.attrs.get("type", ""):
            body = "".join(x for x in n.texts if isinstance(x, str))
            if limits.json_ld_bytes is not None and len(body.encode("utf-8", "surrogatepass")) > limits.json_ld_bytes:
                continue
            try:
                roots = json.loads(body)
            except (ValueError, RecursionError):
                continue
            for root in roots if isinstance(roots, list) else [roots]:
                graph = root.get("@graph") if isinstance(root, dict) else None
                for x in graph if isinstance(graph, list) else [root]:
                    if isinstance(x, dict):
                        kinds = x.get("@type") if isinstance(x.get("@type"), list) else [x.get("@type")]
                        if any(k in (*ARTICLES, PRODUCT) for k in kinds):
                            out.append(x)
    return out


def metadata(tree: Node, base: str, limits: Limits = Limits()) -> list[tuple[str, str, str]]:  # noqa: B008
    """(field, value, source) candidates from title, language, meta, canonical links and JSON-LD; repeated ones once."""
    out: list[tuple[str, str, str]] = []
    known: set[tuple[str, str, str]] = set()
    per_field: dict[str, int] = {}

    def add(field: str, value: object, source: str) -> None:
        text = " ".join((flat(value, items=limits.items) or "").split())
        full = (limits.per_field is not None and per_field.get(field, 0) >= limits.per_field) or (limits.candidates is not None and len(out) >= limits.candidates)
        if text and (field, text, source) not in known and not full:
            known.add((field, text, source))
            per_field[field] = per_field.get(field, 0) + 1
            out.append((field, text, source))

    for n in tree.walk():
        if n.tag == "title" and n.parent is not None and n.parent.tag in ("head", "html", ""):
            add("title", n.text(seen_only=False), "html_title")
        elif n.tag == "html" and n.attrs.get("lang"):
            add("language", n.attrs["lang"].lower(), "html_lang")
        elif n.tag == "meta":
            name = (n.attrs.get("name") or n.attrs.get("property") or "").lower()
            if name in METADATA_NAMES:
                add(METADATA_NAMES[name], n.attrs.get("content"), "html_meta")
        elif n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split():
            target = urljoin(base, n.attrs.get("href", ""))
            if urlsplit(target).scheme in ("http", "https"):
                add("declared_canonical_url", target, "html_canonical")
    for x in json_ld(tree, limits):
        for field, keys in (("title", ("headline", "name")), ("author", ("author",)), ("published_at", ("datePublished",)), ("modified_at", ("dateModified",)), ("language", ("inLanguage",)), ("declared_canonical_url", ("url",))):
            for k in keys:
                add(field, x.get(k), "json_ld")
    return out


CSS = re.compile(r"(?:[a-z][a-z0-9-]*|\*)?(?:#[\w-]+|\.[\w-]+|\[[\w-]+(?:=(?:\"[^\"]*\"|'[^']*'|[\w-]+))?\])*", re.I)


def locate(tree: Node, css: str | None = None, role: str | None = None, name: str | None = None, text: str | None = None, section: str | None = None) -> tuple[str, str | None, dict]:
    """(state, text, attributes) of the one element meant: by compound selector, role and name, or text in a section."""
    nodes = [n for n in tree.walk() if n.tag and not n.hidden]
    if css is not None:
        css = css.strip()
        if not css or not CSS.fullmatch(css):
            return "unsupported", None, {}
        attrs = [a.partition("=") for a in re.findall(r"\[([^\]]*)\]", css)]
        bare = re.sub(r"\[[^\]]*\]", "", css)
        tag, ids, classes = re.match(r"[\w*-]*", bare).group().lower(), re.findall(r"#([\w-]+)", bare), re.findall(r"\.([\w-]+)", bare)
        hits = [
            n for n in nodes
            if tag in ("", "*", n.tag) and all(n.attrs.get("id") == i for i in ids) and set(classes) <= set(n.attrs.get("class", "").split())
            and all(k in n.attrs and (not eq or n.attrs[k] == v.strip("\"'")) for k, eq, v in attrs)
        ]
    elif role is not None:
        hits = [n for n in nodes if (n.attrs.get("role") or ROLES.get(n.tag)) == role and (name is None or (n.attrs.get("aria-label") or n.text()).lower() == " ".join(name.split()).lower())]
    elif text is not None:
        wanted, current, hits = " ".join(text.split()), None, []
        for n in nodes:
            if ROLES.get(n.tag) == "heading":
                current = n.text()
            if n.text() == wanted and not any(c.text() == wanted for c in n.children) and (section is None or current == section):
                hits.append(n)
    else:
        return "unsupported", None, {}
    if len(hits) != 1:
        return "missing" if not hits else "ambiguous", None, {}
    return "found", hits[0].text(), dict(hits[0].attrs)


LINK = T.StructType([T.StructField(n, k) for n, k in (("href", T.StringType()), ("text", T.StringType()), ("title", T.StringType()), ("rel", T.StringType()), ("external", T.BooleanType()), ("start_index", T.IntegerType()), ("end_index", T.IntegerType()))])
CELL = T.StructType([T.StructField(n, k) for n, k in (("table_no", T.IntegerType()), ("row_no", T.IntegerType()), ("column_no", T.IntegerType()), ("header", T.BooleanType()), ("text", T.StringType()), ("rowspan", T.IntegerType()), ("colspan", T.IntegerType()))])
CANDIDATE = T.StructType([T.StructField(n, T.StringType()) for n in ("field_name", "value", "source")])


def extract(pages: DataFrame, id_col: str, html_col: str, url_col: str, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """id, status and the arrays ``links``, ``cells`` and ``candidates``; every page is parsed once.

    ``status``: ok, empty (no body), or truncated where one of ``limits`` left something out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, source, base in zip(b["_id"], b["_h"], b["_u"], strict=True):
                if not source or not source.strip():
                    rows.append((key, "empty", [], [], []))
                    continue
                tree = Tree(source[: limits.chars]).root
                named = lambda kind, items: [dict(zip(kind.names, x, strict=True)) for x in items]
                every = links(tree, base or ""), tables(tree), metadata(tree, base or "")
                kept = every if limits == Limits() else (every[0][: limits.links], tables(tree, limits), metadata(tree, base or "", limits))
                cut = limits.chars is not None and len(source) > limits.chars or any(len(a) < len(b) for a, b in zip(kept, every, strict=True))
                rows.append((key, "truncated" if cut else "ok", named(LINK, kept[0]), named(CELL, kept[1]), named(CANDIDATE, kept[2])))
            yield pd.DataFrame(rows, columns=[id_col, "status", "links", "cells", "candidates"])

    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("status", T.StringType()), T.StructField("links", T.ArrayType(LINK)), T.StructField("cells", T.ArrayType(CELL)), T.StructField("candidates", T.ArrayType(CANDIDATE))])
    return pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_h"), F.col(url_col).alias("_u")).mapInPandas(run, schema)


def watch(pages: DataFrame, id_col: str, html_col: str, **locator: str | None) -> DataFrame:
    """id, state and text of a watched element on every page; the whole page is parsed, so no match is missed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [locate(Tree(h).root, **locator)[:2] if h else ("missing", None) for h in b["_h"]]
            yield pd.DataFrame({id_col: b["_id"], "state": [f[0] for f in found], "text": [f[1] for f in found]})

    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("state", T.StringType()), T.StructField("text", T.StringType())])
    return pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_h")).mapInPandas(run, schema)


def metadata_choice(candidates: DataFrame, keys: list[str], ranks: DataFrame, rank_keys: list[str]) -> DataFrame:
    """Per group the candidate of the best source (then source, then value) and whether several values compete."""
    ranked = candidates.join(ranks.groupBy(*rank_keys).agg(F.min("source_rank").alias("_r")), rank_keys, "left")
    order = F.struct(F.coalesce("_r", F.lit(1 << 30)).alias("r"), F.coalesce("source", F.lit("~")).alias("source"), F.col("value").alias("value"))
    return ranked.filter("value IS NOT NULL").groupBy(*keys).agg(F.min(order).alias("_b"), F.count_distinct("value").alias("n_values")).select(*keys, F.col("_b.value").alias("value"), F.col("_b.source").alias("source"), (F.col("n_values") > 1).alias("conflict"))
