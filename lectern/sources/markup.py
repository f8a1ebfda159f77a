"""XHTML / HTML documents to ordered text blocks, and navigation lists to TOC rows.

The parser is a small per-document helper; Spark splits and moves the documents.
"""

from __future__ import annotations

import posixpath
import re
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import durable

HEADINGS = {f"h{i}": i for i in range(1, 7)}
BLOCK_TAGS = set(HEADINGS) | set(
    "address article aside blockquote body caption dd div dl dt figcaption figure footer form header hr li main nav "
    "ol p pre section table tbody td tfoot th thead tr ul".split()
)
HIDDEN = {"script", "style", "head", "title", "template", "noscript"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())

BLOCK_FIELDS = (
    "ord bigint, kind string, text string, level bigint, footnote_id string, node_id bigint, "
    "image struct<src:string,resolved_path:string,alt:string,title:string>, anchors array<string>, "
    "links array<struct<fragment:string,kind:string>>"
)


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.blocks: list[dict] = []
        self.text: list[str] = []
        self.links: list[dict] = []
        self.loose_ids: list[str] = []
        self.hidden = 0
        self.href: str | None = None

    # -- element handling
    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in HIDDEN:
            self.hidden += 1
            return
        if self.hidden:
            return
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCK_TAGS:
            self._boundary()
            self._imply_end(tag)
        if tag == "img":
            self._image(attrs)
        if tag == "a":
            self._link(attrs)
        if tag in VOID:
            return
        kinds = (attrs.get("epub:type") or "").split() + (attrs.get("role") or "").split()
        node = {
            "tag": tag,
            "id": attrs.get("id"),
            "note": tag == "aside" and bool({"footnote", "endnote", "doc-footnote", "doc-endnote"} & set(kinds)),
            "image": None,
            "first": len(self.blocks),
        }
        if tag not in BLOCK_TAGS and node["id"] and not self._pending():
            self.loose_ids.append(node["id"])
        self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in HIDDEN:
            self.handle_endtag(tag)
        elif tag in HIDDEN:
            self.hidden -= 1

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            return
        if self.hidden or not any(n["tag"] == tag for n in self.open):
            return
        if tag in BLOCK_TAGS:
            self._boundary(closing=tag)
        while self.open:
            if self._leave()["tag"] == tag:
                break

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)

    def finish(self):
        self.close()
        while self.open:
            self._boundary(closing=self.open[-1]["tag"])
            self._leave()
        self._flush()
        return self.blocks

    # -- helpers
    def _pending(self):
        return "".join(self.text).strip()

    def _imply_end(self, tag):
        """An open paragraph ends at the next block, an open item at the next item."""
        if any(n["tag"] == "p" for n in self.open):
            while self.open:
                if self._leave()["tag"] == "p":
                    break
        if tag == "li":
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i]["tag"] in ("ul", "ol"):
                    break
                if self.open[i]["tag"] == "li":
                    while len(self.open) > i:
                        self._leave()
                    break

    def _leave(self):
        node = self.open.pop()
        if node["tag"] == "figure" and node["image"]:
            for block in self.blocks[node["first"] :]:
                if block["kind"] in ("paragraph", "list", "list-item", "blockquote") and block["image"] is None:
                    block["kind"], block["image"] = "image-caption", node["image"]
        return node

    def _boundary(self, closing=None):
        inside_note = any(n["note"] for n in self.open)
        if inside_note and not (closing == "aside" and self.open[-1]["note"]):
            self.text.append(" ")
            return
        self._flush()

    def _image(self, attrs):
        src = attrs.get("src")
        image = {"src": src, "resolved_path": resolved(self.href, src), "alt": attrs.get("alt"), "title": attrs.get("title")}
        for node in self.open:
            if node["tag"] == "figure" and node["image"] is None:
                node["image"] = image

    def _link(self, attrs):
        href = attrs.get("href") or ""
        kinds = (attrs.get("epub:type") or "").split() + (attrs.get("role") or "").split()
        if "#" in href:
            kind = "footnote" if {"noteref", "doc-noteref"} & set(kinds) else "internal"
            self.links.append({"fragment": href.split("#", 1)[1], "kind": kind})

    def _flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if not text:
            return
        kind, level, note = "paragraph", None, None
        for node in self.open:
            tag = node["tag"]
            if tag in ("ul", "ol"):
                kind = "list"
            elif tag == "li":
                kind = kind if kind == "blockquote" else "list-item"
            elif tag == "blockquote":
                kind = "blockquote"
            elif tag in HEADINGS:
                kind, level = "heading", HEADINGS[tag]
            if node["note"]:
                kind, note = "footnote", node["id"]
                break
        index = len(self.blocks)
        anchors = [n["id"] for n in self.open if n["id"] and n["first"] == index] + self.loose_ids
        self.blocks.append(
            {
                "ord": index,
                "kind": kind,
                "text": text,
                "level": level,
                "footnote_id": note,
                "node_id": index,
                "image": None,
                "anchors": anchors,
                "links": self.links,
            }
        )
        self.links, self.loose_ids = [], []


def resolved(href: str | None, src: str | None) -> str | None:
    """Path in the package of what a document at ``href`` refers to; addresses with a scheme stay as they are."""
    if not src or href is None or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", src):
        return src
    path = unquote(src.split("#", 1)[0].split("?", 1)[0])
    if path.startswith("/"):
        return posixpath.normpath(path).lstrip("/")
    return posixpath.normpath(posixpath.join(posixpath.dirname(href), path))


def parse_blocks(html: str, href: str | None = None) -> list[dict]:
    parser = _Blocks()
    parser.href = href
    parser.feed(html or "")
    return parser.finish()


def extract_blocks(docs: DataFrame, keys: list[str], html: str = "html", href: str | None = None) -> DataFrame:
    """One row per text block of each document, in document order.

    With ``href``, the column of the document's own path in its package, images
    get their path in the package.
    """
    key_schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            rows = []
            places = [None] * len(pdf) if href is None else pdf[href]
            for place, *record in zip(places, *[pdf[k] for k in keys], pdf[html]):
                for block in parse_blocks(record[-1], place):
                    rows.append(dict(zip(keys, record)) | block)
            yield pd.DataFrame(rows, columns=[*keys, *_names()], dtype=object)

    return docs.select(*dict.fromkeys([*keys, html, *([href] if href else [])])).mapInPandas(run, f"{key_schema}, {BLOCK_FIELDS}")


def _names():
    return ["ord", "kind", "text", "level", "footnote_id", "node_id", "image", "anchors", "links"]


class _Nav(HTMLParser):
    """Collects every nav element as a list of entries."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.navs: list[dict] = []
        self.stack: list[dict] = []
        self.label: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "nav":
            self.navs.append({"type": attrs.get("epub:type") or attrs.get("type"), "roots": [], "open": True})
            self.stack = []
        elif self._inside():
            if tag == "li":
                self.stack.append({"label": "", "href": "", "children": []})
            elif tag == "a" and self.stack:
                self.stack[-1]["href"] = attrs.get("href") or ""
                self.label = []

    def handle_endtag(self, tag):
        if not self._inside():
            return
        if tag == "a" and self.label is not None:
            self.stack[-1]["label"] = " ".join("".join(self.label).split())
            self.label = None
        elif tag == "li" and self.stack:
            self._close_item()
        elif tag == "nav":
            while self.stack:
                self._close_item()
            self.navs[-1]["open"] = False

    def handle_data(self, data):
        if self.label is not None:
            self.label.append(data)

    def _inside(self):
        return bool(self.navs) and self.navs[-1]["open"]

    def _close_item(self):
        entry = self.stack.pop()
        if entry["label"].strip() and entry["href"].strip():
            (self.stack[-1]["children"] if self.stack else self.navs[-1]["roots"]).append(entry)


def parse_toc(html: str) -> list[tuple]:
    """(path, depth, label, href, is_leaf) in depth-first order.

    The first nav that is untyped or of type ``toc`` counts, else the first nav.
    """
    parser = _Nav()
    parser.feed(html or "")
    navs = [n for n in parser.navs if not n["open"]]
    chosen = next((n for n in navs if n["type"] in (None, "toc")), navs[0] if navs else None)
    rows: list[tuple] = []

    def walk(entries, path):
        for i, entry in enumerate(entries):
            here = [*path, i]
            rows.append((here, len(here), entry["label"], entry["href"], not entry["children"]))
            walk(entry["children"], here)

    if chosen:
        walk(chosen["roots"], [])
    return rows


def parse_ncx(xml: str) -> list[tuple]:
    """The same rows from a package's own navigation document (nested navPoint elements)."""
    from xml.etree import ElementTree

    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    root = ElementTree.fromstring(xml)
    rows: list[tuple] = []

    def entries(parent):
        made = []
        for point in (e for e in parent if local(e) == "navPoint"):
            label = next((" ".join("".join(e.itertext()).split()) for e in point if local(e) == "navLabel"), "")
            href = next((e.get("src") or "" for e in point if local(e) == "content"), "")
            if label and href.strip():
                made.append((label, href, entries(point)))
        return made

    def walk(found, path):
        for i, (label, href, children) in enumerate(found):
            rows.append(([*path, i], len(path) + 1, label, href, not children))
            walk(children, [*path, i])

    walk([x for nav in root.iter() if local(nav) == "navMap" for x in entries(nav)], [])
    return rows


def package_toc(documents: DataFrame) -> DataFrame:
    """Contents of every book from rows of the EPUB source: its nav document, else the package's navigation.

    A book whose nav document has no entries falls back too.
    """
    navs = documents.where("is_nav and html is not null").select(
        "path", (F.col("media_type") == "application/x-dtbncx+xml").alias("own"), F.col("idref"), "html"
    )
    # Stored: the files would be read twice, for the choice and for the entries.
    found = durable(extract_toc(navs, ["path", "own", "idref"]))
    chosen = found.groupBy("path").agg(F.min(F.struct("own", "idref")).alias("first")).select("path", "first.*")
    return found.join(chosen, ["path", "own", "idref"]).select(
        F.col("path").alias("book"), "pos", F.col("path_in_tree").alias("path"), "depth", "label", "href", "is_leaf"
    )


def extract_toc(docs: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Navigation entries as flat rows with their path and depth-first position.

    XHTML navigation or NCX, by what a document holds.  Where ``path`` is a key the
    place in the tree is ``path_in_tree``.
    """
    place = "path_in_tree" if "path" in keys else "path"
    key_schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            rows = []
            for record in zip(*[pdf[k] for k in keys], pdf[html]):
                parse = parse_ncx if "<navMap" in (record[-1] or "") or ":navMap" in (record[-1] or "") else parse_toc
                rows += [(*record[:-1], pos, *entry) for pos, entry in enumerate(parse(record[-1]))]
            yield pd.DataFrame(rows, columns=[*keys, "pos", place, "depth", "label", "href", "is_leaf"], dtype=object)

    schema = f"{key_schema}, pos bigint, {place} array<int>, depth bigint, label string, href string, is_leaf boolean"
    return docs.select(*keys, html).mapInPandas(run, schema)
