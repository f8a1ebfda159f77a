"""Writes rows as EPUB archives, so that the EPUB source has something to read."""

from __future__ import annotations

import io
import zipfile
from functools import cache
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame

# Namespaces and media types that the format prescribes.
NS = {
    "container": "urn:oasis:names:tc:opendocument:xmlns:container",
    "opf": "http://www.idpf.org/2007/opf",
    "dc": "http://purl.org/dc/elements/1.1/",
    "ncx": "http://www.daisy.org/z3986/2005/ncx/",
}
PACKAGE_TYPE, PAGE_TYPE, NCX_TYPE = "application/oebps-package+xml", "application/xhtml+xml", "application/x-dtbncx+xml"
FOLDER = "book"
QUOTED = {'"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"}
SMALL = 256  # bytes of a member up to which it is stored as it is: packing it costs more time than it saves room


def _tree(tag: str, ns: str, **attributes: str) -> ET.Element:
    return ET.Element(f"{{{NS[ns]}}}{tag}", attributes)


def _add(parent: ET.Element, tag: str, ns: str, text: str | None = None, **attributes: str) -> ET.Element:
    child = ET.SubElement(parent, f"{{{NS[ns]}}}{tag}", attributes)
    child.text = text
    return child


def document(content: str) -> str:
    """A page around ready markup."""
    return f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body>{content}</body></html>'


@cache
def _container() -> bytes:
    root = _tree("container", "container", version="1.0")
    files = _add(root, "rootfiles", "container")
    _add(files, "rootfile", "container", **{"full-path": f"{FOLDER}/package.opf", "media-type": PACKAGE_TYPE})
    return ET.tostring(root)


def _package(title: str, names: list[str], own_navigation: bool) -> bytes:
    about = "".join(f"<dc:{field}>{escape(value)}</dc:{field}>" for field, value in (("title", title), ("identifier", "rows"), ("language", "en")))
    if own_navigation:
        listed, toc = f'<item id="ncx" href="toc.ncx" media-type="{NCX_TYPE}"/>', ' toc="ncx"'
    else:
        listed, toc = f'<item id="contents" href="contents.xhtml" media-type="{PAGE_TYPE}" properties="nav"/>', ""
    names = [escape(name, QUOTED) for name in names]
    listed += "".join(f'<item id="{name}" href="{name}.xhtml" media-type="{PAGE_TYPE}"/>' for name in names)
    order = "".join(f'<itemref idref="{name}"/>' for name in names)
    return (
        f'<package xmlns="{NS["opf"]}" xmlns:dc="{NS["dc"]}" version="3.0"><metadata>{about}</metadata>'
        f"<manifest>{listed}</manifest><spine{toc}>{order}</spine></package>"
    ).encode()


def navigation(entries: list[tuple[str, str]]) -> bytes:
    """A package's own navigation document, one level."""
    points = "".join(
        f'<navPoint id="p{i}"><navLabel><text>{escape(label)}</text></navLabel><content src="{escape(href, QUOTED)}"/></navPoint>'
        for i, (label, href) in enumerate(entries)
    )
    return f'<ncx xmlns="{NS["ncx"]}" version="2005-1"><navMap>{points}</navMap></ncx>'.encode()


def archive(title: str, pages: dict[str, str], contents: str = "", ncx: bytes | None = None) -> bytes:
    """EPUB bytes: a page per (name, markup) in spine order, and the markup of the contents page or an NCX instead."""
    parts = {"META-INF/container.xml": _container(), f"{FOLDER}/package.opf": _package(title, list(pages), ncx is not None)}
    held = pages if ncx is not None else {"contents": contents, **pages}
    parts |= {f"{FOLDER}/{name}.xhtml": document(markup) for name, markup in held.items()}
    if ncx is not None:
        parts[f"{FOLDER}/toc.ncx"] = ncx
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as book:
        for path, data in parts.items():
            book.writestr(path, data, zipfile.ZIP_STORED if len(data) <= SMALL else zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def paragraph(text: str) -> str:
    return f"<p>{escape(text if text.isprintable() else ''.join(c for c in text if c.isprintable()))}</p>"


def write_archives(rows: DataFrame, folder: str, folders: int = 1) -> int:
    """rows(name, texts array<string>, own_navigation) to files in ``folder``; a page of one paragraph per text.

    With ``folders`` the files are dealt by name over so many folders in it.

    Contents name every page by its number and its first 20 characters, in a nav
    document or the package's own navigation.  Each task writes its files.
    """

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made_places = {root}
        for batch in batches:
            for name, texts, own in zip(batch["name"], batch["texts"], batch["own_navigation"]):
                entries = [(f"{i}: {' '.join(t[:20].split())}", f"c{i}.xhtml") for i, t in enumerate(texts)]
                items = "".join(f"<li>{link(label, href)}</li>" for label, href in entries)
                made = archive(
                    name, {f"c{i}": paragraph(t) for i, t in enumerate(texts)}, f'<nav epub:type="toc"><ol>{items}</ol></nav>',
                    navigation(entries) if own else None,
                )
                place = root if folders == 1 else f"{root}/{crc32(str(name).encode()) % folders}"
                if place not in made_places:
                    store.create_dir(place, recursive=True)
                    made_places.add(place)
                with store.open_output_stream(f"{place}/{name}.epub") as out:
                    out.write(made)
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select("name", "texts", "own_navigation").mapInPandas(run, "n long").groupBy().sum("n").first()[0] or 0


def link(label: str, href: str) -> str:
    return f'<a href="{escape(href, QUOTED)}">{escape(label)}</a>'
