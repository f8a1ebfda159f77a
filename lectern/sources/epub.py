"""EPUB files to spine documents: one output row per reading-order item.

Two readers of the same rows.  ``epub`` is a Spark data source: files are listed
once, dealt to partitions by size, and of each archive only its directory and the
members that are wanted are read.  ``read_epubs`` takes whole files from Spark's
``binaryFile`` source, for stores that only Spark's own readers can open.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith,
)

XHTML = ("application/xhtml+xml", "text/html")
NCX = "application/x-dtbncx+xml"
SCHEMA = (
    "path string, title string, identifier string, language string, spine_index bigint, idref string, href string, "
    "media_type string, linear boolean, is_nav boolean, html string, error string"
)
FIELDS = [part.strip().split(" ")[0] for part in SCHEMA.split(",")]
PARTITION_BYTES, FILE_COST = 64 << 20, 64 << 10
NAMED = 10_000  # files up to which the driver names each
LEAST_FILES, FEW_GROUPS = 64, 64  # a small folder is dealt to FEW_GROUPS groups of LEAST_FILES files or more


def _local(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _all(root, name):
    return _by_name(root).get(name, [])


def _by_name(root) -> dict[str, list]:
    """The elements of a tree by local name, in document order."""
    found: dict[str, list] = {}
    for e in root.iter():
        if isinstance(e.tag, str):
            found.setdefault(_local(e), []).append(e)
    return found


def book_rows(path: str, file, wanted=lambda row: True) -> list[dict]:
    """Spine documents in order, then navigation documents (XHTML or NCX), of a seekable file.

    Members are read one by one through the archive's directory; ``wanted``
    decides on a row without its text, before the member is read.
    """
    with zipfile.ZipFile(file) as archive:
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        package_path = _all(container, "rootfile")[0].get("full-path")
        package = _by_name(ElementTree.fromstring(archive.read(package_path)))
        folder = posixpath.dirname(package_path)

        def first(name):
            found = package.get(name)
            return "".join(found[0].itertext()).strip() if found else None

        base = {"path": path, "title": first("title"), "identifier": first("identifier"), "language": first("language")}
        manifest = {item.get("id"): item for item in package.get("item", [])}
        spine = package.get("itemref", [])
        rows = []

        def add(item, **fields):
            row = base | {"href": None, "media_type": None, "html": None, "error": None} | fields
            if item is not None:
                row["href"] = posixpath.normpath(posixpath.join(folder, unquote(item.get("href") or "")))
                row["media_type"] = item.get("media-type")
            if not wanted(row):
                return
            if item is not None and row["media_type"] in (*XHTML, NCX):
                text = archive.read(row["href"])
                ElementTree.fromstring(text)
                row["html"] = text.decode("utf-8")
            rows.append(row)

        for index, ref in enumerate(spine):
            linear = ref.get("linear") != "no"
            add(manifest.get(ref.get("idref")), spine_index=index, idref=ref.get("idref"), linear=linear, is_nav=False)
        toc = next((e.get("toc") for e in package.get("spine", [])), None)
        for ident, item in manifest.items():
            if "nav" in (item.get("properties") or "").split() or item.get("media-type") == NCX or (toc and ident == toc):
                add(item, is_nav=True, idref=ident)
        return rows


def _guarded(path: str, file, wanted=lambda row: True) -> list[dict]:
    try:
        return book_rows(path, file, wanted)
    except Exception as error:  # one bad file must not stop the others
        return [{"path": path, "error": f"{type(error).__name__}: {error}"}]


@dataclass
class Files(InputPartition):
    paths: list[str]
    folders: list[str]


class EpubReader(DataSourceReader):
    """Reads groups of files.  Filters on path decide which files are opened, those on href,
    spine_index and is_nav which members are read; broken books keep their error row."""

    MEMBER = ("href", "spine_index", "is_nav", "idref")

    def __init__(self, root: str):
        self.root, self.paths, self.members = root, [], []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for each in filters:
            name = each.attribute[0] if getattr(each, "attribute", None) and len(each.attribute) == 1 else None
            if name == "path" and isinstance(each, EqualTo | In | StringStartsWith | StringEndsWith):
                self.paths.append(each)
            elif name in self.MEMBER and isinstance(each, EqualTo | In):
                self.members.append(each)
                yield each  # an error row has none of these columns: Spark decides on it
            else:
                yield each

    @staticmethod
    def _holds(each: Filter, value) -> bool:
        if isinstance(each, In):
            return value in each.value
        if isinstance(each, StringStartsWith):
            return value is not None and value.startswith(each.value)
        if isinstance(each, StringEndsWith):
            return value is not None and value.endswith(each.value)
        return value == each.value

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("/") else "file:" + self.root)

    def _files(self, store, folder: str) -> tuple[list[tuple[str, int]], list[str]]:
        """The wanted files of one folder with their sizes, in order, and the folders in it."""
        from pyarrow import fs

        infos = store.get_file_info(fs.FileSelector(folder))
        found = sorted((i.path, i.size or 0) for i in infos if i.is_file and i.path.lower().endswith(".epub"))
        found = [(path, size) for path, size in found if all(self._holds(each, path) for each in self.paths)]
        return found, [i.path for i in infos if i.type == fs.FileType.Directory]

    def partitions(self) -> list[Files]:
        """Groups of files by size.  Above ``NAMED`` files a folder that fits a group goes in by its own name
        and is listed again by the task, so that the driver never holds the names of all files."""
        store, root = self._store()
        folders, waiting, n = [], [root], 0
        while waiting:
            folder = waiting.pop()
            found, inner = self._files(store, folder)
            waiting += inner
            if found:
                n += len(found)
                folders.append([folder, sum(size + FILE_COST for _, size in found), found])
            if n > NAMED and not self.paths:
                for each in folders if n - len(found) <= NAMED else folders[-1:]:
                    each[2] = each[2] if each[1] > PARTITION_BYTES else None
        whole = sum(cost for _, cost, _ in folders)
        limit = min(PARTITION_BYTES, max(whole // FEW_GROUPS, LEAST_FILES * FILE_COST))
        named = sorted(file for _, _, found in folders for file in found or ())
        groups: list[Files] = []
        filled = limit
        for name, cost, kind in [
            *((path, size + FILE_COST, "paths") for path, size in named),
            *((folder, cost, "folders") for folder, cost, found in sorted(folders, key=lambda f: f[0]) if found is None),
        ]:
            if filled + cost > limit:
                groups.append(Files([], []))
                filled = 0
            getattr(groups[-1], kind).append(name)
            filled += cost
        return groups or [Files([], [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._store()
        wanted = lambda row: all(self._holds(each, row.get(each.attribute[0])) for each in self.members)
        for path in chain(partition.paths, (path for folder in partition.folders for path, _ in self._files(store, folder)[0])):
            try:
                with store.open_input_file(path) as file:
                    rows = _guarded(path, file, wanted)
            except OSError as error:
                rows = [{"path": path, "error": f"{type(error).__name__}: {error}"}]
            for row in rows:
                yield tuple(row.get(f) for f in FIELDS)


class EpubDataSource(DataSource):
    """``spark.read.format("epub").load(folder)``; folders that pyarrow's file systems can open."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EpubReader:
        return EpubReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the ``epub`` format known to the session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpubDataSource)


def parse_epubs(files: DataFrame) -> DataFrame:
    """files(path, content) as read by ``binaryFile``.

    A book with a broken archive or a broken XHTML item gives one row with the
    error and no documents.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                rows += _guarded(path, io.BytesIO(content))
            frame = pd.DataFrame(rows, columns=FIELDS).astype(object)
            yield frame.where(frame.notna(), None)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return parse_epubs(files)
