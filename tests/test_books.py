"""EPUB data source, package navigation, image paths, nested contents and whole-book documents."""

import json
import zipfile

import pytest

from lectern.plans.epub_rows import archive, document, link, navigation, paragraph, write_archives
from lectern.sinks import book_document
from lectern.sources import epub, markup


@pytest.fixture
def shelf(spark, tmp_path):
    epub.register(spark)
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.epub").write_bytes(archive("One", {"a": "<p>first</p>", "b": "<p>second</p>"}, '<nav><ol><li><a href="a.xhtml">A</a></li></ol></nav>'))
    (tmp_path / "sub/two.epub").write_bytes(archive("Two", {"a": "<p>x</p>"}, ncx=navigation([("Alpha", "a.xhtml"), (" ", "skipped")])))
    (tmp_path / "broken.epub").write_bytes(b"no archive" * 10)
    (tmp_path / "notes.txt").write_text("not a book")
    return tmp_path


def test_source_equals_whole_file_reader(spark, shelf):
    got = spark.read.format("epub").load(str(shelf))
    short = lambda rows: sorted(((r["path"].rsplit("/", 1)[1], r["spine_index"], r["is_nav"], r["href"], r["html"], r["title"]) for r in rows), key=repr)
    assert short(got.collect()) == short(epub.read_epubs(spark, str(shelf)).collect())
    errors = got.where("error is not null").collect()
    assert len(errors) == 1 and errors[0]["path"].endswith("broken.epub") and "BadZipFile" in errors[0]["error"]


def test_path_filter_opens_matching_files_only(spark, shelf):
    rows = spark.read.format("epub").load(str(shelf))
    one = rows.where(rows["path"].endswith("one.epub"))
    assert one.where("error is not null").count() == 0 and one.where("not is_nav").count() == 2
    reader = epub.EpubReader(str(shelf))
    assert list(reader.pushFilters([epub.StringEndsWith(("path",), "two.epub")])) == []
    assert [p.rsplit("/", 1)[1] for part in reader.partitions() for p in part.paths] == ["two.epub"]


def test_unwanted_members_are_not_read(spark, tmp_path):
    """A member that cannot be read does no harm to a query that does not ask for it."""
    epub.register(spark)
    good = tmp_path / "good.epub"
    good.write_bytes(archive("Good", {"a": "<p>kept</p>", "b": "<p>later</p>"}))
    spoiled = tmp_path / "spoiled.epub"
    with zipfile.ZipFile(good) as old, zipfile.ZipFile(spoiled, "w") as new:
        for name in old.namelist():
            new.writestr(name, b"<html><unclosed>" if name.endswith("b.xhtml") else old.read(name))
    rows = spark.read.format("epub").load(str(tmp_path))
    first = rows.where("spine_index = 0").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in first) == ["good.epub", "spoiled.epub"]
    assert all("kept" in r["html"] for r in first)
    assert rows.where("error is not null").count() == 1


def test_groups_are_bounded_by_bytes(tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"{i}.epub").write_bytes(b"x" * 1000)
    monkeypatch.setattr(epub, "PARTITION_BYTES", 2 * (1000 + epub.FILE_COST))
    assert [len(p.paths) for p in epub.EpubReader(str(tmp_path)).partitions()] == [2, 2, 1]


def test_many_small_files_share_a_task(tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"{i}.epub").write_bytes(b"x")
    assert [len(p.paths) for p in epub.EpubReader(str(tmp_path)).partitions()] == [63, 63, 63, 63, 48]
    monkeypatch.setattr(epub, "FEW_GROUPS", 1)
    assert [len(p.paths) for p in epub.EpubReader(str(tmp_path)).partitions()] == [300]


def test_driver_names_folders_instead_of_many_files(spark, tmp_path, monkeypatch):
    """Above a bound the driver deals whole folders, the tasks list them; every file is read once."""
    rows = spark.createDataFrame([(f"doc-{i}", [f"text {i}"], i % 2 == 1) for i in range(60)], "name string, texts array<string>, own_navigation boolean")
    assert write_archives(rows.repartition(3), f"file://{tmp_path}", 7) == 60
    reader = lambda: epub.EpubReader(str(tmp_path))
    few = {tuple(x) for p in reader().partitions() for x in reader().read(p)}
    monkeypatch.setattr(epub, "NAMED", 20)
    parts = reader().partitions()
    assert not any(p.paths for p in parts) and len([f for p in parts for f in p.folders]) == 7
    read = [tuple(x) for p in parts for x in reader().read(p)]
    assert len(read) == len(few) == 120 and set(read) == few
    monkeypatch.setattr(epub, "PARTITION_BYTES", epub.FILE_COST)  # no folder fits a group: its files are dealt
    assert sorted(len(p.paths) for p in reader().partitions()) == [1] * 60


def test_contents_open_every_file_once(spark, shelf):
    found = markup.package_toc(spark.read.format("epub").load(str(shelf)))
    assert found.count() == 2
    assert "BatchScan" not in found._jdf.queryExecution().executedPlan().toString()  # choice and entries come from the stored rows


def test_written_package_parts_are_whole(spark, tmp_path):
    """Labels and pages with markup characters, and members on both sides of the packing limit, come back as they were."""
    pages = {"a": paragraph('x < y & "z"\x01'), "b": paragraph("long " * 400)}
    entries = [('A & "B" <c>', "a.xhtml"), ("B", 'b.xhtml?q="1"&r')]
    (tmp_path / "one.epub").write_bytes(archive('T & "u"', pages, ncx=navigation(entries)))
    (tmp_path / "two.epub").write_bytes(archive("U", pages, f"<nav><ol>{''.join(f'<li>{link(*e)}</li>' for e in entries)}</ol></nav>"))
    kinds = {i.compress_type for i in zipfile.ZipFile(tmp_path / "one.epub").infolist()}
    assert kinds == {zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED}
    epub.register(spark)
    rows = spark.read.format("epub").load(str(tmp_path))
    assert {(r["title"], r["html"]) for r in rows.where("not is_nav").collect()} == {(t, document(p)) for t in ('T & "u"', "U") for p in pages.values()}
    assert sorted((r["label"], r["href"]) for r in markup.package_toc(rows).collect()) == sorted(entries * 2)


def test_empty_folder_is_an_empty_table(spark, tmp_path):
    epub.register(spark)
    assert spark.read.format("epub").load(str(tmp_path)).collect() == []


def test_package_navigation_where_nav_has_no_entries(spark, shelf):
    empty = archive("Three", {"a": "<p>x</p>"}, "<nav><ol></ol></nav>")
    (shelf / "three.epub").write_bytes(empty)
    found = markup.package_toc(spark.read.format("epub").load(str(shelf))).collect()
    assert sorted((r["book"].rsplit("/", 1)[1], r["pos"], list(r["path"]), r["label"], r["href"], r["is_leaf"]) for r in found) == [
        ("one.epub", 0, [0], "A", "a.xhtml", True), ("two.epub", 0, [0], "Alpha", "a.xhtml", True),
    ]


def test_nested_package_navigation():
    xml = """<n:ncx xmlns:n="u"><n:navMap>
      <n:navPoint><n:navLabel><n:text> Part  one </n:text></n:navLabel><n:content src="p.xhtml"/>
        <n:navPoint><n:navLabel><n:text>Inner</n:text></n:navLabel><n:content src="p.xhtml#i"/></n:navPoint></n:navPoint>
      <n:navPoint><n:navLabel><n:text>Last</n:text></n:navLabel><n:content src="l.xhtml"/></n:navPoint></n:navMap></n:ncx>"""
    assert markup.parse_ncx(xml) == [
        ([0], 1, "Part one", "p.xhtml", False), ([0, 0], 2, "Inner", "p.xhtml#i", True), ([1], 1, "Last", "l.xhtml", True),
    ]


@pytest.mark.parametrize(
    ("href", "src", "path"),
    [
        ("EPUB/text/a.xhtml", "../img/f.jpg", "EPUB/img/f.jpg"), ("EPUB/a.xhtml", "figure%201.jpg#x", "EPUB/figure 1.jpg"),
        ("a.xhtml", "f.jpg", "f.jpg"), ("EPUB/a.xhtml", "/img/f.jpg", "img/f.jpg"), ("EPUB/a.xhtml", "https://h/f.jpg", "https://h/f.jpg"),
        ("EPUB/a.xhtml", "data:image/png;base64,x", "data:image/png;base64,x"), (None, "f.jpg", "f.jpg"), ("EPUB/a.xhtml", None, None),
    ],
)
def test_image_paths(href, src, path):
    assert markup.resolved(href, src) == path


def test_images_of_captions_carry_their_path(spark):
    html = '<figure><img src="../i/m.png" alt="Map"/><figcaption>The river</figcaption></figure>'
    docs = spark.createDataFrame([(1, "EPUB/t/c.xhtml", html)], "id long, href string, html string")
    row = markup.extract_blocks(docs, ["id"], href="href").where("kind = 'image-caption'").first()
    assert (row["image"]["src"], row["image"]["resolved_path"], row["image"]["alt"]) == ("../i/m.png", "EPUB/i/m.png", "Map")


def plain_tree(entries):
    def children(path):
        own = sorted(e for e in entries if len(e[0]) == len(path) + 1 and e[0][:-1] == path)
        out = []
        for p, label, href in own:
            node = {"label": label, "href": href}
            below = children(p)
            out.append(node | ({"children": below} if below else {}))
        return out

    return children([])


def test_nested_contents_equal_a_recursive_fold(spark):
    entries = [
        ([1], "B", "b"), ([0], 'A "quoted"', "a"), ([0, 1], "A2", "a2"), ([0, 0], "A1", "a1"), ([0, 0, 0, 0], "lost", "no parent"),
        ([10], "K", "k"), ([2], "C", "c"), ([2, 0], "C1", "c1"), ([2, 0, 0], "é\n", "c11"), ([2, 0, 1], "deep", "c12"),
    ]
    toc = spark.createDataFrame([("x", *e) for e in entries] + [("y", [0], "only", "o")], "book_id string, path array<int>, label string, href string")
    got = {r["book_id"]: json.loads(r["contents"]) for r in book_document.nested_contents(toc).collect()}
    assert got == {"x": plain_tree(entries), "y": [{"label": "only", "href": "o"}]}
    assert book_document.nested_contents(toc.limit(0)).collect() == []


def parts(spark, book, text):
    return spark.createDataFrame([(book, 0, 0, 0, json.dumps({"title": text})), (book, 2, 0, 0, "[]")], book_document.PARTS)


def test_writing_one_book_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "out")
    book_document.write_documents(parts(spark, "x", "one").unionByName(parts(spark, "y", "two")), path)
    book_document.write_documents(parts(spark, "x", "three"), path)
    rows = book_document.read_documents(spark, path).where("section = 0").collect()
    assert {r["book_id"]: json.loads(r["json"])["title"] for r in rows} == {"x": "three", "y": "two"}


def test_book_documents_are_written_packed(spark, tmp_path):
    rows = [("b", 5, s, o, json.dumps({"text": "Ferry toll " * 50, "ord": o})) for s in range(3) for o in range(20)]
    parts = spark.createDataFrame(rows, book_document.PARTS)
    book_document.write_documents(parts, f"{tmp_path}/out")
    written = [p for p in (tmp_path / "out").rglob("part-*") if p.is_file()]
    assert written and all(p.name.endswith(".json.gz") for p in written)
    assert sum(p.stat().st_size for p in written) * 5 < sum(len(r[4]) for r in rows)
    back = book_document.read_documents(spark, f"{tmp_path}/out").select(*parts.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
