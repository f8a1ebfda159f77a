"""Normalisation, markup and sections on small fixtures."""

from pyspark.sql import functions as F

from lectern.operators import corpus, sections
from lectern.plans.epub_rows import archive, document
from lectern.sources import epub, markup

ITEM = "array<struct<ord:bigint,kind:string,text:string>>"


def chapters(spark, texts, kinds=None):
    rows = []
    for i, lines in enumerate(texts):
        rows.append(("b", i, f"c{i}.xhtml", "t", False, [(n, (kinds or {}).get((i, n), "paragraph"), t) for n, t in enumerate(lines)]))
    return spark.createDataFrame(rows, f"book_id string, spine_index long, href string, title string, is_noise boolean, items {ITEM}")


def merge_by_hand(lines):
    out = []
    for text in lines:
        if out and len(out[-1]) <= 1200 and out[-1][-1] not in ".!?:;。！？：；" and (text[0].islower() or out[-1][-1] in "，、"):
            out[-1] += " " + text
        else:
            out.append(text)
    return out


def test_merge_paragraphs_matches_a_plain_loop(spark):
    long = "x" * 700
    cases = [
        ["The road", "went on", "and on.", "then stopped", "here"],
        ["茶壶，", "灯笼", "船夫。", "x"],
        [f"A {long}", long, long, long, "tail"],
        ["One."],
        [],
    ]
    merged = corpus.explode_blocks(corpus.merge_paragraphs(chapters(spark, cases))).orderBy("spine_index", "ord").collect()
    for i, lines in enumerate(cases):
        mine = [r for r in merged if r.spine_index == i]
        assert [r.text for r in mine] == merge_by_hand(lines)
        if mine:
            assert mine[0].starts_chapter and mine[-1].ends_chapter
            assert all(len(r.block_id) == 32 and len(r.fp) == 64 for r in mine)
    road = [r for r in merged if r.spine_index == 0]
    assert [len(r.merged_from) for r in road] == [3, 2]


def test_merge_needs_paragraphs(spark):
    rows = corpus.explode_blocks(corpus.merge_paragraphs(chapters(spark, [["A", "b"]], {(0, 1): "list-item"}))).collect()
    assert len(rows) == 2


def test_boundary_lines_at_three_fifths(spark):
    body = [["RUNNING HEAD", f"text {i}", "RUNNING HEAD", f"more {i}", "7" if i < 2 else f"end {i}"] for i in range(5)]
    body[4][0] = "Other"
    table = chapters(spark, body)
    repeated = corpus.repeated_boundary_lines(table)
    assert [r.chapters for r in repeated.collect()] == [4]
    kept = corpus.drop_boundary_lines(table, repeated).orderBy("spine_index").collect()
    assert [b.text for b in kept[0]["items"]] == ["text 0", "more 0", "7"]
    # The line is no edge of the last chapter, so its interior copy stays there.
    assert [b.text for b in kept[4]["items"]] == ["Other", "text 4", "RUNNING HEAD", "more 4", "end 4"]


def test_heading_levels(spark):
    rows = spark.createDataFrame([("b", 2), ("b", 2), ("b", 4), ("b", 9)], "book_id string, level long")
    got = {r.level: r.normalised_level for r in corpus.heading_levels(rows).collect()}
    assert got == {2: 1, 4: 2, 6: 3}


def test_extract_blocks_kinds():
    html = document(
        '<h2 id="top">Title</h2><p>One <a epub:type="noteref" href="#n1">1</a></p><p>unclosed<p>next'
        "<ul><li>item<li>two</ul><blockquote><ul><li>q</li></ul><p>quote</p></blockquote>"
        '<figure><p>Caption</p><img src="f.jpg" alt="a"/></figure>'
        '<aside epub:type="footnote" id="n1"><p>Note</p><p>text</p></aside><script>no()</script>'
    )
    got = [(b["kind"], b["text"]) for b in markup.parse_blocks(html)]
    assert got == [
        ("heading", "Title"),
        ("paragraph", "One 1"),
        ("paragraph", "unclosed"),
        ("paragraph", "next"),
        ("list-item", "item"),
        ("list-item", "two"),
        ("list-item", "q"),
        ("blockquote", "quote"),
        ("image-caption", "Caption"),
        ("footnote", "Note text"),
    ]
    blocks = markup.parse_blocks(html)
    assert blocks[0]["level"] == 2 and blocks[0]["anchors"] == ["top"]
    assert blocks[1]["links"] == [{"fragment": "n1", "kind": "footnote"}]
    assert blocks[8]["image"]["src"] == "f.jpg" and blocks[9]["footnote_id"] == "n1"


def test_toc_rows():
    nav = (
        '<nav epub:type="page-list"><ol><li><a href="p">1</a></li></ol></nav>'
        '<nav epub:type="toc"><ol><li><a href="a">A <i>b</i></a><ol><li><a href="a#x">X</a></li></ol></li>'
        '<li><a href="">blank</a></li><li><a href="c">C</a></li></ol></nav>'
    )
    assert markup.parse_toc(nav) == [([0], 1, "A b", "a", False), ([0, 0], 2, "X", "a#x", True), ([1], 1, "C", "c", True)]


# Two files: the first holds three entries, the last of which runs on into the second, where the fourth begins.
PAGES = {
    "ferry": [("open", "Timetable"), (None, "Boats leave on the hour."), ("salt", "Salt"), (None, "Crates are weighed twice, crête et sel."),
              ("rope", "Rope"), (None, "Nobody ties the last knot.")],
    "shore": [(None, "It is tied here instead."), ("lamp", "Lamp"), (None, "A lamp burns until ten. 🪔")],
}


def markup_of(rows):
    return "".join(f'<h2 id="{anchor}">{text}</h2>' if anchor else f"<p>{text}</p>" for anchor, text in rows)


def overlay(spark, third):
    """Sections of the two files for a contents page whose third entry points to ``third``."""
    targets = {"Timetable": "ferry.xhtml#open", "Salt": "ferry.xhtml#salt", "Rope": third, "Lamp": "shore.xhtml#lamp"}
    entries = "".join(f'<li><a href="{href}">{label}</a></li>' for label, href in targets.items())
    made = archive("Ferry", {name: markup_of(rows) for name, rows in PAGES.items()}, f'<nav epub:type="toc"><ol>{entries}</ol></nav>')
    docs = epub.parse_epubs(spark.createDataFrame([("ferry", bytearray(made))], "path string, content binary"))
    docs = docs.withColumnRenamed("path", "book_id")
    pages, contents = docs.where("not is_nav"), docs.where("is_nav")
    from lectern.plans.base import with_identity

    blocks = with_identity(markup.extract_blocks(pages, ["book_id", "spine_index", "href"]))
    physical = pages.select("book_id", "spine_index", "href", F.lit(False).alias("is_noise"))
    anchors = blocks.select("book_id", "href", F.explode("anchors").alias("fragment"), "ord", "block_id")
    leaves = markup.extract_toc(contents, ["book_id"]).where("is_leaf").select("book_id", "pos", "label", "href")
    return sections.build_sections(leaves, physical, blocks, anchors), blocks


def test_sections_cross_files(spark):
    built, blocks = overlay(spark, "ferry.xhtml#rope")
    got = [(r.title, r.start_position, r.end_position) for r in built.orderBy("section_index").collect()]
    assert got == [("Timetable", 0, 2), ("Salt", 2, 4), ("Rope", 4, 7), ("Lamp", 7, 9)]
    keyed = sections.section_blocks(built, blocks)
    files = {r.section_index: r.n for r in keyed.groupBy("section_index").agg(F.countDistinct("spine_index").alias("n")).collect()}
    assert files == {0: 1, 1: 1, 2: 2, 3: 1}
    claimed = keyed.drop("ord")
    assert sections.partition_check(built, claimed, blocks).isEmpty()
    lost = claimed.where("section_index <> 2 or section_ord <> 1")
    assert [r.code for r in sections.partition_check(built, lost, blocks).collect()] == ["block_not_in_section"]


def test_an_entry_without_its_anchor_leaves_no_sections(spark):
    assert overlay(spark, "ferry.xhtml#tide")[0].isEmpty()


def test_broken_epub_is_one_error_row(spark):
    bad = archive("x", {"a": "<p>unclosed"})
    rows = spark.createDataFrame([("bad", bytearray(bad)), ("nozip", bytearray(b"x"))], "path string, content binary")
    got = epub.parse_epubs(rows).collect()
    assert len(got) == 2 and all(r.error and r.html is None for r in got)


def test_read_epubs_from_a_folder(spark, tmp_path):
    (tmp_path / "one.epub").write_bytes(archive("One", {"a": "<p>x</p>"}))
    assert epub.read_epubs(spark, str(tmp_path)).where("not is_nav").select("html").count() == 1
