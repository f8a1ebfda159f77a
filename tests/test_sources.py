"""Suite loading, ledgers and package lines from files."""

import hashlib
import json

from lectern.sinks import exports
from lectern.sources import files


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def suite(tmp_path, **changes):
    texts = {"baseline": "Bread is sold before noon.", "partial": "Only half 🥖 !"}
    book = {
        "id": "bakery", "family": "town", "language": "en", "title": "Bakery", "license": "CC0",
        "chapters": [{"href": "m.xhtml", "title": "M", "paragraphs": [{"id": k, "text": t, "sha256": digest(t)} for k, t in texts.items()]}],
    }
    case = {
        "id": "c1", "book_id": "bakery", "suite": "regression", "dimensions": ["D01"], "applicability": "applicable",
        "steps": [{"task": "ask", "question": "Why?", "read": [{"anchor": "partial", "end_char": changes.get("end", 13)}]}],
        "budget": {"timeout_ms": 10, "max_calls": 1},
    }
    gold = {"case_id": changes.get("gold", "c1"), "status": "draft", "evidence_sets": [[changes.get("anchor", "baseline")]], "answerable": True}
    for name in ("books", "cases", "gold"):
        (tmp_path / name).mkdir(parents=True)
    if changes.get("tamper"):
        book["chapters"][0]["paragraphs"][0]["text"] += " Again."
    (tmp_path / "books" / "bakery.json").write_text(json.dumps(book, indent=2))
    (tmp_path / "cases" / "cases.jsonl").write_text(json.dumps(case) + "\n")
    (tmp_path / "gold" / "gold.jsonl").write_text(json.dumps(gold) + "\n")
    return [str(tmp_path / n) for n in ("books", "cases", "gold")]


def codes(spark, paths):
    return sorted(r.code for r in files.suite_integrity(files.load_suite(spark, *paths)).collect())


def test_suite_integrity(spark, tmp_path):
    assert codes(spark, suite(tmp_path / "a")) == []
    assert codes(spark, suite(tmp_path / "b", end=14)) == ["endpoint_out_of_bounds"]
    assert codes(spark, suite(tmp_path / "c", gold="c9")) == ["missing_gold", "unexpected_gold"]
    assert codes(spark, suite(tmp_path / "d", anchor="nowhere", tamper=True)) == ["paragraph_hash_mismatch", "unknown_evidence"]


def test_unreadable_calls_stay_in_the_ledger(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"id": "c1", "status": "completed", "usage": {"input_tokens": 3, "output_tokens": 1}}\n')
    (tmp_path / "two.json").write_text('{"id": "c2", "stat')
    got = {r.id: (r.status, r.usage is not None) for r in files.read_call_ledger(spark, str(tmp_path)).collect()}
    assert got == {"c1": ("completed", True), "two.json": ("interrupted", False)}


def test_rewriting_a_chapter_leaves_the_others(spark, tmp_path):
    schema = "book_id string, spine_index long, chapter_id string, note string"
    write = lambda rows: exports.write_chapter_analyses(spark.createDataFrame(rows, schema), str(tmp_path / "out"))
    write([("A", 0, "chapter_001", "old"), ("A", 1, "chapter_002", "old"), ("B", 0, "chapter_001", "old")])
    write([("A", 1, "chapter_002", "new")])
    rows = spark.read.schema(schema).json(str(tmp_path / "out")).collect()
    assert {(r.book_id, r.chapter_id, r.note) for r in rows} == {("A", "chapter_001", "old"), ("A", "chapter_002", "new"), ("B", "chapter_001", "old")}


def test_files_of_chapter_analyses_do_not_grow_with_the_chapters(spark, tmp_path):
    rows = spark.range(3000).selectExpr("'A' as book_id", "id as spine_index", "concat('c', id) as chapter_id", "if(id % 2 = 0, 'old', null) as note")
    exports.write_chapter_analyses(rows, str(tmp_path / "out"))
    exports.write_chapter_analyses(rows.where("spine_index < 40").selectExpr("book_id", "spine_index", "chapter_id", "'new' as note", "1 as more"), str(tmp_path / "out"))
    assert len({p.parent for p in (tmp_path / "out").rglob("part-*")}) <= exports.ANALYSIS_BUCKETS
    got = {r.chapter_id: (r.note, r.more) for r in spark.read.schema("book_id string, chapter_id string, note string, more int").json(str(tmp_path / "out")).collect()}
    assert got == {f"c{i}": ("new", 1) if i < 40 else ("old" if i % 2 == 0 else None, None) for i in range(3000)}


def test_package_lines_report_bad_ones_and_skip_blanks(spark, tmp_path):
    (tmp_path / "blocks.jsonl").write_text('{"block_id": "a", "chapter_index": 0}\n\n{"block_id": "b"\n')
    rows = files.read_packages(spark, str(tmp_path)).cache()
    assert sorted((r.block_id or "", r[files.BAD] is not None) for r in rows.collect()) == [("", True), ("a", False)]


def test_markdown_blocks(spark):
    text = "# Title\r\n\n- point\n* other\n> quote\n#### deep\nplain"
    rows = exports.markdown_to_blocks(spark.createDataFrame([(1, text)], "id long, markdown string"), "id", size=2).orderBy("pos").collect()
    assert [(r.type, r.content, r.batch) for r in rows] == [
        ("heading_1", "Title", 0), ("bulleted_list_item", "point", 0), ("bulleted_list_item", "other", 1),
        ("paragraph", "quote", 1), ("paragraph", "#### deep", 2), ("paragraph", "plain", 2),
    ]
