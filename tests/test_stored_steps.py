"""Queries that read blocks or analyses several times derive them from the documents once."""

import datetime

import pytest
from pyspark.sql import functions as F

from lectern.operators import reading
from lectern.plans import base, catalog, package


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    text = lambda d: "\n".join(f"Line {n} of chapter {d} tells of ferry {d % 3}, toll {n}." for n in range(1, 8))
    docs = [(d, text(d), "en", f"src{d % 20}") for d in (0, 1, 20, 21, 40, 41)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{root}/documents.parquet")
    start = datetime.datetime(2024, 1, 1)
    kinds = ("view", "click", "view", "purchase", "signup", "error")
    events = [
        (i, start + datetime.timedelta(minutes=7 * i), i % 4 % 2 + 20 * (i % 3), kinds[i % 6], 1.0, f'{{"k": {i % 11}}}') for i in range(120)
    ]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, schema).write.parquet(f"{root}/events.parquet")
    talk = [(d, t, "user" if t % 2 == 0 else "assistant", f"Which ferry has toll {t}?") for d in (0, 1, 20) for t in range(4)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return str(root)


def derived(monkeypatch, spark, folder, name):
    """Rows of a query, and how often it derived blocks and analyses."""
    calls = {"blocks": 0, "analyses": 0}
    blocks, analyses = base.blocks, package.chapter_analyses

    def counted(kind, make):
        def run(*args):
            calls[kind] += 1
            return make(*args)

        return run

    monkeypatch.setattr(base, "blocks", counted("blocks", blocks))
    monkeypatch.setattr(package, "chapter_analyses", counted("analyses", analyses))
    return catalog.QUERIES[name](spark, folder).collect(), calls


@pytest.mark.parametrize("name", ["request_context", "explain_requests", "related_concepts", "assemble_context"])
def test_contexts_derive_blocks_once(monkeypatch, spark, folder, name):
    rows, calls = derived(monkeypatch, spark, folder, name)
    assert calls == {"blocks": 1, "analyses": 1}
    assert name == "related_concepts" or len(rows) > 0


def test_visible_chars_of_wanted_blocks_only(spark):
    blocks = spark.createDataFrame(
        [("b", 0, 0, "x", 4), ("b", 0, 1, "y", 5), ("b", 1, 0, "z", 6), ("c", 0, 0, "x", 7)],
        "book_id string, spine_index long, ord long, block_id string, n_chars long",
    )
    cover = spark.createDataFrame(
        [("s", "b", 0, 1, 2), ("t", "b", 0, 0, 9), ("t", "c", 0, 0, 1)],
        "session_id string, book_id string, spine_index long, end_ord long, end_offset long",
    )
    asked = [("s", "b", "y"), ("s", "b", "y"), ("t", "b", "x"), ("t", "b", "z"), ("u", "b", "x"), ("t", None, "x")]
    wanted = spark.createDataFrame(asked, "session_id string, book_id string, block_id string")
    whole = reading.visible_chars(blocks, cover)
    some = reading.visible_chars(blocks, cover, wanted)
    keys = ["session_id", "book_id", "block_id"]
    expected = whole.join(wanted.distinct(), keys, "left_semi").select(*keys, "ord", "visible")
    assert sorted(some.select(*keys, "ord", "visible").collect()) == sorted(expected.collect())
    assert some.where(F.col("session_id") == "s").select("visible").collect() == [(2,)]


@pytest.mark.parametrize("name", ["analysis_view", "partition_check", "section_blocks", "rejected_overlays"])
def test_sections_derive_blocks_once(monkeypatch, spark, folder, name):
    _, calls = derived(monkeypatch, spark, folder, name)
    assert calls["blocks"] == 1


@pytest.mark.parametrize("name", ["eval_report_files", "eval_metrics", "evaluate_packages", "studio_snapshot", "metric_baseline"])
def test_reports_derive_blocks_and_analyses_once(monkeypatch, spark, folder, name):
    rows, calls = derived(monkeypatch, spark, folder, name)
    assert calls == {"blocks": 1, "analyses": 1}
    assert name == "metric_baseline" or rows  # these few books fall short of no baseline


def test_packages_derive_shared_tables_once(monkeypatch, spark, folder):
    rows, calls = derived(monkeypatch, spark, folder, "validate_packages")
    assert calls == {"blocks": 1, "analyses": 1} and rows


def test_assembled_context_holds_concepts_analysis_and_selection(monkeypatch, spark, folder):
    """Every part of a context, not only how many blocks are near."""
    from lectern.operators import actions

    made = []
    assemble = actions.assemble_context
    monkeypatch.setattr(actions, "assemble_context", lambda *given: made.append(assemble(*given)) or made[-1])
    rows, _ = derived(monkeypatch, spark, folder, "assemble_context")
    assert len(made) == 1  # by the operator, not beside it
    contexts = {r["request_id"]: r for r in made[0].collect()}
    assert rows and {r["request_id"] for r in rows} == set(contexts)
    for r in rows:
        whole = contexts[r["request_id"]]
        assert r["selected_id"] == (whole["selected_block"] and whole["selected_block"]["block_id"])
        assert (r["nearby"], r["nearby_chars"]) == (len(whole["nearby_blocks"]), sum(len(b["text"]) for b in whole["nearby_blocks"]))
        assert r["has_analysis"] == (r["deep"] is not None) == (whole["chapter_analysis"] is not None)
        assert r["concepts"].count("=") == len(whole["related_concepts"])
        assert r["allowed_chapters"] == whole["allowed_chapters"] and r["allowed"] == (whole["error"] is None)
    assert any(r["selected_id"] for r in rows)
