"""The driver contract and a parity sample on the smallest data."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.parity import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "rank_blocks", "merge_paragraphs", "boundary_line_removal", "retrieve", "grounding_report", "structural_score",
    "rate_window", "budget_admission", "evidence_recall", "dedupe_toc", "json_diff", "usage_stream", "job_state_stream",
]


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["xxhash", "corpus_pipeline", "lectern.llm"])
def test_entry_without_the_training_data_operators(missing):
    """Without them, or without a library that only they need, the other queries stay."""
    code = (
        "import sys; sys.modules[{0!r}] = None\n"
        "import __spark_entry__ as e\n"
        "assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 190\n"
        "assert not any(q.startswith('op') and q[2].isdigit() for q in e.queries())"
    ).format(missing)
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_parity(spark, name):
    ok, note, _ = compare(spark, connect(FOLDER), name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert ok, note
