"""Decontamination: one contradicting slot, stretches of long texts, cost in proportion to the text."""

import time

import pytest

from lectern.llm import decontamination

ITEM = "A train leaves Oslo at 9 and runs 60 km to Bergen before Anna from there boards it and the conductor returns to Oslo with 3 bags"
ITEMS = [(1, ITEM), (2, "seven grey geese watch from the far bank of the river while the quick brown fox jumps")]


def found(spark, docs):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontamination.contaminated(docs, items).collect()
    return {(r["doc_id"], r["item_id"]): (r["matched_windows"], r["item_windows"], r["new_values"]) for r in rows}


def test_one_contradicting_slot_leaves_the_plain_windows(spark):
    """All windows but the four that hold the changed name are literally the item's."""
    copy = ITEM.replace("returns to Oslo", "returns to Rome")
    got = found(spark, [(1, f"so it goes {copy} and on"), (2, "nothing of the kind")])
    windows = len(ITEM.split()) - 4
    assert got == {(1, 1): (windows - 4, windows, False)}


def test_a_template_with_two_values_for_one_slot_is_not_the_item(spark):
    changed = ITEM.replace("leaves Oslo at 9 and runs 60 km to Bergen before Anna", "leaves Rome at 7 and runs 85 km to Milan before Maria")
    changed = changed.replace("returns to Oslo with 3", "returns to Naples with 4")
    assert found(spark, [(1, changed)]) == {}
    assert found(spark, [(1, changed.replace("Naples", "Rome"))]) == {(1, 1): (len(ITEM.split()) - 4, len(ITEM.split()) - 4, True)}


@pytest.mark.parametrize("stretch", [1, 7])
def test_stretches_change_nothing(spark, monkeypatch, stretch):
    filler = " ".join(f"word{i}" for i in range(50))
    docs = [(i, f"{' '.join(filler.split()[:i])} {ITEM} {filler} {ITEMS[1][1]}") for i in range(0, 12)] + [(50, None), (51, ""), (52, "one two")]
    want = found(spark, docs)
    assert len(want) == 24
    monkeypatch.setattr(decontamination, "STRETCH", stretch)
    assert found(spark, docs) == want


def test_a_long_text_costs_in_proportion(spark):
    def seconds(words):
        text = " ".join(f"w{i % 5000}" for i in range(words)) + " " + ITEMS[1][1]
        start = time.perf_counter()
        assert (1, 2) in found(spark, [(1, text)])
        return time.perf_counter() - start

    seconds(1000)
    short, long = seconds(20_000), seconds(160_000)
    assert long < 8 * short + 5
