"""Publication: failed candidates, torn writes, repeated and interrupted attempts."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.sinks import publish

SOURCE = {b: hashlib.sha256(b.encode()).hexdigest() for b in "xyz"}


def candidate(book, seq, complete=True, violations=0, prefix=None):
    return (book, f"{prefix or SOURCE[book][:16]}-{seq}", seq, complete, violations, SOURCE[book])


def frames(spark, *rows):
    candidates = spark.createDataFrame(list(rows), "book_id string, version_id string, seq long, complete boolean, violations long, source_hash string")
    documents = candidates.select(
        "book_id", "version_id", F.explode(F.array(F.lit("a.json"), F.lit("b.json"))).alias("document"), F.lit(0).cast("long").alias("pos"),
        F.concat(F.lit('{"v":'), F.col("seq").cast("string"), F.lit("}")).alias("json"),
    )
    return documents, candidates


def attempt(spark, root, *rows):
    documents, candidates = frames(spark, *rows)
    return {(r["book_id"], r["seq"]): r["error"] for r in publish.run(spark, root, documents, candidates).collect()}


def seen(spark, root):
    return sorted((r["book_id"], r["document"], r["json"]) for r in publish.read_active(spark, root).collect())


def both(book, seq):
    return [(book, "a.json", f'{{"v":{seq}}}'), (book, "b.json", f'{{"v":{seq}}}')]


def state(root):
    return sorted((str(p), p.stat().st_mtime_ns, p.read_bytes()) for p in Path(root).rglob("*") if p.is_file() and "/staged/" not in str(p))


def test_failed_candidates_leave_the_old_version(spark, tmp_path):
    root = str(tmp_path)
    assert seen(spark, root) == []
    assert attempt(spark, root, candidate("x", 1), candidate("y", 1, complete=False)) == {("x", 1): None, ("y", 1): "incomplete"}
    assert seen(spark, root) == both("x", 1)
    errors = attempt(spark, root, candidate("x", 2, violations=3), candidate("y", 2), candidate("z", 2, prefix="0" * 16))
    assert errors == {("x", 2): "violations", ("y", 2): None, ("z", 2): "foreign_version"}
    assert seen(spark, root) == both("x", 1) + both("y", 2)
    attempt(spark, root, candidate("x", 3), candidate("x", 4, complete=False))
    assert seen(spark, root) == both("x", 3) + both("y", 2)


def test_a_repeated_attempt_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    attempt(spark, root, candidate("x", 5), candidate("y", 5))
    before = state(root)
    attempt(spark, root, candidate("x", 5), candidate("y", 5))
    attempt(spark, root, candidate("x", 4))  # an older one does not come back
    assert state(root) == before


def test_a_torn_write_is_not_published(spark, tmp_path):
    root = str(tmp_path)
    attempt(spark, root, candidate("x", 1), candidate("y", 1))
    documents, candidates = frames(spark, candidate("x", 2), candidate("y", 2))
    staged = publish.stage(documents, root)
    lost = spark.read.parquet(staged).where("book_id = 'x'").first()["package"]
    files = list(Path(staged.removeprefix("file:")).glob(f"package={lost}/*.parquet"))
    for file in files:
        file.with_suffix(".parquet.crc").unlink(missing_ok=True)
        file.rename(file.with_name("_" + file.name))
    audited = publish.audit(spark, staged, candidates.join(publish.sealed(documents), ["book_id", "version_id"], "left"))
    assert {r["book_id"]: r["error"] for r in audited.collect()} == {"x": "torn_write", "y": None}
    assert publish.publish(spark, root, staged, audited) == 1
    assert seen(spark, root) == both("x", 1) + both("y", 2)


@pytest.mark.parametrize("moved", [False, True])
def test_an_interrupted_attempt_can_be_repeated(spark, tmp_path, monkeypatch, moved):
    """The driver dies before the pointer is swapped, with the package moved or not."""
    root = str(tmp_path)
    attempt(spark, root, candidate("x", 1))
    documents, candidates = frames(spark, candidate("x", 2))
    with monkeypatch.context() as patch:

        def die(*_):
            raise OSError("gone")

        patch.setattr(publish.Store, "swap" if moved else "move", die)
        with pytest.raises(OSError, match="gone"):
            publish.run(spark, root, documents, candidates)
    assert seen(spark, root) == both("x", 1)
    attempt(spark, root, candidate("x", 2))
    assert seen(spark, root) == both("x", 2)


def test_the_newest_of_several_candidates(spark, tmp_path):
    root = str(tmp_path)
    attempt(spark, root, candidate("x", 7), candidate("x", 9, complete=False), candidate("x", 8))
    assert seen(spark, root) == both("x", 8)
