"""Token files against whole texts encoded one by one; their layout; selective reads."""

import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import byte_level, token_files
from lectern.llm.common import scratch

SCHEMA = "doc_id long, text string, id string, part string, before string, ids string, n_tokens string, place string"
TEXTS = [
    None, "", " ", "\n", "Hello world", "it's  two  spaces\n\nand lines ", "\t tab \n x", "a<|endoftext|> b <|endoftext|>", "日本 語　x",
    "été, l'âme%%% ###", "x\x1c y \x85z\xa0 w", "w" * 30_000, "word " * 20_000, "same", "same", "trail\n", " lead", "\nlead x", "1 2\r\n3",
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", None, "x", "x", "x") for i, t in rows], SCHEMA)


def plain(rows):
    from tokenizers import Tokenizer

    made, out, at = Tokenizer.from_file(token_files.default_path()), [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = made.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), ids))
        at += len(ids)
    return out


@pytest.fixture(scope="module")
def rows():
    return [((i * 7) % 19 - 3, t) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def folder(spark, rows):
    # Dictionary and delta pages need some rows: the odd texts stand among many plain ones.
    return token_files.write_tokens(table(spark, rows + more()), scratch(spark, "t"), files=3)


def more():
    return [(100 + i, f"document {i} of many, it says {i * i}") for i in range(3000)]


def test_round_trip_equals_whole_texts(spark, rows, folder):
    want = plain(rows + more())
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) for r in token_files.read_tokens(spark, folder).collect())
    assert got == want
    digests = sorted(map(tuple, token_files.digests(token_files.read_tokens(spark, folder)).collect()))
    assert digests == [(i, at, n, zlib.crc32(np.array(ids, "<u4"))) for i, at, n, ids in want]


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, "no id"), (5, "five"), (5, "five"), (5, "five"), (None, "no id"), (1, None)]
    got = token_files.written_and_read(table(spark, rows))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    want = [(i, at, n, zlib.crc32(np.array(ids, "<u4"))) for i, at, n, ids in plain(rows)]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert token_files.written_and_read(table(spark, [])).count() == 0


def test_layout(folder):
    files = sorted(glob.glob(f"{folder.removeprefix('file:')}/tokens/*.parquet"))
    last = None
    for name in files:
        meta = pq.ParquetFile(name).metadata
        assert all(meta.row_group(g).num_rows <= 20_000 for g in range(meta.num_row_groups))
        group = meta.row_group(0)
        columns = {group.column(c).path_in_schema.split(".")[0]: group.column(c) for c in range(group.num_columns)}
        assert "RLE_DICTIONARY" in columns["ids"].encodings
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["before"].encodings
        assert all(c.has_column_index and c.has_offset_index for c in columns.values())
        ids = pq.read_table(name, columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and (last is None or last <= ids[0])
        last = ids[-1]
    assert len(files) == 3


def test_selective_reads(spark, rows, folder):
    want = plain(rows + more())
    got = token_files.read_tokens(spark, folder, 5, 120)
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i, *_ in want if 5 <= i <= 120]
    lengths = got.select("doc_id", "n_tokens")
    plan = lengths._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    whole = [x for *_, ids in want for x in ids]
    for start, stop in [(0, 10), (5, 29_000), (len(whole) - 7, len(whole) + 50), (44, 45), (len(whole), len(whole) + 5)]:
        parts = sorted((r["start"], list(r["ids"])) for r in token_files.read_span(spark, folder, start, stop).collect())
        assert [x for _, ids in parts for x in ids] == whole[start:stop]
        assert not parts or parts[0][0] == start


def test_pieces_equal_whole_texts():
    code = byte_level.byte_coder(token_files.default_path())
    literal = byte_level.byte_coder(token_files.default_path(), True)
    assert code.by_piece and code.short_cut and literal.by_piece
    rng = np.random.default_rng(3)
    letters = list("abé Ü  \n\n\t'sdm1.,;%#あ\x1c\x85\xa0 -") + ["the", "<|endoftext|>", " ll", "'re"]
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 25)))
        assert code.ids(text) == code.whole(text), repr(text)
        assert literal.ids(text) == literal.whole(text), repr(text)


def test_index_names_every_file(spark, folder):
    index = token_files.read_index(spark, folder).orderBy("part").collect()
    total = token_files.read_tokens(spark, folder).agg(F.sum("n_tokens")).first()[0]
    assert [r["first"] for r in index] == [sum(x["n_tokens"] for x in index[:k]) for k in range(len(index))]
    assert sum(r["n_tokens"] for r in index) == total
