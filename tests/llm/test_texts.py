"""Exact dedup, sharding, tokens and packing against plain Python over small and odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, packing, sharding, tokens

SCHEMA = "doc_id long, text string, kept string, _id long, size string, h long, n string"

ODD = [
    (5, "a  b", "x", 1, "s", 1, None),
    (3, "a\tb", None, 1, None, 1, "n"),
    (9, "a b", "x", None, "s", None, "n"),
    (4, " a b", "x", 1, "s", 1, "n"),
    (7, None, "x", 1, "s", 1, "n"),
    (8, "", "x", 1, "s", 1, "n"),
    (2, "é é", "x", 1, "s", 1, "n"),
    (1, "é é", "x", 1, "s", 1, "n"),
    (None, "only here", "x", 1, "s", 1, "n"),
    (6, "twice", "x", 1, "s", 1, "n"),
    (6, "twice", "x", 1, "s", 1, "n"),
    (10, "\r\n\x0b\x0c", "x", 1, "s", 1, "n"),
    (11, " ", "x", 1, "s", 1, "n"),
    (12, "w" * 200_000, "x", 1, "s", 1, "n"),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected_groups(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[normal(row[1])].append(row[0])
    out = []
    for row in rows:
        ids = groups[normal(row[1])]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((row[0], keep, len(ids), row[0] == keep, hashlib.sha256(normal(row[1]).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [32, 1])
def test_exact_groups_even_where_hashes_collide(spark, bits):
    digest = lambda t: F.substring(F.md5(t), 1, bits)
    got = exact_dedup.exact_groups(odd(spark), digest=digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected_groups(ODD)


def test_exact_dedup_of_a_hot_group(spark):
    rows = [(i, "same words" if i % 3 else f"own {i}") for i in range(3000)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted(map(tuple, got.collect()), key=repr) == expected_groups(rows)


def test_copies_go_with_all_columns_kept(spark):
    docs = odd(spark)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([3, 4, 7, 1, 2, None, 6, 6, 10, 12])


def test_empty_tables(spark):
    empty = odd(spark).limit(0)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    assert sharding.byte_shards(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert tokens.length_histogram(tokens.token_lengths(empty)).count() == 0


def check_shards(rows, got, shards=8):
    assert len(got) == len(rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    most = max(k[1] for k in want)
    assert all(abs(load[s] - sum(load.values()) / shards) <= 2 * most for s in range(shards))


def test_shards_of_odd_rows(spark):
    check_shards(ODD, sharding.byte_shards(odd(spark)).collect())


@pytest.mark.parametrize("per_range", [250_000, 40])
def test_shards_with_a_hot_group_and_small_ranges(spark, per_range):
    rows = [(i, "hot " * 30 if i % 3 == 0 else f"{i} " * (1 + i % 50)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.byte_shards(docs, rows_per_range=per_range).collect()
    check_shards(rows, got)
    # The same rows in other partitions get the same places.
    again = sharding.byte_shards(docs.repartition(5), rows_per_range=per_range).collect()
    assert set(map(tuple, got)) == set(map(tuple, again))
    # Equal texts are neighbours: all but the hot text are in one shard each, but for those a shard's end cuts.
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 7


STRANGE = [
    "Hello, World! don't we'll 'tis <|endoftext|> x<|startoftext|>y",
    "ÀÉÎ naïve Straße ΣΊΣΥΦΟΣ İstanbul ǅ",
    "日本語 テキスト 12345 3.14 1,000 a1b2",
    "tabs\tand\nlines\r\n\x0b\x0c\x1c\x85 é   end",
    "%%% &&& *** a_b__c @user #tag http://x.y/z?q=1 “quotes” — dash…",
    "a" * 300 + " " + "xyz" * 100,
    "😀😃 👩‍👩‍👧 🇫🇷 ​ zero",
    "", " ", "\n\n", "word", "'s 't 're",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    whole, code, count = Tokenizer.from_file(path), tokens.Coder(path), tokens.Coder(path, True)
    assert code.by_word == name.startswith("word")
    for text in STRANGE * 2:
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(code.ids(text), code.type).tolist() == want
        assert count.length(text) == len(want)


def test_full_word_table_changes_nothing():
    code = tokens.Coder(tokens.default_path())
    want = [code.ids(t) for t in STRANGE]
    code.words.limit = code.cores.limit = 0
    code.words.clear(), code.cores.clear()
    assert [code.ids(t) for t in STRANGE] == want


def test_histogram(spark):
    sizes = [0, 0, 3, 3, 3, 2000, 5000, 1023, 1024, None]
    rows = spark.createDataFrame([(x,) for x in sizes], "n_tokens long")
    plain = [x or 0 for x in sizes]
    got = tokens.length_histogram(rows)
    for r in got.collect():
        k = r["n_tokens"]
        assert r["n_docs"] == plain.count(k)
        assert r["docs_up_to"] == sum(x <= k for x in plain) and r["docs_longer"] == sum(x > k for x in plain)
        assert r["tokens_longer"] == sum(x for x in plain if x > k) and r["tokens_up_to"] == sum(x for x in plain if x <= k)
        assert r["kept_tokens"] == sum(min(x, k) for x in plain) and r["cut_tokens"] == sum(max(x - k, 0) for x in plain)
        assert (r["total_docs"], r["total_tokens"]) == (len(plain), sum(plain))
    assert {r["n_tokens"] for r in got.collect()} == set(plain)
    limits = [0, 2, 3, 1500, 9999]
    want = [(m, sum(x > m for x in plain), sum(min(x, m) for x in plain), sum(max(x - m, 0) for x in plain)) for m in limits]
    assert sorted(map(tuple, tokens.at_limits(got, limits).collect())) == want
    assert dict(map(tuple, tokens.length_quantiles(got, [0.5, 1.0]).collect())) == {0.5: 3, 1.0: 5000}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    rows = [(i, t) for i, t in enumerate(STRANGE)] + [(90, None), (None, "no id"), (91, "one two three " * 900), (91, "again")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n string, part long")
    got = packing.pack(docs.repartition(3), window=64).collect()
    ids = [(i, whole.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    # Every piece is a slice of a document with that id, and documents are covered without gaps.
    covered = Counter()
    for r in got:
        piece = (r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
        fits = [
            x for i, x in ids
            if i == r["doc_id"] and len(x) == piece[3]
            and zlib.crc32(np.array(x[piece[0] : piece[0] + piece[1]], "<u4").tobytes()) == piece[2]
        ]
        assert fits and r["length"] > 0
        covered[r["doc_id"]] += r["length"]
    want = Counter()
    for i, x in ids:
        want[i] += len(x)
    assert covered == want
    fill = defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(fill) == list(range(-(-sum(want.values()) // 64)))
    for k, parts in fill.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or k == max(fill)
