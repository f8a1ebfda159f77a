"""Alignment of two tokenizers against sets of common ends over whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import alignment

SCHEMA = "doc_id long, text string, key string, n long, pair long, copies string, b string"
TEXTS = [
    "The quick brown fox", "The quick brown fox", "The quick brown fox", None, "", " ", "\n", "\nline\nline", "a  b   c\n\nd ",
    "été %%% l'âme<|endoftext|><s></s><unk>", "low ▁ line", "日本語のテキスト 𝄞", "x\x1c y\x85z\xa0w\t\tv", "<0x41> it's 1234567", "q" * 5000,
    "word and word\n" * 3000, "tail ", " lead", "▁", "bare\x00nul", "emoji 😀😀",
]


@pytest.fixture(scope="module")
def made():
    return alignment.aligner(*alignment.default_paths())


def plain(made, text):
    """(n_a, n_b, links, digest) from whole encodings, or None."""
    if not text:
        return None
    a = made.a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = made.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(made.a_bytes[i] for i in a) != raw or b"".join(made.b_bytes[i] for i in b) != raw:
        return None
    ends_a, ends_b = (np.cumsum([len(x[i]) for i in ids]).tolist() for x, ids in ((made.a_bytes, a), (made.b_bytes, b)))
    place_b = defaultdict(list)
    for j, e in enumerate(ends_b):
        place_b[e].append(j)
    links = [(i, j) for i, e in enumerate(ends_a) for j in place_b[e]]
    groups, p, q = [], 0, 0
    for i, j in links:
        groups.append(",".join(map(str, a[p : i + 1])) + "|" + ",".join(map(str, b[q : j + 1])))
        p, q = i + 1, j + 1
    return len(a), len(b), [(a[i], b[j]) for i, j in links], hashlib.sha256(";".join(groups).encode()).hexdigest()


def test_equal_to_brute_force(spark, made):
    rows = [((i * 5) % 23, t, "k", 7, None, "c", "b") for i, t in enumerate(TEXTS)]
    rows += [(None, "The quick brown fox", "k", 7, None, "c", "b"), (3, "The quick", None, None, None, None, None)]
    got = alignment.align_corpus(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = [(r[0], plain(made, r[1])) for r in rows]
    assert sum(x is None for _, x in found) >= 4  # null, empty and texts with U+2581
    count = Counter(p for _, x in found if x for p in x[2])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = [
        (i, 0, 0, 0, 0, 0, 0, "") if x is None else
        (i, x[0], x[1], len(x[2]), len(x[2]), sum(count[p] == most[p[1]] for p in x[2]), sum(count[p] for p in x[2]), x[3])
        for i, x in found
    ]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert len(count) <= alignment.most_pairs(*alignment.default_paths()) <= alignment.BROADCAST_PAIRS


def test_empty_table(spark):
    assert alignment.align_corpus(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pieces_equal_whole_texts(made):
    assert made.by_piece
    rng = np.random.default_rng(5)
    letters = list("abé Ü  \n\n\t'sdm1.,;%#あ▁\x1c\x85\xa0-") + ["the", "<s>", " ll", "<0x0A>", "ing "]
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(1, 25)))
        assert made(text) == made.whole(text), repr(text)
