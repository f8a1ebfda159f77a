"""Components, near duplicates, repeated passages and decontamination against brute force."""

import random
import re
from collections import defaultdict

import pytest

from lectern.llm import decontamination, minhash, runs, substring_dedup
from lectern.llm.common import components


def union_find(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(1000, 1060)]  # a chain
    pairs += [(5000, 5000 + i) for i in range(1, 300)]  # a star
    pairs += [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, 7)]
    got = components(spark.createDataFrame(pairs, "a long, b long"), spark).collect()
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    assert {r["id"]: r["component"] for r in got} == union_find(pairs, ids)
    assert len(got) == len(ids)
    assert components(spark.createDataFrame([], "a long, b long"), spark).count() == 0


WORDS = [f"w{i}" for i in range(4000)]


def corpus(seed=5):
    """Copies, near copies, a passage that many share, short and odd texts."""
    rng = random.Random(seed)
    make = lambda n: [rng.choice(WORDS) for _ in range(n)]
    shared, base = make(60), make(120)
    rows = []
    for _ in range(40):
        rows.append(" ".join(make(50) + shared + make(30)))
    for k in range(60):
        near = list(base)
        for _ in range(k % 8):
            near[rng.randrange(len(near))] = rng.choice(WORDS)
        rows.append(" ".join(near))
    for k in range(30):  # hardly anything but the shared passage
        rows.append(" ".join(shared + make(k % 9)))
    rows += [" ".join(base).upper(), " ".join(base).replace(" ", "\n"), "a b c", "A  b\tc", "a b", "a", "", None, " \n ", "b a"]
    rows += [" ".join(make(rng.randrange(1, 40))) for _ in range(40)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def brute(rows, words, percent):
    sets = {i: set(minhash.shingle_set(t or "", words).tolist()) for i, t in rows}
    ids = sorted(sets)
    pairs = [
        (a, b)
        for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return sets, union_find(pairs, ids)


@pytest.mark.parametrize(("words", "percent", "cold"), [(3, 85, 64), (5, 80, 4)])
def test_near_groups(spark, monkeypatch, words, percent, cold):
    monkeypatch.setattr(minhash, "COLD", cold)  # makes lists hot that are short
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x", None) for r in rows], "doc_id long, text string, n long, fp string, v string")
    got = {r["doc_id"]: r for r in minhash.near_groups(docs, words, percent).collect()}
    sets, named = brute(rows, words, percent)
    assert {i: r["component_id"] for i, r in got.items()} == named
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_shared_text_with_many_small_values_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(minhash, "COLD", 4)
    rng = random.Random(2)
    while True:  # at least 8 of the 16 keys occur nowhere else
        base = [rng.choice(WORDS) for _ in range(102)]
        text = " ".join(base + [rng.choice(WORDS) for _ in range(17)])
        keys = minhash.shingle_set(text, 3)[: minhash.KEYS]
        if len(set(keys.tolist()) - set(minhash.shingle_set(" ".join(base), 3).tolist())) >= 8:
            break
    texts = [" ".join(base), *(" ".join([*base, f"own{k}"]) for k in range(11)), text]
    rows = list(enumerate(texts))
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows, 3, 85)[1] == dict.fromkeys(range(13), 0)


def test_one_of_each_keeps_columns_and_null_ids(spark):
    text = " ".join(WORDS[:40])
    docs = spark.createDataFrame([(2, text, "a"), (1, text, "b"), (None, text, "c"), (3, None, "d")], "doc_id long, text string, _gone string")
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert {tuple(r)[::2] for r in left.collect()} == {(1, "b"), (None, "c"), (3, "d")}
    assert minhash.one_of_each(docs.limit(0)).count() == 0


def test_tuned_bands():
    b, r = substring_dedup.BANDS, substring_dedup.ROWS
    assert 1 - (1 - 0.8**r) ** b >= 0.9995 and b * r <= 24


def test_passages_inside_lines_are_cut_alike():
    rng = random.Random(1)
    sentence = lambda: " ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(12))
    cut = []
    for _ in range(2):
        text = " ".join(sentence() for _ in range(7)) + " and " + passage + " or " + " ".join(sentence() for _ in range(5))
        spans = substring_dedup.paragraphs(text)
        assert "".join(text[a:b] for a, b in spans) == text
        cut.append({text[a:b].strip() for a, b in spans})
    assert len(cut[0] & cut[1]) >= 2


def test_repeated_passages(spark):
    rng = random.Random(9)
    make = lambda n: [rng.choice(WORDS) for _ in range(n)]
    passage, other = make(55), make(30)
    near = list(passage)
    near[3] = "changed"
    short = " ".join(make(12))
    texts = [
        "\n".join([" ".join(make(25)), " ".join(passage), short]),
        "\n".join([" ".join(passage).upper(), " ".join(make(22))]),
        "\n".join([short, " ".join(near)]),
        "\n".join([" ".join(other), "x", " ".join(other)]),
        " ".join(make(40)), "", None, short,
    ]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, " ".join(passage), "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, paragraph long")
    got = substring_dedup.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["paragraph"]) for r in got} == {(0, 1), (1, 0), (2, 1), (3, 0), (3, 2)}
    assert {(r["doc_id"], r["paragraph"]) for r in got if not r["removed"]} == {(0, 1), (3, 0)}
    for r in got:
        assert texts[r["doc_id"]][r["start"] : r["start"] + r["n_chars"]] == texts[r["doc_id"]].split("\n")[r["paragraph"]]
        assert r["places"] == (3 if r["doc_id"] < 3 else 2) and r["first_doc_id"] == (0 if r["doc_id"] < 3 else 3)
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs).collect()}
    assert left[0] == texts[0] and left[1] == "\n" + texts[1].split("\n")[1]
    assert left[2] == short + "\n" and left[3] == " ".join(other) + "\nx\n" and left[6] == ""
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_values_of_their_own_are_counted_in_full_only_for_what_a_part_leaves(spark, monkeypatch):
    monkeypatch.setattr(minhash, "COLD", 2)
    rng = random.Random(7)
    base = [rng.choice(WORDS) for _ in range(200)]
    texts = {i: " ".join([*base[:i], f"w{i}", *base[i + 1 :]]) for i in range(5)}
    texts |= {i: " ".join([*base[:12], *(rng.choice(WORDS) + str(rng.random()) for _ in range(150))]) for i in range(10, 30)}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    full, part = ({r["rep"]: r["own"] for r in minhash.own_values(docs, 5, k).collect()} for k in (1, 3))
    assert all(0 < part.get(i, 0) < full[i] for i in range(10, 30)) and all(part.get(i, 0) <= full[i] for i in range(5))
    counted = []
    own_values = minhash.own_values

    def noted(some, words, one_in=1):
        counted.append((one_in, some.count()))
        return own_values(some, words, one_in)

    monkeypatch.setattr(minhash, "own_values", noted)
    rows = [(1, i, len(minhash.shingle_set(t, 5)), len(texts), 0, 196) for i, t in texts.items()]
    lists = spark.createDataFrame(rows, "v long, rep long, n long, members long, leader long, leader_n long")
    classes = minhash.sketches(docs, 5, id_col="id").select(minhash.F.col("id").alias("rep"), "n", "sketch")
    fetch = lambda ids: docs.join(ids, "id", "left_semi")
    links = minhash.all_links(lists, classes, fetch, 5, 85)
    assert {x for r in links.collect() for x in r} == set(range(5))
    assert counted == [(3, 25), (1, 5)]


def test_wanted_texts_hold_an_id_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    got = lambda *ids: {tuple(r) for r in minhash.texts_of(docs, spark.createDataFrame([(i,) for i in ids], "id long"), "doc_id", "text").collect()}
    assert got(1, 2, 2) == {(1, "a"), (2, "")} and got(3, 2) == {(3, "c"), (2, "")}


def test_link_in_any_of_many_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(minhash, "COLD", 2)
    rng = random.Random(6)
    base = [rng.choice(WORDS) for _ in range(60)]
    texts = {1: " ".join(base), 2: " ".join(["other", *base[1:]])}
    texts |= {i: " ".join(rng.choice(WORDS) for _ in range(60)) for i in range(10, 40)}
    # Each of both is in eight lists of three and more; only the last of the first one's is common.
    members = {v: {1, 10 + v, 20 + v} for v in range(1, 8)} | {v: {2, 10 + v - 8, 20 + v - 8} for v in range(9, 16)} | {8: {1, 2, 30}}
    rows = [(v, i, 56, len(m), min(m), 56) for v, m in members.items() for i in m]
    lists = spark.createDataFrame(rows, "v long, rep long, n long, members long, leader long, leader_n long")
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    classes = minhash.sketches(docs, 5, id_col="id").select(minhash.F.col("id").alias("rep"), "n", "sketch")
    fetch = lambda ids: docs.join(ids, "id", "left_semi")
    assert {tuple(r) for r in minhash.all_links(lists, classes, fetch, 5, 80).collect()} == {(1, 2)}


def test_repeated_passages_find_all_links(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(60)]
        for k in range(8):
            line = list(base)
            for _ in range(k % 4):
                line[rng.randrange(60)] = rng.choice(WORDS)
            texts.append(" ".join(line) + "\n" + " ".join(rng.choice(WORDS) for _ in range(25)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["paragraph"]) for r in substring_dedup.repeated_passages(docs).collect()}
    sets = {(i, k): set(minhash.shingle_set(p, 5).tolist()) for i, t in enumerate(texts) for k, p in enumerate(t.split("\n"))}
    keys = sorted(sets)
    want = set()
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                want |= {a, b}
    assert got == want


def verbatim_rows(seed=11):
    """Passages of 50 to 60 words mid-line, unpunctuated, in sentences and over short lines; shorter ones; loops."""
    rng = random.Random(seed)
    make = lambda n: [rng.choice(WORDS) for _ in range(n)]

    def sentences(words, n):
        return " ".join(w + "." if k % n == n - 1 else w for k, w in enumerate(words))

    texts = []
    for n in (49, 50, 51, 55, 60):
        for style in (
            " ".join, lambda w: sentences(w, 9), lambda w: sentences(w, 15), lambda w: sentences(w, 100),
            lambda w: "\n".join(" ".join(w[k : k + 7]) for k in range(0, len(w), 7)),
        ):
            passage = style(make(n))
            for _ in range(3):
                texts.append(f"{sentences(make(rng.randrange(70)), 12)} {passage} {sentences(make(rng.randrange(70)), 12)}")
        line = make(n)
        texts += [" ".join(make(30) + line + make(1)) + "\n" + " ".join(make(3)), "é\u00a0ü  " + "  ".join(line).upper()]
    loop = make(7)
    texts += [" ".join(loop * 20), " ".join(make(9) + loop * 12), "a " * 130, "", None, "x"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_verbatim_runs_equal_brute_force(spark, monkeypatch):
    rows = verbatim_rows()
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), rows[3]], "doc_id long, text string").repartition(3)
    got = substring_dedup.repeated_passages(docs).collect()
    words = {i: minhash.words_of(t) for i, t in rows}
    spans = {i: [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for i, t in rows}
    seen, later, kept = {}, defaultdict(set), defaultdict(set)
    for i, own in words.items():
        for k in range(len(own) - 49):
            first, at = seen.setdefault(tuple(own[k : k + 50]), (i, k))
            if (first, at) != (i, k):
                later[i] |= set(range(max(k, at + 50) if first == i else k, k + 50))
                kept[first] |= set(range(at, at + 50))
    held = {True: defaultdict(set), False: defaultdict(set)}
    texts = dict(rows)
    for r in got:
        i, place = r["doc_id"], (r["start"], r["start"] + r["n_chars"])
        inside = {k for k, (a, b) in enumerate(spans[i]) if place[0] <= a and b <= place[1]}
        assert len(inside) == r["n_words"]
        # Paragraphs are passages from 20 words on; whatever else goes is a later run.
        assert not r["removed"] or inside <= later[i] or place in substring_dedup.paragraphs(texts[i])
        held[r["removed"]][i] |= inside
    assert any(later.values()) and all(later[i] <= held[True][i] for i in words)
    assert all(kept[i] <= held[False][i] | held[True][i] for i in words)
    count = defaultdict(list)
    for r in got:
        count[r["passage_id"]].append(r)
    for places in count.values():
        assert {r["places"] for r in places} == {len(places)} and [r["removed"] for r in places].count(False) == 1
        assert all(r["first_doc_id"] == next(x["doc_id"] for x in places if not x["removed"]) for r in places)
    monkeypatch.setattr(runs, "BROADCAST_ANCHORS", 0)
    monkeypatch.setattr(runs, "BROADCAST_IDS", 0)
    left = {r["doc_id"]: minhash.words_of(r["text"]) for r in substring_dedup.without_repeats(docs.dropna().distinct()).collect()}
    assert left and all(left[i] == [w for k, w in enumerate(words[i]) if k not in held[True][i]] for i in left)


ITEMS = [
    (1, "A train leaves Oslo at 9 and runs 60 km to Bergen before Anna from Oslo boards it at noon with 3 bags"),
    (2, "the quick brown fox jumps over the lazy dog while seven grey geese watch from the far bank of the river"),
    (3, "short item here"),
    (4, None),
    (5, "  "),
    (None, "an item without an id is not reported at all by anything"),
]


def test_contaminated(spark):
    filler = " ".join(WORDS[:30])
    docs = [
        (10, f"{filler}. {ITEMS[0][1]}. {filler}"),
        (11, f"{filler} A train leaves Rome at 7 and runs 85 km to Milan before Maria from Rome boards it at noon with 4 bags {filler}"),
        (12, f"{filler} A train leaves Rome at 7 and runs 85 km to Milan before Maria from Naples boards it at noon with 4 bags"),
        (13, f"{filler} {ITEMS[1][1]}! {filler}"), (21, " ".join(w.capitalize() for w in WORDS[:40])),
        (14, "the quick brown fox jumps over " + filler),
        (15, "HERE is a short, item: HERE and more"), (20, f"{filler} {ITEMS[1][1].upper()}! {filler}"),
        (16, filler), (17, None), (18, ""), (None, ITEMS[1][1]), (13, f"{filler} {ITEMS[1][1]}"),
        (19, "an item without an id is not reported at all by anything"),
    ]
    docs = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id long, h string")
    items = spark.createDataFrame([(*i, 2) for i in ITEMS], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, items).collect()}
    # 12 names two towns where the item has one, so its windows across both are no copy of the item.
    assert set(got) == {(10, 1), (11, 1), (13, 2), (15, 3), (20, 2)}
    assert not got[10, 1]["new_values"] and got[11, 1]["new_values"] and got[10, 1]["share"] == 1.0
    left = decontamination.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["12", "14", "16", "17", "18", "19", "21", "None"]
    for a, b in ((docs.limit(0), items), (docs, items.limit(0))):
        assert decontamination.contaminated(a, b).count() == 0


def test_contaminated_with_a_large_benchmark(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x y " + ITEMS[1][1]), (2, "x y z")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    few = decontamination.contaminated(docs, items).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert decontamination.contaminated(docs, items).collect() == few and len(few) == 1


def test_contaminated_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = defaultdict(set)
    for r in decontamination.contaminated(docs, items).collect():
        got[r["doc_id"]].add(r["item_id"])
    plain = lambda t: " ".join("".join(c for c in w.lower() if c.isalnum()) for w in (t or "").split())
    held = [(r["item_id"], plain(r["text"])) for r in items.collect()]
    want = defaultdict(set)
    for r in docs.collect():
        text = plain(r["text"])
        for i, t in held:
            if t in text:
                want[r["doc_id"]].add(i)
    assert got == want and want


def test_words_of_many_texts_are_hashed_at_once():
    from lectern.llm.common import lower_bytes, word_hashes, word_places

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab cD\t\n.! 　é\x0b\x85'") for _ in range(rng.choice([0, 1, 9, 400]))) for _ in range(200)]
    texts += ["x" * n + " " + "x" * (n + 1) for n in range(1, 90)]
    lower = [lower_bytes(t) for t in texts]
    for text, own, (hashes, first, behind) in zip(texts, lower, word_places(lower), strict=True):
        words = minhash.words_of(text)
        assert [own[a:b] for a, b in zip(first, behind, strict=True)] == words
        assert hashes.tolist() == [int(word_hashes(w.decode())[0]) for w in words]
        assert len(set(hashes.tolist())) == len(set(words))
    assert [s.tolist() for s in minhash.shingle_sets(texts, 3)] == [minhash.shingle_set(t, 3).tolist() for t in texts]


def test_sketches_travel_as_halves(spark):
    high = [i << 40 for i in range(1, 65)]
    classes = spark.createDataFrame(
        [(1, high), (2, [v + 1 for v in high]), (3, [v + (1 << 50) for v in high])], "rep long, sketch array<long>"
    )
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    near = minhash.estimated(pairs, classes, 85)
    assert "as int" in near._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in near.collect()] == [(1, 2)]


def test_windows_of_one_alignment_are_one_row(spark):
    span = "struct<doc_id:long, t:long, s:int, e:int, sc:int, ec:int, p0:int, p1:int>"
    row = lambda s, f: (9, 5, s, s + 50, 6 * s, 6 * (s + 50), 0, s // 40, (1, 4, f, f + 50, 6 * f, 6 * (f + 50), 0, f // 40))
    rows = [row(200 + i, 64 + i) for i in range(32)] + [row(700 + i, 64 + i) for i in (0, 31)]
    schema = f"doc_id long, t long, s int, e int, sc int, ec int, p0 int, p1 int, first {span}"
    got = runs._aligned(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["s"], r["e"], r["first"]["s"], r["first"]["e"]) for r in got) == [(200, 281, 64, 145), (700, 781, 64, 145)]
    cut = [(9, 5, 50 + i, 60 + i, 0, 1, 0, 0, (9, 5, i, 10 + i + 0, 0, 1, 0, 0)) for i in (0, 20)]
    assert runs._aligned(spark.createDataFrame(cut, schema)).count() == 2
