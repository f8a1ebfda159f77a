"""Retrieval, coverage and admission against brute force."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lectern.operators import actions, analysis, packages, reading, retrieval, review, scoring

BUDGET = {
    "max_request_bytes": 100,
    "max_invocations": 6,
    "stop_after_input_tokens": 60,
    "stop_after_output_tokens": 1000,
    "stop_after_estimated_usd": 5.0,
}


def test_rank_blocks_prefers_rare_terms_and_reading_order(spark):
    texts = ["the river compass", "river river", "northern compass river", "nothing here", "compass"]
    blocks = spark.createDataFrame([(0, i, f"b{i}", t) for i, t in enumerate(texts)], "spine_index long, ord long, block_id string, text string")
    queries = spark.createDataFrame([(1, "Where is the northern compass?"), (2, "zebra")], "qid long, question string")
    got = retrieval.rank_blocks(blocks, queries, query_key="qid", block_key=["block_id"], position=["spine_index", "ord"]).orderBy("rank").collect()
    assert [(r.block_id, r.score) for r in got] == [("b2", 50_000 + 25_000), ("b0", 25_000), ("b4", 25_000)]


def rank_by_hand(blocks, queries, weight):
    docs = {b: set(t.split()) for b, t in blocks}
    out = set()
    for qid, text in queries:
        terms = set(text.split())
        df = {t: sum(t in d for d in docs.values()) for t in terms}
        scored = [(-sum(weight // (df[t] + 1) for t in terms & d), b) for b, d in docs.items()]
        for rank, (score, b) in enumerate(sorted(x for x in scored if x[0] < 0)[:8], 1):
            out.add((qid, b, -score, rank))
    return out


def test_rank_blocks_without_broadcast_and_with_weightless_terms(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    pick = lambda n: " ".join(rng.choice(words[: rng.choice([4, 30])]) for _ in range(n))
    blocks = [(i, pick(8)) for i in range(120)]
    queries = [(i, pick(5)) for i in range(15)]
    table = spark.createDataFrame(blocks, "ord long, text string")
    asked = spark.createDataFrame(queries, "qid long, question string")
    monkeypatch.setattr(retrieval, "WEIGHT", 40)
    wanted = rank_by_hand(blocks, queries, 40)
    for small in (True, False):
        monkeypatch.setattr(retrieval, "is_small", lambda df, *a, small=small: small)
        monkeypatch.setattr(retrieval, "broadcast_if_small", lambda df, *a: df)
        got = retrieval.rank_blocks(table, asked, query_key="qid", block_key=["ord"], position=["ord"]).collect()
        assert {(r.qid, r.ord, r.score, r["rank"]) for r in got} == wanted


def greedy(sizes, budget, k=8):
    left, picked = budget, []
    for i, size in enumerate(sizes):
        if len(picked) < k and size + 256 <= left:
            left -= size + 256
            picked.append(i + 1)
    return picked


def test_byte_budget_continues_past_the_head(spark):
    rng = random.Random(3)
    wanted, rows = {}, []
    for request in range(12):
        sizes = [rng.choice([10, 900, 3000]) for _ in range(40)]
        if request == 0:
            sizes = [900] * 39 + [10]
        wanted[f"r{request}"] = greedy(sizes, 2000)
        rows += [(f"r{request}", i + 1, s) for i, s in enumerate(sizes)]
    ranked = spark.createDataFrame(rows, "request_id string, rank long, bytes long")
    got = reading.byte_budget_select(ranked, budget=2000, head=4).collect()
    for request, ranks in wanted.items():
        assert sorted(r["rank"] for r in got if r.request_id == request) == ranks


def test_scopes_are_ranked_in_cells_without_a_row_per_match(spark, monkeypatch):
    """Budgets, ranks and ties against brute force; scoring everything into rows is not on the way."""
    rng = random.Random(5)
    texts = {
        scope: [" ".join(rng.choices([f"w{i}" for i in range(12)], k=rng.choice([2, 3, 40, 90]))) for _ in range(n)]
        for scope, n in (("b:big", 150), ("s:u1", 20))
    }
    asked = [(f"r{i}", rng.choice(list(texts)), " ".join(rng.sample([f"w{i}" for i in range(14)], 4))) for i in range(10)]
    candidates = spark.createDataFrame(
        [(s, i // 10, i % 10, f"{s}{i}", "f", len(t), t) for s, rows in texts.items() for i, t in enumerate(rows)],
        "scope_id string, spine_index long, ord long, block_id string, fp string, visible long, text string",
    )
    bounds = spark.createDataFrame(
        [(r, s, q, None) for r, s, q in asked], "request_id string, scope_id string, question string, error string"
    )
    monkeypatch.setattr(retrieval, "top_ranked", lambda found, *a, plain=retrieval.top_ranked: plain(few(found), *a))
    shown = []

    def few(found):
        shown.append(found.count())
        return found

    scores = retrieval.ScopeScores.__init__
    monkeypatch.setattr(retrieval.ScopeScores, "__init__", lambda self, *a: scores(self, *a, cell=200))
    for limit in (800, 3000, 1_000_000):
        shown.clear()
        evidence, matched = reading.retrieve_matched(bounds, candidates, context_limit=limit, head=4)
        got = {(r.request_id, r["rank"], r.block_id, r.score) for r in evidence.collect()}
        wanted, some = set(), set()
        for r, s, q in asked:
            ranked = rank_by_hand_whole(texts[s], q)
            some |= {r} if ranked else set()
            for rank in greedy([len(texts[s][i]) for i, _ in ranked], limit // 2):
                at, score = ranked[rank - 1]
                wanted.add((r, rank, f"{s}{at}", score))
        assert got == wanted
        assert {r.request_id for r in matched.collect()} == some
        # At most four blocks per request and cell in a round: far from every match of every request.
        assert max(shown) <= 4 * 40 * len(asked)


def rank_by_hand_whole(texts, question):
    docs = [set(t.split()) for t in texts]
    df = {t: sum(t in d for d in docs) for t in set(question.split())}
    scored = [(-sum(100_000 // (df[t] + 1) for t in df if t in d), i) for i, d in enumerate(docs)]
    return [(i, -s) for s, i in sorted(x for x in scored if x[0] < 0)]


def test_visible_chars_and_progress(spark):
    rows = [("b", 0, o, f"b{o}", "f", n) for o, n in enumerate([10, 20, 30])] + [("b", 1, 0, "c0", "f", 40)]
    blocks = spark.createDataFrame(rows, "book_id string, spine_index long, ord long, block_id string, fp string, n_chars long")
    events = spark.createDataFrame(
        [("s", "b", 0, 1, 5), ("s", "b", 0, 0, 10), ("s", "b", 1, 0, 99), ("t", "b", 0, None, 3)],
        "session_id string, book_id string, spine_index long, ord long, char_offset long",
    )
    cover = reading.coverage(events)
    seen = {(r.session_id, r.block_id): r.visible for r in reading.visible_chars(blocks, cover).collect()}
    assert seen == {("s", "b0"): 10, ("s", "b1"): 5, ("s", "b2"): 0, ("s", "c0"): 40}
    covered = reading.covered_chapters(blocks, cover)
    assert {(r.spine_index, r.visible, r.completed) for r in covered.collect()} == {(0, 15, False), (1, 40, True)}
    sessions = spark.createDataFrame([("s", "b"), ("t", "b")], "session_id string, book_id string")
    got = {r.session_id: (r.completed_chapters, r.progress_basis_points) for r in reading.reading_progress(sessions, covered, reading.book_chars(blocks)).collect()}
    assert got == {"s": (1, 5500), "t": (0, 0)}


def accept(times, limit, span):
    recent, out = deque(), []
    for t in times:
        while recent and t - recent[0] >= span:
            recent.popleft()
        ok = len(recent) < limit
        if ok:
            recent.append(t)
        out.append(ok)
    return out


def test_rate_window_segments_equal_the_plain_fold(spark):
    rng = random.Random(11)
    rows, wanted, seq = [], {}, 0
    for key in range(6):
        t, times = 0, []
        for _ in range(400):
            t += rng.choice([1, 3, 10, 30, 61, 200]) * 1_000_000 if key else rng.randint(1, 4) * 1_000_000
            times.append(t)
        for t, ok in zip(times, accept(times, 4, 60_000_000)):
            rows.append((key, t, seq))
            wanted[seq] = ok
            seq += 1
    df = spark.createDataFrame(rows, "key long, ts_us long, seq long").repartition(5)
    got = {r.seq: r.accepted for r in scoring.rate_window(df, limit=4, window_seconds=60).collect()}
    assert got == wanted


@pytest.mark.parametrize("chunk_rows", [250])
def test_overloaded_key_in_chunks_equals_the_plain_fold(spark, chunk_rows, monkeypatch):
    """One saturated key, another with lulls, ties within a microsecond; no task gets more than a chunk and a slot."""
    rng = random.Random(chunk_rows)
    rows, wanted = [], {}
    for key, gaps in ((0, [0, 400_000, 900_000]), (1, [100_000, 700_000, 95_000_000])):
        t, times = 10**12, []
        for _ in range(700 if key == 0 else 400):
            t += rng.choice(gaps)
            times.append(t)
        for at, ok in zip(times, accept(times, 5, 20_000_000)):
            wanted[len(rows)] = ok
            rows.append((key, at, len(rows)))
    df = spark.createDataFrame(rows, "key long, ts_us long, seq long").repartition(6)
    sizes = []
    plain = scoring.durable

    def seen(table):
        made = plain(table)
        if "chunk" in made.columns and "warm" in made.columns:
            sizes.append(made.groupBy("key", "segment", "chunk").count().agg({"count": "max"}).first()[0])
        return made

    monkeypatch.setattr(scoring, "durable", seen)
    got = {r.seq: r.accepted for r in scoring.rate_window(df, limit=5, window_seconds=20, chunk_rows=chunk_rows).collect()}
    assert got == wanted
    assert sizes and max(sizes) <= chunk_rows + 60


def admit(calls):
    n = unknown = tin = tout = 0
    usd, out = 0.0, []
    for size, usage, cost in calls:
        reason = None
        if size > BUDGET["max_request_bytes"]:
            reason = "request_bytes"
        elif n >= BUDGET["max_invocations"]:
            reason = "invocation_limit"
        elif unknown:
            reason = "unaccounted_invocation"
        elif tin >= BUDGET["stop_after_input_tokens"]:
            reason = "reported_input_token_threshold"
        elif tout >= BUDGET["stop_after_output_tokens"]:
            reason = "reported_output_token_threshold"
        elif usd >= BUDGET["stop_after_estimated_usd"]:
            reason = "estimated_cost_threshold"
        else:
            n += 1
            if usage is None:
                unknown += 1
            else:
                tin, tout, usd = tin + usage[0], tout + usage[2], usd + cost
        out.append(reason)
    return out


def test_budget_admission_equals_the_plain_fold(spark):
    rng = random.Random(5)
    rows, wanted, seq = [], {}, 0
    for run in range(30):
        calls = []
        for _ in range(15):
            usage = None if rng.random() < 0.08 else (rng.randint(0, 20), 0, rng.randint(0, 9))
            calls.append((rng.choice([10, 50, 150]), usage, None if usage is None else rng.choice([0.25, 0.5, 1.5])))
        for call, reason in zip(calls, admit(calls)):
            rows.append((f"run{run}", seq, *call))
            wanted[seq] = reason
            seq += 1
    schema = "run_id string, seq long, input_bytes long, usage struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>, estimated_usd double"
    got = {r.seq: r.reason for r in scoring.budget_admission(spark.createDataFrame(rows, schema), BUDGET).collect()}
    assert got == wanted


def test_prior_context_counts_earlier_chapters_only(spark):
    rows = [("b", 0, 0, "alpha beta"), ("b", 0, 1, "alpha"), ("b", 1, 0, "beta alpha gamma"), ("b", 2, 0, "gamma"), ("x", 3, 0, "gamma")]
    blocks = spark.createDataFrame(rows, "book_id string, spine_index long, ord long, text string")
    got = {(r.for_chapter, r.spine_index, r.ord): (r.score, r["rank"]) for r in analysis.prior_context(blocks).collect()}
    assert got == {(1, 0, 0): (100_000 // 3 + 100_000 // 2, 1), (1, 0, 1): (100_000 // 3, 2), (2, 1, 0): (50_000, 1)}


def test_json_diff(spark):
    pairs = [("p", '{"a":1,"b":[1,2],"c":{"x":null},"d":{"y":1}}', '{"b":[1,3,4],"a":1,"c":{},"d":[1]}')]
    got = review.json_diff(spark.createDataFrame(pairs, "id string, left_json string, right_json string"), "id").orderBy("pos").collect()
    assert [(r.path, r.left, r.right) for r in got] == [
        ("$.b[1]", "2", "3"),
        ("$.b[2]", "null", "4"),
        ("$.d", '{"y":1}', "[1]"),
    ]


def test_json_diff_tells_kinds_apart(spark):
    pairs = [
        (1, '{"a":1,"b":[1],"c":"1","d":1.0,"e":2.50}', '{"a":true,"b":[1.0],"c":1,"d":1,"e":2.5}'),
        (2, '{"x":{"y":[{"z":1}]},"e":[]}', '{"x":{"y":[{"z":2},null]},"e":{}}'),
        (3, "[1,2]", "[1,2]"),
        (4, "7", "null"),
    ]
    got = review.json_diff(spark.createDataFrame(pairs, "id long, left_json string, right_json string"), "id").collect()
    assert sorted((r.id, r.path, r.left, r.right) for r in got) == [
        (1, "$.a", "1", "true"), (1, "$.b[0]", "1", "1.0"), (1, "$.c", '"1"', "1"), (1, "$.d", "1.0", "1"),
        (2, "$.e", "[]", "{}"), (2, "$.x.y[0].z", "1", "2"), (4, "$", "7", "null"),
    ]
    many = '{"a":[' + ",".join(map(str, range(700))) + "]}"
    cut = review.json_diff(spark.createDataFrame([(1, many, '{"a":[]}')], "id long, left_json string, right_json string"), "id")
    assert sorted(r.pos for r in cut.collect()) == list(range(500))


TWO = [("A", 0, 0, "same", "A opens."), ("A", 0, 1, "a1", "A goes on."), ("B", 0, 0, "same", "B opens, longer."), ("B", 0, 1, "b1", "B ends.")]


def two_books(spark):
    """Two books that number their chapters alike and share a block id."""
    rows = [(b, s, o, i, f"f{i}", "page.xhtml", t, len(t)) for b, s, o, i, t in TWO]
    blocks = spark.createDataFrame(rows, "book_id string, spine_index long, ord long, block_id string, fp string, href string, text string, n_chars long")
    chapters = spark.createDataFrame([("A", 0, "a", False), ("B", 0, "b", False), ("B", 1, "c", False)], "book_id string, spine_index long, title string, is_noise boolean")
    return blocks, chapters


def test_nothing_of_another_book_is_visible(spark):
    blocks, chapters = two_books(spark)
    feed = [("s", 1, 1, "A", 0, 0, 5, None, True), ("t", 2, 2, "B", 0, 1, 7, None, True), ("s", 3, 3, "A", 1, None, None, None, True),
            ("s", 4, 4, "A", 0, 0, 99, None, True)]
    moves = spark.createDataFrame(feed, "session_id string, event_id long, ts long, book_id string, spine_index long, ord long, char_offset long, mode string, is_location boolean")
    located = reading.location_keys(moves, chapters, blocks)
    assert {r.event_id: r.error for r in located.collect()} == {1: None, 2: None, 3: "unknown_chapter", 4: "invalid_offset"}
    cover = reading.coverage(located.where("error is null"))
    seen = {(r.session_id, r.book_id, r.block_id): r.visible for r in reading.visible_chars(blocks, cover).collect()}
    assert seen == {("s", "A", "same"): 5, ("s", "A", "a1"): 0, ("t", "B", "same"): 16, ("t", "B", "b1"): 7}
    covered = reading.covered_chapters(blocks, cover)
    assert {(r.session_id, r.book_id, r.visible, r.completed) for r in covered.collect()} == {("s", "A", 5, False), ("t", "B", 23, True)}
    sessions = spark.createDataFrame([("s", "A", 0), ("t", "B", 0)], "session_id string, book_id string, spine_index long")
    left = reading.excluded_chapters(sessions.drop("spine_index"), chapters, cover)
    assert {(r.session_id, r.book_id, r.spine_index) for r in left.collect()} == {("t", "B", 1)}
    near = reading.nearby_blocks(spark.createDataFrame([("q", "B", 0, "same"), ("p", "A", 0, None)], "request_id string, book_id string, spine_index long, block_id string"), blocks)
    assert {(r.request_id, r.text) for r in near.collect()} == {("q", TWO[2][4]), ("q", TWO[3][4]), ("p", TWO[0][4]), ("p", TWO[1][4])}
    asked = [("r1", "s", "What opens?", "read_range"), ("r2", "t", "What opens?", "current_chapter"), ("r3", "s", "What opens?", "current_chapter")]
    bounds = reading.spoiler_boundary(spark.createDataFrame(asked, "request_id string, session_id string, question string, spoiler_mode string"), sessions, cover, chapters, blocks)
    rows = {r.request_id: (r.scope_id, r.allowed_chapters, r.excluded_chapters) for r in bounds.collect()}
    assert rows == {"r1": ("s:s", 1, 0), "r2": ("c:B:0", 1, 1), "r3": ("c:A:0", 1, 0)}
    offered = {(r.scope_id, r.text) for r in reading.scope_candidates(bounds, cover, blocks).collect()}
    assert offered == {("s:s", "A ope")} | {("c:A:0", t[4]) for t in TWO[:2]} | {("c:B:0", t[4]) for t in TWO[2:]}


def test_excluded_chapters_are_not_shuffled_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(reading, "LISTED", 2)
    books = [("A", i, i == 4) for i in range(7)] + [("A", 6, False), ("A", None, False), ("B", 0, False), (None, 1, False)]
    chapters = spark.createDataFrame(books, "book_id string, spine_index long, is_noise boolean")
    readers = [("s", "A"), ("s", "A"), ("t", "B"), (None, "A"), ("u", None), ("v", "C")]
    sessions = spark.createDataFrame(readers, "session_id string, book_id string")
    seen = [("s", "A", 0), ("s", "A", 6), ("s", "B", 0), ("t", "A", 1), (None, "A", 2)]
    cover = spark.createDataFrame(seen, "session_id string, book_id string, spine_index long")
    found = reading.excluded_chapters(sessions, chapters, cover)
    expected = [(s, b, i) for s, b in readers for c, i, noise in books
                if b is not None and b == c and not noise and not (s is not None and (s, b, i) in seen)]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(expected, key=key)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "LeftAnti" not in plan and plan.index("Generate") < plan.index("Join")


def test_rejected_patches_do_not_move_a_session(spark):
    rows = [("s", 1, 10, 0, 0, 1, None, True, None), ("s", 2, 20, 9, None, None, None, True, "unknown_chapter"), ("s", 3, 30, None, None, None, "full_book", False, None)]
    feed = spark.createDataFrame(rows, "session_id string, event_id long, ts long, spine_index long, ord long, char_offset long, mode string, is_location boolean, error string")
    got = reading.session_state(feed).first()
    assert (got.spine_index, got.ord, got.mode, got.revision) == (0, 0, "full_book", 3)


def test_citations_and_anchors_stay_in_their_book(spark):
    blocks, _ = two_books(spark)
    refs = [("x", "s", "A", "same", 0, 3, "fsame"), ("y", "s", "B", "same", 0, 16, "fsame"), ("z", "s", "A", "b1", 0, 3, "fb1")]
    refs = spark.createDataFrame(refs, "request_id string, session_id string, book_id string, block_id string, start_char long, end_char long, text_fingerprint string")
    cover = spark.createDataFrame([("s", "A", 0, 0, 5)], "session_id string, book_id string, spine_index long, end_ord long, end_offset long")
    got = {(r.request_id, r.code) for r in actions.card_reference_issues(refs, blocks, cover).collect()}
    assert got == {("y", "outside_boundary"), ("z", "unknown_block")}
    hashed = blocks.withColumn("fp", F.sha2("text", 256)).withColumn("text", F.when(F.col("ord") == 0, "Title").otherwise(F.col("text")))
    hashed = hashed.withColumn("fp", F.sha2("text", 256))
    anchors = spark.createDataFrame([("A", "page.xhtml", "Title"), ("B", "page.xhtml", "A goes on.")], "book_id string, href string, text string")
    assert {(r.book_id, r.block_id, r.error) for r in scoring.map_gold_anchors(anchors, hashed).collect()} == {("A", "same", None), ("B", None, "lost")}
    places = packages.locate_blocks(refs, blocks)
    assert {(r.request_id, r.ord, r.error) for r in places.collect()} == {("x", 0, None), ("y", 0, None), ("z", None, "unknown_block")}


def test_three_valued_outcomes(spark):
    scores = spark.createDataFrame([("a", None), ("a", True), ("b", True), ("b", True), ("c", False), ("c", True)], "case_id string, task_success boolean")
    cases = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "case_id string")
    got = {r.case_id: (r.recorded, r.successes, r.all_passed) for r in scoring.repeat_outcomes(cases, scores, 2).collect()}
    assert got == {"a": (2, 1, None), "b": (2, 2, True), "c": (2, 1, False), "d": (0, 0, None)}


def test_leakage_reports_family_and_copy(spark):
    rows = [("d1", "dev", "river", "h1"), ("d2", "dev", "sea", "h2"), ("h1", "holdout", "river", "h9"), ("h2", "holdout", "hill", "h2")]
    got = scoring.leakage(spark.createDataFrame(rows, "book string, split string, family string, source_hash string")).collect()
    assert {(r.book, r.reason, r.counterparts) for r in got} == {
        ("d1", "same_source_family", 1), ("h1", "same_source_family", 1), ("d2", "identical_source", 1), ("h2", "identical_source", 1),
    }


def test_calibration_gate(spark):
    rows = [("k", i, "reviewed", 3, "supports", False) for i in range(20)]
    samples = spark.createDataFrame(rows, "g string, id long, status string, score int, verdict string, hard_failure boolean")
    judged = samples.drop("status")
    good = scoring.calibration_agreement(samples, judged, ["g"]).first()
    assert (good.state, good.calibrated) == ("evaluated", True)
    wrong = judged.withColumn("score", F.when(F.col("id") == 3, 2).otherwise(F.col("score")))
    assert scoring.calibration_agreement(samples, wrong, ["g"]).first().calibrated is False
    assert scoring.calibration_agreement(samples, judged.where("id > 0"), ["g"]).first().state == "not_evaluated"


def test_analyzable_chapters(spark):
    rows = [("b", 0, False, 2), ("b", 1, True, 2), ("b", 2, False, 0), ("b", 3, False, 1)]
    df = spark.createDataFrame(rows, "book_id string, spine_index long, is_noise boolean, block_count long")
    assert [r.spine_index for r in analysis.analyzable_chapters(df).collect()] == [0, 3]
    assert [r.spine_index for r in analysis.analyzable_chapters(df, through=3).collect()] == [0]


def test_two_level_prefixes(spark):
    from lectern.operators import prefix

    rng = random.Random(2)
    rows, wanted = [], {}
    for key in range(3):
        total, previous = 0, None
        for n, order in enumerate(sorted(rng.sample(range(500), 60))):
            value = rng.randint(0, 9)
            rows.append((key, order, value))
            wanted[(key, order)] = (total, n, previous)
            total, previous = total + value, value
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(4)
    out = prefix.running_before(df, ["k"], "o", "v", "total", width=37)
    out = prefix.numbered(out, ["k"], "o", "n", width=37)
    out = prefix.with_previous(out, ["k"], "o", "v", "previous", width=37)
    assert {(r.k, r.o): (r.total, r.n, r.previous) for r in out.collect()} == wanted


def test_edits_are_judged_with_their_whole_package(spark):
    blocks = spark.createDataFrame([("A", 0, 0, "b0", "f0", 10), ("B", 0, 0, "b0", "f1", 10)], "book_id string, spine_index long, ord long, block_id string, fp string, n_chars long")
    ref = "array<struct<block_id:string,start_char:bigint,end_char:bigint,text_fingerprint:string>>"
    good, wrong = [("b0", 0, 5, "f0")], [("b0", 0, 50, "f0")]
    rows = [
        ("plain", "concept", "A", "c1", 10, "grounded", good),
        ("range", "chapter", "A", "chapter_001", 10, "grounded", wrong),
        ("bare claim", "claim", "A", "k1", 10, "grounded", []),
        ("other kind", "claim", "A", "c1", 10, "grounded", good),
        ("mends", "concept", "B", "c1", 10, "inferred", []),
        ("beside", "concept", "B", "c2", 10, "inferred", []),
    ]
    edits = spark.createDataFrame(rows, f"edit_id string, kind string, book_id string, id string, importance long, grounding string, refs {ref}")
    declared = [("A", "concept", "c1"), ("A", "chapter", "chapter_001"), ("A", "claim", "k1"), ("B", "concept", "c1"), ("B", "concept", "c2")]
    declared = spark.createDataFrame(declared, "book_id string, kind string, id string")
    faults = spark.createDataFrame([("B", "concept", "c1")], "book_id string, kind string, id string")
    got = {r.edit_id: r.rejected for r in review.apply_edits(edits, blocks, declared, faults).collect()}
    assert got == {
        "plain": "", "range": "violates_grounding", "bare claim": "grounded_without_refs,claim_not_grounded", "other kind": "unknown_document",
        "mends": "", "beside": "package_invalid",
    }


def test_picked_rows_are_joined_without_shuffling_the_rest(spark):
    """Above the limit of a broadcast a bitmap of the keys keeps other rows from the join; repeated and null keys as in a plain join."""
    from lectern import session

    rows = [(f"s{i % 7}", i if i % 50 else None, f"t{i}") for i in range(20_000)] + [("s1", 1, "again")]
    many = spark.createDataFrame(rows, "scope_id string, ord long, text string")
    picked = spark.createDataFrame([(f"s{i % 7}", i, i) for i in range(0, 20_000, 97)] + [("s1", 1, 5), ("s1", 1, 6), ("s0", None, 7)], "scope_id string, ord long, n long")
    plain = sorted(map(str, many.join(picked, ["scope_id", "ord"]).collect()))
    assert sorted(map(str, session.join_picked(many, picked, ["scope_id", "ord"], max_rows=10).select("scope_id", "ord", "text", "n").collect())) == plain
    passed = session._maybe_among(many, picked, ["scope_id", "ord"])
    assert passed.columns == many.columns and len(plain) <= passed.count() < 2_000
    assert session._maybe_among(many, picked.where("false"), ["scope_id", "ord"]).count() == 0


def test_scope_scores_pack_postings_and_keep_stripes_together(spark):
    """Postings are stored packed, not a row each, and one task hands on the best blocks of several buckets once."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(4000)]
    candidates = spark.createDataFrame(
        [("b:x", i // 50, i % 50, len(t), len(t), t) for i, t in enumerate(texts)] + [("b:x", 0, 0, len(texts[0]), len(texts[0]), texts[0])],
        "scope_id string, spine_index long, ord long, bytes long, visible long, text string",
    )
    asked = spark.createDataFrame([("b:x", "r1", "w1 w2 w3"), ("b:x", "r2", "w4 none"), ("b:x", "r2", "w4")], "scope_id string, request_id string, question string")
    scores = retrieval.ScopeScores(candidates, asked, cell=100)
    postings = sum(len(set(t.split()) & {"w1", "w2", "w3", "w4"}) for t in texts)
    assert scores.packed.count() * 5 < postings
    found = scores._cells(None, retrieval._best_of_cell(4), retrieval.ScopeScores.KEEP)
    stripes = scores.packed.select("stripe").distinct().count()
    assert 1 < stripes < scores.packed.count()
    assert found.count() <= 2 * 4 * stripes
    docs = [set(t.split()) for t in [*texts, texts[0]]]
    df = {w: sum(w in d for d in docs) for w in words}
    for request, terms in (("r1", ["w1", "w2", "w3"]), ("r2", ["w4", "w4"])):
        by = [[sum(100_000 // (df[w] + 1) for w in terms if w in d), -i] for i, d in enumerate(docs[:-1])]
        by[0][0] *= 2  # its copy
        best = sorted((x for x in by if x[0]), reverse=True)[:4]
        got = scores.best(4).where(F.col("request_id") == request).orderBy("rank").collect()
        assert [(r["score"], -(r["spine_index"] * 50 + r["ord"])) for r in got] == [tuple(x) for x in best]
