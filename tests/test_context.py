"""Context of requests, book-map rules, grounding behind analyzer calls, unknown usage, pruned ranking."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import actions, analysis, grounding, reading, retrieval

BLOCK = "book_id string, spine_index long, ord long, block_id string, text string, fp string, n_chars long"


def blocks_of(spark, chapters):
    rows = [("b", s, o, f"{s}.{o}", t, f"f{s}{o}", len(t)) for s, texts in enumerate(chapters) for o, t in enumerate(texts)]
    return spark.createDataFrame(rows, BLOCK)


ASKED = "request_id string, session_id string, book_id string, spine_index long, block_id string"


def test_context_is_clipped_to_what_was_read(spark):
    blocks = blocks_of(spark, [["one", "two 😀 x", "three", "four"], ["next"]])
    requests = spark.createDataFrame([("r", "s", "b", 0, "0.1"), ("open", "s", "b", 0, None), ("far", "s", "b", 1, "1.0")], ASKED)
    cover = spark.createDataFrame([("s", "b", 0, 1, 5)], "session_id string, book_id string, spine_index long, end_ord long, end_offset long")
    analyses = spark.createDataFrame([("b", 0, "deep thought", ["a", "c"]), ("b", 1, "x", [])], "book_id string, spine_index long, deep string, argument_flow array<string>")
    concepts = spark.createDataFrame([("b", "k1", "Ferry"), ("b", "k2", "Toll")], "book_id string, concept_id string, name string")
    related = spark.createDataFrame([("r", "k2"), ("r", "k1"), ("far", "k1")], "request_id string, concept_id string")
    readable = spark.createDataFrame([("r",), ("far",)], "request_id string")
    near = reading.nearby_blocks(requests.select("request_id", "book_id", "spine_index", "block_id"), blocks)
    got = {r["request_id"]: r for r in actions.assemble_context(requests, near, cover, readable, analyses, related, concepts).collect()}
    r = got["r"]
    assert r["error"] is None and r["selected_block"]["text"] == "two 😀"
    assert [(b["block_id"], b["text"]) for b in r["nearby_blocks"]] == [("0.0", "one"), ("0.1", "two 😀")]
    assert json.loads(r["chapter_analysis"])["deep"] == "deep thought" and list(r["argument_flow"]) == ["a", "c"]
    assert [json.loads(c["concept"])["name"] for c in r["related_concepts"]] == ["Ferry", "Toll"]
    assert r["allowed_chapters"] == 1
    o = got["open"]
    assert o["selected_block"] is None and len(o["nearby_blocks"]) == 2 and o["chapter_analysis"] is None and o["related_concepts"] == []
    f = got["far"]
    assert f["error"] == "outside_boundary" and f["selected_block"] is None
    assert f["nearby_blocks"] == [] and f["chapter_analysis"] is None and f["related_concepts"] == [] and f["argument_flow"] == []


def test_book_map_rules(spark):
    maps = spark.createDataFrame(
        [("a", "Why?", "So.", ["chapter_001"]), ("b", " ", None, []), ("c", "Why?", "So.", ["chapter_001", "chapter_009", "chapter_009"]), ("d", None, "So.", None)],
        "book_id string, central_question string, thesis string, key_chapter_ids array<string>",
    )
    analyses = spark.createDataFrame([(x, "chapter_001") for x in "abce"], "book_id string, chapter_id string")
    got = sorted((r["book_id"], r["id"], r["code"]) for r in grounding.book_map_issues(maps, analyses).collect())
    assert sorted(got, key=repr) == sorted(
        [
            ("b", None, "blank_central_question"), ("b", None, "blank_thesis"), ("b", None, "no_key_chapters"),
            ("c", "chapter_009", "unknown_key_chapter"), ("d", None, "blank_central_question"), ("d", None, "no_key_chapters"),
            ("e", None, "missing_book_map"),
        ],
        key=repr,
    )


def ref(block, end=3, fp=None):
    return {"block_id": block, "start_char": 0, "end_char": end, "text_fingerprint": fp or "f" + block.replace(".", "")}


GROUNDED = [
    ({"concepts": [{"source_refs": [ref("0.0")]}]}, "completed", []),
    ({"claims": [{"evidence": []}]}, "invalid", ["claim_without_evidence"]),
    ({"claims": [{}], "entities": None}, "invalid", ["claim_without_evidence"]),
    ({"claims": [{"evidence": [{"source_ref": ref("0.1", 99)}]}]}, "invalid", ["invalid_char_range"]),
    ({"difficult_passages": [{"source_ref": ref("0.0", fp="zz")}], "entities": [{"source_refs": [ref("9.9")]}]}, "invalid", ["fingerprint_mismatch", "missing_source_ref"]),
    ({"concepts": [{"source_refs": [ref("1.0")]}]}, "invalid", ["spoiler_boundary"]),
    ({}, "completed", []),
]


def test_ungrounded_output_is_invalid_with_its_codes(spark):
    blocks = blocks_of(spark, [["one", "two"], ["next"]])
    rows = [(i, json.dumps(payload)) for i, (payload, _, _) in enumerate(GROUNDED)]
    requests = spark.createDataFrame(rows, "id long, request_json string")

    def analyzer(request):
        return {"summary": dict.fromkeys(("one_sentence", "short", "deep", "role_in_book"), "x")} | request

    outputs = analysis.analyze(requests, analyzer, "id", analysis.check_generated)
    failed = spark.createDataFrame([(60, "failed", None, "refused")], outputs.schema)
    places = spark.createDataFrame([(i, "b", 0) for i in range(len(GROUNDED))] + [(60, "b", 0)], "id long, book_id string, spine_index long")
    got = {r["id"]: r for r in analysis.grounded(outputs.unionByName(failed), places, blocks, "id").collect()}
    for i, (_, status, codes) in enumerate(GROUNDED):
        assert (got[i]["status"], list(got[i]["codes"])) == (status, codes), i
        assert got[i]["error"] == ("ungrounded" if codes else None)
    assert (got[60]["status"], got[60]["error"], got[60]["codes"]) == ("failed", "refused", [])


@pytest.mark.parametrize(
    ("usage", "known"),
    [
        (None, False), ({}, False), ({"input_tokens": 1, "output_tokens": 0}, True), ({"input_tokens": 1.0, "output_tokens": 0}, False),
        ({"input_tokens": True, "output_tokens": 0}, False), ({"input_tokens": 3, "output_tokens": 1, "cached_input_tokens": 4}, False),
        ({"input_tokens": 3, "output_tokens": 1, "cached_input_tokens": 3}, True), ({"input_tokens": 3, "output_tokens": -1}, False),
        ({"input_tokens": 3, "output_tokens": 1, "cache_write_input_tokens": 2}, False),
    ],
)
def test_usage(usage, known):
    assert analysis.usage_known(usage) is known


def test_unknown_usage_is_a_state_of_completed_calls(spark):
    rows = spark.createDataFrame([(0, "0"), (1, "1"), (2, "2")], "id long, request_json string")

    def judge(n):
        good = {"score": 2, "verdict": "supports", "evidence": "e", "hard_failure": False}
        return good | {"usage": {"input_tokens": 1, "output_tokens": 1} if n == 0 else None} | ({"score": 9} if n == 2 else {})

    made = analysis.analyze(rows, judge, "id", analysis.check_judgment, usage=lambda p: p["usage"]).collect()
    assert {r["id"]: (r["status"], r["error"]) for r in made} == {0: ("completed", None), 1: ("unknown_usage", None), 2: ("invalid", "score")}


def test_profile_of_bounded_calls(spark):
    assert analysis.calls_per_executor(2, 8).taskResources["cpus"].amount == 4
    assert analysis.calls_per_executor(3, 8).taskResources["cpus"].amount == 3
    assert analysis.calls_per_executor(99, 8).taskResources["cpus"].amount == 1


WORDS = [f"w{i}" for i in range(60)]


def ranked_plainly(texts, question, k):
    ask = set(question.split())
    df = {w: sum(w in t.split() for t in texts) for w in ask}
    scored = [(-sum(100_000 // (df[w] + 1) for w in ask if w in t.split()), i) for i, t in enumerate(texts)]
    return [(i, -s) for s, i in sorted(x for x in scored if x[0] < 0)[:k]]


@pytest.mark.parametrize("head", [1, 10_000])
def test_pruned_ranking_equals_scoring_everything(spark, head, monkeypatch):
    rng = random.Random(head)
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(WORDS, weights, k=rng.randrange(1, 12))) for _ in range(150)] + ["w0 w1"] * 12
    questions = [" ".join(rng.sample(WORDS, rng.randrange(1, 15))) for _ in range(12)] + ["w0", "unknown words", "w0 w1 w2"]
    blocks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "at long, text string")
    asked = spark.createDataFrame(list(enumerate(questions)), "q long, question string")
    plain = retrieval.max_score
    monkeypatch.setattr(retrieval, "max_score", lambda *a, **b: plain(*a, **b, head=head, direct=0))
    got = retrieval.rank_blocks(blocks, asked, query_key="q", block_key=["at"], position=["at"], k=5).collect()
    for q, question in enumerate(questions):
        mine = sorted((r["rank"], r["at"], r["score"]) for r in got if r["q"] == q)
        assert [(at, score) for _, at, score in mine] == ranked_plainly(texts, question, 5), question


def test_pruning_joins_fewer_postings(spark):
    """Lists of frequent terms are not joined once rarer ones decide the best blocks."""
    rows = [(i, f"common often{i % 3} mid{i % 40} rare{i // 4}") for i in range(2000)]
    blocks = spark.createDataFrame(rows, "at long, text string")
    postings = retrieval.term_rows(blocks, ["at"])
    asked = spark.createDataFrame([(0, "common often1 mid5 rare100 rare101 rare102 rare103")], "q long, question string")
    df = retrieval.document_frequency(postings, retrieval.term_rows(asked, ["q"], "question"))
    weighted = retrieval.term_rows(asked, ["q"], "question").join(df, "term").withColumn("weight", F.expr("100000 div (df + 1)"))
    terms = retrieval._from_heaviest(weighted, ["q"]).collect()
    everything = sum(r["df"] for r in terms)
    bar = 4 * (100_000 // 5) // 4  # eight blocks hold a rare term each
    essential = sum(r["df"] for r in terms if r["rest"] >= bar)
    assert essential * 20 < everything


def _random_book_rows(seed, books):
    """(book, chapter, order, text, id) rows with repeated places, missing keys, long and empty blocks."""
    rnd = random.Random(seed)
    words = "ferry toll river bridge lantern harbour the and".split() + [f"w{i}" for i in range(40)]
    rows = []
    for b in [*range(books), None]:
        for c in [*range(rnd.randint(1, 7)), None]:
            for o in range(rnd.randint(1, 4)):
                text = " ".join(rnd.choices(words, k=rnd.randint(0, 12))) + (" " + "x" * 9000 if rnd.random() < 0.05 else "")
                rows.append((b, c, o, text, f"{b}.{c}.{o}"))
                if rnd.random() < 0.1:
                    rows.append((b, c, o, text + " ferry", f"{b}.{c}.{o}b"))
    rnd.shuffle(rows)
    return rows


PRIOR = "book_id long, spine_index long, ord long, text string, block_id string"


def test_prior_context_of_whole_books_shuffles_no_posting(spark, monkeypatch):
    blocks = spark.createDataFrame(_random_book_rows(3, 12), PRIOR).repartition(5)
    by_term = sorted(map(str, analysis.prior_context(blocks, whole=-1).collect()))
    assert by_term == sorted(map(str, analysis.prior_context(blocks, whole=300).collect()))  # some books one way, some the other
    monkeypatch.setattr(analysis, "max_score", None)  # what joins posting lists
    assert by_term == sorted(map(str, analysis.prior_context(blocks).collect()))


def test_prior_context_in_small_portions(spark):
    """Books that lie in several batches give the same rows."""
    blocks = spark.createDataFrame(_random_book_rows(4, 6), PRIOR).coalesce(1)
    expected = sorted(map(str, analysis.prior_context(blocks, whole=-1).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, analysis.prior_context(blocks).collect())) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_prior_context_scores_chapters_in_turns():
    import pyarrow as pa

    rows = sorted(r for r in _random_book_rows(6, 5) if None not in r)
    columns = dict(zip(("book_id", "spine_index", "ord", "text"), zip(*rows)))
    texts = columns.pop("text")
    table = pa.table({k: list(v) for k, v in columns.items()} | {"bytes": [len(t) for t in texts], "_terms": [sorted(set(t.split())) for t in texts]})
    at_once, in_turns = analysis._best_earlier(table, 8), analysis._best_earlier(table, 8, most=3)
    assert len(at_once[0]) > 20
    assert [x.tolist() for x in in_turns] == [x.tolist() for x in at_once]


def test_chapters_meet_their_excerpts_in_one_shuffle(spark):
    blocks = spark.createDataFrame(_random_book_rows(5, 10), PRIOR).repartition(5)
    chapters = blocks.groupBy("book_id", "spine_index").agg(F.min("text").alias("title"), F.sort_array(F.collect_list("text")).alias("blocks"))
    chapters = chapters.unionByName(chapters.where("book_id % 4 = 1")).unionByName(spark.createDataFrame([(2, 50, "x", []), (90, 0, "y", ["z"])], chapters.schema))
    joined = analysis.chapter_requests(chapters, analysis.prior_context(blocks, whole=-1), blocks, profile="standard")
    expected = sorted(map(str, joined.collect()))
    for whole in (analysis.WHOLE_BOOK, 300):
        made = analysis.chapter_requests(analysis.prior_context(blocks, beside=chapters, whole=whole), None, blocks, profile="standard")
        assert made.columns == joined.columns
        assert sorted(map(str, made.collect())) == expected
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        narrow = chapters.select("book_id", "spine_index", "title", "blocks").localCheckpoint()
        made = analysis.chapter_requests(analysis.prior_context(blocks.localCheckpoint(), beside=narrow), None, blocks, profile="standard")
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
