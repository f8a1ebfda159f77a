"""Streams with state: event order over many Arrow batches, expiry, two-event budgets, progress, replayed epochs."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from lectern.operators import reading
from lectern.streaming import jobs

LIMITS = {
    "max_request_bytes": 100, "max_invocations": 4, "stop_after_input_tokens": 50, "stop_after_output_tokens": 60,
    "stop_after_estimated_usd": 0.5,
}
HOUR = 3_600_000_000


class Feed:
    """A folder to which files are added between runs of one query."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/part={self.n}")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in/part=*")

    def run(self, stream):
        return jobs.run_available(stream, "append", f"{self.folder}/run")

    def state(self, name):
        return self.spark.read.format("statestore").option("stateVarName", name).load(f"{self.folder}/run/checkpoint")


def plain_rate(rows, limit, span):
    out, recent = {}, {}
    for key, seq, at in sorted(rows, key=lambda r: (r[2], r[1])):
        held = recent.setdefault(key, deque())
        while held and at - held[0] >= span:
            held.popleft()
        out[key, seq] = len(held) < limit
        if out[key, seq]:
            held.append(at)
    return out


def test_rate_limit_in_event_order_with_bounded_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i % 7 if i % 3 else 0, i, HOUR + rng.randrange(40 * 60) * 1_000_000) for i in range(3000)]
    feed = Feed(spark, tmp_path, "key long, seq long, ts_us long")
    feed.add(rows)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # the busy key spans many batches
    try:
        got = feed.run(jobs.rate_limit_stream(feed.stream(), limit=5, window_seconds=120)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert {(r["key"], r["seq"]): r["accepted"] for r in got} == plain_rate(rows, 5, 120_000_000)
    assert feed.state("spool").count() == 0


def test_rate_state_goes_with_its_window(spark, tmp_path):
    feed = Feed(spark, tmp_path, "key long, seq long, ts_us long")
    build = lambda: jobs.rate_limit_stream(feed.stream(), limit=2, window_seconds=60, delay="1 minute")
    feed.add([(k, 10 * k + i, HOUR + i * 1_000_000) for k in range(4) for i in range(3)])
    feed.run(build())
    assert {r["key"]["key"] for r in feed.state("recent").collect()} == {0, 1, 2, 3}
    feed.add([(9, 100, 10 * HOUR)])
    feed.add([(9, 101, 10 * HOUR + 1)])
    got = {r["seq"]: r["accepted"] for r in feed.run(build()).collect()}
    assert got[0] and got[1] and not got[2] and got[100] and got[101]
    assert {r["key"]["key"] for r in feed.state("recent").collect()} == {9}
    assert {r["key"]["key"] for r in feed.state("until").collect()} == {9}


BUDGET = "key string, seq long, ts_us long, kind string, call_id string, input_bytes long, known boolean, tokens_in long, tokens_out long, nano_usd long"


def reserve(seq, call, size=1, key="r"):
    return (key, seq, seq, "reserve", call, size, False, 0, 0, 0)


def settle(seq, call, known=True, i=1, o=1, nano=1, key="r"):
    return (key, seq, seq, "settle", call, 0, known, i, o, nano)


def decisions(feed):
    got = feed.run(jobs.budget_stream(feed.stream(), LIMITS)).collect()
    return {r["seq"]: r["reason"] for r in got}


def test_open_calls_block_and_settlements_release(spark, tmp_path):
    feed = Feed(spark, tmp_path, BUDGET)
    feed.add([
        reserve(1, "a"), reserve(2, "b"), settle(3, "a"), reserve(4, "a"), reserve(5, "b", 101), reserve(6, "b"), settle(7, "x"),
        settle(8, "b", i=49), settle(9, "b"), reserve(10, "c"), reserve(11, "c"),
    ])
    feed.add([settle(12, "c"), reserve(13, "d")])  # settled in a later micro-batch
    assert decisions(feed) == {
        1: None, 2: "unaccounted_invocation", 3: None, 4: "duplicate_invocation", 5: "request_bytes", 6: None, 7: "settled_or_missing",
        8: None, 9: "settled_or_missing", 10: "reported_input_token_threshold", 11: "reported_input_token_threshold",
        12: "settled_or_missing", 13: "reported_input_token_threshold",
    }


def test_settlement_in_a_later_batch_changes_later_decisions_only(spark, tmp_path):
    feed = Feed(spark, tmp_path, BUDGET)
    feed.add([reserve(1, "a"), reserve(2, "b")])
    feed.add([settle(3, "a"), reserve(4, "b")])
    feed.add([reserve(5, "c"), settle(6, "b", known=False)])
    feed.add([reserve(7, "c")])  # unknown usage keeps blocking: the reservation is not given back
    assert decisions(feed) == {
        1: None, 2: "unaccounted_invocation", 3: None, 4: None, 5: "unaccounted_invocation", 6: None, 7: "unaccounted_invocation",
    }


@pytest.mark.parametrize(
    ("settled", "reason"),
    [
        (dict(o=60), "reported_output_token_threshold"), (dict(nano=500_000_000), "estimated_cost_threshold"), (dict(nano=499_999_999), None),
    ],
)
def test_thresholds(spark, tmp_path, settled, reason):
    feed = Feed(spark, tmp_path, BUDGET)
    feed.add([reserve(1, "a"), settle(2, "a", **settled), reserve(3, "b")])
    assert decisions(feed)[3] == reason


def test_invocation_limit_counts_open_calls(spark, tmp_path):
    feed = Feed(spark, tmp_path, BUDGET)
    rows = [x for i in range(4) for x in (reserve(2 * i, f"c{i}"), settle(2 * i + 1, f"c{i}"))]
    feed.add([*rows, reserve(20, "e")])
    assert decisions(feed)[20] == "invocation_limit"


def test_jobs_forget_after_their_time(spark, tmp_path):
    schema = "key long, seq long, ts_us long, kind string, analysis_key string"
    feed = Feed(spark, tmp_path, schema)
    build = lambda: jobs.job_state_stream(feed.stream(), keep_seconds=3600, delay="1 minute")
    feed.add([(1, 1, 1, "request", "a"), (1, 2, 5, "request", "b"), (1, 3, 9, "ready", None), (2, 4, 1, "failed", None)])
    feed.add([(3, 5, 5 * HOUR, "request", "a"), (1, 6, 30, "request", "a")])
    feed.add([(1, 7, 5 * HOUR, "request", "a")])
    got = {r["seq"]: (r["decision"], r["state"]) for r in feed.run(build()).collect()}
    assert got[1] == ("queued", "queued") and got[2] == ("conflict", "queued") and got[3] == (None, "ready") and got[4] == (None, None)
    assert got[6] == ("joined", "ready")
    assert got[7] == ("queued", "queued")  # the job of hour 0 is forgotten
    assert {r["key"]["key"] for r in feed.state("job").collect()} == {1, 3}


def test_progress_after_every_patch_equals_the_batch_operator(spark, tmp_path):
    blocks = spark.createDataFrame(
        [("b", c, o, f"{c}.{o}", 10 + 5 * c + o) for c in range(3) for o in range(4)] + [("other", 0, 0, "z", 7)],
        "book_id string, spine_index long, ord long, block_id string, n_chars long",
    )
    schema = "session_id string, book_id string, seq long, ts_us long, spine_index long, ord long, char_offset long, is_read boolean"
    rng = random.Random(4)
    rows = []
    for seq in range(60):
        read = rng.random() < 0.7
        rows.append((rng.choice("st"), "b", seq, seq // 3, rng.randrange(3), rng.randrange(4), rng.choice([None, 0, 4, 99]), read))
    rows.append(("e", "empty", 60, 60, None, None, None, False))
    feed = Feed(spark, tmp_path, schema)
    for part in (rows[:25], rows[25:40], rows[40:]):
        feed.add(part)
    got = {r["seq"]: r for r in feed.run(jobs.session_progress_stream(feed.stream(), blocks)).collect()}
    assert len(got) == len(rows)
    assert (got[60]["visible"], got[60]["progress_basis_points"], got[60]["revision"]) == (0, 0, 2)
    for session in "st":
        mine = [r for r in rows if r[0] == session]
        for upto in (5, len(mine) // 2, len(mine)):
            read = spark.createDataFrame([r for r in mine[:upto] if r[7]], schema)
            seen = reading.covered_chapters(blocks, reading.coverage(read))
            sessions = spark.createDataFrame([(session, "b")], "session_id string, book_id string")
            want = reading.reading_progress(sessions, seen, reading.book_chars(blocks)).first()
            last = got[mine[upto - 1][2]]
            assert (last["visible"], last["progress_basis_points"]) == (want["visible"], want["progress_basis_points"])
            assert last["revision"] == upto + 1


def test_a_replayed_epoch_leaves_no_copies(spark, tmp_path):
    root = str(tmp_path / "routes")
    save = jobs.save_routes(root)
    batch = spark.createDataFrame([(i, None if i % 3 else "bad") for i in range(30)], "id long, error string")
    batch = batch.withColumn("route", F.when(F.col("error").isNull(), "accepted").otherwise("rejected"))
    save(batch.limit(20), 0)  # an attempt that got some of the rows
    save(batch, 0)
    save(batch.withColumn("id", F.col("id") + 100).where("error is null"), 1)
    accepted, rejected = (jobs.read_route(spark, root, r, batch.schema).collect() for r in ("accepted", "rejected"))
    assert Counter(r["id"] for r in accepted) == Counter([i for i in range(30) if i % 3] + [i + 100 for i in range(30) if i % 3])
    assert Counter(r["id"] for r in rejected) == Counter(i for i in range(30) if not i % 3)
    assert all(r["error"] == "bad" and r["epoch"] == 0 for r in rejected)


def test_a_restart_without_its_last_commit_replays_the_epoch(spark, tmp_path):
    feed = Feed(spark, tmp_path, "id long, error string")
    feed.add([(1, None), (2, "bad")])
    feed.add([(3, None), (4, "bad")])
    routed = lambda: feed.stream().withColumn("route", F.when(F.col("error").isNull(), "accepted").otherwise("rejected"))
    root = jobs.run_routes(routed(), f"{tmp_path}/out")
    (tmp_path / "out/checkpoint/commits/1").rename(tmp_path / "uncommitted")
    crc = tmp_path / "out/checkpoint/commits/.1.crc"
    if crc.exists():
        crc.rename(tmp_path / "uncommitted.crc")
    jobs.run_routes(routed(), root)
    for route, ids in (("accepted", [1, 3]), ("rejected", [2, 4])):
        assert sorted(r["id"] for r in jobs.read_route(spark, root, route, routed().schema).collect()) == ids


def test_progress_is_one_stateful_step(spark, tmp_path):
    """A session's chapters share its state, over several micro-batches too."""
    patches = "session_id string, book_id string, seq long, ts_us long, spine_index long, ord long, char_offset long, is_read boolean"
    first = [("s", "b", 1, 10, 0, 1, 5, True), ("s", "b", 2, 20, 1, 0, 4, True), ("s", "b", 3, 30, 0, 0, 3, True), ("t", "c", 4, 5, 9, 0, 1, False)]
    second = [("s", "b", 5, 40, 0, 1, 7, True), ("s", "b", 6, 50, 1, 0, 9, True), ("s", "b", 7, 60, 2, 0, 9, True)]
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, patches).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
    blocks = spark.createDataFrame(
        [("b", 0, 0, 10), ("b", 0, 1, 10), ("b", 1, 0, 20)], "book_id string, spine_index long, ord long, n_chars long"
    )
    stream = spark.readStream.schema(patches).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    made = jobs.session_progress_stream(stream, blocks)
    assert made._jdf.queryExecution().logical().toString().count("TransformWithStateInPySpark") == 1
    got = {r["seq"]: (r["visible"], r["revision"], r["progress_basis_points"]) for r in jobs.run_available(made, "append").collect()}
    assert got == {1: (15, 2, 3750), 2: (19, 3, 4750), 3: (19, 4, 4750), 4: (0, 2, 0), 5: (21, 5, 5250), 6: (26, 6, 6500), 7: (26, 7, 6500)}


def test_budget_reads_the_calls_of_a_run_at_once():
    from lectern.streaming.processors import Budget

    class State:
        def __init__(self):
            self.asked = 0
            self.rows, self.value = {}, None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def iterator(self):
            self.asked += 1
            return iter([((k,), v) for k, v in self.rows.items()])

        def containsKey(self, key):  # noqa: N802
            self.asked += 1
            return key[0] in self.rows

        def getValue(self, key):  # noqa: N802
            self.asked += 1
            return self.rows[key[0]]

        def updateValue(self, key, value):  # noqa: N802
            self.rows[key[0]] = value

    from types import SimpleNamespace

    limits = {
        "max_request_bytes": 10, "max_invocations": 3, "stop_after_input_tokens": 99, "stop_after_output_tokens": 99, "stop_after_estimated_usd": 1,
    }
    run = Budget(limits)
    run.calls, run.totals = State(), State()
    row = lambda seq, kind, call, known=True: SimpleNamespace(
        seq=seq, kind=kind, call_id=call, input_bytes=1, known=known, tokens_in=1, tokens_out=1, nano_usd=1
    )
    reasons = []
    for batch in ([row(1, "reserve", "a"), row(2, "reserve", "b")], [row(3, "settle", "a"), row(4, "settle", "a"), row(5, "reserve", "a"), row(6, "reserve", "b")]):
        run.start()
        reasons += [run.step(r)[3] for r in batch]
        run.finish()
    assert reasons == [None, "unaccounted_invocation", None, "settled_or_missing", "duplicate_invocation", None]
    assert run.calls.rows == {"a": (False,), "b": (True,)} and run.calls.asked == 1
