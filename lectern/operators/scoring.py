"""Benchmark scoring: structural scores, recall, groups, ledgers, comparisons."""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.numbers import basis_points
from lectern.operators.prefix import running_before
from lectern.rules import blank, violations
from lectern.session import broadcast_if_small, durable, forget

# Review dimensions, case dimensions, comparison labels.
REVIEW_DIMENSIONS = ("attribution", "citation_support", "key_point_coverage", "spoiler_boundary")
CASE_DIMENSIONS = tuple(f"D{i:02d}" for i in range(1, 19))
CHANGES = ("improved", "regressed", "unchanged", "unassessed")


def reference_failures(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """First failing check of every cited reference: identity, range, reading scope.

    refs(attempt_id, book_id, block_id, start_char, end_char, text_fingerprint,
    limit_end?); a missing limit allows nothing.
    """
    source = blocks.select("book_id", "block_id", F.col("n_chars").alias("_n"), F.col("fp").alias("_fp"))
    bad_identity = F.col("_n").isNull() | (F.col("text_fingerprint") != F.col("_fp"))
    start, end = F.col("start_char"), F.col("end_char")
    bad_range = start.isNull() | end.isNull() | (start < 0) | (end <= start) | (end > F.col("_n"))
    out_of_scope = end > F.coalesce("limit_end", F.lit(0))
    code = (
        F.when(bad_identity, "source_identity").when(bad_range, "citation_range").when(out_of_scope, "reading_scope")
    )
    return refs.join(source, ["book_id", "block_id"], "left").select("attempt_id", code.alias("code")).where("code is not null")


def structural_score(
    trials: DataFrame, cases: DataFrame, steps: DataFrame, refs: DataFrame, blocks: DataFrame
) -> DataFrame:
    """Per trial: distinct failure codes, structural result, hard failures, success.

    ``passed`` and ``task_success`` are null for a case that does not apply;
    success is false on failure and otherwise unknown until a review sets it.
    """
    cased = trials.join(
        cases.select("case_id", "applicability", "max_calls", "n_steps"), "case_id"
    )
    recorded = steps.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("_steps"))
    trial_codes = (
        cased.join(recorded, "attempt_id", "left")
        .select(
            "attempt_id",
            F.explode(
                violations(
                    [
                        (F.col("call_count") > F.col("max_calls"), "call_budget"),
                        (
                            (F.col("status") == "completed") & (F.coalesce("_steps", F.lit(0)) != F.col("n_steps")),
                            "missing_steps",
                        ),
                    ]
                )
            ).alias("code"),
        )
        .unionByName(
            trials.where("status <> 'completed'").select(
                "attempt_id", F.concat(F.lit("execution:"), "status").alias("code")
            )
        )
    )
    step_codes = steps.select(
        "attempt_id",
        F.when(~F.col("has_cards"), "empty_cards").when(blank(F.col("output")), "empty_output").alias("code"),
    ).where("code is not null")
    codes = (
        reduce(DataFrame.unionByName, [trial_codes, step_codes, reference_failures(refs, blocks)])
        .groupBy("attempt_id")
        .agg(F.array_sort(F.collect_set("code")).alias("codes"))
    )
    empty = F.array().cast("array<string>")
    na = F.col("applicability") == "not_applicable"
    found = F.coalesce("codes", empty)
    return cased.join(codes, "attempt_id", "left").select(
        "attempt_id",
        "case_id",
        "status",
        F.when(na, "not_applicable").otherwise("evaluated").alias("structural_state"),
        F.when(~na, F.size(found) == 0).alias("passed"),
        F.when(na, empty).otherwise(found).alias("hard_failures"),
        F.when(~na & (F.size(found) > 0), F.lit(False)).alias("task_success"),
    )


def evidence_recall(attempts: DataFrame, gold_sets: DataFrame, anchors: DataFrame, offers: DataFrame) -> DataFrame:
    """Best share of any gold evidence set that was offered in full.

    gold_sets(case_id, set_no, anchor), anchors(case_id, anchor, block_id, fp,
    n_chars), offers(attempt_id, block_id, start_char, end_char,
    text_fingerprint).  No sets: not applicable; no anchors: not evaluated.
    """
    whole = offers.where("start_char = 0").select(
        "attempt_id", "block_id", F.col("text_fingerprint").alias("fp"), F.col("end_char").alias("n_chars")
    ).distinct()
    members = attempts.select("attempt_id", "case_id").join(gold_sets, "case_id")
    placed = members.join(anchors, ["case_id", "anchor"], "left")
    hit = placed.join(
        whole.withColumn("_hit", F.lit(1)), ["attempt_id", "block_id", "fp", "n_chars"], "left"
    )
    per_set = hit.groupBy("attempt_id", "set_no").agg(
        F.sum(F.coalesce("_hit", F.lit(0))).alias("hits"),
        F.count(F.lit(1)).alias("members"),
        F.max(F.col("block_id").isNotNull()).alias("mapped"),
    )
    best = per_set.groupBy("attempt_id").agg(
        F.max(basis_points(F.col("hits"), F.col("members"))).alias("_best"),
        F.max(F.col("hits") == F.col("members")).alias("_complete"),
        F.max("mapped").alias("_mapped"),
    )
    evaluated = F.coalesce("_mapped", F.lit(False))
    return attempts.select("attempt_id", "case_id").join(best, "attempt_id", "left").select(
        "attempt_id",
        F.when(F.col("_best").isNull(), "not_applicable")
        .when(~evaluated, "not_evaluated")
        .otherwise("evaluated")
        .alias("state"),
        F.when(evaluated, F.col("_best")).alias("best_recall_basis_points"),
        F.when(evaluated, F.col("_complete")).alias("complete_evidence_set"),
    )


def apply_reviews(scores: DataFrame, reviews: DataFrame) -> DataFrame:
    """Scores with the bound review: minimum over dimensions, semantic hard codes, success.

    reviews(attempt_id, semantic_score, semantic_codes).
    """
    hard = F.concat("hard_failures", F.coalesce("semantic_codes", F.array().cast("array<string>")))
    reviewed = F.col("semantic_score").isNotNull()
    return scores.join(reviews.select("attempt_id", "semantic_score", "semantic_codes"), "attempt_id", "left").select(
        "attempt_id",
        "case_id",
        "status",
        "structural_state",
        "passed",
        F.when(reviewed, "evaluated")
        .when(F.col("structural_state") == "not_applicable", "not_applicable")
        .otherwise("not_evaluated")
        .alias("semantic_state"),
        "semantic_score",
        hard.alias("hard_failures"),
        F.when(
            reviewed,
            F.coalesce("passed", F.lit(False)) & (F.size("semantic_codes") == 0) & (F.col("semantic_score") == 3),
        )
        .otherwise(F.col("task_success"))
        .alias("task_success"),
    )


def review_score(checks: DataFrame) -> DataFrame:
    """Minimum score and hard-failure codes per attempt; checks(attempt_id, dimension, score, hard_failure)."""
    return checks.groupBy("attempt_id").agg(
        F.min("score").alias("semantic_score"),
        F.array_sort(
            F.collect_set(F.when(F.col("hard_failure"), F.concat(F.lit("semantic:"), "dimension")))
        ).alias("semantic_codes"),
    )


def bind_reviews(reviews: DataFrame, checks: DataFrame, trials: DataFrame, cases: DataFrame, gold: DataFrame) -> DataFrame:
    """Each review with the reason it is rejected, null when it binds.

    A review must name a completed trial once, match artifact, case and gold
    hashes, rest on reviewed gold, and carry all four dimensions exactly once
    with consistent scores.
    """
    per = checks.groupBy("attempt_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.array_sort(F.collect_set("dimension")).alias("_dims"),
        F.max(
            ~F.col("score").between(0, 3)
            | ~F.col("verdict").isin("supports", "refutes", "insufficient")
            | blank(F.col("evidence"))
        ).alias("_malformed"),
        F.max(
            (F.col("score") == 3) & ((F.col("verdict") != "supports") | F.col("hard_failure"))
        ).alias("_conflict"),
    )
    copies = reviews.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("_copies"))
    t = trials.select("attempt_id", "case_id", F.col("status").alias("_status"), F.col("artifact_hash").alias("_a"))
    c = cases.select("case_id", F.col("case_hash").alias("_c"))
    g = gold.select("case_id", F.col("gold_hash").alias("_g"), F.col("gold_status").alias("_gs"))
    joined = (
        reviews.join(t, "attempt_id", "left")
        .join(c, "case_id", "left")
        .join(g, "case_id", "left")
        .join(per, "attempt_id", "left")
        .join(copies, "attempt_id", "left")
    )
    dims = F.array(*[F.lit(d) for d in REVIEW_DIMENSIONS])
    reason = (
        F.when(F.col("_status").isNull(), "unknown_attempt")
        .when(F.col("_copies") > 1, "duplicate_review")
        .when(F.col("_status") != "completed", "incomplete_attempt")
        .when(~F.col("_gs").eqNullSafe(F.lit("reviewed")), "draft_gold")
        .when(~F.col("artifact_hash").eqNullSafe(F.col("_a")), "stale_artifact")
        .when(~F.col("case_hash").eqNullSafe(F.col("_c")), "stale_case")
        .when(~F.col("gold_hash").eqNullSafe(F.col("_g")), "stale_gold")
        .when(blank(F.col("reviewer")) | blank(F.col("judge_version")), "missing_attribution")
        .when((F.coalesce("_n", F.lit(0)) != 4) | (F.col("_dims") != dims), "dimensions")
        .when(F.col("_malformed"), "malformed_check")
        .when(F.col("_conflict"), "score_conflict")
    )
    return joined.select("attempt_id", reason.alias("rejected"))


def group_summary(scores: DataFrame, memberships: DataFrame) -> DataFrame:
    """Counts per group value; memberships(attempt_id, grouping, value).

    A trial counts once per distinct value, so memberships are made distinct.
    """
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return (
        memberships.distinct()
        .join(scores, "attempt_id")
        .groupBy("grouping", "value")
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            flag(F.col("status") == "completed").alias("completed"),
            flag(F.col("passed")).alias("structural_passes"),
            flag(F.col("semantic_state") == "evaluated").alias("semantic_evaluated"),
            flag(F.col("task_success")).alias("successes"),
            flag(F.size("hard_failures") > 0).alias("hard_failures"),
        )
    )


def repeat_outcomes(cases: DataFrame, scores: DataFrame, planned: int) -> DataFrame:
    """Per case: planned, recorded, successes; all_passed stays null until all are known."""
    seen = scores.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("recorded"),
        F.count("task_success").alias("_known"),
        F.sum(F.when(F.col("task_success"), 1).otherwise(0)).alias("successes"),
        F.min("task_success").alias("_all"),
    )
    zero = F.lit(0).cast("long")
    return cases.select("case_id").join(seen, "case_id", "left").select(
        "case_id",
        F.lit(planned).cast("long").alias("planned"),
        F.coalesce("recorded", zero).alias("recorded"),
        F.coalesce("successes", zero).alias("successes"),
        F.when((F.col("recorded") == planned) & (F.col("_known") == F.col("recorded")), F.col("_all")).alias("all_passed"),
    )


def pair_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs side by side with a change label; unknown on either side is unassessed."""
    a = left.select("attempt_id", F.col("task_success").alias("left_success"))
    b = right.select("attempt_id", F.col("task_success").alias("right_success"))
    unknown = F.col("left_success").isNull() | F.col("right_success").isNull()
    return a.join(b, "attempt_id", "full_outer").withColumn(
        "change",
        F.when(unknown, "unassessed")
        .when(F.col("left_success") == F.col("right_success"), "unchanged")
        .when(F.col("right_success"), "improved")
        .otherwise("regressed"),
    )


def change_counts(pairs: DataFrame) -> DataFrame:
    """All four labels, zeros kept."""
    labels = pairs.sparkSession.createDataFrame([(c,) for c in CHANGES], "change string")
    counted = pairs.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(labels).join(counted, "change", "left").select(
        "change", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def comparable_runs(left: DataFrame, right: DataFrame, fields: list[str], pair: str = "pair_id") -> DataFrame:
    """Manifest fields on which the two runs of each pair differ (pair_id, incomparable).

    The compiler may differ only for the source-only comparison.
    """
    names = [*fields, "compiler", "candidate"]
    a = left.select(pair, *[F.col(f).alias(f"l_{f}") for f in names])
    b = right.select(pair, *[F.col(f).alias(f"r_{f}") for f in names])
    both = a.join(b, pair)

    def source_only(side: str) -> Column:
        return (F.col(f"{side}_candidate") == "A1") & (F.col(f"{side}_compiler") == "source-only")

    def compiled(side: str) -> Column:
        return (F.col(f"{side}_candidate") == "A0") & F.col(f"{side}_compiler").isin(
            "offline-registration", "configured-provider"
        )

    allowed = (source_only("l") & compiled("r")) | (source_only("r") & compiled("l"))
    rules = [(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), f) for f in fields]
    rules.append((~F.col("l_compiler").eqNullSafe(F.col("r_compiler")) & ~allowed, "compiler"))
    return both.select(pair, F.explode(violations(rules)).alias("incomparable"))


def same_attempts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Attempts present in only one run."""
    a, b = left.select("attempt_id").distinct(), right.select("attempt_id").distinct()
    return (
        a.join(b, "attempt_id", "left_anti")
        .withColumn("side", F.lit("left"))
        .unionByName(b.join(a, "attempt_id", "left_anti").withColumn("side", F.lit("right")))
    )


def run_verdict(scores: DataFrame, keys: list[str]) -> DataFrame:
    failed = (F.size("hard_failures") > 0) | F.coalesce(~F.col("task_success"), F.lit(False))
    return scores.groupBy(*keys).agg(
        F.when(F.max(failed), "fail").otherwise("inconclusive").alias("quality"),
        F.count(F.lit(1)).alias("attempts"),
    )


def ledger_summary(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and phase, with a total row (phase null): usage known and unknown.

    calls(…, phase?, usage struct?, estimated_usd?); a missing phase is ``answer``.
    Money is summed as decimal, so the result does not depend on task order.
    """
    known = F.col("usage").isNotNull() & F.col("estimated_usd").isNotNull()
    usd = F.when(known, F.col("estimated_usd").cast("decimal(38,12)"))
    total = lambda c: F.coalesce(F.sum(F.when(known, c)), F.lit(0).cast("long"))
    prepared = calls.withColumn("phase", F.coalesce("phase", F.lit("answer")))
    measures = [
        F.count(F.lit(1)).alias("invocations"),
        F.sum(F.when(known, 1).otherwise(0)).alias("known_usage_calls"),
        F.sum(F.when(known, 0).otherwise(1)).alias("unknown_usage_calls"),
        total(F.col("usage.input_tokens")).alias("input_tokens"),
        total(F.col("usage.output_tokens")).alias("output_tokens"),
        F.coalesce(F.sum(usd).cast("double"), F.lit(0.0)).alias("known_estimated_usd"),
    ]
    sets = [[*[F.col(k) for k in keys], F.col("phase")], [F.col(k) for k in keys]]
    return prepared.groupingSets(sets, *[F.col(k) for k in keys], F.col("phase")).agg(*measures)


def budget_admission(calls: DataFrame, limits: dict) -> DataFrame:
    """Admit or refuse each call of a run, judged on what was admitted before.

    calls(run_id, seq, input_bytes, usage, estimated_usd).  Oversized requests
    are refused alone.  All other tests are on totals that only grow, so a run
    is closed from its first refusal on: the closing call and its reason are
    found among the first ``max_invocations`` + 1 calls of a run, and every
    later call gets the same reason.  No run is ever folded whole.
    """
    fits = F.col("input_bytes") <= limits["max_request_bytes"]
    order = Window.partitionBy("run_id").orderBy("seq")
    head = (
        calls.where(fits)
        .select(
            "run_id",
            "seq",
            (F.col("usage").isNull() | F.col("estimated_usd").isNull()).cast("int").alias("unknown"),
            F.coalesce("usage.input_tokens", F.lit(0).cast("long")).alias("tokens_in"),
            F.coalesce("usage.output_tokens", F.lit(0).cast("long")).alias("tokens_out"),
            F.coalesce("estimated_usd", F.lit(0.0)).cast("decimal(38,12)").alias("usd"),
        )
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= limits["max_invocations"] + 1)
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    reason = (
        F.when(F.col("n") > limits["max_invocations"], "invocation_limit")
        .when(F.col("p_unknown") > 0, "unaccounted_invocation")
        .when(F.col("p_in") >= limits["stop_after_input_tokens"], "reported_input_token_threshold")
        .when(F.col("p_out") >= limits["stop_after_output_tokens"], "reported_output_token_threshold")
        .when(
            F.col("p_usd") >= F.lit(limits["stop_after_estimated_usd"]).cast("decimal(38,12)"),
            "estimated_cost_threshold",
        )
    )
    closing = (
        head.withColumn("p_unknown", prior("unknown"))
        .withColumn("p_in", prior("tokens_in"))
        .withColumn("p_out", prior("tokens_out"))
        .withColumn("p_usd", prior("usd"))
        .withColumn("reason", reason)
        .where("reason is not null")
        .groupBy("run_id")
        .agg(F.min(F.struct("seq", "reason")).alias("close"))
    )
    joined = calls.join(closing, "run_id", "left")
    return joined.withColumn(
        "reason",
        F.when(~fits, "request_bytes").when(F.col("seq") >= F.col("close.seq"), F.col("close.reason")),
    ).withColumn("allowed", F.col("reason").isNull()).drop("close")


CHUNK_ROWS = 1_000_000


def rate_window(requests: DataFrame, *, limit: int = 60, window_seconds: int = 60, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Accept a request when fewer than ``limit`` were accepted in the trailing window.

    requests(key, ts_us, seq).  A key is cut where the outcome cannot depend on
    earlier requests: after a silent window, and after a window that, with the
    one before, holds at most ``limit`` requests (all of them accepted; they are
    handed to the next segment as its starting state).  Cuts are found on
    per-window counts, so a busy key becomes many independent segments; inside
    one the fold streams over sorted rows with at most ``limit`` timestamps of
    state.  A segment of more than ``chunk_rows`` requests, a key that is
    overloaded for long, is folded in chunks (``_in_chunks``).
    """
    span = window_seconds * 1_000_000
    bucketed = requests.withColumn("bucket", F.expr(f"ts_us div {span}"))
    counts = bucketed.groupBy("key", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )
    order = Window.partitionBy("key").orderBy("bucket")
    previous = lambda c: F.lag(c).over(order)
    adjacent = previous("bucket") == F.col("bucket") - 1
    light = F.col("n") + F.when(adjacent, previous("n")).otherwise(0) <= limit
    marked = counts.withColumn("light", light).withColumn(
        "silent", F.coalesce(F.col("first_us") - previous("last_us") >= span, F.lit(True))
    )
    marked = marked.withColumn("after_light", F.coalesce(previous("light") & adjacent, F.lit(False)))
    segments = durable(
        marked.withColumn("segment", F.last(F.when(F.col("silent") | F.col("after_light"), F.col("bucket")), True).over(order))
    )
    warm = (
        segments.where("after_light and not silent")
        .select("key", (F.col("bucket") - 1).alias("bucket"), F.col("bucket").alias("segment"))
        .withColumn("warm", F.lit(True))
    )
    own = segments.select("key", "bucket", "segment").withColumn("warm", F.lit(False))
    rows = bucketed.join(own.unionByName(warm), ["key", "bucket"]).select("key", "segment", "ts_us", "seq", "warm")
    key_type = requests.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, seq bigint, accepted boolean"
    long = durable(segments.groupBy("key", "segment").agg(F.sum("n").alias("n")).where(F.col("n") > chunk_rows).drop("n"))
    if long.isEmpty():
        return _streamed(rows, limit, span, schema)
    side = broadcast_if_small(long)
    chunked = _in_chunks(rows.join(side, ["key", "segment"], "left_semi"), limit, span, chunk_rows, key_type)
    return _streamed(rows.join(side, ["key", "segment"], "left_anti"), limit, span, schema).unionByName(chunked)


def _streamed(rows: DataFrame, limit: int, span: int, schema: str) -> DataFrame:
    dealt = rows.repartition("key", "segment").sortWithinPartitions("key", "segment", "ts_us", "seq")
    return dealt.mapInPandas(_rate_fold(limit, span), schema)


def _rate_fold(limit: int, span: int):
    def run(batches):
        current, recent = None, deque()
        for pdf in batches:
            accepted = []
            for key, segment, at, warm in zip(pdf["key"], pdf["segment"], pdf["ts_us"], pdf["warm"]):
                if (key, segment) != current:
                    current, recent = (key, segment), deque()
                accepted.append(_admit(recent, at, warm, limit, span))
            out = pdf[["key", "seq"]].assign(accepted=accepted)
            yield out[~pdf["warm"]]

    return run


def _admit(recent: deque, at: int, warm: bool, limit: int, span: int) -> bool:
    while recent and at - recent[0] >= span:
        recent.popleft()
    ok = warm or len(recent) < limit
    if ok:
        recent.append(at)
    return ok


CHUNK = ["key", "segment", "chunk"]
SLOTS = 256  # cuts of a window at which a chunk may end


def _in_chunks(rows: DataFrame, limit: int, span: int, chunk_rows: int, key_type: str) -> DataFrame:
    """Overloaded segments folded chunk by chunk, all chunks at once, from assumed entry states.

    A chunk is a stretch of time with about ``chunk_rows`` requests; the state
    between two chunks is at most ``limit`` timestamps.  Every chunk is first
    folded from no state.  Then each gets the state that the chunk before it
    left, and only chunks whose entry has changed are folded again, until none
    has.  A fold forgets its entry wherever traffic thins out, so few rounds are
    needed; a key that stays saturated throughout settles one chunk a round, which
    costs rounds but never puts more than one chunk into a task.
    """
    slot = max(1, span // SLOTS)
    slotted = rows.withColumn("slot", F.expr(f"ts_us div {slot}"))
    sizes = slotted.groupBy("key", "segment", "slot").agg(F.count(F.lit(1)).alias("n"))
    numbered_slots = running_before(sizes, ["key", "segment"], "slot", "n", "_before")
    chunks = numbered_slots.select("key", "segment", "slot", F.expr(f"_before div {chunk_rows}").alias("chunk"))
    dealt = durable(slotted.join(chunks, ["key", "segment", "slot"]).drop("slot"))
    state = f"key {key_type}, segment bigint, chunk bigint, first_us bigint, entry array<bigint>, leaving array<bigint>"

    def fold(ident, pdf, given, accepted):
        recent = deque(int(t) for t in given["entry"].iloc[0])
        pdf = pdf.sort_values(["ts_us", "seq"], kind="stable")
        for at, warm in zip(pdf["ts_us"].tolist(), pdf["warm"].tolist()):
            accepted.append(_admit(recent, at, warm, limit, span))
        return pdf, list(recent)

    def states(ident, pdf, given):
        if not len(given):
            return pd.DataFrame(columns=["key", "segment", "chunk", "first_us", "entry", "leaving"])
        done, recent = fold(ident, pdf, given, [])
        first = int(done["ts_us"].iloc[0])
        return pd.DataFrame([(*ident, first, list(given["entry"].iloc[0]), recent)], columns=["key", "segment", "chunk", "first_us", "entry", "leaving"])

    def outcomes(ident, pdf, given):
        accepted = []
        done, _ = fold(ident, pdf, given, accepted)
        out = done[["key", "seq"]].assign(accepted=accepted)
        return out[~done["warm"]]

    def folded(entries: DataFrame, run, schema: str) -> DataFrame:
        wanted = dealt.join(broadcast_if_small(entries.select(*CHUNK)), CHUNK, "left_semi")
        return wanted.groupBy(*CHUNK).cogroup(entries.groupBy(*CHUNK)).applyInPandas(run, schema)

    none = F.array().cast("array<bigint>")
    now = durable(folded(durable(dealt.select(*CHUNK).distinct().withColumn("entry", none)), states, state))
    along = Window.partitionBy("key", "segment").orderBy("chunk")
    while True:
        handed = F.coalesce(F.lag("leaving").over(along), none)
        live = F.filter(handed, lambda t: F.col("first_us") - t < span)
        wanted = durable(now.withColumn("given", live))
        changed = wanted.where("given <> entry").select(*CHUNK, F.col("given").alias("entry"))
        if changed.isEmpty():
            break
        again = folded(durable(changed), states, state)
        before = now
        now = durable(now.join(changed.select(*CHUNK), CHUNK, "left_anti").unionByName(again))
        forget(before, wanted)
    return folded(now.select(*CHUNK, "entry"), outcomes, f"key {key_type}, seq bigint, accepted boolean")


def usage_totals(requests: DataFrame, *, agent_micros: int, compile_micros: int) -> DataFrame:
    """Request, byte and cost totals by operation, and over all (operation null)."""
    agent = F.col("operation").isin("explain", "ask", "reflect")
    compiled = F.col("operation") == "compile"
    micros = F.when(agent, agent_micros).when(compiled, compile_micros).otherwise(0).cast("long")
    return requests.rollup("operation").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.sum(F.when(agent, 1).otherwise(0)).alias("agent_request_count"),
        F.sum(F.when(compiled, 1).otherwise(0)).alias("compile_count"),
        F.sum("input_bytes").alias("input_bytes"),
        F.sum("output_bytes").alias("output_bytes"),
        F.sum(micros).alias("estimated_cost_micros"),
    )


def corpus_profile(cases: DataFrame, books: DataFrame, gold: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Long table (measure, n): questions, families, gold, suites and D01..D18 with zeros."""
    spark = cases.sparkSession
    head = cases.agg(
        F.count(F.lit(1)).alias("questions"),
        F.sum(F.when(F.col("suite") == "regression", 1).otherwise(0)).alias("regression"),
        F.sum(F.when(F.col("suite") == "capability", 1).otherwise(0)).alias("capability"),
    ).unpivot([], ["questions", "regression", "capability"], "measure", "n")
    families = books.select("family").distinct().agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("source_families").alias("measure"), "n"
    )
    reviewed = gold.agg(F.sum(F.when(F.col("gold_status") == "reviewed", 1).otherwise(0)).alias("n")).select(
        F.lit("reviewed_gold").alias("measure"), F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )
    labels = spark.createDataFrame([(d,) for d in CASE_DIMENSIONS], "measure string")
    counted = (
        dimensions.select("case_id", F.col("dimension").alias("measure"))
        .distinct()
        .groupBy("measure")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    histogram = F.broadcast(labels).join(counted, "measure", "left").select(
        "measure", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )
    return reduce(DataFrame.unionByName, [head, families, reviewed, histogram])


def leakage(books: DataFrame) -> DataFrame:
    """Books that conflict across the dev / holdout split, by family and by content.

    books(book, split, family, source_hash).  A conflict group is every dev book
    times every holdout book with the same key; the groups are given factored,
    one row per book with the number of books on the other side, because the
    pairs of a large group of copies would be quadratic.  No rows: split valid.
    """
    long = books.select(
        "book",
        "split",
        F.explode(
            F.array(
                F.struct(F.lit("same_source_family").alias("reason"), F.col("family").alias("key")),
                F.struct(F.lit("identical_source").alias("reason"), F.col("source_hash").alias("key")),
            )
        ).alias("x"),
    ).select("book", "split", "x.reason", "x.key")
    sides = long.groupBy("reason", "key").agg(
        F.sum(F.when(F.col("split") == "dev", 1).otherwise(0)).alias("dev"),
        F.sum(F.when(F.col("split") == "holdout", 1).otherwise(0)).alias("holdout"),
    ).where("dev > 0 and holdout > 0")
    return long.join(sides, ["reason", "key"]).select(
        "book",
        "split",
        "reason",
        "key",
        F.when(F.col("split") == "dev", F.col("holdout")).otherwise(F.col("dev")).alias("counterparts"),
    )


def calibration_agreement(samples: DataFrame, judgments: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement on score, verdict and hard failure per calibration set.

    samples(keys, id, status, score, verdict, hard_failure); the gate needs at
    least 20 reviewed samples, all judged, all equal.
    """
    j = judgments.select(
        *keys,
        "id",
        F.col("score").alias("j_score"),
        F.col("verdict").alias("j_verdict"),
        F.col("hard_failure").alias("j_hard"),
        F.lit(True).alias("_judged"),
    )
    same = (
        F.col("score").eqNullSafe(F.col("j_score"))
        & F.col("verdict").eqNullSafe(F.col("j_verdict"))
        & F.col("hard_failure").eqNullSafe(F.col("j_hard"))
    )
    counted = samples.join(j, [*keys, "id"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("expected_samples"),
        F.count("_judged").alias("evaluated_samples"),
        F.sum(F.when(F.col("_judged").isNotNull() & same, 1).otherwise(0)).alias("matches"),
        F.min(F.col("status") == "reviewed").alias("_reviewed"),
    )
    complete = F.col("_reviewed") & (F.col("evaluated_samples") == F.col("expected_samples")) & (
        F.col("expected_samples") >= 20
    )
    return counted.select(
        *keys,
        "expected_samples",
        "evaluated_samples",
        (F.col("expected_samples") - F.col("evaluated_samples")).alias("missing_samples"),
        "matches",
        F.when(complete, "evaluated").otherwise("not_evaluated").alias("state"),
        (complete & (F.col("matches") == F.col("evaluated_samples"))).alias("calibrated"),
    )


def map_gold_anchors(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Anchors (book_id, href, text, …) to blocks of their book by href and exact text; anything but one match is an error.

    Matching is on the text fingerprint, so no text is shuffled.
    """
    targets = blocks.groupBy("book_id", "href", "fp").agg(F.count(F.lit(1)).alias("matches"), F.min("block_id").alias("block_id"))
    return anchors.withColumn("fp", F.sha2("text", 256)).drop("text").join(targets, ["book_id", "href", "fp"], "left").select(
        *[c for c in anchors.columns if c != "text"],
        F.coalesce("matches", F.lit(0).cast("long")).alias("matches"),
        F.when(F.col("matches") == 1, F.col("block_id")).alias("block_id"),
        F.when(F.col("matches").isNull(), "lost").when(F.col("matches") > 1, "ambiguous").alias("error"),
    )


def derive_thresholds(runs: DataFrame) -> DataFrame:
    """25 % above the observed duration and cost; one row per run."""
    return runs.select(
        "book_id",
        "profile",
        F.ceil(F.col("duration_ms") * 1.25).cast("long").alias("max_duration_ms"),
        (F.col("estimated_usd") * 1.25).alias("max_estimated_usd"),
    )


def baseline_check(runs: DataFrame, limits: DataFrame) -> DataFrame:
    """Runs against frozen limits: missing on either side, too slow, too dear."""
    keys = ["book_id", "profile"]
    now = runs.select(*keys, "duration_ms", "estimated_usd", F.lit(1).alias("_run"))
    frozen = limits.select(*keys, "max_duration_ms", "max_estimated_usd", F.lit(1).alias("_limit"))
    rules = [
        (F.col("_run").isNull(), "baseline_case_missing"),
        (F.col("_limit").isNull(), "baseline_missing"),
        (F.col("duration_ms") > F.col("max_duration_ms"), "duration_exceeds_baseline"),
        (F.col("estimated_usd") > F.col("max_estimated_usd"), "cost_exceeds_baseline"),
    ]
    return now.join(frozen, keys, "full_outer").select(*keys, F.explode(violations(rules)).alias("code"))


def metric_baseline(metrics: DataFrame, minimum: DataFrame) -> DataFrame:
    """Metrics below the frozen minimum; an unknown minimum must keep its state."""
    keys = ["book_id", "metric"]
    m = minimum.select(*keys, F.col("state").alias("_state"), F.col("value").alias("_value"))
    fine = F.when(F.col("_value").isNull(), F.col("state").eqNullSafe(F.col("_state"))).otherwise(
        F.coalesce((F.col("state") == "evaluated") & (F.col("value") >= F.col("_value")), F.lit(False))
    )
    return m.join(metrics, keys, "left").where(~fine).select(*keys, F.lit("metric_regression").alias("code"))


def provider_span(events: DataFrame, keys: list[str]) -> DataFrame:
    """Wall time from first start to last finish, calls and tokens per run."""
    return events.groupBy(*keys).agg(
        (F.max("finished_us") - F.min("started_us")).alias("span_us"),
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def acceptance_gate(runs: DataFrame) -> DataFrame:
    """At least three standard books, a deep run of one of them, a basic run, no duplicates.

    runs(book_id, profile, passed, has_usage).  Both sides are one-row totals.
    """
    per = runs.groupBy("book_id").agg(
        F.max((F.col("profile") == "standard") & F.col("passed")).alias("standard"),
        F.max((F.col("profile") == "deep") & F.col("passed")).alias("deep"),
        F.max((F.col("profile") == "basic") & F.col("passed")).alias("basic"),
        F.min("has_usage").alias("usage"),
    )
    copies = runs.groupBy("book_id", "profile").agg(F.count(F.lit(1)).alias("n"))
    gate = per.agg(
        F.sum(F.when(F.col("standard"), 1).otherwise(0)).alias("standard_books"),
        F.max(F.col("standard") & F.col("deep")).alias("deep_of_standard"),
        F.max("basic").alias("has_basic"),
        F.min("usage").alias("full_usage"),
    )
    duplicate = copies.agg((F.max("n") > 1).alias("duplicates")).withColumn("_one", F.lit(1))
    return gate.withColumn("_one", F.lit(1)).join(duplicate, "_one").drop("_one").withColumn(
        "passed",
        (F.col("standard_books") >= 3)
        & F.col("deep_of_standard")
        & F.col("has_basic")
        & F.col("full_usage")
        & ~F.col("duplicates"),
    )


def experiment_cost(events: DataFrame, keys: list[str]) -> DataFrame:
    """Cost of events with usage and the number of unpriced ones; the list is the null-cost rows."""
    usd = F.col("estimated_usd").cast("decimal(38,12)")
    return events.groupBy(*keys).agg(
        F.coalesce(F.sum(usd).cast("double"), F.lit(0.0)).alias("estimated_usd"),
        F.count("estimated_usd").alias("measured_events"),
        F.sum(F.when(F.col("estimated_usd").isNull(), 1).otherwise(0)).alias("unpriced_events"),
    )


def timing_summary(attempts: DataFrame, compilations: DataFrame) -> DataFrame:
    """Compile, reader and first-result time; compilations shared by attempts are deduplicated by id."""
    once = compilations.groupBy("compilation_id").agg(F.max("duration_ms").alias("compile_ms"))
    return attempts.join(once, "compilation_id").select(
        "attempt_id",
        "reader_ms",
        "compile_ms",
        F.when(F.col("status") == "completed", F.col("compile_ms") + F.col("reader_ms")).alias("first_result_ms"),
    )


def review_packets(trials: DataFrame, steps: DataFrame, limits: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blinded evidence packets of completed trials, and the bindings kept apart.

    The packet id is a hash that does not reveal attempt or candidate.
    """
    done = trials.where("status = 'completed'").select("attempt_id", "case_id", "artifact_hash")
    named = done.withColumn("packet_id", F.sha2(F.concat_ws("|", F.lit("packet"), "attempt_id", "artifact_hash"), 256))
    evidence = limits.join(blocks.select("book_id", "block_id", "text", "fp"), ["book_id", "block_id"]).select(
        "attempt_id",
        "block_id",
        F.expr("substring(text, 1, cast(end_char as int))").alias("text"),
        "end_char",
        F.col("fp").alias("text_fingerprint"),
    )
    packets = named.select("packet_id", "attempt_id").join(evidence, "attempt_id").drop("attempt_id")
    return packets, named.select("packet_id", "attempt_id", "case_id", "artifact_hash")
