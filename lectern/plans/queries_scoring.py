"""Benchmark scoring, ledgers, comparison and calibration queries."""

from pyspark.sql import functions as F

from lectern.functions import numbers
from lectern.functions import text as T
from lectern.operators import scoring
from lectern.plans import base, reader, suite_data
from lectern.plans.registry import query, view

view(
    "v_codes",
    """SELECT attempt_id, 'execution:' || status AS code FROM v_trials WHERE status <> 'completed'
       UNION SELECT attempt_id, 'call_budget' FROM v_trials JOIN v_cases USING (case_id) WHERE call_count > max_calls
       UNION SELECT t.attempt_id, 'missing_steps' FROM v_trials t JOIN v_cases c USING (case_id)
         LEFT JOIN (SELECT attempt_id, count(*) AS n FROM v_steps GROUP BY ALL) s USING (attempt_id)
         WHERE status = 'completed' AND coalesce(s.n, 0) <> c.n_steps
       UNION SELECT attempt_id, 'empty_cards' FROM v_steps WHERE NOT has_cards
       UNION SELECT attempt_id, 'empty_output' FROM v_steps WHERE has_cards AND trim(output) = ''
       UNION SELECT attempt_id, CASE WHEN b.block_id IS NULL OR r.text_fingerprint <> b.fp THEN 'source_identity'
           WHEN end_char <= start_char OR end_char > b.n_chars THEN 'citation_range' ELSE 'reading_scope' END
         FROM v_step_refs r LEFT JOIN v_blocks b USING (block_id)
         WHERE b.block_id IS NULL OR r.text_fingerprint <> b.fp OR end_char <= start_char OR end_char > b.n_chars
           OR end_char > coalesce(limit_end, 0)""",
)
view(
    "v_scores",
    """SELECT t.attempt_id, t.case_id, t.status, CASE WHEN na THEN 'not_applicable' ELSE 'evaluated' END AS structural_state,
         CASE WHEN NOT na THEN len(codes) = 0 END AS passed, CASE WHEN na THEN [] ELSE codes END AS hard_failures,
         CASE WHEN NOT na AND len(codes) > 0 THEN false END AS task_success
       FROM (SELECT t.*, c.applicability = 'not_applicable' AS na,
               coalesce((SELECT list(code ORDER BY code) FROM v_codes k WHERE k.attempt_id = t.attempt_id), []) AS codes
             FROM v_trials t JOIN v_cases c USING (case_id)) t""",
)


def scores(spark, folder):
    return scoring.structural_score(
        suite_data.trials(spark, folder),
        suite_data.cases(spark, folder),
        suite_data.steps(spark, folder),
        suite_data.refs(spark, folder),
        base.blocks(spark, folder),
    )


@query(
    "structural_score",
    """SELECT attempt_id, structural_state, passed, array_to_string(hard_failures, ',') AS hard_failures, task_success FROM v_scores""",
)
def structural_score(spark, folder):
    return scores(spark, folder).select(
        "attempt_id",
        "structural_state",
        "passed",
        F.array_join("hard_failures", ",").alias("hard_failures"),
        "task_success",
    )


@query("status_counts", "SELECT status, count(*) AS attempts FROM v_trials GROUP BY status")
def status_counts(spark, folder):
    return suite_data.trials(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("attempts"))


view(
    "v_reviews",
    """SELECT t.attempt_id, t.case_id, t.status, t.case_hash, t.gold_hash, t.gold_status, t.artifact_hash AS bound_hash, l.doc_id, l.quality, l.toxic, t.rep,
         CASE WHEN l.doc_id % 9 = 4 THEN 'old' ELSE t.artifact_hash END AS artifact_hash,
         CASE WHEN l.doc_id % 14 = 6 THEN '' ELSE 'judge-1' END AS judge_version
       FROM labels l JOIN (SELECT * FROM v_trials JOIN v_cases USING (case_id, conv_id)) t ON t.conv_id = l.doc_id""",
)
view(
    "v_checks",
    """SELECT attempt_id, dimension, CASE WHEN quality = 1 THEN 3 WHEN d = 1 THEN 1 ELSE 2 END AS score,
         CASE WHEN quality = 1 THEN 'supports' ELSE 'insufficient' END AS verdict,
         toxic = 1 AND d = 3 AS hard_failure, doc_id, quality
       FROM (SELECT *, ['attribution', 'citation_support', 'key_point_coverage', 'spoiler_boundary'][d + 1] AS dimension
             FROM (SELECT *, unnest(range(0, CASE WHEN doc_id % 13 = 2 THEN 3 ELSE 4 END)) AS d FROM v_reviews))""",
)
view(
    "v_bound",
    """SELECT r.attempt_id, CASE WHEN r.status <> 'completed' THEN 'incomplete_attempt' WHEN r.gold_status <> 'reviewed' THEN 'draft_gold'
         WHEN r.artifact_hash <> r.bound_hash THEN 'stale_artifact' WHEN r.judge_version = '' THEN 'missing_attribution'
         WHEN c.n <> 4 THEN 'dimensions' WHEN c.conflict THEN 'score_conflict' END AS rejected, c.low, c.hard
       FROM v_reviews r JOIN (SELECT attempt_id, count(*) AS n, bool_or(score = 3 AND hard_failure) AS conflict, min(score) AS low,
           coalesce(list('semantic:' || dimension ORDER BY dimension) FILTER (hard_failure), []) AS hard
         FROM v_checks GROUP BY ALL) c USING (attempt_id)""",
)


def reviews(spark, folder):
    """Labels as reviews of the conversation with the same number."""
    trial = suite_data.trials(spark, folder).join(
        suite_data.cases(spark, folder).select("case_id", "case_hash", "gold_hash"), "case_id"
    )
    labels = base.table(spark, folder, "labels").withColumnRenamed("doc_id", "conv_id")
    rows = labels.join(trial, "conv_id")
    return rows.select(
        "attempt_id",
        "conv_id",
        "quality",
        "toxic",
        F.when(F.col("conv_id") % 9 == 4, "old").otherwise(F.col("artifact_hash")).alias("artifact_hash"),
        "case_hash",
        "gold_hash",
        F.lit("reader").alias("reviewer"),
        F.when(F.col("conv_id") % 14 == 6, "").otherwise("judge-1").alias("judge_version"),
    )


def checks(spark, folder):
    dims = F.array(*[F.lit(d) for d in scoring.REVIEW_DIMENSIONS])
    some = F.when(F.col("conv_id") % 13 == 2, F.slice(dims, 1, 3)).otherwise(dims)
    return reviews(spark, folder).select("attempt_id", "quality", "toxic", F.posexplode(some).alias("d", "dimension")).select(
        "attempt_id",
        "dimension",
        F.when(F.col("quality") == 1, 3).when(F.col("d") == 1, 1).otherwise(2).cast("long").alias("score"),
        F.when(F.col("quality") == 1, "supports").otherwise("insufficient").alias("verdict"),
        F.lit("seen").alias("evidence"),
        ((F.col("toxic") == 1) & (F.col("d") == 3)).alias("hard_failure"),
    )


def bound(spark, folder):
    cases = suite_data.cases(spark, folder)
    return scoring.bind_reviews(
        reviews(spark, folder), checks(spark, folder), suite_data.trials(spark, folder), cases, cases
    )


def full_scores(spark, folder):
    ok = bound(spark, folder).where("rejected is null").select("attempt_id")
    accepted = checks(spark, folder).join(ok, "attempt_id", "left_semi")
    return scoring.apply_reviews(scores(spark, folder), scoring.review_score(accepted))


view(
    "v_full",
    """SELECT s.attempt_id, s.case_id, s.status, s.structural_state, s.passed,
         CASE WHEN b.low IS NOT NULL THEN 'evaluated' WHEN s.structural_state = 'not_applicable' THEN 'not_applicable' ELSE 'not_evaluated' END AS semantic_state,
         b.low AS semantic_score, list_concat(s.hard_failures, coalesce(b.hard, [])) AS hard_failures,
         CASE WHEN b.low IS NOT NULL THEN coalesce(s.passed, false) AND len(b.hard) = 0 AND b.low = 3 ELSE s.task_success END AS task_success
       FROM v_scores s LEFT JOIN (SELECT * FROM v_bound WHERE rejected IS NULL) b USING (attempt_id)""",
)


@query("bind_reviews", "SELECT attempt_id, rejected FROM v_bound")
def bind_reviews(spark, folder):
    return bound(spark, folder)


@query(
    "review_score",
    """SELECT attempt_id, CAST(semantic_score AS BIGINT) AS semantic_score, semantic_state, array_to_string(hard_failures, ',') AS hard_failures, task_success FROM v_full""",
)
def review_score(spark, folder):
    return full_scores(spark, folder).select(
        "attempt_id", "semantic_score", "semantic_state", F.array_join("hard_failures", ",").alias("hard_failures"), "task_success"
    )


view(
    "v_memberships",
    """SELECT DISTINCT attempt_id, grouping, value FROM (
         SELECT attempt_id, 'dimensions' AS grouping, unnest(dimensions) AS value FROM v_trials JOIN v_cases USING (case_id)
         UNION ALL SELECT attempt_id, 'books', book_id FROM v_trials JOIN v_cases USING (case_id)
         UNION ALL SELECT attempt_id, 'languages', language FROM v_trials JOIN v_cases USING (case_id)
         UNION ALL SELECT attempt_id, 'suites', suite FROM v_trials JOIN v_cases USING (case_id)
         UNION ALL SELECT attempt_id, 'tasks', task FROM v_steps)""",
)


def memberships(spark, folder):
    cased = suite_data.trials(spark, folder).select("attempt_id", "case_id").join(suite_data.cases(spark, folder), "case_id")
    pairs = [F.struct(F.lit("books").alias("grouping"), F.col("book_id").alias("value"))]
    pairs += [
        F.struct(F.lit("languages").alias("grouping"), F.col("language").alias("value")),
        F.struct(F.lit("suites").alias("grouping"), F.col("suite").alias("value")),
    ]
    dims = F.transform("dimensions", lambda d: F.struct(F.lit("dimensions").alias("grouping"), d.alias("value")))
    named = cased.select("attempt_id", F.explode(F.concat(F.array(*pairs), dims)).alias("m")).select("attempt_id", "m.*")
    tasks = suite_data.steps(spark, folder).select("attempt_id", F.lit("tasks").alias("grouping"), F.col("task").alias("value"))
    return named.unionByName(tasks)


@query(
    "group_summary",
    """SELECT grouping, value, count(*) AS attempts, count(*) FILTER (status = 'completed') AS completed,
         count(*) FILTER (passed) AS structural_passes, count(*) FILTER (semantic_state = 'evaluated') AS semantic_evaluated,
         count(*) FILTER (task_success) AS successes, count(*) FILTER (len(hard_failures) > 0) AS hard_failures
       FROM v_memberships JOIN v_full USING (attempt_id) GROUP BY ALL""",
)
def group_summary(spark, folder):
    return scoring.group_summary(full_scores(spark, folder), memberships(spark, folder))


@query(
    "repeat_outcomes",
    """SELECT case_id, CAST(2 AS BIGINT) AS planned, count(attempt_id) AS recorded, count(*) FILTER (task_success) AS successes,
         CASE WHEN count(attempt_id) = 2 AND count(task_success) = 2 THEN bool_and(task_success) END AS all_passed
       FROM v_cases LEFT JOIN v_full USING (case_id) GROUP BY case_id""",
)
def repeat_outcomes(spark, folder):
    return scoring.repeat_outcomes(suite_data.cases(spark, folder), full_scores(spark, folder), suite_data.REPEAT)


@query(
    "run_verdict",
    """SELECT CAST(rep AS BIGINT) AS rep, CASE WHEN bool_or(len(hard_failures) > 0 OR task_success IS FALSE) THEN 'fail' ELSE 'inconclusive' END AS quality, count(*) AS attempts
       FROM v_full JOIN (SELECT attempt_id, rep FROM v_trials) USING (attempt_id) GROUP BY rep""",
)
def run_verdict(spark, folder):
    reps = suite_data.trials(spark, folder).select("attempt_id", "rep")
    return scoring.run_verdict(full_scores(spark, folder).join(reps, "attempt_id"), ["rep"])


def _halves(spark, folder):
    """The two repeats as two runs over the same attempt ids."""
    full = full_scores(spark, folder).join(suite_data.trials(spark, folder).select("attempt_id", "rep"), "attempt_id")
    one = full.where("rep = 1").select(F.col("case_id").alias("attempt_id"), "task_success")
    two = full.where("rep = 2").select(F.col("case_id").alias("attempt_id"), "task_success")
    return one, two


view(
    "v_pairs",
    """SELECT case_id AS attempt_id, a.task_success AS left_success, b.task_success AS right_success,
         CASE WHEN a.task_success IS NULL OR b.task_success IS NULL THEN 'unassessed' WHEN a.task_success = b.task_success THEN 'unchanged'
              WHEN b.task_success THEN 'improved' ELSE 'regressed' END AS change
       FROM (SELECT * FROM v_full WHERE attempt_id LIKE '%-1') a FULL JOIN (SELECT * FROM v_full WHERE attempt_id LIKE '%-2') b USING (case_id)""",
)


@query("pair_runs", "SELECT attempt_id, left_success, right_success, change FROM v_pairs")
def pair_runs(spark, folder):
    return scoring.pair_runs(*_halves(spark, folder))


@query(
    "change_counts",
    """SELECT change, count(attempt_id) AS n FROM (SELECT unnest(['improved', 'regressed', 'unchanged', 'unassessed']) AS change)
       LEFT JOIN v_pairs USING (change) GROUP BY change""",
)
def change_counts(spark, folder):
    return scoring.change_counts(scoring.pair_runs(*_halves(spark, folder)))


@query(
    "same_attempts",
    """SELECT DISTINCT conv_id AS attempt_id, 'left' AS side FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)
       UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT conv_id FROM conversations)""",
)
def same_attempts(spark, folder):
    left = base.table(spark, folder, "conversations").select(F.col("conv_id").alias("attempt_id"))
    right = base.table(spark, folder, "labels").select(F.col("doc_id").alias("attempt_id"))
    return scoring.same_attempts(left, right)


view(
    "v_gold",
    """SELECT case_id, set_no, unnest(CASE WHEN set_no = 0 THEN [0, 1, 2] ELSE [0, 40] END) AS ord, conv_id
       FROM (SELECT *, unnest([0, 1]) AS set_no FROM v_cases WHERE conv_id % 6 <> 5)""",
)
view(
    "v_offers",
    """SELECT 'case-' || conv_id || '-' || rep AS attempt_id, b.block_id, 0 AS start_char,
         CASE WHEN length(c.text) % 6 = 0 THEN n_chars - 1 ELSE n_chars END AS end_char, fp
       FROM (SELECT *, unnest([1, 2]) AS rep FROM conversations) c JOIN v_blocks b ON b.spine_index = c.conv_id AND b.ord = c.turn
       WHERE c.turn <> c.rep""",
)


@query(
    "evidence_recall",
    """SELECT t.attempt_id, CASE WHEN s.best IS NULL THEN 'not_applicable' WHEN NOT s.mapped THEN 'not_evaluated' ELSE 'evaluated' END AS state,
         CASE WHEN s.mapped THEN s.best END AS best_recall_basis_points, CASE WHEN s.mapped THEN s.complete END AS complete_evidence_set
       FROM v_trials t LEFT JOIN (
         SELECT attempt_id, max(hits * 10000 // members) AS best, bool_or(hits = members) AS complete, bool_or(mapped) AS mapped FROM (
           SELECT t.attempt_id, g.set_no, count(*) AS members, bool_or(b.block_id IS NOT NULL) AS mapped,
             count(*) FILTER (EXISTS (SELECT 1 FROM v_offers o WHERE o.attempt_id = t.attempt_id AND o.block_id = b.block_id AND o.end_char = b.n_chars)) AS hits
           FROM v_trials t JOIN v_gold g USING (case_id) LEFT JOIN v_blocks b ON b.spine_index = g.conv_id AND b.ord = g.ord GROUP BY ALL) GROUP BY ALL) s
       USING (attempt_id)""",
)
def evidence_recall(spark, folder):
    """Gold sets name the opening lines of the case's chapter; turns offer their own line."""
    cases = suite_data.cases(spark, folder)
    spot = base.blocks(spark, folder).select("spine_index", "ord", "block_id", "fp", "n_chars")
    sets = F.array(
        F.struct(F.lit(0).alias("set_no"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("ords")),
        F.struct(F.lit(1).alias("set_no"), F.array(F.lit(0), F.lit(40)).alias("ords")),
    )
    gold = (
        cases.where("conv_id % 6 <> 5")
        .select("case_id", "conv_id", F.explode(sets).alias("s"))
        .select("case_id", "conv_id", "s.set_no", F.explode(F.col("s.ords").cast("array<bigint>")).alias("anchor"))
    )
    anchors = (
        gold.select("case_id", "conv_id", "anchor")
        .distinct()
        .join(
            spot.withColumnRenamed("ord", "anchor").withColumnRenamed("spine_index", "conv_id"), ["conv_id", "anchor"]
        )
        .drop("conv_id")
    )
    rep = F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("rep")
    offered = base.table(spark, folder, "conversations").select("conv_id", "turn", F.char_length("text").alias("n"), rep)
    offers = offered.where("turn <> rep").join(
        spot.withColumnRenamed("ord", "turn").withColumnRenamed("spine_index", "conv_id"), ["conv_id", "turn"]
    ).select(
        F.format_string("case-%d-%d", "conv_id", "rep").alias("attempt_id"),
        "block_id",
        F.lit(0).cast("long").alias("start_char"),
        F.when(F.col("n") % 6 == 0, F.col("n_chars") - 1).otherwise(F.col("n_chars")).alias("end_char"),
        F.col("fp").alias("text_fingerprint"),
    )
    return scoring.evidence_recall(suite_data.trials(spark, folder), gold.drop("conv_id"), anchors, offers)


@query(
    "map_gold_anchors",
    """SELECT a.href, a.ord, coalesce(m.matches, 0) AS matches, CASE WHEN m.matches = 1 THEN m.block_id END AS block_id,
         CASE WHEN m.matches IS NULL THEN 'lost' WHEN m.matches > 1 THEN 'ambiguous' END AS error
       FROM v_lines a LEFT JOIN (SELECT href, text, count(*) AS matches, min(block_id) AS block_id FROM v_blocks GROUP BY ALL) m
         ON m.href = a.href AND m.text = a.raw""",
)
def map_gold_anchors(spark, folder):
    anchors = base.lines(spark, folder).select("book_id", "href", "ord", F.col("raw").alias("text"))
    return scoring.map_gold_anchors(anchors, base.blocks(spark, folder)).drop("book_id")


@query(
    "valid_usage",
    """SELECT event_id, ok AS valid, CASE WHEN ok THEN raw_input END AS input_tokens, CASE WHEN ok THEN raw_cached END AS cached_input_tokens,
         CASE WHEN ok THEN raw_output END AS output_tokens FROM v_calls""",
)
def valid_usage(spark, folder):
    return suite_data.calls(spark, folder).select(
        "event_id", F.col("usage").isNotNull().alias("valid"), "usage.input_tokens", "usage.cached_input_tokens", "usage.output_tokens"
    )


@query(
    "call_cost",
    """SELECT event_id, (raw_input * 10.0::DOUBLE + raw_output * 50.0::DOUBLE) / 1000000.0::DOUBLE AS flat_usd, estimated_usd AS cached_usd,
         CASE WHEN big >= cached + cached // 2 THEN CASE WHEN big > 272000
           THEN ((big - cached - cached // 2) * 20.0::DOUBLE + cached * 2.0::DOUBLE + (cached // 2) * 25.0::DOUBLE + raw_output * 75.0::DOUBLE) / 1000000.0::DOUBLE
           ELSE ((big - cached - cached // 2) * 10.0::DOUBLE + cached * 1.0::DOUBLE + (cached // 2) * 12.5::DOUBLE + raw_output * 50.0::DOUBLE) / 1000000.0::DOUBLE END END AS tiered_usd
       FROM (SELECT *, raw_input * 100 AS big, raw_cached AS cached FROM v_calls)""",
)
def call_cost(spark, folder):
    big = F.col("raw_input") * 100
    return suite_data.calls(spark, folder).select(
        "event_id",
        numbers.flat_cost(F.col("raw_input"), F.col("raw_output"), 10, 50).alias("flat_usd"),
        F.col("estimated_usd").alias("cached_usd"),
        numbers.tiered_cost(big, F.col("raw_cached"), F.expr("raw_cached div 2"), F.col("raw_output")).alias("tiered_usd"),
    )


@query(
    "ledger_summary",
    """SELECT run_id, phase, count(*) AS invocations, count(*) FILTER (ok) AS known_usage_calls, count(*) FILTER (NOT ok) AS unknown_usage_calls,
         CAST(coalesce(sum(raw_input) FILTER (ok), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(raw_output) FILTER (ok), 0) AS BIGINT) AS output_tokens,
         coalesce(CAST(sum(CAST(estimated_usd AS DECIMAL(38,12))) FILTER (ok) AS DOUBLE), 0.0::DOUBLE) AS known_estimated_usd
       FROM (SELECT * REPLACE (coalesce(phase, 'answer') AS phase) FROM v_calls) GROUP BY GROUPING SETS ((run_id, phase), (run_id))""",
)
def ledger_summary(spark, folder):
    return scoring.ledger_summary(suite_data.calls(spark, folder), ["run_id"])


LIMITS = {
    "max_request_bytes": 1000,
    "max_invocations": 40,
    "stop_after_input_tokens": 60_000,
    "stop_after_output_tokens": 9_000,
    "stop_after_estimated_usd": 0.9,
}

view(
    "v_fitting",
    """SELECT *, row_number() OVER w AS n,
         coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER p, 0) AS p_unknown,
         coalesce(sum(CASE WHEN ok THEN raw_input END) OVER p, 0) AS p_in, coalesce(sum(CASE WHEN ok THEN raw_output END) OVER p, 0) AS p_out,
         coalesce(sum(CAST(estimated_usd AS DECIMAL(38,12))) OVER p, 0) AS p_usd
       FROM v_calls WHERE input_bytes <= 1000
       WINDOW w AS (PARTITION BY session_id ORDER BY seq), p AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
view(
    "v_closing",
    """SELECT session_id, min(seq) AS seq, arg_min(reason, seq) AS reason FROM (
         SELECT *, CASE WHEN n > 40 THEN 'invocation_limit' WHEN p_unknown > 0 THEN 'unaccounted_invocation'
           WHEN p_in >= 60000 THEN 'reported_input_token_threshold' WHEN p_out >= 9000 THEN 'reported_output_token_threshold'
           WHEN p_usd >= 0.9 THEN 'estimated_cost_threshold' END AS reason FROM v_fitting) WHERE reason IS NOT NULL GROUP BY session_id""",
)


@query(
    "budget_admission",
    """SELECT c.event_id, CASE WHEN input_bytes > 1000 THEN 'request_bytes' WHEN c.seq >= k.seq THEN k.reason END AS reason,
         NOT (input_bytes > 1000 OR coalesce(c.seq >= k.seq, false)) AS allowed FROM v_calls c LEFT JOIN v_closing k USING (session_id)""",
)
def budget_admission(spark, folder):
    calls = suite_data.calls(spark, folder).withColumn("run_id", F.col("session_id"))
    return scoring.budget_admission(calls, LIMITS).select("event_id", "reason", "allowed")


view(
    "v_arrivals",
    "SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events",
)
view(
    "v_rate",
    """SELECT user_id, event_id, pos, true AS accepted, [t] AS recent FROM v_arrivals WHERE pos = 1
       UNION ALL SELECT user_id, event_id, pos, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END FROM (
         SELECT a.user_id, a.event_id, a.pos, a.t, list_filter(r.recent, lambda x: a.t - x < 86400000000) AS live
         FROM v_rate r JOIN v_arrivals a ON a.user_id = r.user_id AND a.pos = r.pos + 1)""",
    recursive=True,
)


@query("rate_window", "SELECT user_id, event_id, accepted FROM v_rate")
def rate_window(spark, folder):
    """Three accepted requests per user and day."""
    rows = base.table(spark, folder, "events").select(
        F.col("user_id").alias("key"), numbers.wall_micros(F.col("ts")).alias("ts_us"), F.col("event_id").alias("seq")
    )
    return scoring.rate_window(rows, limit=3, window_seconds=86_400).select(
        F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "accepted"
    )


view(
    "v_targets",
    """SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'error' THEN 'GET' ELSE 'POST' END AS method,
         '/v1/books' || CASE event_type WHEN 'purchase' THEN '' WHEN 'error' THEN '/' || (k % 3) || '?x=/ask' ELSE '/' || user_id ||
           CASE event_type WHEN 'view' THEN '/ask' WHEN 'click' THEN '/explain?q=1' ELSE '/reflect' END END AS target,
         k * 10 AS input_bytes, CAST(floor("value" * 100) AS BIGINT) AS output_bytes FROM v_events""",
)
view(
    "v_operations",
    """SELECT *, CASE WHEN ends_with(path, '/explain') THEN 'explain' WHEN ends_with(path, '/ask') THEN 'ask' WHEN ends_with(path, '/reflect') THEN 'reflect'
         WHEN method = 'POST' AND path = '/v1/books' THEN 'compile' ELSE lower(method) || ' ' || path END AS operation
       FROM (SELECT *, string_split(target, '?')[1] AS path FROM v_targets)""",
)


def http_requests(spark, folder):
    return as_http(reader.events(spark, folder))


def as_http(ev):
    kind = F.col("event_type")
    tail = (
        F.when(kind == "purchase", "")
        .when(kind == "error", F.concat(F.lit("/"), (F.col("k") % 3).cast("string"), F.lit("?x=/ask")))
        .otherwise(
            F.concat(
                F.lit("/"),
                F.col("user_id").cast("string"),
                F.when(kind == "view", "/ask").when(kind == "click", "/explain?q=1").otherwise("/reflect"),
            )
        )
    )
    method = F.when(kind == "error", "GET").otherwise("POST")
    target = F.concat(F.lit("/v1/books"), tail)
    return ev.select(
        "event_id",
        "ts",
        "user_id",
        T.operation_name(method, target).alias("operation"),
        (F.col("k") * 10).alias("input_bytes"),
        F.floor(F.col("value") * 100).cast("long").alias("output_bytes"),
    )


@query("operation_name", "SELECT event_id, operation FROM v_operations")
def operation_name(spark, folder):
    return http_requests(spark, folder).select("event_id", "operation")


@query(
    "usage_totals",
    """SELECT operation, count(*) AS request_count, count(*) FILTER (operation IN ('explain', 'ask', 'reflect')) AS agent_request_count,
         count(*) FILTER (operation = 'compile') AS compile_count, CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(output_bytes) AS BIGINT) AS output_bytes,
         CAST(sum(CASE WHEN operation IN ('explain', 'ask', 'reflect') THEN 300 WHEN operation = 'compile' THEN 9000 ELSE 0 END) AS BIGINT) AS estimated_cost_micros
       FROM v_operations GROUP BY ROLLUP (operation)""",
)
def usage_totals(spark, folder):
    return scoring.usage_totals(http_requests(spark, folder), agent_micros=300, compile_micros=9000)


@query(
    "corpus_profile",
    """SELECT 'questions' AS measure, count(*) AS n FROM v_cases UNION ALL SELECT suite, count(*) FROM v_cases GROUP BY suite
       UNION ALL SELECT 'source_families', count(DISTINCT book_id) FROM v_cases
       UNION ALL SELECT 'reviewed_gold', count(*) FROM v_cases WHERE gold_status = 'reviewed'
       UNION ALL SELECT d, count(c.case_id) FROM (SELECT printf('D%02d', unnest(range(1, 19))) AS d)
         LEFT JOIN (SELECT DISTINCT case_id, unnest(dimensions) AS d FROM v_cases) c USING (d) GROUP BY d""",
)
def corpus_profile(spark, folder):
    cases = suite_data.cases(spark, folder)
    dims = cases.select("case_id", F.explode("dimensions").alias("dimension"))
    return scoring.corpus_profile(cases, cases.select(F.col("book_id").alias("family")), cases, dims)


view(
    "v_split_books",
    """SELECT doc_id AS book, CASE WHEN doc_id % 5 = 0 THEN 'holdout' ELSE 'dev' END AS split,
         source || ':' || lang || ':' || n_chars AS family, sha256(text) AS source_hash FROM documents""",
)
view("v_split_keys", "SELECT book, split, 'same_source_family' AS reason, family AS key FROM v_split_books UNION ALL SELECT book, split, 'identical_source', source_hash FROM v_split_books")


@query(
    "leakage_pairs",
    """SELECT book, split, reason, key, CASE WHEN split = 'dev' THEN holdout ELSE dev END AS counterparts
       FROM v_split_keys JOIN (SELECT reason, key, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'holdout') AS holdout
         FROM v_split_keys GROUP BY ALL) USING (reason, key) WHERE dev > 0 AND holdout > 0""",
)
def leakage_pairs(spark, folder):
    """Every fifth document is held out; the family is source, language and length."""
    docs = base.table(spark, folder, "documents")
    books = docs.select(
        F.col("doc_id").alias("book"),
        F.when(F.col("doc_id") % 5 == 0, "holdout").otherwise("dev").alias("split"),
        F.concat_ws(":", "source", "lang", F.col("n_chars").cast("string")).alias("family"),
        T.fingerprint(F.col("text")).alias("source_hash"),
    )
    return scoring.leakage(books)


view(
    "v_samples",
    """SELECT d.lang, l.doc_id AS id, CASE WHEN d.lang = 'de' AND l.doc_id % 50 = 1 THEN 'draft' ELSE 'reviewed' END AS status,
         CASE WHEN quality = 1 THEN 3 ELSE 1 END AS score, toxic = 1 AS hard_failure,
         CASE WHEN n_chars > 120 THEN 3 ELSE 1 END AS j_score, strpos(text, 'zz') > 0 AS j_hard, n_chars % 41 <> 0 AS judged
       FROM labels l JOIN documents d USING (doc_id)""",
)


@query(
    "calibration_agreement",
    """SELECT lang, n AS expected_samples, judged AS evaluated_samples, n - judged AS missing_samples, matches,
         CASE WHEN full_set THEN 'evaluated' ELSE 'not_evaluated' END AS state, full_set AND matches = judged AS calibrated FROM (
         SELECT lang, count(*) AS n, count(*) FILTER (judged) AS judged, count(*) FILTER (judged AND score = j_score AND hard_failure = j_hard) AS matches,
           bool_and(status = 'reviewed') AND count(*) = count(*) FILTER (judged) AND count(*) >= 20 AS full_set FROM v_samples GROUP BY lang)""",
)
def calibration_agreement(spark, folder):
    """Labels as the reference, a length and marker rule as the judge, one set per language."""
    docs = base.table(spark, folder, "documents").select("doc_id", "lang", "text", "n_chars")
    rows = base.table(spark, folder, "labels").join(docs, "doc_id")
    verdict = lambda s: F.when(s == 3, "supports").otherwise("insufficient")
    score = F.when(F.col("quality") == 1, 3).otherwise(1)
    samples = rows.select(
        "lang",
        F.col("doc_id").alias("id"),
        F.when((F.col("lang") == "de") & (F.col("doc_id") % 50 == 1), "draft").otherwise("reviewed").alias("status"),
        score.alias("score"),
        verdict(score).alias("verdict"),
        (F.col("toxic") == 1).alias("hard_failure"),
    )
    judged = F.when(F.col("n_chars") > 120, 3).otherwise(1)
    judgments = rows.where("n_chars % 41 <> 0").select(
        "lang", F.col("doc_id").alias("id"), judged.alias("score"), verdict(judged).alias("verdict"), F.col("text").contains("zz").alias("hard_failure")
    )
    return scoring.calibration_agreement(samples, judgments, ["lang"])


view(
    "v_runs",
    """SELECT book_id, profile, max(fin) // 1000 - min(st) // 1000 AS duration_ms, CAST(sum(CAST(estimated_usd AS DECIMAL(38,12))) AS DOUBLE) AS estimated_usd,
         count(*) AS calls, CAST(sum(raw_input) AS BIGINT) AS input_tokens, CAST(sum(raw_output) AS BIGINT) AS output_tokens, bool_and(ok) AS has_usage, max(fin) - min(st) AS span_us
       FROM v_provider_events GROUP BY ALL""",
)
view(
    "v_provider_events",
    """SELECT c.*, 'src' || (CAST(substring(session_id, 2) AS BIGINT) % 20) AS book_id,
         CASE coalesce(phase, 'none') WHEN 'answer' THEN 'standard' WHEN 'compile' THEN 'deep' WHEN 'judge' THEN 'basic' ELSE 'standard' END AS profile,
         epoch_us(ts) AS st, epoch_us(ts) + raw_output * 1000 AS fin FROM v_calls c""",
)


def provider_events(spark, folder):
    profile = F.when(F.col("phase") == "compile", "deep").when(F.col("phase") == "judge", "basic").otherwise("standard")
    return suite_data.calls(spark, folder).select(
        "*",
        F.format_string("src%d", F.substring("session_id", 2, 12).cast("long") % 20).alias("book_id"),
        profile.alias("profile"),
        numbers.wall_micros(F.col("ts")).alias("started_us"),
        (numbers.wall_micros(F.col("ts")) + F.col("raw_output") * 1000).alias("finished_us"),
        F.col("raw_input").alias("input_tokens"),
        F.col("raw_output").alias("output_tokens"),
    )


def runs(spark, folder):
    return provider_events(spark, folder).groupBy("book_id", "profile").agg(
        F.expr("max(finished_us) div 1000 - min(started_us) div 1000").alias("duration_ms"),
        F.sum(F.col("estimated_usd").cast("decimal(38,12)")).cast("double").alias("estimated_usd"),
        F.min(F.col("usage").isNotNull()).alias("has_usage"),
    )


@query("provider_span", "SELECT book_id, profile, span_us, calls, input_tokens, output_tokens FROM v_runs")
def provider_span(spark, folder):
    return scoring.provider_span(provider_events(spark, folder), ["book_id", "profile"])


@query(
    "derive_thresholds",
    """SELECT book_id, profile, CAST(ceil(duration_ms * 1.25::DOUBLE) AS BIGINT) AS max_duration_ms, estimated_usd * 1.25::DOUBLE AS max_estimated_usd FROM v_runs""",
)
def derive_thresholds(spark, folder):
    return scoring.derive_thresholds(runs(spark, folder))


@query(
    "baseline_check",
    """WITH l AS (SELECT book_id, profile, CAST(ceil(duration_ms * 1.25::DOUBLE) AS BIGINT) * CASE WHEN book_id = 'src3' THEN 0 ELSE 1 END AS d,
           estimated_usd * CASE WHEN profile = 'deep' THEN 0.5::DOUBLE ELSE 1.25::DOUBLE END AS u FROM v_runs WHERE book_id <> 'src5'),
         r AS (SELECT * FROM v_runs WHERE book_id <> 'src8')
       SELECT l.book_id, l.profile, 'baseline_case_missing' AS code FROM l ANTI JOIN r USING (book_id, profile)
       UNION ALL SELECT r.book_id, r.profile, 'baseline_missing' FROM r ANTI JOIN l USING (book_id, profile)
       UNION ALL SELECT book_id, profile, 'duration_exceeds_baseline' FROM r JOIN l USING (book_id, profile) WHERE duration_ms > d
       UNION ALL SELECT book_id, profile, 'cost_exceeds_baseline' FROM r JOIN l USING (book_id, profile) WHERE estimated_usd > u""",
)
def baseline_check(spark, folder):
    now = runs(spark, folder)
    frozen = scoring.derive_thresholds(now.where("book_id <> 'src5'")).select(
        "book_id",
        "profile",
        (F.col("max_duration_ms") * F.when(F.col("book_id") == "src3", 0).otherwise(1)).alias("max_duration_ms"),
        F.when(F.col("profile") == "deep", F.col("max_estimated_usd") / 1.25 * 0.5).otherwise(F.col("max_estimated_usd")).alias("max_estimated_usd"),
    )
    return scoring.baseline_check(now.where("book_id <> 'src8'"), frozen)


@query(
    "acceptance_gate",
    """SELECT standard_books, deep_of_standard, has_basic, full_usage, duplicates,
         standard_books >= 3 AND deep_of_standard AND has_basic AND full_usage AND NOT duplicates AS passed FROM (
         SELECT count(*) FILTER (standard) AS standard_books, bool_or(standard AND deep) AS deep_of_standard, bool_or(basic) AS has_basic,
           bool_and(usage) AS full_usage, false AS duplicates FROM (
           SELECT book_id, bool_or(profile = 'standard' AND calls > 60) AS standard, bool_or(profile = 'deep' AND calls > 60) AS deep,
             bool_or(profile = 'basic' AND calls > 60) AS basic, bool_and(has_usage) AS usage FROM v_runs GROUP BY book_id))""",
)
def acceptance_gate(spark, folder):
    per = provider_events(spark, folder).groupBy("book_id", "profile").agg(
        (F.count(F.lit(1)) > 60).alias("passed"), F.min(F.col("usage").isNotNull()).alias("has_usage")
    )
    return scoring.acceptance_gate(per)


@query(
    "experiment_cost",
    """SELECT run_id, coalesce(CAST(sum(CAST(estimated_usd AS DECIMAL(38,12))) AS DOUBLE), 0.0::DOUBLE) AS estimated_usd, count(estimated_usd) AS measured_events,
         count(*) FILTER (estimated_usd IS NULL) AS unpriced_events FROM v_calls GROUP BY run_id""",
)
def experiment_cost(spark, folder):
    return scoring.experiment_cost(suite_data.calls(spark, folder), ["run_id"])


@query("unpriced_events", "SELECT event_id, run_id FROM v_calls WHERE estimated_usd IS NULL")
def unpriced_events(spark, folder):
    return suite_data.calls(spark, folder).where("estimated_usd is null").select("event_id", "run_id")


@query(
    "timing_summary",
    """SELECT attempt_id, duration_ms AS reader_ms, (conv_id % 20) * 100 + 7 AS compile_ms,
         CASE WHEN status = 'completed' THEN (conv_id % 20) * 100 + 7 + duration_ms END AS first_result_ms FROM v_trials""",
)
def timing_summary(spark, folder):
    """Attempts on the same book share one compilation."""
    attempts = suite_data.trials(spark, folder).select(
        "attempt_id", "status", F.col("duration_ms").alias("reader_ms"), (F.col("conv_id") % 20).alias("compilation_id")
    )
    compilations = attempts.select("compilation_id", (F.col("compilation_id") * 100 + 7).alias("duration_ms"))
    return scoring.timing_summary(attempts, compilations)


@query(
    "review_packets",
    """SELECT sha256('packet|' || t.attempt_id || '|' || t.artifact_hash) AS packet_id, r.block_id, substring(b.text, 1, least(r.end_char, b.n_chars)) AS text
       FROM v_trials t JOIN v_step_refs r USING (attempt_id) JOIN v_blocks b USING (block_id) WHERE t.status = 'completed'""",
)
def review_packets(spark, folder):
    refs = suite_data.refs(spark, folder).select("attempt_id", "book_id", "block_id", "end_char")
    packets, _ = scoring.review_packets(
        suite_data.trials(spark, folder), suite_data.steps(spark, folder), refs, base.blocks(spark, folder)
    )
    return packets.select("packet_id", "block_id", "text")


@query("review_bindings", "SELECT sha256('packet|' || attempt_id || '|' || artifact_hash) AS packet_id, attempt_id, case_id, artifact_hash FROM v_trials WHERE status = 'completed'")
def review_bindings(spark, folder):
    _, bindings = scoring.review_packets(
        suite_data.trials(spark, folder),
        suite_data.steps(spark, folder),
        suite_data.refs(spark, folder).select("attempt_id", "book_id", "block_id", "end_char"),
        base.blocks(spark, folder),
    )
    return bindings


@query(
    "ambiguous_owners",
    "SELECT event_type AS id, count(DISTINCT book) AS books FROM (SELECT event_type, user_id % 20 AS book FROM events) GROUP BY ALL HAVING count(DISTINCT book) > 1",
)
def ambiguous_owners(spark, folder):
    """An id that names a session or export in more than one book."""
    from lectern.operators import packages

    owners = base.table(spark, folder, "events").select(
        F.col("event_type").alias("id"), (F.col("user_id") % 20).alias("book_id")
    )
    return packages.ambiguous_owners(owners)
