"""Conversations as benchmark cases and attempts, events as provider calls.

A conversation is a case, tried twice.  A user turn is a step, the next
assistant turn its answer.  Each answer cites one block of the case's book;
some citations, statuses and budgets are off so that every code occurs.
"""

from pyspark.sql import functions as F

from lectern.functions import numbers
from lectern.plans import base, reader
from lectern.plans.registry import view

REPEAT = 2


def _case_id(conv):
    return F.concat(F.lit("case-"), conv.cast("string"))


def cases(spark, folder):
    conv = base.table(spark, folder, "conversations")
    per = conv.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("n_steps"), F.count(F.lit(1)).alias("turns")
    )
    c = F.col("conv_id")
    return per.select(
        "conv_id",
        _case_id(c).alias("case_id"),
        F.format_string("src%d", c % 20).alias("book_id"),
        F.when(c % 2 == 0, "regression").otherwise("capability").alias("suite"),
        F.when(c % 11 == 0, "not_applicable").otherwise("applicable").alias("applicability"),
        F.lit(3).cast("long").alias("max_calls"),
        "n_steps",
        F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de"), F.lit("es")), (c % 4 + 1).cast("int")).alias("language"),
        F.array(
            F.format_string("D%02d", c % 17 + 1), F.format_string("D%02d", (c * 7) % 17 + 1)
        ).alias("dimensions"),
        F.sha2(F.concat(F.lit("case"), c.cast("string")), 256).alias("case_hash"),
        F.sha2(F.concat(F.lit("gold"), c.cast("string")), 256).alias("gold_hash"),
        F.when(c % 5 == 0, "draft").otherwise("reviewed").alias("gold_status"),
    )


view(
    "v_cases",
    """SELECT conv_id, 'case-' || conv_id AS case_id, 'src' || (conv_id % 20) AS book_id,
         CASE WHEN conv_id % 2 = 0 THEN 'regression' ELSE 'capability' END AS suite,
         CASE WHEN conv_id % 11 = 0 THEN 'not_applicable' ELSE 'applicable' END AS applicability, 3 AS max_calls, n_steps,
         ['en', 'fr', 'de', 'es'][conv_id % 4 + 1] AS language,
         [printf('D%02d', conv_id % 17 + 1), printf('D%02d', (conv_id * 7) % 17 + 1)] AS dimensions,
         sha256('case' || conv_id) AS case_hash, sha256('gold' || conv_id) AS gold_hash,
         CASE WHEN conv_id % 5 = 0 THEN 'draft' ELSE 'reviewed' END AS gold_status
       FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS n_steps FROM conversations GROUP BY conv_id)""",
)


def trials(spark, folder):
    rep = F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("rep")
    rows = cases(spark, folder).select("conv_id", "case_id", "n_steps", rep)
    attempt = F.concat_ws("-", "case_id", F.col("rep").cast("string"))
    status = (
        F.when((F.col("conv_id") + F.col("rep")) % 7 == 0, "timed_out")
        .when((F.col("conv_id") + F.col("rep")) % 7 == 3, "provider_error")
        .otherwise("completed")
    )
    return rows.select(
        "conv_id",
        "case_id",
        "rep",
        attempt.alias("attempt_id"),
        status.alias("status"),
        (F.col("n_steps") + F.col("conv_id") % 2).alias("call_count"),
        F.sha2(F.concat(F.lit("artifact"), attempt), 256).alias("artifact_hash"),
        (F.col("conv_id") * 37 % 9000 + F.col("rep") * 100).alias("duration_ms"),
    )


view(
    "v_trials",
    """SELECT conv_id, case_id, rep, case_id || '-' || rep AS attempt_id,
         CASE WHEN (conv_id + rep) % 7 = 0 THEN 'timed_out' WHEN (conv_id + rep) % 7 = 3 THEN 'provider_error' ELSE 'completed' END AS status,
         n_steps + conv_id % 2 AS call_count, sha256('artifact' || case_id || '-' || rep) AS artifact_hash,
         conv_id * 37 % 9000 + rep * 100 AS duration_ms
       FROM (SELECT *, unnest([1, 2]) AS rep FROM v_cases)""",
)


def steps(spark, folder):
    conv = base.table(spark, folder, "conversations")
    user = conv.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    task = F.element_at(F.array(F.lit("ask"), F.lit("explain"), F.lit("reflect")), F.expr("cast((turn div 2) % 3 + 1 as int)"))
    rep = F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("rep")
    rows = user.join(reply, ["conv_id", "turn"], "left").select("*", rep)
    n = F.char_length("answer") + F.col("rep")
    return rows.select(
        "conv_id",
        F.concat_ws("-", _case_id(F.col("conv_id")), F.col("rep").cast("string")).alias("attempt_id"),
        "turn",
        task.alias("task"),
        "question",
        F.col("answer").isNotNull().alias("has_cards"),
        F.when(n % 13 == 0, " ").otherwise(F.col("answer")).alias("output"),
        n.cast("long").alias("n"),
    )


view(
    "v_steps",
    """SELECT conv_id, 'case-' || conv_id || '-' || rep AS attempt_id, turn, ['ask', 'explain', 'reflect'][(turn // 2) % 3 + 1] AS task,
         question, answer IS NOT NULL AS has_cards, CASE WHEN (length(answer) + rep) % 13 = 0 THEN ' ' ELSE answer END AS output,
         length(answer) + rep AS n
       FROM (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer, unnest([1, 2]) AS rep FROM conversations u
             LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')""",
)


def refs(spark, folder):
    """One citation per answered step."""
    spot = base.blocks(spark, folder).select("book_id", "spine_index", "ord", "block_id", "fp", "n_chars")
    rows = steps(spark, folder).where("has_cards").select(
        F.format_string("src%d", F.col("conv_id") % 20).alias("book_id"),
        "attempt_id",
        "n",
        "turn",
        (F.col("conv_id") % 20 + 20 * (F.col("turn") % 10)).alias("spine_index"),
        (F.col("turn") % 3).alias("ord"),
    )
    n = F.col("n")
    return rows.join(spot, ["book_id", "spine_index", "ord"]).select(
        "book_id",
        "attempt_id",
        "turn",
        F.when(n % 29 == 0, "nowhere").otherwise(F.col("block_id")).alias("block_id"),
        F.lit(0).cast("long").alias("start_char"),
        F.when(n % 19 == 0, F.col("n_chars") + 1).otherwise(F.least(F.col("n_chars"), n)).alias("end_char"),
        F.when(n % 23 == 0, F.reverse("fp")).otherwise(F.col("fp")).alias("text_fingerprint"),
        F.when(n % 17 != 0, F.col("n_chars")).alias("limit_end"),
    )


view(
    "v_step_refs",
    """SELECT attempt_id, s.turn, CASE WHEN n % 29 = 0 THEN 'nowhere' ELSE b.block_id END AS block_id, 0 AS start_char,
         CASE WHEN n % 19 = 0 THEN n_chars + 1 ELSE least(n_chars, n) END AS end_char,
         CASE WHEN n % 23 = 0 THEN reverse(fp) ELSE fp END AS text_fingerprint, CASE WHEN n % 17 <> 0 THEN n_chars END AS limit_end
       FROM v_steps s JOIN v_blocks b ON b.spine_index = conv_id % 20 + 20 * (s.turn % 10) AND b.ord = s.turn % 3
       WHERE has_cards""",
)


def calls(spark, folder):
    """Events as provider calls: tokens from the value, phase from the type."""
    return as_calls(reader.events(spark, folder))


def as_calls(ev):
    phase = F.create_map(
        F.lit("view"), F.lit("answer"), F.lit("click"), F.lit("compile"), F.lit("purchase"), F.lit("judge"),
        F.lit("error"), F.lit("answer"),
    )
    tokens_in = F.floor(F.col("value") * 100).cast("long")
    tokens_out = F.floor(F.col("value") * 10).cast("long")
    unknown = (F.col("event_type") == "error") & (F.col("k") % 4 == 0)
    usage = numbers.valid_usage(
        F.when(~unknown, tokens_in), tokens_out, F.col("k"), F.when(F.col("k") == 7, F.lit(1).cast("long"))
    )
    return (
        ev.withColumn("usage", usage)
        .select(
            "event_id",
            "ts",
            F.format_string("run%d", F.col("user_id") % 10).alias("run_id"),
            "session_id",
            F.col("event_id").alias("seq"),
            phase[F.col("event_type")].alias("phase"),
            (F.col("k") * 11).alias("input_bytes"),
            tokens_in.alias("raw_input"),
            tokens_out.alias("raw_output"),
            F.col("k").alias("raw_cached"),
            "usage",
            numbers.cached_cost(F.col("usage"), 10, 1, 50).alias("estimated_usd"),
        )
    )


view(
    "v_calls",
    """SELECT *, CASE WHEN ok THEN ((raw_input - raw_cached) * 10 + raw_cached * 1 + raw_output * 50) / 1000000.0::DOUBLE END AS estimated_usd FROM (
       SELECT *, NOT unknown AND raw_input >= raw_cached AND raw_cached <> 7 AS ok FROM (
         SELECT event_id, ts, 'run' || (user_id % 10) AS run_id, session_id, event_id AS seq,
           CASE event_type WHEN 'view' THEN 'answer' WHEN 'click' THEN 'compile' WHEN 'purchase' THEN 'judge' WHEN 'error' THEN 'answer' END AS phase,
           k * 11 AS input_bytes, CAST(floor("value" * 100) AS BIGINT) AS raw_input, CAST(floor("value" * 10) AS BIGINT) AS raw_output,
           k AS raw_cached, event_type = 'error' AND k % 4 = 0 AS unknown FROM v_events))""",
)
