"""What a reader has confirmed as read, and what may be shown from it.

A chapter is named by book and spine index, since books number their chapters
alike.  Coverage is at most one endpoint (order, offset) per session and chapter; a
block before the endpoint is visible in full, the endpoint block up to the
offset, later blocks not at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.numbers import basis_points
from lectern.functions.text import clip
from lectern.operators.retrieval import ScopeScores
from lectern.rules import first_violation
from lectern.session import broadcast_if_small, durable, join_picked

CHAPTER = ["book_id", "spine_index"]
BLOCK = [*CHAPTER, "ord"]
BUDGET_OVERHEAD = 256
CONTEXT_LIMIT = 512 * 1024
LISTED = 1024  # chapters of a book in one list


def location_keys(locations: DataFrame, chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """Order key of each location, or the reason it is invalid.

    locations(…, book_id, spine_index, ord?, char_offset?); a location without a
    block sorts at the chapter start.
    """
    known = chapters.select(*CHAPTER, F.lit(True).alias("known"))
    sizes = blocks.select(*BLOCK, "block_id", "n_chars")
    joined = locations.join(known, CHAPTER, "left").join(sizes, BLOCK, "left")
    offset = F.coalesce("char_offset", F.lit(0).cast("long"))
    return joined.withColumn(
        "error",
        first_violation(
            [
                (F.col("known").isNull(), "unknown_chapter"),
                (F.col("ord").isNotNull() & F.col("block_id").isNull(), "invalid_block"),
                (F.col("ord").isNotNull() & (offset > F.col("n_chars")), "invalid_offset"),
            ]
        ),
    ).withColumn(
        "location_key",
        F.when(
            F.col("error").isNull(),
            F.struct(
                F.col("spine_index").alias("spine_index"),
                F.coalesce("ord", F.lit(0).cast("long")).alias("ord"),
                offset.alias("char_offset"),
            ),
        ),
    ).drop("known")


def coverage(read_events: DataFrame) -> DataFrame:
    """Largest endpoint per session and chapter.

    ``max`` of a struct is commutative and combines map-side, so late, repeated
    or hot-session events cost one row per task and chapter.
    """
    offset = F.coalesce("char_offset", F.lit(0).cast("long"))
    return (
        read_events.where(F.col("ord").isNotNull())
        .groupBy("session_id", *CHAPTER)
        .agg(F.max(F.struct(F.col("ord").alias("ord"), offset.alias("char_offset"))).alias("end"))
        .select(
            "session_id",
            *CHAPTER,
            F.col("end.ord").alias("end_ord"),
            F.col("end.char_offset").alias("end_offset"),
        )
    )


def visible_chars(blocks: DataFrame, cover: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Blocks of every covered chapter with the characters the session may see.

    With wanted(session_id, book_id, block_id) only those blocks of those sessions: a
    chapter's text is then not repeated for each of its readers.
    """
    shown = cover.join(blocks, CHAPTER)
    if wanted is not None:
        asked = wanted.select("session_id", "book_id", "block_id").distinct()
        shown = blocks.join(asked, ["book_id", "block_id"]).join(cover, ["session_id", *CHAPTER])
    return (
        shown
        .withColumn(
            "visible",
            F.when(F.col("ord") < F.col("end_ord"), F.col("n_chars"))
            .when(F.col("ord") == F.col("end_ord"), F.least("end_offset", "n_chars"))
            .otherwise(F.lit(0).cast("long")),
        )
        .drop("end_ord", "end_offset")
    )


def chapter_prefix(blocks: DataFrame) -> DataFrame:
    """Characters before each block and the last order of its chapter.

    One chapter per window partition.
    """
    before = Window.partitionBy(*CHAPTER).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*CHAPTER)
    return blocks.select(
        "book_id",
        "spine_index",
        "ord",
        "n_chars",
        F.coalesce(F.sum("n_chars").over(before), F.lit(0).cast("long")).alias("chars_before"),
        F.max("ord").over(whole).alias("last_ord"),
    )


def covered_chapters(blocks: DataFrame, cover: DataFrame) -> DataFrame:
    """Per session and chapter: visible characters and whether all is read.

    One lookup of the endpoint block against the prefix table replaces the
    expansion of a chapter's blocks for each of its readers.
    """
    ends = cover.withColumnRenamed("end_ord", "ord")
    read = blocks.join(cover.select(*CHAPTER).distinct(), CHAPTER, "left_semi")
    joined = ends.join(chapter_prefix(read), BLOCK)
    shown = F.least("end_offset", "n_chars")
    return joined.select(
        "session_id",
        "book_id",
        "spine_index",
        (F.col("chars_before") + shown).alias("visible"),
        ((F.col("ord") == F.col("last_ord")) & (shown == F.col("n_chars"))).alias("completed"),
    )


def book_chars(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("book_id").agg(F.sum("n_chars").alias("total"))


def reading_progress(sessions: DataFrame, covered: DataFrame, totals: DataFrame) -> DataFrame:
    """floor(visible * 10000 / all) per session, 0 for an empty book."""
    seen = covered.groupBy("session_id", "book_id").agg(
        F.sum("visible").alias("visible"),
        F.sum(F.when(F.col("completed"), 1).otherwise(0)).alias("completed_chapters"),
    )
    return (
        sessions.join(seen, ["session_id", "book_id"], "left")
        .join(totals, "book_id", "left")
        .select(
            "session_id",
            "book_id",
            F.coalesce("visible", F.lit(0).cast("long")).alias("visible"),
            F.coalesce("completed_chapters", F.lit(0).cast("long")).alias("completed_chapters"),
            basis_points(F.coalesce("visible", F.lit(0)), F.coalesce("total", F.lit(0)), empty=0).alias(
                "progress_basis_points"
            ),
        )
    )


def session_state(events: DataFrame) -> DataFrame:
    """Latest location and mode by time, revision one more per accepted patch.

    events(session_id, ts, event_id, is_location, …, error): rows of
    ``location_keys`` and mode changes; a rejected patch changes nothing.
    """
    events = events.where("error is null")
    at = F.struct("ts", "event_id")
    located = F.col("is_location")
    return events.groupBy("session_id").agg(
        F.max_by("spine_index", F.when(located, at)).alias("spine_index"),
        F.max_by("ord", F.when(located, at)).alias("ord"),
        F.max_by("char_offset", F.when(located, at)).alias("char_offset"),
        F.max_by("mode", F.when(F.col("mode").isNotNull(), at)).alias("mode"),
        (F.count(F.lit(1)) + 1).alias("revision"),
    )


def excluded_chapters(sessions: DataFrame, chapters: DataFrame, allowed: DataFrame) -> DataFrame:
    """Content chapters of the session's book that its coverage does not reach.

    The result has a row per session and chapter.  None of these is shuffled: a
    book's chapters come in lists of about ``LISTED``, what a session has reached
    is taken out of the list it is in, and the lists are opened last.
    """
    content = chapters.where(~F.col("is_noise")).select("book_id", "spine_index")
    sizes = content.groupBy("book_id").agg(F.ceil(F.count(F.lit(1)) / LISTED).cast("int").alias("lists"))
    part = F.pmod(F.xxhash64("spine_index"), F.col("lists")).cast("int").alias("part")
    listed = content.join(sizes, "book_id").groupBy("book_id", part).agg(F.collect_list(F.struct("spine_index")).alias("listed"))
    reached = allowed.select("session_id", *CHAPTER).join(sizes, "book_id").groupBy("session_id", "book_id", part).agg(
        F.collect_set("spine_index").alias("reached")
    )
    asked = sessions.join(sizes, "book_id").select(
        "session_id", "book_id", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("part")
    )
    rows = asked.join(reached, ["session_id", "book_id", "part"], "left")
    # Few rows become very many behind the join: a given number of partitions is not made smaller.
    tasks = int(sessions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "book_id", "part").join(listed.hint("merge"), ["book_id", "part"])
    open_ = F.filter("listed", lambda c: c["spine_index"].isNull() | ~F.array_contains("reached", c["spine_index"]))
    left = F.when(F.col("reached").isNull(), F.col("listed")).otherwise(open_)
    return rows.select("session_id", "book_id", F.explode(left).alias("c")).select("session_id", "book_id", "c.spine_index")


def spoiler_boundary(
    requests: DataFrame, sessions: DataFrame, cover: DataFrame, chapters: DataFrame, blocks: DataFrame
) -> DataFrame:
    """One row per request: scope, allowed and excluded chapter counts, error.

    The whole-book mode is kept as a scope name and never expanded to rows per
    chapter.  Scopes: ``s:`` a session's coverage, ``c:`` one chapter, ``b:`` a
    book.  A request with a chapter in an optional column ``before`` has the part
    of its scope below that chapter as a scope of its own.
    """
    reach = cover.groupBy("session_id", "book_id").agg(F.count(F.lit(1)).alias("covered"))
    filled = blocks.select("book_id", "spine_index").distinct()
    sizes = (
        chapters.where(~F.col("is_noise"))
        .join(filled.withColumn("filled", F.lit(1)), ["book_id", "spine_index"], "left")
        .groupBy("book_id")
        .agg(F.count(F.lit(1)).alias("content"), F.count("filled").alias("filled"))
    )
    current = filled.select(*CHAPTER, F.lit(1).cast("long").alias("here"))
    known = (
        sessions.join(reach, ["session_id", "book_id"], "left")
        .join(sizes, "book_id", "left")
        .join(current, CHAPTER, "left")
    )
    zero = F.lit(0).cast("long")
    allowed = (
        F.when(F.col("spoiler_mode") == "read_range", F.coalesce("covered", zero))
        .when(F.col("spoiler_mode") == "current_chapter", F.coalesce("here", zero))
        .otherwise(F.coalesce("filled", zero))
    )
    scope = (
        F.when(F.col("spoiler_mode") == "read_range", F.concat(F.lit("s:"), "session_id"))
        .when(F.col("spoiler_mode") == "current_chapter", F.concat(F.lit("c:"), "book_id", F.lit(":"), F.col("spine_index").cast("string")))
        .otherwise(F.concat(F.lit("b:"), "book_id"))
    )
    if "before" in requests.columns:
        limit = F.col("before").isNotNull()
        scope = F.when(limit, F.concat(scope, F.lit("<"), F.col("before").cast("string"))).otherwise(scope)
    joined = requests.join(known, "session_id", "left")
    ok = F.col("book_id").isNotNull()
    return joined.select(
        *requests.columns,
        "book_id",
        F.col("spine_index").alias("current_spine"),
        F.when(ok, scope).alias("scope_id"),
        F.when(ok, allowed).alias("allowed_chapters"),
        F.when(ok, F.col("content") - allowed).alias("excluded_chapters"),
        F.when(~ok, F.lit("unknown_session")).alias("error"),
    )


def scope_candidates(boundaries: DataFrame, cover: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks each requested scope may draw on, text clipped to what is visible.

    Requests that share a scope share its rows.
    """
    wanted = boundaries.where("error is null")
    if "before" not in wanted.columns:
        wanted = wanted.withColumn("before", F.lit(None).cast("long"))
    far = F.lit(2**62).cast("long")

    def scopes(mode: str, *keys: str) -> DataFrame:
        return wanted.where(F.col("spoiler_mode") == mode).select("scope_id", "before", *keys).distinct()

    below = "before is null or spine_index < before"

    chapter = scopes("current_chapter", "book_id", F.col("current_spine").alias("spine_index"))
    endpoints = (
        cover.join(broadcast_if_small(scopes("read_range", "session_id", "book_id")), ["session_id", "book_id"])
        .where(below)
        .select("scope_id", *CHAPTER, "end_ord", "end_offset")
        .unionByName(chapter.where(below).drop("before").withColumn("end_ord", far).withColumn("end_offset", far))
    )
    by_chapter = visible_chars(blocks, broadcast_if_small(endpoints)).where("visible > 0")
    by_book = blocks.join(broadcast_if_small(scopes("full_book", "book_id")), "book_id").where(below).withColumn(
        "visible", F.col("n_chars")
    )
    fields = ["scope_id", "visible", "book_id", "spine_index", "ord", "block_id", "fp", "n_chars"]
    return by_chapter.select(*fields, clip(F.col("text"), F.col("visible")).alias("text")).unionByName(
        by_book.select(*fields, "text")
    )


def scored_candidates(boundaries: DataFrame, candidates: DataFrame) -> ScopeScores:
    """What every request of a known session asks of its scope's blocks."""
    sized = candidates.select(
        "scope_id", "spine_index", "ord", "visible", "text", F.octet_length("text").cast("long").alias("bytes")
    )
    return ScopeScores(sized, boundaries.where("error is null").select("scope_id", "request_id", "question"))


def retrieve(
    boundaries: DataFrame,
    candidates: DataFrame,
    *,
    context_limit: int = CONTEXT_LIMIT,
    k: int = 8,
) -> DataFrame:
    """Ranked evidence per request within its scope and byte budget."""
    return retrieve_matched(boundaries, candidates, context_limit=context_limit, k=k)[0]


def retrieve_matched(
    boundaries: DataFrame, candidates: DataFrame, *, context_limit: int = CONTEXT_LIMIT, k: int = 8, head: int = 64
) -> tuple[DataFrame, DataFrame]:
    """The evidence of ``retrieve``, and the requests with any matching block, whether or not it fits."""
    scored = scored_candidates(boundaries, candidates)
    first = durable(scored.best(head))
    chosen = durable(_budgeted(scored, first, context_limit // 2, k, head))
    # Ids and fingerprints are looked up for the chosen blocks only.
    spots = candidates.select("scope_id", "spine_index", "ord", "block_id", "fp")
    evidence = join_picked(spots, chosen, ["scope_id", "spine_index", "ord"])
    return evidence, first.select("request_id").distinct()


def _budgeted(scored: ScopeScores, first: DataFrame, budget: int, k: int, head: int) -> DataFrame:
    """The choice of ``byte_budget_select`` from the first ``head`` ranks and as many further blocks as it takes.

    A block that was skipped for its size never fits later, since the budget only shrinks.  So a
    request that is still open asks for the next ``head`` blocks that fit what remains; the first
    of them is always taken, which ends the rounds after ``k`` at most.
    """
    start = F.lit(budget).cast("long")
    folded = durable(_fold_budget(first, start, F.lit(0), k, head))
    chosen = [_picked_rows(folded, first.columns)]
    # A request id in several scopes has one budget for all of them: its blocks are taken in order of rank.
    scopes = durable(first.groupBy("request_id").agg(F.countDistinct("scope_id").alias("n")).where("n > 1"))
    shared = None if scopes.isEmpty() else scopes.select("request_id")
    keys = ["scope_id", "request_id"]
    late = []
    for _ in range(k):
        rows = F.col("rows")
        waiting = folded.where((F.size("rows") == head) & _has_room(k)).select(
            F.element_at(rows, -1)["scope_id"].alias("scope_id"),
            "request_id",
            (F.col("state.remaining") - BUDGET_OVERHEAD).alias("limit"),
            F.element_at(rows, -1)["score"].alias("after_score"),
            F.element_at(rows, -1)["spine_index"].alias("after_spine"),
            F.element_at(rows, -1)["ord"].alias("after_ord"),
            F.size("state.picked").alias("_picked"),
        )
        if shared is not None:
            waiting = waiting.join(broadcast_if_small(shared), "request_id", "left_anti")
        waiting = durable(waiting)
        if waiting.isEmpty():
            break
        fitting = scored.best(head, waiting.drop("_picked"))
        so_far = waiting.select(*keys, (F.col("limit") + BUDGET_OVERHEAD).alias("_remaining"), "_picked")
        folded = durable(
            _fold_budget(fitting.join(so_far, keys), F.first("_remaining"), F.first("_picked"), k, head)
        )
        late.append(_picked_rows(folded, first.columns).drop("rank"))
    if late:
        found = durable(reduce(DataFrame.unionByName, late))
        place = [*keys, "score", "spine_index", "ord"]
        numbered = found.join(scored.ahead(found.select(*place)), place)
        chosen.append(numbered.withColumn("rank", F.col("ahead") + 1).select(*first.columns))
    if shared is not None:
        chosen.append(_rest_of_shared(scored, first, shared, start, k, head))
    return reduce(DataFrame.unionByName, chosen)


def _rest_of_shared(
    scored: ScopeScores, first: DataFrame, shared: DataFrame, start: Column, k: int, head: int
) -> DataFrame:
    """Blocks beyond the first ranks for request ids that stand for several requests."""
    folded = _fold_budget(first.join(broadcast_if_small(shared), "request_id", "left_semi"), start, F.lit(0), k, head)
    open_requests = durable(_open(folded, k, head))
    scopes = first.select("scope_id", "request_id").distinct().join(open_requests, "request_id", "left_semi")
    none = [F.lit(2**62).cast("long").alias(c) for c in ("limit", "after_score", "after_spine", "after_ord")]
    ranked = scored.best(None, durable(scopes.select("*", *none)))
    return _continued(ranked.select(*first.columns), open_requests, k, head)


def byte_budget_select(ranked: DataFrame, *, budget: int, k: int = 8, head: int = 64) -> DataFrame:
    """Greedy choice in rank order: a block that does not fit is skipped.

    ranked(request_id, rank, bytes, …).  The first ``head`` ranks of a request
    are folded in one array.  A request that needs more than that (many blocks
    skipped) continues in a streaming pass over its sorted rows with constant
    state, so no ranked list is ever held whole.
    """
    folded = durable(_fold_budget(ranked.where(F.col("rank") <= head), F.lit(budget).cast("long"), F.lit(0), k, head))
    chosen = _picked_rows(folded, ranked.columns)
    open_requests = _open(folded, k, head)
    if open_requests.isEmpty():
        return chosen
    return chosen.unionByName(_continued(ranked, open_requests, k, head).select(*chosen.columns))


def _fold_budget(rows: DataFrame, remaining: Column, picked: Column, k: int, head: int) -> DataFrame:
    """(request_id, rows, state): at most ``head`` rows per request in order of rank, the budget after them and their ranks taken.

    remaining and picked, the budget and the number of blocks taken before, are constants or aggregates.
    """
    fields = [c for c in rows.columns if c not in ("request_id", "rank", "_remaining", "_picked")]
    first = rows.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("rows"),
        remaining.alias("_remaining"),
        picked.alias("_picked"),
    )
    state_type = "struct<remaining:bigint,picked:array<bigint>>"
    # Blocks taken in earlier rounds count as ranks below 1.
    before = F.when(F.col("_picked") > 0, F.sequence(1 - F.col("_picked"), F.lit(0))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.col("_remaining").alias("remaining"), before.cast("array<bigint>").alias("picked"))

    def step(state, x):
        cost = x["bytes"] + BUDGET_OVERHEAD
        takes = (F.size(state["picked"]) < k) & (cost <= state["remaining"])
        return F.when(
            takes,
            F.struct(
                (state["remaining"] - cost).alias("remaining"),
                F.concat(state["picked"], F.array(x["rank"])).alias("picked"),
            ).cast(state_type),
        ).otherwise(state)

    return first.withColumn("state", F.aggregate("rows", start.cast(state_type), step)).drop("_remaining", "_picked")


def _picked_rows(folded: DataFrame, columns: list[str]) -> DataFrame:
    taken = F.filter("rows", lambda x: F.array_contains(F.col("state.picked"), x["rank"]))
    return folded.select("request_id", F.explode(taken).alias("x")).select("request_id", "x.*").select(*columns)


def _has_room(k: int) -> Column:
    """Whether a request may take another block: none costs as little as the overhead."""
    return (F.size("state.picked") < k) & (F.col("state.remaining") > BUDGET_OVERHEAD)


def _open(folded: DataFrame, k: int, head: int) -> DataFrame:
    return folded.where((F.size("rows") == head) & _has_room(k)).select(
        "request_id", F.col("state.remaining").alias("_remaining"), F.size("state.picked").alias("_picked")
    )


def _continued(ranked: DataFrame, open_requests: DataFrame, k: int, head: int) -> DataFrame:
    """The streaming pass: ranks beyond ``head`` of requests that need them."""
    rest = (
        ranked.where(F.col("rank") > head)
        .join(open_requests, "request_id")
        .repartition("request_id")
        .sortWithinPartitions("request_id", "rank")
    )
    schema = ranked.schema
    return rest.mapInPandas(_continue_budget(k, [f.name for f in schema]), schema)


def _continue_budget(k: int, columns: list[str]):
    def run(batches):
        request, remaining, picked = None, 0, 0
        for pdf in batches:
            keep = []
            for i, (rid, size, rem, got) in enumerate(
                zip(pdf["request_id"], pdf["bytes"], pdf["_remaining"], pdf["_picked"])
            ):
                if rid != request:
                    request, remaining, picked = rid, rem, got
                cost = size + BUDGET_OVERHEAD
                if picked < k and cost <= remaining:
                    remaining, picked = remaining - cost, picked + 1
                    keep.append(i)
            yield pdf.iloc[keep][columns]

    return run


def nearby_blocks(selections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Selected block with its neighbours, or the first three of the chapter.

    selections(request_id, book_id, spine_index, block_id?).
    """
    order = Window.partitionBy(*CHAPTER).orderBy("ord")
    held = blocks.join(selections.select(*CHAPTER).distinct(), CHAPTER, "left_semi")
    placed = held.withColumn("pos", F.row_number().over(order))
    spot = placed.select(*CHAPTER, F.col("block_id").alias("_sel"), F.col("pos").alias("_at"))
    selected = (
        selections.where("block_id is not null")
        .withColumnRenamed("block_id", "_sel")
        .join(spot, [*CHAPTER, "_sel"])
        .select("request_id", *CHAPTER, F.explode(F.expr("array(_at - 1, _at, _at + 1)")).alias("pos"))
    )
    opening = selections.where("block_id is null").select(
        "request_id", *CHAPTER, F.explode(F.expr("array(1, 2, 3)")).alias("pos")
    )
    return selected.unionByName(opening).join(placed, [*CHAPTER, "pos"])


def validate_highlights(highlights: DataFrame, blocks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Highlights with the first broken rule, null when accepted.

    highlights(…, session_id, book_id, spine_index, block_id, start_char, end_char, text).
    """
    source = blocks.select(*CHAPTER, "block_id", F.col("text").alias("_text"), F.col("n_chars").alias("_n"))
    known = sessions.select("session_id", F.lit(True).alias("_session")).distinct()
    slice_ = F.expr("substring(_text, cast(start_char + 1 as int), cast(end_char - start_char as int))")
    return (
        highlights.join(source, [*CHAPTER, "block_id"], "left")
        .join(known, "session_id", "left")
        .withColumn(
            "error",
            first_violation(
                [
                    (F.col("_text").isNull(), "block_outside_chapter"),
                    ((F.col("start_char") >= F.col("end_char")) | (F.col("end_char") > F.col("_n")), "invalid_range"),
                    (slice_ != F.col("text"), "text_mismatch"),
                    (F.col("_session").isNull(), "unknown_session"),
                ]
            ),
        )
        .drop("_text", "_n", "_session")
    )


def validate_notes(notes: DataFrame, chapters: DataFrame, blocks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Notes with the first broken rule; the block is optional and may be in any chapter of the book."""
    from lectern.rules import blank

    known_chapter = chapters.select("book_id", "spine_index", F.lit(True).alias("_chapter"))
    known_block = blocks.select("book_id", "block_id", F.lit(True).alias("_block"))
    known_session = sessions.select("session_id", F.lit(True).alias("_session")).distinct()
    return (
        notes.join(known_chapter, ["book_id", "spine_index"], "left")
        .join(known_block, ["book_id", "block_id"], "left")
        .join(known_session, "session_id", "left")
        .withColumn(
            "error",
            first_violation(
                [
                    (F.col("_chapter").isNull(), "unknown_chapter"),
                    (blank(F.col("text")), "blank_text"),
                    (F.col("block_id").isNotNull() & F.col("_block").isNull(), "unknown_block"),
                    (F.col("_session").isNull(), "unknown_session"),
                ]
            ),
        )
        .drop("_chapter", "_block", "_session")
    )


def state_matches_session(submitted: DataFrame, stored: DataFrame) -> DataFrame:
    """Submitted reader state against the stored session, field by field, null-safe."""
    fields = ["spine_index", "ord", "char_offset", "progress_basis_points"]
    kept = stored.select("session_id", F.lit(True).alias("_known"), *[F.col(f).alias(f"_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return submitted.join(kept, "session_id", "left").select(
        *submitted.columns,
        F.when(F.col("_known").isNull(), F.lit("unknown_session"))
        .when(~same, F.lit("state_mismatch"))
        .alias("error"),
    )


def unread_limits(blocks: DataFrame, cover: DataFrame) -> DataFrame:
    """Allowed end offset per session and block, blocks up to the endpoint only."""
    return visible_chars(blocks, cover).join(
        cover.select("session_id", *CHAPTER, "end_ord"), ["session_id", *CHAPTER]
    ).where("ord <= end_ord").select("session_id", *CHAPTER, "block_id", F.col("visible").alias("end_char"))
