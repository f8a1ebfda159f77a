"""Chapter and book analysis: what to analyse, requests, plug-in analyzers."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import query_terms
from lectern.operators.prefix import numbered, with_previous
from lectern.operators.retrieval import WEIGHT, max_score, term_rows
from lectern.rules import blank, violations
from lectern.session import broadcast_if_small, durable

EXCERPT_BYTES = 8192
WHOLE_BOOK = 1 << 20  # bytes of text up to which a book's blocks are ranked in one piece
# Instruction and synthesis caps of the three profiles.
PROFILES = {
    "basic": ("Be concise: extract only the chapter's essential summary, ideas, and evidence.", 8),
    "standard": (
        "Balance coverage and cost: include the important concepts, claims, entities, and difficult passages.",
        16,
    ),
    "deep": (
        "Be comprehensive: preserve nuanced arguments, counterpoints, relations, and difficult passages.",
        32,
    ),
}
MAX_APPEARANCES, MAX_EVIDENCE = 3, 2
STAGES = ("parse", "normalize", "chapter_analysis", "book_synthesis", "grounding_validation")


def analyzable_chapters(chapters: DataFrame, through: int | None = None) -> DataFrame:
    """Content chapters with blocks, optionally below a spine index."""
    chosen = chapters.where(~F.col("is_noise") & (F.col("block_count") > 0))
    return chosen if through is None else chosen.where(F.col("spine_index") < through)


def profile_settings(rows: DataFrame, profile: str = "profile") -> DataFrame:
    """Instruction and object cap of each row's profile; null for an unknown one."""
    name = F.col(profile)
    instruction, cap = F.lit(None).cast("string"), F.lit(None).cast("long")
    for key, (text, n) in PROFILES.items():
        instruction = F.when(name == key, text).otherwise(instruction)
        cap = F.when(name == key, n).otherwise(cap)
    return rows.withColumn("instruction", instruction).withColumn("max_objects", cap.cast("long"))


def cap_references(objects: DataFrame, refs: str, limit: int = MAX_APPEARANCES) -> DataFrame:
    return objects.withColumn(refs, F.slice(refs, 1, limit))


def generated_issues(analyses: DataFrame) -> DataFrame:
    """Array of blank summary fields per analysis."""
    fields = ("one_sentence", "short", "deep", "role_in_book")
    return analyses.withColumn("issues", violations([(blank(F.col(f"summary.{f}")), f"summary.{f}") for f in fields]))


def analysis_key(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Identity hash over the listed columns; unknown ones stay in as null."""
    packed = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return rows.withColumn("analysis_key", F.sha2(packed, 256))


def reusable_packages(packages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Packages that answer a wanted (book, source, profile, through, key) as they are."""
    keys = ["book_id", "source_hash", "profile", "analyzed_through", "analysis_key"]
    ok = packages.where("complete and grounded and violations = 0")
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    return wanted.alias("w").join(ok.alias("p"), same, "left_semi")


def chapters_to_analyze(chapters: DataFrame, saved: DataFrame, invalid: DataFrame, *, profile: str, version: str) -> DataFrame:
    """Chapters without a saved analysis that still holds.

    saved(book_id, spine_index, chapter_id, schema_version, analysis_profile,
    source_content_hash, summary); invalid(book_id, spine_index) lists saved
    chapters whose citations no longer resolve.
    """
    fresh = (
        generated_issues(saved)
        .where(
            (F.col("schema_version") == version) & (F.col("analysis_profile") == profile) & (F.size("issues") == 0)
        )
        .join(invalid.select("book_id", "spine_index").distinct(), ["book_id", "spine_index"], "left_anti")
        .select("book_id", "spine_index", "chapter_id", F.col("source_content_hash").alias("content_hash"))
    )
    return chapters.join(fresh, ["book_id", "spine_index", "chapter_id", "content_hash"], "left_anti")


def prior_context(blocks: DataFrame, k: int = 8, beside: DataFrame | None = None, whole: int = WHOLE_BOOK) -> DataFrame:
    """Best earlier blocks of the book for every chapter.

    blocks(book_id, spine_index, ord, text).  A chapter's query is all its
    blocks, so query terms are the chapter's own postings.  A term counts only
    the blocks of earlier chapters.  Blocks above 8192 bytes count for the
    frequency but are not returned.

    Books of up to ``whole`` bytes are ranked one by one where their blocks meet:
    texts are shuffled once, and no posting is.  The postings of longer books are
    shuffled by term (``_prior_by_term``), so that no task has to hold such a book.

    With beside(book_id, spine_index, …), a row per chapter, and ``block_id`` in the
    blocks, these rows are returned with ``prior_chapters``, how many of them precede
    theirs, and ``prior_excerpts``, the ranked blocks with id and text: as they met the
    blocks already, no excerpt is shuffled.  Rows without book or chapter have no place.
    """
    place = ["book_id", "spine_index"]
    sized = blocks.withColumn("bytes", F.octet_length("text").cast("long"))
    long = durable(sized.groupBy("book_id").agg(F.sum("bytes").alias("_size")).where(F.col("_size") > whole).select("book_id"))
    all_short = long.isEmpty()
    within = lambda df, how: df.join(broadcast_if_small(long), "book_id", how)
    shorter = lambda df: df.where("book_id is not null") if all_short else within(df.where("book_id is not null"), "left_anti")
    kind = lambda c: blocks.schema[c].dataType.simpleString()
    head = f"book_id {kind('book_id')}, for_chapter {kind('spine_index')}, spine_index {kind('spine_index')}, ord {kind('ord')}, score bigint, rank bigint"
    if beside is None:
        met = _dealt_by_book(shorter(sized).select(*place, "ord", "bytes", "text")).select(*place, "ord", "bytes", "_terms")
        found = met.mapInArrow(_prior_of_books(_ranked_blocks, k), head)
        return found if all_short else found.unionByName(_prior_by_term(within(sized, "left_semi"), k))
    fields = [c for c in beside.columns if c not in place]
    rows = shorter(sized).select(*place, "ord", "bytes", "text", "block_id").unionByName(
        shorter(beside).select(*place, F.struct(*fields).alias("_beside")), allowMissingColumns=True
    )
    entry = f"struct<rank:bigint,from_chapter:{kind('spine_index')},ord:{kind('ord')},block_id:{kind('block_id')},text:string>"
    schema = f"book_id {kind('book_id')}, spine_index {kind('spine_index')}, _beside {rows.schema['_beside'].dataType.simpleString()}, prior_chapters bigint, prior_excerpts array<{entry}>"
    found = _dealt_by_book(rows).mapInArrow(_prior_of_books(_rows_beside, k), schema)
    made = found.where("spine_index is not null").select(*place, "_beside.*", "prior_chapters", F.array_sort("prior_excerpts").alias("prior_excerpts"))
    if all_short:
        return made
    held = within(sized, "left_semi")
    texts = _prior_by_term(held, k).join(held.select(*place, "ord", "block_id", "text"), [*place, "ord"])
    return made.unionByName(_with_excerpts(within(beside, "left_semi"), texts).select(*made.columns))


def _dealt_by_book(rows: DataFrame) -> DataFrame:
    """Books side by side, each in reading order, with the terms of every block; split into terms behind the shuffle."""
    dealt = rows.repartition("book_id").sortWithinPartitions("book_id", "spine_index", "ord")
    return dealt.withColumn("_terms", query_terms(F.col("text")))


def _with_excerpts(chapters: DataFrame, texts: DataFrame) -> DataFrame:
    """Chapters with ``prior_chapters`` and ``prior_excerpts``; texts(book_id, for_chapter, spine_index, ord, rank, block_id, text)."""
    entry = F.struct("rank", F.col("spine_index").alias("from_chapter"), "ord", "block_id", "text")
    chosen = texts.groupBy("book_id", F.col("for_chapter").alias("spine_index")).agg(
        F.array_sort(F.collect_list(entry)).alias("prior_excerpts")
    )
    joined = earlier_chapters(chapters).withColumnRenamed("place", "prior_chapters").join(chosen, ["book_id", "spine_index"], "left")
    empty = F.array().cast(chosen.schema["prior_excerpts"].dataType)
    return joined.withColumn("prior_excerpts", F.coalesce("prior_excerpts", empty))


def _prior_by_term(blocks: DataFrame, k: int) -> DataFrame:
    """``prior_context`` by posting lists: a term's frequency is a running sum over per-chapter counts; terms
    worth nothing are dropped before the join, and of the others only the lists that can decide the best ``k`` are joined."""
    postings = durable(term_rows(blocks, ["book_id", "spine_index", "ord", "bytes"]))
    counted = postings.groupBy("book_id", "term", "spine_index").agg(F.count(F.lit(1)).alias("n"))
    before = (
        Window.partitionBy("book_id", "term").orderBy("spine_index").rowsBetween(Window.unboundedPreceding, -1)
    )
    asked = (
        counted.withColumn("df", F.sum("n").over(before))
        .where("df > 0")
        .select(
            "book_id",
            "term",
            F.col("spine_index").alias("for_chapter"),
            "df",
            F.expr(f"{WEIGHT} div (df + 1)").alias("weight"),
        )
        .where("weight > 0")
    )
    return max_score(
        postings.where(F.col("bytes") <= EXCERPT_BYTES).drop("bytes"),
        asked,
        on=["book_id", "term"],
        query=["book_id", "for_chapter"],
        block=["book_id", "spine_index", "ord"],
        position=["spine_index", "ord"],
        k=k,
        admissible=F.col("spine_index") < F.col("for_chapter"),
    )


def _prior_of_books(make, k: int):
    """``make`` over rows sorted by book, chapter and order, whole books at a time."""

    def run(batches):
        import pyarrow as pa

        held = None  # the last book of what has come: it may go on
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if not len(table):
                continue
            books = _runs(table, ["book_id"])
            cut = int(books.searchsorted(books[-1]))
            if cut:
                yield from make(table.slice(0, cut), k).to_batches()
            held = table.slice(cut)
        if held is not None and len(held):
            yield from make(held, k).to_batches()

    return run


def _ranked_blocks(table, k: int):
    import pyarrow as pa

    first, taken, score, rank = _best_earlier(table, k)
    there, rows = table["spine_index"].take(pa.array(first)), pa.array(taken)
    return pa.table(
        {"book_id": table["book_id"].take(rows), "for_chapter": there, "spine_index": table["spine_index"].take(rows),
         "ord": table["ord"].take(rows), "score": pa.array(score, pa.int64()), "rank": pa.array(rank, pa.int64())}
    )


def _rows_beside(table, k: int):
    """The rows beside the blocks, with their number in the book and the best earlier blocks of their chapter."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    chapter, asking = _runs(table, ["book_id", "spine_index"]), pc.is_valid(table["_beside"]).to_numpy()
    blocks, rows = table.filter(pa.array(~asking)), table.filter(pa.array(asking))
    first, taken, _, rank = _best_earlier(blocks, k, copies=True)
    own, wanted = chapter[~asking][first], chapter[asking]  # found blocks are in order of the chapter that asks
    begin, end = np.searchsorted(own, wanted), np.searchsorted(own, wanted, side="right")
    n = end - begin
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    chosen = pa.array(taken[at])
    names = {"from_chapter": "spine_index", "ord": "ord", "block_id": "block_id", "text": "text"}
    held = [blocks[c].take(chosen).combine_chunks() for c in names.values()]
    entries = pa.StructArray.from_arrays([pa.array(rank[at], pa.int64()), *held], ["rank", *names])
    book = _runs(rows, ["book_id"])
    number = np.arange(len(rows)) - np.searchsorted(book, book)
    return pa.table(
        {"book_id": rows["book_id"], "spine_index": rows["spine_index"], "_beside": rows["_beside"],
         "prior_chapters": pa.array(number, pa.int64()),
         "prior_excerpts": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), entries)}
    )


def _runs(table, names):
    """Number of the run of equal values that each row of a sorted table is in."""
    import numpy as np

    new = np.zeros(len(table), dtype=bool)
    for name in names:
        codes = table[name].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if hasattr(codes, "chunks") else codes).indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def _best_earlier(table, k: int, copies: bool = False, most: int = 4_000_000):
    """(first row of the chapter that asks, row of a block, score, rank) over whole books; with ``copies`` every row of a block's place."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    whole = lambda a: a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    book, chapter, block = (_runs(table, ["book_id", "spine_index", "ord"][:n]) for n in (1, 2, 3))
    first_row = np.flatnonzero(np.diff(block, prepend=-1))  # of every block; copies of a block add up in one
    lists = whole(table["_terms"])
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(table)), sizes)
    words = whole(whole(lists.flatten()).dictionary_encode()) if len(row) else None
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(row) else np.zeros(0, dtype=np.int64)
    # Posting lists of a book's terms, each in reading order.
    key = book[row] * (len(words.dictionary) if len(row) else 1) + code
    row = row[np.argsort(key, kind="stable")]
    key.sort()
    at = np.arange(len(row))
    new_list = np.diff(key, prepend=-1) != 0
    new_chapter = new_list | (np.diff(chapter[row], prepend=-1) != 0)
    # A chapter asks once for each of its terms: its list from the start up to the chapter.
    asked = np.flatnonzero(new_chapter)
    start = np.maximum.accumulate(np.where(new_list, at, 0))[asked]
    df = asked - start
    weight = WEIGHT // (df + 1)
    use = (df > 0) & (weight > 0)
    asked, start, df, weight = asked[use], start[use], df[use], weight[use]
    by = chapter[row[asked]]
    order = np.argsort(by, kind="stable")
    by, start, df, weight = by[order], start[order], df[order], weight[order]
    may = (pc.fill_null(pc.less_equal(whole(table["bytes"]), EXCERPT_BYTES), False)).to_numpy(zero_copy_only=False)
    may = may & pc.is_valid(whole(table["spine_index"])).to_numpy(zero_copy_only=False)
    # Scores of a chapter stand side by side, one for each block of the book before it.
    asking, lead = np.unique(by, return_index=True)
    chapter_row = np.flatnonzero(np.diff(chapter, prepend=-1))
    book_row = np.flatnonzero(np.diff(book, prepend=-1))
    low = block[book_row[book[chapter_row[asking]]]]
    width = block[chapter_row[asking]] - low
    cost = np.cumsum(width + np.add.reduceat(df, lead)) if len(asking) else width
    ends = [*lead[1:], len(by)]
    out: list[list] = [[], [], [], []]
    begin = 0
    while begin < len(asking):
        spent = cost[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(cost, spent + most, side="right")))
        lo, hi = lead[begin], ends[end - 1]
        n = df[lo:hi]
        ahead = np.cumsum(n) - n
        posting = row[np.repeat(start[lo:hi] - ahead, n) + np.arange(n.sum())]
        own = np.repeat(np.searchsorted(asking[begin:end], by[lo:hi]), n)
        worth = np.repeat(weight[lo:hi], n)
        kept = may[posting]
        posting, own, worth = posting[kept], own[kept], worth[kept]
        base = np.cumsum(width[begin:end]) - width[begin:end]
        scores = np.bincount(base[own] + block[posting] - low[begin:end][own], weights=worth, minlength=int(width[begin:end].sum()))
        place = np.flatnonzero(scores)
        score = scores[place].astype(np.int64)
        of = np.searchsorted(base, place, side="right") - 1
        best = np.argsort(of * (score.max(initial=0) + 1) - score, kind="stable")  # in order of position where scores are equal
        of, score, found = of[best], score[best], (place - base[of] + low[begin:end][of])[best]
        rank = np.arange(len(of)) - np.searchsorted(of, of) + 1
        some = rank <= k
        for kind, values in zip(out, (asking[begin:end][of[some]], found[some], score[some], rank[some])):
            kind.append(values)
        begin = end
    asking, found, score, rank = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out)
    taken, at = first_row[found], np.arange(len(found))
    if copies:
        n = np.diff(first_row, append=len(table))[found]
        at = np.repeat(at, n)
        taken = np.repeat(taken - (np.cumsum(n) - n), n) + np.arange(len(at))
        named = pc.is_valid(whole(table["ord"]).take(pa.array(taken))).to_numpy(zero_copy_only=False)  # no other is found by its place
        at, taken = at[named], taken[named]
    return chapter_row[asking[at]], taken, score[at], rank[at]


def earlier_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters of a book by place, from 0.  A request for the chapter at place n refers to places 0 to n - 1.

    One table serves all requests of a book; a copy of the list in every request
    would grow with the square of the book.
    """
    return numbered(chapters, ["book_id"], "spine_index", "place")


def chapter_requests(
    chapters: DataFrame, excerpts: DataFrame | None, blocks: DataFrame, *, profile: str, contents: DataFrame | None = None
) -> DataFrame:
    """One request row per chapter: its blocks, its excerpts with id and text, how many chapters precede it.

    chapters(book_id, spine_index, title, blocks array<string>),
    excerpts(book_id, for_chapter, spine_index, ord, rank) are at most eight per
    chapter, blocks(book_id, spine_index, ord, block_id, text).  Without excerpts the
    chapters are those of ``prior_context`` with its ``beside``.  The earlier
    chapters themselves are the first ``prior_chapters`` rows of ``earlier_chapters``.
    contents(book_id, contents) is a book's nested contents as JSON
    (``book_document.nested_contents``); every request of the book carries it, an
    empty array where the book has none.
    """
    joined = chapters
    if excerpts is not None:
        texts = blocks.select("book_id", "spine_index", "ord", "block_id", "text")
        joined = _with_excerpts(chapters, excerpts.join(texts, ["book_id", "spine_index", "ord"]))
    if contents is not None:
        joined = joined.join(contents.select("book_id", "contents"), "book_id", "left")
    return profile_settings(
        joined.select(
            "book_id",
            "spine_index",
            "title",
            F.lit("chapter_analysis").alias("task"),
            F.lit(profile).alias("profile"),
            "blocks",
            "prior_chapters",
            "prior_excerpts",
            *([] if contents is None else [F.coalesce("contents", F.lit("[]")).alias("table_of_contents")]),
        )
    )


def synthesis_requests(books: DataFrame, analyses: DataFrame) -> DataFrame:
    """One request row per book with the number of its analyses; a book without any is an error row.

    The analyses are the rows of ``synthesis_chapters`` with that book.
    """
    counted = analyses.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"))
    return books.select("book_id").join(counted, "book_id", "left").select(
        "book_id",
        F.lit("book_synthesis").alias("task"),
        F.coalesce("chapters", F.lit(0).cast("long")).alias("chapters"),
        F.when(F.col("chapters").isNull(), "no_chapter_analyses").alias("error"),
    )


def synthesis_chapters(analyses: DataFrame) -> DataFrame:
    """(book_id, place, spine_index, chapter_id, analysis): every whole analysis of a book, in order, as JSON."""
    fields = [c for c in analyses.columns if c not in ("book_id", "spine_index", "chapter_id")]
    rows = analyses.select("book_id", "spine_index", "chapter_id", F.to_json(F.struct(*fields)).alias("analysis"))
    return earlier_chapters(rows)


def registration_analysis(chapters: DataFrame) -> DataFrame:
    """Analysis without a model: the same four sentences for every chapter, so that a package can be made and checked."""
    label = F.when(blank(F.col("title")), F.col("chapter_id")).otherwise(F.col("title"))
    return chapters.withColumn(
        "summary",
        F.struct(
            F.format_string("No model has read %s.", label).alias("one_sentence"),
            F.format_string("Nothing has been written about %s yet.", label).alias("short"),
            F.format_string(
                "The text of %s stands as it is; this entry only keeps its place in the package.", label
            ).alias("deep"),
            F.lit("Keeps the order of the chapters.").alias("role_in_book"),
        ),
    )


# Fixed value: text of the source-only baseline.
UNAVAILABLE = "Source-only baseline: no precomputed interpretation."


def source_only_analysis(chapters: DataFrame) -> DataFrame:
    text = F.lit(UNAVAILABLE)
    return chapters.withColumn(
        "summary",
        F.struct(
            text.alias("one_sentence"), text.alias("short"), text.alias("deep"), text.alias("role_in_book")
        ),
    )


def extract_answer(context: DataFrame) -> DataFrame:
    """Distinct supplied block texts in order, joined by new lines; context(request_id, texts array<string>)."""
    return context.withColumn("answer", F.array_join(F.array_distinct("texts"), "\n"))


def calls_per_executor(calls: int, cores: int):
    """Resource profile under which an executor of ``cores`` cores runs at most ``calls`` tasks of a stage at once.

    Every other stage keeps all cores.  For cluster managers that schedule by
    stage (standalone, YARN, Kubernetes); a local session has no executors.
    """
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(max(1, -(-cores // max(1, calls))))).build


def analyze(
    requests: DataFrame, analyzer: Callable[[dict], dict], key: str, check: Callable[[dict], str | None], concurrency: int | None = None,
    profile=None, usage: Callable[[dict], dict | None] | None = None,
) -> DataFrame:
    """Run a plug-in analyzer over request rows.

    requests(key, request_json).  Each row gives (key, status, payload, error);
    a failing request never stops the others.  ``profile`` (``calls_per_executor``)
    bounds how many calls an executor makes at once, ``concurrency`` the number of
    tasks.  With ``usage``, which takes the provider's usage out of a payload, a
    completed call without a valid one has the status ``unknown_usage``: its
    output stands, but nothing may be dispatched after it.
    """
    key_type = requests.schema[key].dataType.simpleString()
    rows = requests.select(key, "request_json")
    if concurrency is not None:
        rows = rows.repartition(concurrency)

    def run(batches):
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf["request_json"]):
                try:
                    payload = analyzer(json.loads(text))
                    problem = check(payload)
                    status = "invalid" if problem else "completed"
                    if status == "completed" and usage is not None and not usage_known(usage(payload)):
                        status = "unknown_usage"
                    out.append((k, status, json.dumps(payload, ensure_ascii=False), problem))
                except Exception as error:  # recorded per request
                    out.append((k, "failed", None, str(error)))
            yield pd.DataFrame(out, columns=[key, "status", "payload", "error"], dtype=object)

    schema = f"{key} {key_type}, status string, payload string, error string"
    return rows.mapInPandas(run, schema) if profile is None else rows.mapInPandas(run, schema, profile=profile)


def usage_known(usage: dict | None) -> bool:
    """Whole non-negative token numbers, no more cached than read, no cache writes."""
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    if not usage or not whole(usage.get("input_tokens")) or not whole(usage.get("output_tokens")):
        return False
    cached = usage.get("cached_input_tokens") or 0
    return whole(cached) and cached <= usage["input_tokens"] and not usage.get("cache_write_input_tokens")


_REF = "struct<block_id:string,start_char:bigint,end_char:bigint,text_fingerprint:string>"
GENERATED = (
    f"struct<concepts:array<struct<source_refs:array<{_REF}>>>,claims:array<struct<evidence:array<struct<source_ref:{_REF}>>>>,"
    f"difficult_passages:array<struct<source_ref:{_REF}>>,entities:array<struct<source_refs:array<{_REF}>>>>"
)


def grounded(outputs: DataFrame, places: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Analyzer outputs with their grounding checked: an ungrounded one is ``invalid`` with its codes.

    outputs as ``analyze`` gives them, places(key, book_id, spine_index),
    blocks(book_id, block_id, spine_index, n_chars, fp).  Every citation of every
    completed output is joined with the blocks; a claim without evidence is a code
    of its own.  Codes are few per output however many citations it has.
    """
    from lectern.operators.grounding import resolve_refs

    done = outputs.where("status in ('completed', 'unknown_usage')").join(places.select(key, "book_id", "spine_index"), key)
    made = done.select(key, "book_id", F.col("spine_index").alias("max_chapter"), F.from_json("payload", GENERATED).alias("g"))
    some = lambda c, kind: F.coalesce(F.col(f"g.{c}"), F.array().cast(kind))
    inner = lambda refs: F.coalesce(refs, F.array().cast(f"array<{_REF}>"))
    object_refs = f"array<struct<source_refs:array<{_REF}>>>"
    claim = f"array<struct<evidence:array<struct<source_ref:{_REF}>>>>"
    refs = F.concat(
        F.flatten(F.transform(some("concepts", object_refs), lambda c: inner(c["source_refs"]))),
        F.flatten(F.transform(some("claims", claim), lambda c: inner(F.transform(c["evidence"], lambda e: e["source_ref"])))),
        F.transform(some("difficult_passages", f"array<struct<source_ref:{_REF}>>"), lambda x: x["source_ref"]),
        F.flatten(F.transform(some("entities", object_refs), lambda e: inner(e["source_refs"]))),
    )
    cited = made.select(key, "book_id", "max_chapter", F.explode(refs).alias("r")).select(key, "book_id", "max_chapter", "r.*")
    bare = made.where(F.exists(some("claims", claim), lambda c: F.coalesce(F.size(c["evidence"]), F.lit(0)) <= 0))
    found = (
        resolve_refs(cited, blocks)
        .select(key, F.explode("codes").alias("code"))
        .unionByName(bare.select(key, F.lit("claim_without_evidence").alias("code")))
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("code")).alias("codes"))
    )
    bad = F.col("codes").isNotNull()
    return outputs.join(found, key, "left").select(
        key,
        F.when(bad, "invalid").otherwise(F.col("status")).alias("status"),
        "payload",
        F.when(bad, "ungrounded").otherwise(F.col("error")).alias("error"),
        F.coalesce("codes", F.array().cast("array<string>")).alias("codes"),
    )


def check_generated(payload: dict) -> str | None:
    """Name of the first blank summary field of an analyzer's output."""
    summary = payload.get("summary") or {}
    for field in ("one_sentence", "short", "deep", "role_in_book"):
        if not str(summary.get(field) or "").strip():
            return f"summary.{field}"
    return None


def check_judgment(payload: dict) -> str | None:
    """First problem of a judge's output: score 0..3, verdict, evidence, explicit hard failure."""
    if payload.get("score") not in (0, 1, 2, 3):
        return "score"
    if payload.get("verdict") not in ("supports", "refutes", "insufficient"):
        return "verdict"
    if not str(payload.get("evidence") or "").strip():
        return "evidence"
    return None if isinstance(payload.get("hard_failure"), bool) else "hard_failure"


def compile_status(chapters: DataFrame, analyses: DataFrame, synthesized: DataFrame, grounded: DataFrame) -> DataFrame:
    """Stages reached, counts and completeness per book.

    synthesized(book_id) and grounded(book_id, valid) list what exists.
    """
    total = chapters.groupBy("book_id").agg(
        F.sum(F.when(~F.col("is_noise") & (F.col("block_count") > 0), 1).otherwise(0)).alias("total")
    )
    done = analyses.groupBy("book_id").agg(F.count(F.lit(1)).alias("done"))
    has_synthesis = synthesized.select("book_id", F.lit(True).alias("_s")).distinct()
    joined = (
        total.join(done, "book_id", "left")
        .join(has_synthesis, "book_id", "left")
        .join(grounded.select("book_id", "valid"), "book_id", "left")
    )
    analyzed = F.coalesce("done", F.lit(0)) >= F.col("total")
    synthesis = analyzed & F.col("_s").isNotNull()
    complete = synthesis & F.coalesce("valid", F.lit(False))
    reached = F.when(complete, 5).when(synthesis, 4).when(analyzed, 3).otherwise(2)
    return joined.select(
        "book_id",
        F.slice(F.array(*[F.lit(s) for s in STAGES]), F.lit(1), reached).alias("ready_stages"),
        F.coalesce("done", F.lit(0).cast("long")).alias("analyzed_chapters"),
        F.col("total").alias("total_chapters"),
        complete.alias("complete"),
        F.when(synthesis & ~F.coalesce("valid", F.lit(False)), "grounding validation failed").alias("error"),
    )


def stage_progress(snapshots: DataFrame) -> DataFrame:
    """Snapshots that are no prefix of the stage list or shrink; snapshots(book_id, seq, ready_stages)."""
    stages = F.array(*[F.lit(s) for s in STAGES])
    sized = snapshots.withColumn("_size", F.size("ready_stages"))
    return with_previous(sized, ["book_id"], "seq", "_size", "_was").select(
        "book_id",
        "seq",
        (F.slice(stages, F.lit(1), F.col("_size")) != F.col("ready_stages")).alias("not_prefix"),
        F.coalesce(F.col("_size") < F.col("_was"), F.lit(False)).alias("shrinks"),
    ).where("not_prefix or shrinks")


def attempt_numbers(attempts: DataFrame) -> DataFrame:
    """Attempts of a book numbered from one."""
    return numbered(attempts, ["book_id"], "seq", "_n").withColumn("attempt", F.col("_n") + 1).drop("_n")


def earlier_summaries(current: DataFrame) -> DataFrame:
    """(book_id, place, spine_index, short): the present short summaries of a book by place, from 0."""
    return earlier_chapters(current.select("book_id", "spine_index", F.col("summary.short").alias("short")))


def reanalysis_requests(chapters: DataFrame, current: DataFrame) -> DataFrame:
    """Request rows to analyse chapters again: the existing analysis and how many summaries precede it.

    chapters(book_id, spine_index, chapter_id), current adds ``summary``.  The
    earlier summaries, all of them, are the first ``n_earlier`` rows of
    ``earlier_summaries`` of the book.
    """
    placed = earlier_chapters(current.select("book_id", "spine_index", "summary")).withColumnRenamed("place", "n_earlier")
    return chapters.join(placed, ["book_id", "spine_index"]).withColumn("task", F.lit("chapter_reanalysis"))


def ordered_results(analyses: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Analyses in spine order with their distinct artifacts sorted; artifacts(book_id, spine_index, artifact)."""
    named = artifacts.groupBy("book_id", "spine_index").agg(F.array_sort(F.collect_set("artifact")).alias("artifacts"))
    return analyses.join(named, ["book_id", "spine_index"], "left").orderBy("book_id", "spine_index")
