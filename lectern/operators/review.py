"""Editorial versions, metrics and package evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.numbers import basis_points
from lectern.operators.prefix import numbered, with_previous
from lectern.rules import blank
from lectern.session import durable

METRICS = ("parse_quality", "source_ref_validity", "chapter_coverage", "claim_grounding", "concept_grounding")
# Metrics that may be waived, dimensions of a semantic review.
WAIVABLE = ("claim_grounding", "concept_grounding")
SEMANTIC_DIMENSIONS = ("citation_support", "key_point_coverage", "spoiler_boundary")
DIFF_LIMIT = 500


def version_history(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Package value as revision 0, then edits in order; the newest is marked.

    base(kind, id, value), edits(kind, id, seq, analyzer, value).
    """
    counts = edits.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(edits, ["kind", "id"], "seq", "_at").withColumn("revision", F.col("_at") + 1)
    edited = placed.join(counts, ["kind", "id"]).select(
        "kind", "id", "revision", F.concat(F.lit("v"), F.col("revision").cast("string")).alias("version_id"), "analyzer", "value",
        (F.col("revision") == F.col("_n")).alias("is_latest"),
    )
    touched = edits.select("kind", "id").distinct().withColumn("_edited", F.lit(True))
    zero = base.join(touched, ["kind", "id"], "left").select(
        "kind",
        "id",
        F.lit(0).cast("long").alias("revision"),
        F.lit("base").alias("version_id"),
        F.lit("package").alias("analyzer"),
        "value",
        F.col("_edited").isNull().alias("is_latest"),
    )
    return zero.unionByName(edited.join(base.select("kind", "id"), ["kind", "id"], "left_semi"))


def effective_documents(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Base rows with the latest edit in place; edits of unknown documents are ignored."""
    latest = edits.groupBy("kind", "id").agg(F.max_by("value", "seq").alias("_value"), F.count(F.lit(1)).alias("_n"))
    return base.join(latest, ["kind", "id"], "left").select(
        "kind",
        "id",
        F.coalesce("_value", "value").alias("value"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("revision"),
    )


def apply_edits(edits: DataFrame, blocks: DataFrame, declared: DataFrame, issues: DataFrame) -> DataFrame:
    """Accept an edit of a chapter, concept or claim only if the whole package is valid with it.

    edits(edit_id, kind, book_id, id, importance, grounding, refs array<ref>),
    declared(book_id, kind, id), issues(book_id, kind, id): what the present
    package violates, a row per finding.  An edit replaces one document, so what
    counts is the findings of all other documents of its book and those of the
    new one: an edit can be refused for the sake of another document, and one that
    mends the last fault is accepted.
    """
    from lectern.operators.grounding import resolve_refs
    from lectern.rules import violations

    cited = edits.select("book_id", "edit_id", F.explode("refs").alias("r")).select(
        "book_id", "edit_id", "r.*", F.lit(None).cast("long").alias("max_chapter")
    )
    bad = resolve_refs(cited, blocks).where("size(codes) > 0").groupBy("edit_id").agg(
        F.count(F.lit(1)).alias("_bad")
    )
    document = ["book_id", "kind", "id"]
    known = declared.select(*document, F.lit(True).alias("_known")).distinct()
    own = issues.groupBy(*document).agg(F.count(F.lit(1)).alias("_own"))
    whole = own.groupBy("book_id").agg(F.sum("_own").alias("_all"))
    zero = F.lit(0)
    rules = [
        (F.col("_known").isNull(), "unknown_document"),
        (F.col("importance") > 100, "score_out_of_range"),
        ((F.col("grounding") == "grounded") & (F.size("refs") == 0), "grounded_without_refs"),
        ((F.col("kind") == "claim") & ((F.col("grounding") != "grounded") | (F.size("refs") == 0)), "claim_not_grounded"),
        (F.col("_bad") > 0, "violates_grounding"),
        (F.coalesce("_all", zero) > F.coalesce("_own", zero), "package_invalid"),
    ]
    return (
        edits.join(known, document, "left")
        .join(bad, "edit_id", "left")
        .join(own, document, "left")
        .join(whole, "book_id", "left")
        .withColumn("rejected", F.array_join(violations(rules), ","))
        .withColumn("accepted", F.col("rejected") == "")
        .drop("_known", "_bad", "_own", "_all")
    )


def _kind(v: Column) -> Column:
    """Kind of a JSON value; a missing value is null, and whole numbers are apart from fractions."""
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    whole = (name == "DECIMAL") & F.schema_of_variant(v).endswith(",0)") & (F.length(F.to_json(v)) > 18)
    return (
        F.when(v.isNull() | name.isin("VOID", ""), "null")
        .when(name.isin("DOUBLE", "FLOAT", "DECIMAL") & ~whole, "fraction")
        .when(whole, "whole")
        .when(name.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "whole")
        .otherwise(F.lower(name))
    )


def _shown(v: Column, kind: Column) -> Column:
    text = F.to_json(v)
    return F.when(kind == "null", "null").when((kind == "fraction") & text.rlike("^-?[0-9]+$"), F.concat(text, F.lit(".0"))).otherwise(text)


def json_diff(pairs: DataFrame, key: str, limit: int = DIFF_LIMIT) -> DataFrame:
    """Leaf differences of two JSON documents, in document order, at most ``limit`` per pair.

    pairs(key, left_json, right_json).  Both documents are opened one level at a
    time, all pairs together: objects over the union of their keys, arrays to the
    longer length.  What is no pair of containers is a leaf; leaves differ in kind
    (1, 1.0 and true are three) or in value, and a missing value equals null.
    """
    rows = pairs.select(
        key,
        F.lit("$").alias("path"),
        F.array().cast("array<string>").alias("place"),
        F.parse_json("left_json").alias("l"),
        F.parse_json("right_json").alias("r"),
    )
    # A scan may open values before the filter on their kind has left others out.
    opened = lambda c, kind: F.try_variant_get(c, "$", kind).alias(c)
    leaves = None
    while True:
        level = durable(rows.withColumn("kl", _kind(F.col("l"))).withColumn("kr", _kind(F.col("r"))))
        objects = (F.col("kl") == "object") & (F.col("kr") == "object")
        arrays = (F.col("kl") == "array") & (F.col("kr") == "array")
        number = (F.col("kl") == "fraction") & (F.col("kr") == "fraction")
        left, right = _shown(F.col("l"), F.col("kl")), _shown(F.col("r"), F.col("kr"))
        equal = (F.col("kl") == F.col("kr")) & F.when(number, left.cast("double") == right.cast("double")).otherwise(left == right)
        found = level.where(~objects & ~arrays & ~equal).select(key, "path", "place", left.alias("left"), right.alias("right"))
        leaves = found if leaves is None else leaves.unionByName(found)
        fields = level.where(objects).select(
            key, "path", "place", opened("l", "map<string,variant>"), opened("r", "map<string,variant>")
        )
        fields = fields.select("*", F.explode(F.array_union(F.map_keys("l"), F.map_keys("r"))).alias("name")).select(
            key,
            F.concat("path", F.lit("."), "name").alias("path"),
            F.array_append("place", F.col("name")).alias("place"),
            F.try_element_at("l", F.col("name")).alias("l"),
            F.try_element_at("r", F.col("name")).alias("r"),
        )
        items = level.where(arrays).select(
            key, "path", "place", opened("l", "array<variant>"), opened("r", "array<variant>")
        )
        longest = F.greatest(F.size("l"), F.size("r"))
        items = items.where(longest > 0).select("*", F.explode(F.sequence(F.lit(0), longest - 1)).alias("at")).select(
            key,
            F.concat("path", F.lit("["), F.col("at").cast("string"), F.lit("]")).alias("path"),
            F.array_append("place", F.lpad(F.col("at").cast("string"), 10, "0")).alias("place"),
            F.get("l", F.col("at")).alias("l"),
            F.get("r", F.col("at")).alias("r"),
        )
        if level.where(objects | arrays).isEmpty():
            break
        rows = fields.unionByName(items)
    order = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    return leaves.withColumn("pos", order.cast("long") - 1).where(F.col("pos") < limit).select(key, "pos", "path", "left", "right")


def eval_metrics(chapters: DataFrame, report: DataFrame, objects: DataFrame, waivers: DataFrame) -> DataFrame:
    """Five ratios per book as rows (book_id, metric, state, value, waiver_error).

    chapters(book_id, title, is_noise, block_count); report is the grounding
    report; objects(book_id, kind, grounded) lists concepts and claims;
    waivers(book_id, metric, reason).
    """
    content = chapters.where(~F.col("is_noise")).groupBy("book_id").agg(
        F.count(F.lit(1)).alias("readable"),
        F.sum(F.when(~blank(F.col("title")) & (F.col("block_count") > 0), 1).otherwise(0)).alias("parsed"),
    )
    counted = objects.groupBy("book_id").agg(
        *[
            F.sum(F.when((F.col("kind") == kind) & cond, 1).otherwise(0)).alias(name)
            for kind, name, cond in (
                ("claim", "claims", F.lit(True)),
                ("claim", "grounded_claims", F.col("grounded")),
                ("concept", "concepts", F.lit(True)),
                ("concept", "grounded_concepts", F.col("grounded")),
            )
        ]
    )
    joined = content.join(
        report.select("book_id", "analyzed_chapter_count", "source_ref_count", "error_count"), "book_id", "left"
    ).join(counted, "book_id", "left")
    zero = F.lit(0).cast("long")
    n = lambda c: F.coalesce(F.col(c), zero)
    pairs = {
        "parse_quality": (n("parsed"), n("readable")),
        "source_ref_validity": (F.greatest(n("source_ref_count") - n("error_count"), zero), n("source_ref_count")),
        "chapter_coverage": (n("analyzed_chapter_count"), n("readable")),
        "claim_grounding": (n("grounded_claims"), n("claims")),
        "concept_grounding": (n("grounded_concepts"), n("concepts")),
    }
    entries = F.array(
        *[F.struct(F.lit(m).alias("metric"), basis_points(a, b).alias("value")) for m, (a, b) in pairs.items()]
    )
    rows = joined.select("book_id", F.explode(entries).alias("e")).select("book_id", "e.metric", "e.value")
    asked = waivers.select("book_id", "metric", "reason", F.lit(True).alias("_asked"))
    missing = F.col("value").isNull()
    may = F.col("metric").isin(*WAIVABLE) & ~blank(F.col("reason"))
    return rows.join(asked, ["book_id", "metric"], "left").select(
        "book_id",
        "metric",
        F.when(missing & F.col("_asked") & may, "not_applicable")
        .when(missing, "missing_required")
        .otherwise("evaluated")
        .alias("state"),
        "value",
        F.when(F.col("_asked") & ~F.col("metric").isin(*WAIVABLE), "not_waivable")
        .when(F.col("_asked") & blank(F.col("reason")), "reason_required")
        .when(F.col("_asked") & ~missing, "existing_output")
        .alias("waiver_error"),
    )


def metric_regressions(history: DataFrame) -> DataFrame:
    """Each metric against the previous run; history(book_id, metric, run, state, value).

    A known value that becomes missing, unknown or lower is a regression.
    """
    worse = (F.col("state") == "missing_required") | F.col("value").isNull() | (F.col("value") < F.col("previous"))
    return with_previous(history, ["book_id", "metric"], "run", "value", "previous").withColumn(
        "regressed", F.col("previous").isNotNull() & worse
    )


def bind_semantic_review(reviews: DataFrame, checks: DataFrame, current: DataFrame) -> DataFrame:
    """Semantic ratio of a bound review, or the reason it is rejected.

    reviews(book_id, reviewer, analysis_fingerprint, annotations_fingerprint),
    current(book_id, analysis_fingerprint, annotations_fingerprint),
    checks(book_id, dimension, expected, observed, passed).
    """
    now = current.select(
        "book_id",
        F.col("analysis_fingerprint").alias("_a"),
        F.col("annotations_fingerprint").alias("_n"),
    )
    per = checks.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("_checks"),
        F.sum(F.when(F.col("passed"), 1).otherwise(0)).alias("_passed"),
        F.max(
            ~F.col("dimension").isin(*SEMANTIC_DIMENSIONS) | blank(F.col("expected")) | blank(F.col("observed"))
        ).alias("_malformed"),
        F.size(F.collect_set(F.when(F.col("dimension").isin(*SEMANTIC_DIMENSIONS), F.col("dimension")))).alias("_dims"),
    )
    joined = reviews.join(now, "book_id", "left").join(per, "book_id", "left")
    rejected = (
        F.when(F.col("_n").isNull(), "no_golden")
        .when(blank(F.col("reviewer")), "missing_reviewer")
        .when(F.col("analysis_fingerprint") != F.col("_a"), "stale_analysis")
        .when(F.col("annotations_fingerprint") != F.col("_n"), "stale_annotations")
        .when(F.coalesce("_malformed", F.lit(True)) | (F.col("_dims") < len(SEMANTIC_DIMENSIONS)), "dimensions")
    )
    return joined.select(
        "book_id",
        rejected.alias("rejected"),
        F.when(rejected.isNull(), basis_points(F.col("_passed"), F.col("_checks"))).alias("semantic_basis_points"),
    )


def evaluate_packages(metrics: DataFrame, report: DataFrame, semantic: DataFrame, previous: DataFrame) -> DataFrame:
    """One verdict per book: valid, beta-ready, numbers of findings, regressions and waiver errors, fingerprint.

    metrics(book_id, metric, state, value, waiver_error), previous(book_id,
    metric, state, value): the run before.  The fingerprint is that of all metric
    states and values, so equal verdicts of two runs can be told from equal runs.
    """
    run = lambda df, n: df.select("book_id", "metric", "state", "value", F.lit(n).cast("long").alias("run"))
    worse = metric_regressions(run(previous, 0).unionByName(run(metrics, 1))).where("run = 1 and regressed")
    worse = worse.groupBy("book_id").agg(F.count(F.lit(1)).alias("_worse"))
    shown = F.concat_ws("=", "metric", F.concat_ws(":", "state", F.coalesce(F.col("value").cast("string"), F.lit("null"))))
    # At most one row per metric and book.
    per = metrics.groupBy("book_id").agg(
        F.max(F.col("state") == "missing_required").alias("_missing"),
        F.sum(
            F.when((F.col("state") == "missing_required") | (F.col("value") < 8000), 1).otherwise(0)
        ).alias("_low"),
        F.count("waiver_error").alias("waiver_errors"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(shown)), ";"), 256).alias("fingerprint"),
    )
    issues = F.col("error_count") + F.when(F.col("low_summary_coverage"), 1).otherwise(0)
    valid = F.col("valid") & ~F.col("_missing")
    return (
        report.join(per, "book_id")
        .join(worse, "book_id", "left")
        .join(semantic.select("book_id", "semantic_basis_points"), "book_id", "left")
        .select(
            "book_id",
            F.col("valid").alias("structural_valid"),
            valid.alias("valid"),
            (valid & F.col("semantic_basis_points").eqNullSafe(F.lit(10_000))).alias("beta_ready"),
            (F.col("_low") + issues).alias("findings"),
            F.coalesce("_worse", F.lit(0).cast("long")).alias("regressions"),
            "waiver_errors",
            "fingerprint",
        )
    )


def golden_snapshots(goldens: DataFrame, annotations: DataFrame, sources: DataFrame) -> DataFrame:
    """Goldens with their latest annotation; usable only for the same source hash and a label."""
    latest = annotations.groupBy("golden_id").agg(F.max_by("annotation", "seq").alias("_new"))
    now = sources.select("book_id", F.col("source_hash").alias("_hash"))
    return (
        goldens.join(latest, "golden_id", "left")
        .join(now, "book_id", "left")
        .select(
            "golden_id",
            "book_id",
            F.coalesce("_new", "annotation").alias("annotation"),
            F.when(blank(F.col("label")), "blank_label")
            .when(~F.col("source_hash").eqNullSafe(F.col("_hash")), "other_source")
            .alias("error"),
        )
    )


def studio_snapshot(report: DataFrame, history: DataFrame) -> DataFrame:
    """Grounding totals with version counts per kind; history adds book_id."""
    counts = history.where("revision > 0").groupBy("book_id").agg(
        F.count(F.lit(1)).alias("versions"), F.sum(F.when(F.col("is_latest"), 1).otherwise(0)).alias("edited_documents")
    )
    zero = F.lit(0).cast("long")
    return report.join(counts, "book_id", "left").select(
        "book_id",
        "analyzed_chapter_count",
        "source_ref_count",
        "error_count",
        F.coalesce("versions", zero).alias("versions"),
        F.coalesce("edited_documents", zero).alias("edited_documents"),
    )


def book_dashboard(chapters: DataFrame, analyses: DataFrame, concepts: DataFrame, claims: DataFrame) -> DataFrame:
    """Content chapters with block count, whether analysed, and the book's object counts."""
    has = analyses.select("book_id", "spine_index", F.lit(True).alias("_has"))
    n_concepts = concepts.groupBy("book_id").agg(F.count(F.lit(1)).alias("concepts"))
    n_claims = claims.groupBy("book_id").agg(F.count(F.lit(1)).alias("claims"))
    zero = F.lit(0).cast("long")
    return (
        chapters.where(~F.col("is_noise"))
        .join(has, ["book_id", "spine_index"], "left")
        .join(n_concepts, "book_id", "left")
        .join(n_claims, "book_id", "left")
        .select(
            "book_id",
            "spine_index",
            "block_count",
            F.coalesce("_has", F.lit(False)).alias("has_analysis"),
            F.coalesce("concepts", zero).alias("concepts"),
            F.coalesce("claims", zero).alias("claims"),
        )
    )
