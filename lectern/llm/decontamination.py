"""Benchmark decontamination by templates: numbers, names and units become typed slots, windows are hash-joined.

A document holds an item when enough of the item's windows occur in it with
consistent slots: along one alignment, equal values of the item stand for equal
values in the document.  Equal values are a plain copy; other values are the
same question with new parameters.  Where equal values of the item stand for
different ones, only windows that are plain copies count.

Input: documents and benchmark items with an id and a text.  Null, empty and
blank texts have no words and match nothing; an item of fewer words than a window
is one window of its own length.  Rows with a null id cannot be named and are not
reported.  Repeated rows and ties change nothing, since windows count by their
place in the item.  Extra columns are not read; an empty table on either side
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import empty_text, stored

WINDOW = 5
LEAST_SHARE = 0.4  # of an item's windows
STRETCH = 1024  # window starts that share a row
BROADCAST_WINDOWS = 500_000  # windows of the benchmark (about 100 bytes each) that may be sent to every executor

# Units that may follow a number.
UNITS = (
    "kg g mg t lb lbs oz km m cm mm mi ft in yd l ml cl s sec min h hr hrs hour hours minute minutes second seconds "
    "day days week weeks month months year years km/h mph kmh w kw mw kwh v a hz khz mhz ghz kb mb gb tb "
    "usd eur gbp dollar dollars euro euros cent cents percent degrees"
).split()

NUMBER, UNIT, NAME = "\u0001", "\u0002", "\u0003"


def marked_words(text: Column) -> Column:
    """Lower-case words without punctuation; a slot's word begins with the mark of its type and goes on with its value.

    A name is a capitalised word that no sentence begins with (words all in
    capitals are not); a unit follows a number.
    """
    t = F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F]", "")
    t = F.regexp_replace(t, r"([^.!?\s]\s)(?=\p{Lu}\p{Ll})", f"$1{NAME}")
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    numbers = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}]){NAME}?(\d[\d.,]*)", f"{NUMBER}$1")
    numbers = F.regexp_replace(numbers, rf"(?i)({NUMBER}[\d.,]*)(%)", f"$1 {UNIT}percent")
    numbers = F.regexp_replace(numbers, rf"(?i)({NUMBER}[\d.,]*)\s*{NAME}?({units})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    t = F.when(text.rlike("[0-9]"), numbers).otherwise(t)
    t = F.regexp_replace(F.lower(t), rf"[^\p{{L}}\p{{N}}\p{{M}}{NUMBER}-{NAME}\s]+", "")
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def word_hashes(words: Column) -> Column:
    """Hash of each word, and of a slot's type without its value."""
    return F.transform(words, lambda w: F.xxhash64(F.when(w < " ", F.substring(w, 1, 1)).otherwise(w)))


def window_hashes(hashes: Column, length: int) -> Column:
    """Hash of every run of ``length`` words."""
    starts = F.when(F.size(hashes) >= length, F.sequence(F.lit(1), F.size(hashes) - (length - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + (j - 1)) for j in range(length)]))


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Stored (item_id, len, windows, ipos, h, ivals): all windows of all items."""
    words = items.select(F.col(id_col).alias("item_id"), marked_words(empty_text(text_col)).alias("w"))
    words = stored(words.where("item_id is not null and size(w) > 0").withColumn("len", F.least(F.size("w"), F.lit(window))), "items")
    parts = []
    for length in range(1, window + 1):
        some = words.where(F.col("len") == length).withColumn("hs", word_hashes(F.col("w")))
        some = some.select("item_id", "len", "w", F.posexplode(window_hashes(F.col("hs"), length)).alias("ipos", "h"))
        parts.append(some.select("item_id", "len", "ipos", "h", F.slice("w", F.col("ipos") + 1, length).alias("ivals")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    sizes = words.groupBy("item_id").agg(F.sum(F.size("w") - F.col("len") + 1).alias("windows"))
    return stored(rows.join(sizes, "item_id"), "item-windows")


def matched_windows(docs: DataFrame, windows: DataFrame, lengths: list[int], small: bool, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, item_id, windows, ipos, shift, ivals, dvals): every window of every document that is one of an item's."""
    rows = docs.select(F.col(id_col).alias("doc_id"), marked_words(empty_text(text_col)).alias("w")).where("doc_id is not null")
    found = None
    for length in lengths:
        side = windows.where(F.col("len") == length).drop("len")
        # A window takes the words of its stretch along, so a long text costs no more than many short ones.
        starts = F.when(F.size("w") >= length, F.sequence(F.lit(0), F.size("w") - length, F.lit(STRETCH))).otherwise(
            F.array().cast("array<int>")
        )
        cut = F.transform(starts, lambda s: F.struct(s.alias("first"), F.slice("w", s + 1, STRETCH + length - 1).alias("w")))
        stretches = rows.select("doc_id", F.explode(cut).alias("c")).select("doc_id", "c.first", "c.w")
        # The hashes are a column of their own: inside the windows they would be made anew for every word.
        hashed = stretches.withColumn("hs", word_hashes(F.col("w")))
        seen = hashed.select("doc_id", "first", "w", F.posexplode(window_hashes(F.col("hs"), length)).alias("pos", "h"))
        if small:
            # The words ride along unread; only a match copies its window.
            joined = seen.join(F.broadcast(side), "h")
            values = F.slice("w", F.col("pos") + 1, length)
        else:
            seen = seen.select("doc_id", "first", "pos", "h", F.slice("w", F.col("pos") + 1, length).alias("dw"))
            joined, values = seen.join(side, "h"), F.col("dw")
        shift = F.col("first") + F.col("pos") - F.col("ipos")
        part = joined.select("doc_id", "item_id", "windows", "ipos", shift.alias("shift"), "ivals", values.alias("dvals"))
        found = part if found is None else found.unionByName(part)
    return found


def contaminated(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, least_share: float = LEAST_SHARE,
    doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows, share, new_values): every document that holds an item.

    The items are the side of known size: their windows are counted, and sent to
    every task while few, else both sides are shuffled by window hash.  Only
    matches are grouped: by document, item and shift.
    """
    windows = item_windows(items, window, item_id, item_text)
    counted = windows.groupBy("len").agg(F.count("*").alias("n")).collect()  # at most ``window`` rows
    lengths = sorted(r["len"] for r in counted) or [window]
    small = sum(r["n"] for r in counted) <= BROADCAST_WINDOWS
    matches = matched_windows(docs, windows, lengths, small, doc_id, doc_text)
    pairs = F.filter(F.arrays_zip("ivals", "dvals"), lambda p: p["ivals"] < " ")
    # A window of little but slots fits anything: it counts only as a plain copy.
    literal = F.size("ivals") - F.size("slots")
    matches = matches.withColumn("slots", pairs)
    matches = matches.where((literal >= F.least(F.size("ivals"), F.lit(2))) | (F.col("ivals") == F.col("dvals")))
    along = matches.groupBy("doc_id", "item_id", "windows", "shift").agg(
        F.collect_set("ipos").alias("at"),
        F.collect_set(F.when(F.col("ivals") == F.col("dvals"), F.col("ipos"))).alias("same"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    values = F.size(F.array_distinct(F.transform("slots", lambda p: p["ivals"])))
    # Where a slot stands for two values, only windows that are plain copies count.
    steady = values == F.size("slots")
    along = along.withColumn("new", steady & F.exists("slots", lambda p: p["ivals"] != p["dvals"]))
    whole = along.select("doc_id", "item_id", "windows", "new", F.explode(F.when(steady, F.col("at")).otherwise(F.col("same"))).alias("ipos"))
    return (
        whole.groupBy("doc_id", "item_id", "windows")
        .agg(F.countDistinct("ipos").alias("matched_windows"), F.max("new").alias("new_values"))
        .where(F.col("matched_windows") >= F.col("windows") * F.lit(least_share))
        .select(
            "doc_id",
            "item_id",
            "matched_windows",
            F.col("windows").alias("item_windows"),
            (F.col("matched_windows") / F.col("windows")).alias("share"),
            "new_values",
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that hold no item, with all their columns."""
    gone = contaminated(docs, items).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
