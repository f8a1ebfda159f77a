"""MinHash near-dedup: bottom-k sketches of word shingles from one hash function.

Retained values have inverted lists; documents of one list are candidates, the
sketch of the union estimates their similarity, and full shingle sets confirm it.

Input: rows with an id and a text.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in
lower case.  A text with fewer words than a shingle is one shingle; null, empty
and blank texts have none and link with nothing.  Rows with a null id cannot be
named: the result leaves them out and ``one_of_each`` keeps them.  Rows that
repeat an id are one vertex.  Extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import components, empty_text, forget, grouped, join_hot, lower_bytes, shingles, stored, word_places
from lectern.llm.common import words_of  # noqa: F401  (named here too)

SKETCH = 64  # values kept per document
KEYS = 16  # of these, values with an inverted list; two documents at 0.85 share none once in 1e13
COLD = 64  # an inverted list of more distinct texts is hot
SOME = 3  # one in so many values is counted first
OWN_BITS = 40  # of 63, by which values are counted
BLOCK = 256  # documents of a hot list that are compared with another such block at once
BROADCAST_IDS = 2_000_000  # ids (8 bytes each) that may be sent to every executor


def shingle_set(text: str, words: int) -> np.ndarray:
    return shingle_sets([text], words)[0]


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The ascending distinct shingles of each text; hashed for many texts at once."""
    out = []
    texts = list(texts)
    for some in grouped(texts):
        hashes = [h for h, _, _ in word_places([lower_bytes(texts[i]) for i in some])]
        long = [len(h) >= words for h in hashes]
        joined = shingles(np.concatenate(hashes), words) if any(long) else None
        at = 0
        for own, enough in zip(hashes, long, strict=True):
            found = joined[at : at + len(own) - words + 1] if enough else shingles(own, words)
            out.append(np.unique(found >> np.uint64(1)))
            at += len(own)
    return out


def sketches(docs: DataFrame, words: int, size: int = SKETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), fp (fingerprint of the whole set), sketch (its smallest values, ascending)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"], words)
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "n": [len(s) for s in sets],
                    "fp": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                    "sketch": [s[:size].astype(np.int64) for s in sets],
                }
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), empty_text(text_col).alias("text")).where("id is not null")
    return rows.mapInPandas(run, "id long, n long, fp binary, sketch array<long>")


def prefix_of(percent: int) -> Column:
    return F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1


def inverted(classes: DataFrame, percent: int, keys: int = KEYS) -> DataFrame:
    """(v, rep, n): the smallest values of each class.

    Sets that reach the similarity share one of the n - ceil(percent * n / 100) + 1
    smallest values for certain; up to ``keys`` of them are listed.
    """
    return classes.select(
        F.explode(F.slice("sketch", F.lit(1), F.least(prefix_of(percent), F.lit(keys)).cast("int"))).alias("v"), "rep", "n"
    )


def _near_size(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def estimated(pairs: DataFrame, classes: DataFrame, percent: int, size: int = SKETCH) -> DataFrame:
    """Pairs (a, b) whose union sketch does not rule the similarity out at five standard errors.

    Values are compared by the upper 31 of 63 bits, half of what would be shuffled else.
    """
    upper = F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int"))
    side = lambda x: classes.select(F.col("rep").alias(x), upper.alias(f"s{x}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, size)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    t = percent / 100
    slack = F.when(F.size(union) < size, F.lit(1e-9)).otherwise(F.lit(5 * math.sqrt(t * (1 - t) / size)))
    return both.where(common >= F.size(union) * (F.lit(t) - slack)).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) that reach the similarity on their full sets."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(ident, text):
            if ident in recent:
                recent.move_to_end(ident)
                return recent[ident]
            recent[ident] = found = shingle_set(text, words)
            if len(recent) > 64:
                recent.popitem(last=False)
            return found

        for batch in batches:
            keep = []
            for a, b, x, y in batch[["a", "b", "ta", "tb"]].itertuples(index=False):
                p, q = of(a, x), of(b, y)
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    return both.select("a", "b", "ta", "tb").mapInPandas(check, "a long, b long")


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored (id, text) of the named documents; the ids are broadcast only while few."""
    ids = stored(ids.distinct(), "wanted-ids")
    small = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.col(id_col).cast("long").alias("id"), empty_text(text_col).alias("text"))
    found = rows.join(F.broadcast(ids) if small else ids, "id", "left_semi")
    found = stored(found, "wanted-texts")
    if found.count() > ids.count():  # a repeated id counts with one of its rows
        rows, found = found, stored(found.groupBy("id").agg(F.min("text").alias("text")), "wanted-texts")
        forget(rows)
    forget(ids)
    return found


def links(pairs: DataFrame, classes: DataFrame, fetch: Callable, words: int, percent: int) -> DataFrame:
    near = stored(estimated(pairs, classes, percent), "estimated")
    texts = fetch(near.select(F.explode(F.array("a", "b")).alias("id")))
    found = stored(confirmed(near, texts, words, percent), "links")
    forget(near)
    return found


def own_values(texts: DataFrame, words: int, one_in: int = 1) -> DataFrame:
    """(rep, own): how many shingles of each full set occur in no other of these sets.

    With ``one_in``, only that part of all values is counted, the same values in
    every set: never more than a set has of its own.  Values travel as their upper
    ``OWN_BITS`` bits; where two agree in those, both count as shared, which again
    is never more.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                sets = shingle_sets(part["text"], words)
                sets = [s[s % np.uint64(one_in) == 0] for s in sets] if one_in > 1 else sets
                values = (np.concatenate(sets) >> np.uint64(63 - OWN_BITS)).astype(np.int64)
                yield pd.DataFrame({"v": values, "rep": np.repeat(part["id"].to_numpy(), [len(s) for s in sets])})

    values = texts.mapInPandas(run, "v long, rep long")
    return (
        values.groupBy("v").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).where("c = 1")
        .groupBy("rep").agg(F.count("*").alias("own"))
    )


def _with_own(classes: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The classes with the number of values of their own, where it does not exclude every link."""
    rows = classes.join(own, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return rows.where((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent)


def _possible(percent: int, na: str, nb: str, oa: str, ob: str) -> Column:
    """Whether two sets with so many values of their own can reach the similarity: those values are not shared."""
    most = F.least(F.col(na) - F.col(oa), F.col(nb) - F.col(ob))
    return most * (100 + percent) >= (F.col(na) + F.col(nb)) * percent


def leader_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each member of a list with the list's smallest id: one pair per member, whatever the list's length."""
    pairs = lists.where(F.col("leader") != F.col("rep")).where(_near_size("n", "leader_n", percent))
    return pairs.select(F.col("leader").alias("a"), F.col("rep").alias("b"))


def hub_pairs(hot: DataFrame, percent: int) -> DataFrame:
    """Each member of a hot list with the member that has the least of its own: the text the others were made from."""
    rank = F.struct((F.col("own") / F.col("n")).alias("share"), F.col("rep").alias("rep"), F.col("n").alias("n"), F.col("own").alias("own"))
    hubs = hot.groupBy("v").agg(F.min(rank).alias("hub"), F.count("*").alias("m"))
    hubs = stored(hubs.select("v", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.own").alias("hub_own"), "m"), "hubs")
    total = hubs.agg(F.coalesce(F.sum("m"), F.lit(1))).first()[0]
    pairs = join_hot(hot, hubs, "v", "m", total).where(F.col("hub") != F.col("rep"))
    pairs = pairs.where(_possible(percent, "n", "hub_n", "own", "hub_own"))
    return pairs.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))


def cold_pairs(open_lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of still unconnected members within lists of at most COLD members."""
    cold = open_lists.where(F.col("members") <= COLD)
    left = cold.select("v", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
    right = cold.select("v", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    pairs = left.join(right.hint("merge"), "v").where("a < b and ca <> cb").where(_near_size("na", "nb", percent))
    return pairs.select("a", "b")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections of a block of sets with another, by products of incidence tables ``width`` values wide."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    places = [[np.searchsorted(shared, np.intersect1d(s, shared, assume_unique=True)) for s in side] for side in (left, right)]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(shared), width):
        tables = []
        for side in places:
            table = np.zeros((len(side), width), np.float32)
            for i, own in enumerate(side):
                table[i, own[np.searchsorted(own, at) : np.searchsorted(own, at + width)] - at] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def hot_links(hot: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members of hot lists that are still unconnected, found block by block on full sets.

    hot(v, rep, n, own, c).  In each list the members outside its largest
    component are the queries, in blocks, against all members, in blocks.
    """
    sizes = hot.groupBy("v", "c").agg(F.count("*").alias("m"))
    sizes = sizes.groupBy("v").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts"), F.sum("m").alias("all"), F.max("m").alias("most"))
    sizes = stored(sizes.where("parts > 1"), "open-hot-lists")
    total = sizes.agg(F.coalesce(F.sum("all"), F.lit(1))).first()[0]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rep": batch["id"], "set": [s.astype(np.int64) for s in shingle_sets(batch["text"], words)]})

    rows = (
        join_hot(hot, sizes, "v", "all", total)
        .withColumn("blocks", F.ceil(F.col("all") / BLOCK).cast("int"))
        .withColumn("asks", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"))
    )
    rows = stored(rows.join(texts.mapInPandas(gather, "rep long, set array<long>").hint("merge"), "rep"), "hot-members")
    fields = ["v", "rep", "n", "own", "c", "set"]
    every = rows.select(
        *fields, F.lit(False).alias("asked"),
        F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("x"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("y"),
    )
    asking = rows.where("c <> main").select(
        *fields, F.lit(True).alias("asked"),
        F.pmod(F.xxhash64("rep", F.lit(1)), F.col("asks")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"),
    )

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["asked"]], pdf[~pdf["asked"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        na, nb = left["n"].to_numpy(), right["n"].to_numpy()
        least = np.minimum.outer(na - left["own"].to_numpy(), nb - right["own"].to_numpy())
        total = np.add.outer(na, nb)
        apart = np.not_equal.outer(left["c"].to_numpy(), right["c"].to_numpy()) & (least * (100 + percent) >= total * percent)
        # Only rows and columns with a possible partner take part.
        rows, columns = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
        if not len(rows):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        same = _overlaps([left["set"].iloc[i] for i in rows], [right["set"].iloc[j] for j in columns])
        linked = apart[np.ix_(rows, columns)] & (same * (100 + percent) >= total[np.ix_(rows, columns)] * percent - 0.5)
        i, j = np.nonzero(linked)
        a, b = left["rep"].to_numpy()[rows[i]], right["rep"].to_numpy()[columns[j]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return every.unionByName(asking).groupBy("v", "x", "y").applyInPandas(compare, "a long, b long")


def all_links(lists: DataFrame, classes: DataFrame, fetch: Callable, words: int, percent: int) -> DataFrame:
    """Stored links (a, b) whose components are those of all links among members of a list.

    ``lists``: v, rep, n, members, leader, leader_n, a row per list and member.
    ``fetch``: texts of ids.

    The first round links every member of a short list to its leader, and every
    member of a long list to its hub.  The second compares members that are still
    in different components: all pairs of short lists, blocks of long lists.

    Of the full sets of all classes in long lists the values are counted that no
    other such set has, first one in SOME of them, then all of what is left: a set with too many of its own has no link within a long
    list, and two sets whose rest is too small for the similarity are no pair.  Copies of
    one text with changes of their own, however many, thus need no comparison
    among each other: what is close enough to another copy is close to the hub.
    """
    spark: SparkSession = lists.sparkSession
    fetched = []

    def texts_for(ids: DataFrame) -> DataFrame:
        fetched.append(fetch(ids))
        return fetched[-1]

    heat = lists.where(F.col("members") > COLD).groupBy("rep").agg(F.sort_array(F.collect_list("v")).alias("hots"))
    heat = classes.join(heat, "rep").select("rep", "n", "hots")
    heat = stored(heat, "hot-classes")
    texts = texts_for(heat.select(F.col("rep").alias("id")))
    # What a third of the values rules out needs no count of all; classes without a link take no values from others.
    maybe = stored(_with_own(heat, own_values(texts, words, SOME), percent).select(*heat.columns), "maybe-alive")
    left = texts.join(maybe.select(F.col("rep").alias("id")), "id", "left_semi")
    alive = stored(_with_own(maybe, own_values(left, words), percent), "alive")
    # Each class in all its hot lists: at most KEYS, or one per band.
    hot = stored(alive.select(F.explode("hots").alias("v"), "rep", "n", "own"), "hot-lists")
    cold = lists.where(F.col("members") <= COLD)

    pairs = leader_pairs(cold, percent).unionByName(hub_pairs(hot, percent)).distinct()
    first = links(pairs, classes, texts_for, words, percent)
    found = stored(components(first, spark), "components").withColumnRenamed("id", "rep")
    component = F.coalesce("component", "rep").alias("c")
    named = cold.join(found, "rep", "left").select("v", "rep", "n", "members", component)
    spans = named.groupBy("v").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("v")
    open_lists = stored(named.join(spans, "v", "left_semi"), "open-lists")
    named_hot = stored(hot.join(found, "rep", "left").select("v", "rep", "n", "own", component), "named-hot-lists")
    more = links(cold_pairs(open_lists, percent).distinct(), classes, texts_for, words, percent)
    across = hot_links(named_hot, texts.join(alive.select(F.col("rep").alias("id")), "id", "left_semi"), words, percent)
    both = stored(first.unionByName(more).unionByName(across), "all-links")
    forget(heat, maybe, alive, hot, open_lists, named_hot, first, more, *fetched)
    return both


def near_groups(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept, for every row.

    Equal sets are one class, so thousands of copies are one line of the lists.
    """
    signed = stored(sketches(docs, words, SKETCH, id_col, text_col), "sketches")
    classes = stored(
        signed.where("n > 0").groupBy("fp").agg(
            F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")
        ),
        "classes",
    )
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    keys = inverted(classes, percent)
    heads = keys.groupBy("v").agg(F.min(F.struct("rep", "n")).alias("l"), F.count("*").alias("members")).where("members > 1")
    heads = stored(heads.select("v", F.col("l.rep").alias("leader"), F.col("l.n").alias("leader_n"), "members"), "heads")
    most = heads.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    lists = stored(join_hot(keys, heads, "v", "members", most), "lists")
    forget(heads)
    fetch = lambda ids: texts_of(docs, ids, id_col, text_col)
    found = all_links(lists, classes, fetch, words, percent)
    forget(lists)
    joined = stored(components(found, docs.sparkSession), "components")
    per_class = classes.join(joined, classes["rep"] == joined["id"], "left").select(
        "fp", "copies", F.coalesce("component", "rep").alias("component_id")
    )
    per_class = stored(per_class, "class-components")
    linked = join_hot(signed.where("n > 0").select("id", "n", "fp"), per_class, "fp", "copies", total).select("id", "n", "component_id")
    alone = signed.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    forget(classes, found, joined)
    return linked.unionByName(alone).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        "component_id",
        (F.col("id") == F.col("component_id")).alias("kept"),
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (column doc_id, text) that stay, with all their columns."""
    gone = near_groups(docs, words, percent).where("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
