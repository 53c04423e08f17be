"""Join of texts whose sets of word n-grams have a Jaccard similarity of 0.8 or more: T-occurrence search with DivideSkip.

Texts of equal sets are one from the start. What cannot have a partner goes next, by an exact bound: in the order of
their hashes, the first fifth and a twentieth of a text's shingles must hold a certain number that another text's first
ones hold too. The shingles of what is left are put in order of frequency, and texts that share one of their rarest
ones - one in five, as many as two similar texts can differ by - are tied. The connected groups of these ties hold all
similar pairs, and are dealt to tasks of bounded size; a group beyond that size is dealt as pairs of blocks.

In a task every text in turn asks for those before it (in order of size) that share at least T shingles with it: its
short inverted lists are merged and counted, its long ones probed by binary search for the candidates that
the short ones leave. Long ones are counted too where that is less work than probing.

Links between different texts are all found and counted; groups of linked texts follow as connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from starling.llm.batches import stored
from starling.llm.components import components
from starling.operators.membership import maybe_in
from starling.session import settled

WORDS = 5
#: Shingles that one task looks through at a time.
TASK_SHINGLES = 1_500_000
#: A probe of a list costs as much as merging so many of its entries.
PROBE_COST = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what parts words.
BLANKS = r"[\x20\x09-\x0D]+"


def shingles(text: Column, size: int = WORDS) -> Column:
    """The distinct runs of ``size`` words as hashes in order; all words as one if there are fewer; none for NULL."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BLANKS), lambda w: w != "")
    return F.transform(F.array(words), lambda w: F.sort_array(F.array_distinct(
        F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(
            F.array_join(F.slice(w, i, size), " "))))
        .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(F.array().cast("array<bigint>")))))[0]


# ---------------------------------------------------------------- the search in one task

@dataclass
class Lists:
    """Inverted lists over some texts, which are numbered in order of size: one after another, each in order."""
    sizes: np.ndarray
    starts: np.ndarray
    postings: np.ndarray

    def __post_init__(self):
        self.length = np.diff(self.starts)
        self.places = np.repeat(np.arange(len(self.length)), self.length) * len(self.sizes) + self.postings

    def merged(self, shingles: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The texts from number ``low`` to before ``high`` that the lists of ``shingles`` hold, and in how many of them
        each stands. The lists, each in order, are merged run by run; nothing but their entries is touched."""
        first = np.searchsorted(self.places, shingles * len(self.sizes) + low)
        size = np.searchsorted(self.places, shingles * len(self.sizes) + high) - first
        index = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        found = np.sort(self.postings[index], kind="stable")
        start = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, int)
        return found[start], np.diff(np.r_[start, len(found)])

    def probed(self, shingles: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """How many of the lists of ``shingles`` hold each of ``texts``, by binary search."""
        wanted = shingles[:, None] * len(self.sizes) + texts
        at = np.searchsorted(self.places, wanted)
        return (self.places[np.minimum(at, len(self.places) - 1)] == wanted).sum(0)


def needed(n: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """The least overlap of sets of n and m elements with 100 * overlap >= 80 * union."""
    return -(-4 * (n + m) // 9)


def partners(lists: Lists, own: np.ndarray, size: int, low: int, high: int) -> np.ndarray:
    """The texts from number ``low`` to before ``high`` that share enough of the shingles ``own`` of a set of
    ``size``. ``low`` is the first whose size allows it, so no text asks for a lower overlap."""
    if low >= high or not len(own):
        return np.zeros(0, int)
    least = int(needed(np.int64(size), int(lists.sizes[low])))
    if len(own) < least:
        return np.zeros(0, int)
    own = own[np.argsort(lists.length[own], kind="stable")]
    n_long = least - 1
    short, long = own[:len(own) - n_long], own[len(own) - n_long:]
    texts, count = lists.merged(short, low, high)
    enough = count >= least - n_long
    texts, count = texts[enough], count[enough]
    if not len(texts):
        return texts
    if len(texts) * n_long * PROBE_COST < lists.length[long].sum():
        count = count + lists.probed(long, texts)
    else:                                                   # so many candidates that probing costs more than merging
        more, held = lists.merged(long, low, high)
        if len(more):
            at = np.minimum(np.searchsorted(more, texts), len(more) - 1)
            count = count + np.where(more[at] == texts, held[at], 0)
    return texts[count >= needed(lists.sizes[texts], size)]


def links_among(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None
                ) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """How many links each text has, and of the links a forest that connects all that are linked. With ``side``, only
    links between texts of side 0 and side 1 are looked for."""
    order = np.lexsort((ids, sizes))
    sizes, sets = sizes[order].astype(np.int64), [sets[i] for i in order]
    side = None if side is None else side[order]
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    codes, _ = pd.factorize(flat)
    own = np.split(codes, np.cumsum([len(x) for x in sets])[:-1])
    listed = np.ones(len(flat), bool) if side is None else side[row] == 0
    by = np.argsort(codes[listed], kind="stable")
    n_codes = int(codes.max(initial=-1)) + 1
    lists = Lists(sizes, np.concatenate(([0], np.cumsum(np.bincount(codes[listed], minlength=n_codes)))),
                  row[listed][by])
    count, root, forest = np.zeros(len(sets), np.int64), list(range(len(sets))), []

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(sets)):
        low = int(np.searchsorted(sizes, -(-4 * sizes[i] // 5)))
        if side is None:
            found = partners(lists, own[i], int(sizes[i]), low, i)
        elif side[i] == 1:
            high = int(np.searchsorted(sizes, 5 * sizes[i] // 4, side="right"))
            found = partners(lists, own[i], int(sizes[i]), low, high)
        else:
            continue
        count[i] += len(found)
        count[found] += 1
        for j in found.tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                forest.append((int(ids[order[i]]), int(ids[order[j]])))
    out = np.empty_like(count)
    out[order] = count
    return out, forest


# ---------------------------------------------------------------- who can have a partner

def _pairable(rows: DataFrame) -> DataFrame:
    """``n``, ``h1``, ``h2`` of the sets that enough of their first shingles could tie to another set. A shingle that
    only copies of one set hold ties it to nothing."""
    # Dealt by shingle once: both sides of the join read the same shuffle, so each must use all of its columns, though
    # the conditions on them hold for every row.
    each = (rows.where("id IS NOT NULL AND h1 IS NOT NULL").select("id", "h1", F.explode("first").alias("t"))
            .repartition("t"))
    shared = (each.groupBy("t").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.min("id").alias("least"))
              .where("low < high"))
    held = (each.join(shared.hint("merge"), "t").where(F.col("h1").between(F.col("low"), F.col("high")))
            .where("id >= least")
            .groupBy("id").agg(F.count(F.lit(1)).alias("c")))
    required = F.floor(F.floor((F.col("n") * 4 + 4) / 5) / 20) + 1
    return (rows.select("id", "n", "h1", "h2").join(held, "id").where(F.col("c") >= required)
            .select("n", "h1", "h2").distinct())


def _by_frequency(sets: DataFrame) -> DataFrame:
    """``rep``, ``n`` and ``shared``: the shingles that other texts hold too, rarest first. Texts that share fewer than
    any partner would have to are left out."""
    # One shuffle for both sides of the join, as above.
    rows = sets.where("rep IS NOT NULL").select("rep", F.explode("sh").alias("t")).repartition("t")
    df = rows.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.min("rep").alias("least")).where("df > 1")
    return (rows.join(df.hint("merge"), "t").where("rep >= least").groupBy("rep")
            .agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s"))
            .join(sets.select("rep", "n"), "rep")
            .select("rep", "n", F.col("s.t").alias("shared")).where(F.size("shared") * 5 >= F.col("n") * 4))


def _ties(sets: DataFrame) -> DataFrame:
    """Of the texts that hold a rare shingle, each with the smallest."""
    rare = F.floor(F.col("n") / 5) + 1 - (F.col("n") - F.size("shared"))
    rows = (sets.where(rare > 0).select("rep", F.explode(F.slice("shared", F.lit(1), rare.cast("int"))).alias("t")))
    hub = rows.groupBy("t").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return rows.join(hub, "t").where("rep > hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))


def _found(sets: DataFrame, task_shingles: int) -> DataFrame:
    """Rows of (rep, NULL, links of rep) and (rep, other, 0) for links that connect."""
    groups = components(_ties(sets))
    tied = groups.select("node", "component").unionByName(
        groups.select(F.col("component").alias("node"), "component").distinct())
    members = settled(sets.join(tied, F.col("rep") == F.col("node")).select("rep", "n", "shared", "component"))
    size = members.groupBy("component").agg(F.sum(F.size("shared")).alias("weight"))
    total = members.agg(F.sum(F.size("shared"))).first()[0] or 0
    buckets = max(1, -(-2 * total // task_shingles))
    blocks = F.ceil(F.col("weight") / task_shingles)
    rows = members.join(size, "component").withColumns({
        "blocks": blocks, "block": F.pmod(F.xxhash64("rep"), blocks)})
    small = rows.where("blocks <= 1").select(
        F.lit(-1).cast("bigint").alias("group"), F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("i"),
        F.lit(0).cast("bigint").alias("j"), F.lit(0).alias("side"), "rep", "n", "shared")
    # A group beyond a task's size: every block with itself and with every other.
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    large = (rows.where("blocks > 1").withColumn("other", other)
             .select(F.col("component").alias("group"), F.least("block", "other").alias("i"),
                     F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"),
                     "rep", "n", "shared"))

    def look(rows: pd.DataFrame) -> pd.DataFrame:
        group, i, j = rows["group"].iloc[0], rows["i"].iloc[0], rows["j"].iloc[0]
        ids = rows["rep"].to_numpy(np.int64)
        side = rows["side"].to_numpy() if group != -1 and i != j else None
        count, forest = links_among(ids, rows["n"].to_numpy(), list(rows["shared"]), side)
        a = np.concatenate([ids[count > 0], np.array([x for x, _ in forest], np.int64)])
        b = pd.array([None] * int((count > 0).sum()) + [y for _, y in forest], dtype="Int64")
        return pd.DataFrame({"rep": a, "other": b, "links": np.concatenate(
            [count[count > 0], np.zeros(len(forest), np.int64)])})

    return settled(small.unionByName(large).repartition("group", "i", "j").groupBy("group", "i", "j")
                   .applyInPandas(look, "rep bigint, other bigint, links bigint"))


def link(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS,
         task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """Per row: key, ``n_shingles``, ``component_id`` (the smallest key it is linked to, over links of links, its own
    included), ``n_links`` (other texts, different in their shingles, that it is linked to) and ``n_copies`` (rows
    of equal shingles, its own included).

    NULL and empty texts have no shingle and are linked with nothing, as are rows with a NULL key, whose component is
    NULL. Rows that share a key are taken as one document and so are linked with each other. Repeated rows come
    out as often as they went in.
    """
    first = F.slice("sh", F.lit(1), (F.floor(F.col("n") / 5) + F.floor(F.col("n") / 20) + 1).cast("int"))
    rows = stored(
        df.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("th"), shingles(F.col(text), size).alias("sh"))
        .withColumn("n", F.size("sh").cast("bigint"))
        .select("id", "th", "n", F.xxhash64("sh").alias("h1"), F.xxhash64(F.lit(1), "sh").alias("h2"),
                first.alias("first")), "shingles")
    linked = rows.where("n > 0 AND id IS NOT NULL")
    reps = settled(linked.groupBy("n", "h1", "h2").agg(
        F.min("id").alias("rep"), F.min_by("th", "id").alias("th"), F.count(F.lit(1)).alias("n_copies")))
    wanted = settled(reps.join(_pairable(linked), ["n", "h1", "h2"], "left_semi").select("rep", "th", "n"))
    own = df.select(F.col(key).cast("bigint").alias("rep"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    sets = (maybe_in(own, wanted, "rep", "th").join(wanted, ["rep", "th"]).dropDuplicates(["rep", "th"])
            .select("rep", "n", shingles(F.col("text"), size).alias("sh")))
    found = _found(stored(_by_frequency(stored(sets, "sets")), "by-frequency"), task_shingles)
    groups = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = found.where("links > 0").groupBy("rep").agg(F.sum("links").alias("n_links"))
    about = (reps.select("n", "h1", "h2", "rep", "n_copies")
             .join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left"))
    copied = rows.select("id", "n", "h1", "h2").join(about, ["n", "h1", "h2"], "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    return copied.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.coalesce("component", "rep")).alias("component_id"),
        F.when(alone, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"),
        F.when(alone, 1).otherwise(F.col("n_copies")).cast("bigint").alias("n_copies"))
