"""Near-duplicates by SimHash fingerprints of 64 bits, compared bit-sliced.

A fingerprint's bit is set if more than half of the hashes of a text's three-word shingles, repeats included, have it.
Equal fingerprints are one from the start. Two that differ in at most ``radius`` bits agree in one of radius + 1 parts
of the bits, so each is dealt to one bucket per part; a bucket beyond a task's size is dealt again by the parts
of its remaining bits, and so on, which loses no pair and copies only what is crowded.

In a task a bucket's fingerprints lie as vertical bit planes, 64 to a word. A fingerprint asks the words of its bucket
plane by plane: two carry-save counters per word add up all 64 distances at once, and a mask remembers those beyond
the radius. Words of which all are beyond it are abandoned on the way. Of the pairs found, each task hands on a forest that
connects the same fingerprints, never all pairs; groups follow as connected components.

NULL and empty texts, and those without a word, have fingerprint 0 and are linked like any other; a text of
fewer than three words is one shingle. Rows are linked by their fingerprints alone: rows that repeat or share a key are
each linked by their own, and rows without a key belong to a group whose smallest key they take (NULL if none has one).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from starling.llm.components import components
from starling.session import settled

BITS, RADIUS, WORDS, SEED = 64, 3, 3, 42
#: Fingerprints that one task compares at a time, and from which size on a bucket is dealt again.
TASK_ROWS, BUCKET_ROWS = 200_000, 20_000
#: A bucket that has so many bits left holds 2**16 different fingerprints at most and needs no further dealing.
MOST_LEFT = 16
#: Pairs of a fingerprint and a word of 64 others that are worked on at once, and hashes whose bits are counted at once.
AT_ONCE, HASHES_AT_ONCE = 1 << 19, 1 << 16
#: Planes between two looks at what can be abandoned.
PLANES_AT_ONCE = 6
FULL = np.uint64(2**64 - 1)


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: str | None, size: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number. Lower-casing touches A-Z only, and words are parted by ASCII blanks: both
    are what bytes do by themselves."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(words) - size)
    spans = zip(starts[:last + 1].tolist(), ends[min(size, len(words)) - 1:].tolist())
    hashes = np.array([xxhash.xxh64_intdigest(line[a:b], seed) for a, b in spans], ">u8")
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at:at + HASHES_AT_ONCE]
        count += np.unpackbits(part.view(np.uint8)).reshape(len(part), BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprints(text: Column) -> Column:
    """The fingerprint as a signed number of the same bits."""
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64))
    return F.pandas_udf(of, LongType())(text)


# ---------------------------------------------------------------- the comparison in one task

def planes_of(words: np.ndarray) -> np.ndarray:
    """Bit planes of rows of 64 fingerprints: plane p, word w holds bit p of the fingerprints in row w, the first of them
    in the lowest bit."""
    bits = np.unpackbits(np.ascontiguousarray(words).astype("<u8").view(np.uint8).reshape(len(words), BITS, 8), axis=2,
                         bitorder="little")
    vertical = np.ascontiguousarray(bits.transpose(2, 0, 1))
    return np.packbits(vertical, axis=2, bitorder="little").reshape(BITS, -1).view("<u8")


def near(planes: np.ndarray, asked: np.ndarray, word: np.ndarray, over: np.ndarray, radius: int = RADIUS) -> tuple[
        np.ndarray, np.ndarray]:
    """For pairs of a fingerprint ``asked`` and a ``word`` of 64 others: the places of the pairs in which some are
    within ``radius`` (at most 3), and masks of these. ``over`` masks those that do not count."""
    at = np.arange(len(asked))
    ones, twos = np.zeros(len(asked), np.uint64), np.zeros(len(asked), np.uint64)
    for plane in range(BITS):
        own = np.uint64(0) - ((asked >> np.uint64(plane)) & np.uint64(1))
        differs = planes[plane][word] ^ own
        carry = ones & differs
        ones = ones ^ differs
        over = over | (twos & carry)
        twos = twos ^ carry
        if plane % PLANES_AT_ONCE == PLANES_AT_ONCE - 1 or plane == BITS - 1:
            if radius < 3:
                over = over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones)
            left = over != FULL
            if not left.all():
                at, asked, word, over, ones, twos = (x[left] for x in (at, asked, word, over, ones, twos))
    return at, ~over


class Forest:
    """Groups of numbers that grow by links; keeps the links that joined two groups."""

    def __init__(self, n: int):
        self.root, self.kept = np.arange(n), []

    def _flat(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            one, other = self.root[a], self.root[b]
            apart = one != other
            a, b, one, other = a[apart], b[apart], one[apart], other[apart]
            high, low = np.maximum(one, other), np.minimum(one, other)
            # One link for each root that is to hang from a smaller one; the rest is looked at again.
            _, first = np.unique(high, return_index=True)
            self.root[high[first]] = low[first]
            self.kept += zip(a[first].tolist(), b[first].tolist())
            self._flat()


def forest_of(bucket: np.ndarray, found: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Places of pairs in ``found`` (distinct fingerprints per bucket) that connect all that lie in one ``bucket`` and
    are linked there over links of links. ``bucket`` is in order."""
    n = len(found)
    new = np.r_[True, bucket[1:] != bucket[:-1]] if n else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    size = np.bincount(number) if n else np.zeros(0, int)
    start = np.flatnonzero(new)
    rank = np.arange(n) - start[number]
    n_words = -(-size // 64)
    first_word = np.cumsum(n_words) - n_words
    slot = first_word[number] * 64 + rank
    at_slot = np.full(int(n_words.sum()) * 64, -1)
    at_slot[slot] = np.arange(n)
    values = np.where(at_slot >= 0, found[np.maximum(at_slot, 0)], np.uint64(0)).reshape(-1, 64)
    # Every fingerprint asks its own word and those after it in its bucket; in its own, those after itself.
    own_word = slot // 64
    asks = n_words[number] - rank // 64
    asks[size[number] == 1] = 0
    empty = np.packbits((at_slot < 0).reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
    forest = Forest(n)
    planes = planes_of(values) if n else np.zeros((BITS, 0), np.uint64)
    upto = np.cumsum(asks)
    at = 0
    while at < n:
        # As many fingerprints as fit; a single one in a long bucket may ask more words than that.
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, side="right")))
        who = np.repeat(np.arange(at, end), asks[at:end])
        word = own_word[who] + np.arange(len(who)) - np.repeat(np.cumsum(asks[at:end]) - asks[at:end], asks[at:end])
        low = np.uint64(2) << (slot[who] % 64).astype(np.uint64)
        over = empty[word] | np.where(word == own_word[who], low - np.uint64(1), np.uint64(0))
        pairs, hit = near(planes, found[who], word, over, radius)
        for part in range(0, len(pairs), AT_ONCE // 64):
            some, mask = pairs[part:part + AT_ONCE // 64], hit[part:part + AT_ONCE // 64]
            row, bit = np.nonzero(np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            forest.add(who[some[row]], at_slot[word[some[row]] * 64 + bit])
        at = end
    return forest.kept


# ---------------------------------------------------------------- buckets

def parts_of(mask: int, radius: int = RADIUS) -> list[int]:
    """The masks of a bucket's next parts: its remaining bits in radius + 1 runs, each added to ``mask``."""
    left = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(left) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in left[x:y]) for x, y in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _dealt(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Each row once per next part of its bucket, as the bucket ``mask`` and ``value``."""
    further = F.lit(None).cast("array<bigint>")
    for mask in masks:
        further = F.when(F.col("mask") == _signed(mask), F.array(*[
            F.lit(_signed(m)).cast("bigint") for m in parts_of(mask, radius)])).otherwise(further)
    return (rows.select("fp", F.explode(further).alias("mask"))
            .withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))))


def links(prints: DataFrame, radius: int = RADIUS, task_rows: int = TASK_ROWS,
          bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs ``a``, ``b`` of the distinct fingerprints ``fp`` that connect all within ``radius`` bits of one another."""
    masks, ready = [0], []
    rows = _dealt(prints.select("fp", F.lit(0).cast("bigint").alias("mask")), masks, radius)
    while True:
        masks = [m for mask in masks for m in parts_of(mask, radius)]
        crowded = (rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
                   .select("mask", "value"))
        last = min(m.bit_count() for m in masks) >= BITS - MOST_LEFT
        crowded = None if last else settled(crowded)
        if crowded is None or not crowded.count():
            ready.append(rows)
            break
        ready.append(rows.join(crowded, ["mask", "value"], "left_anti"))
        rows = _dealt(settled(rows.join(crowded, ["mask", "value"], "left_semi").select("fp", "mask")), masks, radius)
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    tasks = max(1, -(-every.count() // task_rows))

    def look(rows: pd.DataFrame) -> pd.DataFrame:
        # In one order of buckets and of fingerprints inside them, however the rows came.
        order = np.lexsort((rows["fp"], rows["value"], rows["mask"]))
        fp, value, mask = (rows[c].to_numpy(np.int64)[order] for c in ("fp", "value", "mask"))
        new = np.r_[True, (value[1:] != value[:-1]) | (mask[1:] != mask[:-1])]
        kept = np.array(forest_of(np.cumsum(new), fp.view(np.uint64), radius), int).reshape(-1, 2)
        return pd.DataFrame({"a": fp[kept[:, 0]], "b": fp[kept[:, 1]]})

    deal = F.pmod(F.xxhash64("mask", "value"), F.lit(tasks))
    return every.withColumn("deal", deal).groupBy("deal").applyInPandas(look, "a bigint, b bigint")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, **sizes: int) -> DataFrame:
    """Per row: key, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the smallest key that it reaches over
    links between fingerprints of at most ``radius`` (0 to 3) differing bits."""
    if not 0 <= radius <= 3:
        raise ValueError("two counters tell distances up to 3")
    rows = settled(df.select(F.col(key).cast("bigint").alias("id"), fingerprints(F.col(text).cast("string")).alias("fp")))
    own = settled(rows.groupBy("fp").agg(F.min("id").alias("least")))
    tied = components(links(own.select("fp"), radius, **sizes))
    labelled = (own.join(tied.withColumnRenamed("node", "fp"), "fp", "left")
                .select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                         "component_id")
