"""Packing of tokenized documents into sequences of a fixed size, by minimum bin slack.

A document's ids are cut into pieces only where they exceed a sequence. Which lengths share a sequence depends on
how many pieces there are of each length, a table of at most ``size`` rows however large the corpus: that table
alone comes to the driver. There, one sequence after another takes the longest piece left and, by subset-sum dynamic
programming over the bits of an integer, the combination of lengths that fills the rest most fully. A combination
is used as often as the counts allow, so each use-up removes a length and there are at most ``size`` of them.
The pieces then find their places by their number among the pieces of the same length.

NULL texts count as empty and are one piece holding the end id. Repeated rows are packed each. An empty table
gives no rows.
"""

from __future__ import annotations

import functools
import json
import os
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from starling.llm.byte_bpe import slices
from starling.llm.pieces import PairTable, Slice, merged, unspaced_pieces
from starling.session import settled

SIZE, END_ID = 4096, 1
#: Numbers within a length are given out in this many parts each, so that a length which a third of the pieces
#: have is sorted in as many tasks.
PARTS = 256
SLICE_CHARS = 500_000


# ---------------------------------------------------------------- ids

def _plain_characters() -> np.ndarray:
    """Which characters are their own normal form, one character when lower-cased, and of an undoubted class:
    Latin letters, signs and punctuation."""
    table = np.zeros(0x110000, bool)
    for first, last in ((9, 10), (13, 13), (0x20, 0x7E), (0xA1, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E),
                        (0x20A0, 0x20BF)):
        table[first:last + 1] = True
    table[0x130] = False
    return table


class WordTokenizer:
    """Ids by a ``tokenizers`` file of lower-cased words with a word end. Texts of plain characters are cut here and
    their distinct words merged in matrices; any other text is left to the library. Both give the same ids."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = {}
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pairs[vocab[left], vocab[right]] = vocab[left + right]
        ranks = list(pairs.values())
        if ranks != sorted(ranks):
            raise ValueError("ids of this file do not follow its merges")
        shown = _byte_characters()
        self.single = np.array([vocab[c] for c in shown], np.int32)
        self.last = np.array([vocab[c + end] for c in shown], np.int32)
        self.pairs, self.plain = PairTable(pairs), _plain_characters()

    @functools.cached_property
    def tokenizer(self):
        """Loaded when the first text needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        s = Slice.of(texts)
        ends = s.lengths.cumsum()
        other = np.unique(np.searchsorted(ends, np.flatnonzero(~self.plain[s.points]), side="right"))
        del s
        if len(other):
            plain = list(texts)
            for i in other.tolist():
                plain[i] = ""
            found = self.encode(plain)
            for i, ids in zip(other.tolist(), self.by_library([texts[i] for i in other])):
                found[i] = ids
            return found
        s = Slice.of([t.lower() for t in texts])
        if not len(s.points):
            return [b""] * len(texts)
        at, dropped = unspaced_pieces(s)
        place = s.byte_place(at)
        ids, sizes = merged(s.raw, place[:-1][~dropped], place[1:][~dropped], self.pairs,
                            lambda raw, last: np.where(last, self.last[raw], self.single[raw]))
        all_sizes = np.zeros(len(at) - 1, np.int64)
        all_sizes[~dropped] = sizes
        before = np.concatenate(([0], all_sizes.cumsum()))
        ends = (before[np.searchsorted(at, ends)] * 4).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it can be printed, else the
    next one from 256 on."""
    shown = [b for first, last in ((33, 126), (161, 172), (174, 255)) for b in range(first, last + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def document_ids(text: Column, path: str, end_id: int = END_ID) -> Column:
    """Ids of a text and the end id, as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, last = word_tokenizer(path), end_id.to_bytes(4, "little")
        for texts in batches:
            yield pd.Series([x + last for some in slices(texts, SLICE_CHARS) for x in words.encode(some)], dtype=object)

    return ids(text)


def pieces(ids: Column, size: int = SIZE) -> Column:
    """An array of a document's pieces: number, first id, length, and checksum of the ids."""
    count = (F.length(ids) / 4).cast("bigint")
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.ceil(count / size) - 1),
        lambda k: F.struct(
            k.cast("int").alias("piece"), (k * size).alias("start"),
            F.least(F.lit(size), count - k * size).cast("bigint").alias("length"),
            F.crc32(F.substring(ids, (k * size * 4 + 1).cast("int"), F.lit(size * 4))).alias("ids_crc32")))


# ---------------------------------------------------------------- which lengths go together

def fullest(counts: Mapping[int, int], room: int) -> Counter:
    """Of the available lengths, a combination whose sum is the largest within ``room``. Bit s of ``reach`` says
    whether some combination sums to s; longer pieces come first, so short ones stay for later."""
    reach, window, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            chunk = min(chunk, left)
            steps.append((length, chunk, reach))
            reach |= reach << length * chunk & window
            left, chunk = left - chunk, chunk * 2
        if reach >> room & 1:
            break
    taken, total = Counter(), reach.bit_length() - 1
    for length, chunk, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += chunk
            total -= length * chunk
    return taken


def combinations(counts: Mapping[int, int], size: int = SIZE) -> Iterator[tuple[Counter, int]]:
    """(lengths of one sequence, number of sequences made so) until every piece is placed."""
    left = {length: n for length, n in counts.items() if n}
    while left:
        longest = max(left)
        left[longest] -= 1
        taken = fullest({x: n for x, n in left.items() if n}, size - longest)
        left[longest] += 1
        taken[longest] += 1
        times = min(left[x] // n for x, n in taken.items())
        for length, n in taken.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        yield taken, times


def places(counts: Mapping[int, int], size: int = SIZE) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Where the pieces of a length go: (length, from number, to number, pieces to a sequence, first sequence,
    offset of the first piece)."""
    sequence, given = 0, Counter()
    for taken, times in combinations(counts, size):
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            yield length, given[length], given[length] + n * times, n, sequence, offset
            given[length] += n * times
            offset += length * n
        sequence += times


# ---------------------------------------------------------------- packing

def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset. Only the two named columns of
    ``df`` are read."""
    cut = (df.select(F.col(key).alias("_key"), document_ids(F.col(text), path).alias("_ids"))
           .select("_key", F.inline(pieces(F.col("_ids"), size))))
    # Dealt by a number of the row, as a third of the rows may be alike.
    parts = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS))
    # Written once: tokenizing is dear, and the numbering below must see the same rows as the counting.
    cut = settled(cut.withColumn("_part", parts))
    sizes = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    spark = df.sparkSession
    # At most ``size`` combinations of a few lengths each, so the table is bounded and can be broadcast.
    where = F.broadcast(spark.createDataFrame(
        list(places(counts, size)), "length bigint, first bigint, beyond bigint, together bigint, "
                                    "first_sequence bigint, first_offset bigint"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")
    starts = sizes.select("length", "_part", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_key", "piece", "ids_crc32"))
    numbered = (cut.withColumn("number", number).join(starts, ["length", "_part"])
                .withColumn("number", F.col("number") - 1 + F.col("before")))
    inside = F.col("number") - F.col("first")
    return (numbered.join(where, (numbered["length"] == where["length"])
                          & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("beyond")))
            .select(F.col("_key").alias(key), "piece", "start", numbered["length"], "ids_crc32",
                    (F.col("first_sequence") + F.floor(inside / F.col("together"))).alias("sequence_id"),
                    (F.col("first_offset") + F.pmod(inside, F.col("together")) * numbered["length"]).alias("offset")))
