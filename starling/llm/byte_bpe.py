"""Byte-level BPE encoding and decoding with a public rank file.

Texts are cut by the tokenizer's pattern, and the distinct pieces of a slice of a batch are merged together: pieces of
like length form a padded matrix of token ids, and in each round every row merges its leftmost pair of minimum rank.
Pair ranks come from a hash table in flat arrays; finished rows are taken out, and as every other row has lost one
token, the matrix loses one column (``pieces.merge_matrix``).

Both functions work on columns, so other columns of a table pass untouched, whatever they are called. A NULL text
encodes as an empty one, to no ids; NULL ids decode to no bytes. Equal texts get equal ids.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from starling.llm.pieces import MATRIX_ROWS, PairTable, Slice, merge_matrix, merged, spaced_pieces

#: Fixed value: the pattern that ``pieces.spaced_pieces`` cuts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters worked on at a time. A longer text is worked on alone, whole.
SLICE_CHARS = 500_000


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            parts = [line.split() for line in lines if line.strip()]
        rank = {base64.b64decode(token): int(number) for token, number in parts}
        self.token = [b""] * (max(rank.values()) + 1)
        pairs: dict[tuple[int, int], int] = {}
        for token, number in rank.items():
            self.token[number] = token
            for cut in range(1, len(token)):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = number
        self.pairs = PairTable(pairs)
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        # A piece that is a token is that token, whether or not merges lead there: here are those where not.
        self.whole, by_size = {}, {}
        for token in rank:
            by_size.setdefault(len(token), []).append(token)
        for size, tokens in by_size.items():
            for at in range(0, len(tokens), MATRIX_ROWS):
                some = tokens[at:at + MATRIX_ROWS]
                ids = self.single[np.frombuffer(b"".join(some), np.uint8)].reshape(-1, size)
                ids = merge_matrix(ids, self.pairs) if size > 1 else ids
                self.whole |= {t: rank[t] for t, row in zip(some, ids) if row[0] != rank[t]}

    def encode(self, texts: list[str]) -> list[bytes]:
        s = Slice.of(texts)
        if not len(s.points):
            return [b""] * len(texts)
        at = spaced_pieces(s)
        place = s.byte_place(at)
        ids, sizes = merged(s.raw, place[:-1], place[1:], self.pairs, lambda raw, _: self.single[raw], self.whole)
        before = np.concatenate(([0], sizes.cumsum()))
        ends = before[np.searchsorted(at, s.lengths.cumsum())] * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def slices(texts: pd.Series, chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The texts in order, so many characters at a time; NULL as empty."""
    held, size = [], 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encode(text: Column, path: str, pattern: str = PATTERN) -> Column:
    """Token ids of a text as little-endian unsigned 32-bit integers, without special tokens."""
    if pattern != PATTERN:
        raise ValueError("texts are cut by one pattern only")

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = vocabulary(path)
        for texts in batches:
            yield pd.Series([x for some in slices(texts) for x in words.encode(some)], dtype=object)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes that ids stand for."""

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = vocabulary(path).token
        for some in batches:
            yield pd.Series([b"".join(map(token.__getitem__, np.frombuffer(x or b"", "<u4").tolist()))
                             for x in some], dtype=object)

    return raw(ids)


def id_list(ids: Column) -> Column:
    """Encoded ids as an array of numbers."""

    @F.pandas_udf("array<bigint>")
    def numbers(some: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x or b"", "<u4").astype(np.int64) for x in some], dtype=object)

    return numbers(ids)
