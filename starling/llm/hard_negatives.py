"""Hard negatives for contrastive training: per anchor and positive, the best rows of other labels whose score lies in a
window below the positive's.

All rows are put in the order of a Hilbert curve through their vectors, cut into blocks of neighbouring rows, and written as
Parquet, one row a block, with a zone map: the smallest and the largest value of every dimension. Interval
arithmetic on a zone map bounds the inner products that an anchor can have with any row of the block from both
sides. A first pass reads zone maps alone and chooses the blocks whose interval meets what some anchor of a group
still looks for; only these are read, most promising first, and left out again where an anchor's worst result so far
beats their bound. Positives start from the k-th score that the anchor's own block gives.

Vectors that are NULL or empty or hold a NULL or non-finite component take no part, nor do rows without an id or a
label. Only vectors of like length are compared. Repeated rows count once; an id that stands for several rows is
asked once, with the smallest label and vector, and each of its rows is a candidate for others. Components are floor(scale * x);
products are exact while sums stay below 2**53, and in 64-bit integers beyond. A window that holds no whole
number (that of a negative positive score) has no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType

from starling.llm.blocks import best
from starling.session import run_folder, settled

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score in percent of the positive's: least and most.
SHARES = (50, 95)
BLOCK_ROWS = 512
#: A shard is a run of blocks that one task may read; it grows with the table once there would be more than so many.
SHARD_ROWS, MOST_SHARDS = 16_384, 2_000
#: Bits per dimension that place a vector on the curve.
CURVE_BITS = 2
#: Anchors whose products with a block are worked out at once, and most tasks for pairs of a group and a shard.
ANCHORS_AT_ONCE, MOST_TASKS = 1024, 20_000
NONE, ALL = np.iinfo(np.int64).min, np.iinfo(np.int64).max


# ---------------------------------------------------------------- the curve

def curve_places(cells: np.ndarray, bits: int) -> list[bytes]:
    """The places of rows of whole numbers below 2**bits on the Hilbert curve through their space, as bytes that sort
    like the places."""
    x = cells.T.astype(np.int64)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            turned = (x[i] & bit) != 0
            swapped = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turned, below, swapped)
            x[i] ^= swapped if i else 0
    x = np.bitwise_xor.accumulate(x, axis=0)
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    wide = np.stack([(x >> level) & 1 for level in range(bits - 1, -1, -1)])            # bits x dimensions x rows
    return [row.tobytes() for row in np.packbits(wide.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)]


def _curve(v: Column, lows: Column, highs: Column, bits: int) -> Column:
    def place(v: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        out = pd.Series([b""] * len(v), dtype=object)
        length = v.map(len)
        for n in length.unique():
            rows = np.flatnonzero(length == n)
            points, low, high = (np.stack(s.iloc[rows].to_numpy()).astype(float) for s in (v, lows, highs))
            share = (points - low) / np.maximum(high - low, 1)
            out.iloc[rows] = curve_places(np.minimum((share * 2**bits).astype(np.int64), 2**bits - 1), bits)
        return out
    return F.pandas_udf(place, BinaryType())(v, lows, highs)


# ---------------------------------------------------------------- blocks and zone maps

BLOCK = ("length int, part int, block bigint, first bigint, lows binary, highs binary, ids binary, labels binary, "
         "asked binary, kind string, cells binary")


def _narrow(cells: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them."""
    for kind in ("<i2", "<i4"):
        if not len(cells) or (cells.min() >= np.iinfo(kind).min and cells.max() <= np.iinfo(kind).max):
            return cells.astype(kind)
    return cells.astype("<i8")


def _block(rows: pd.DataFrame, number: int) -> dict:
    rows = rows.sort_values(["id", "label"], kind="stable")
    cells = np.stack(rows["v"].to_numpy()).astype(np.int64)
    narrow = _narrow(cells)
    return {"length": cells.shape[1], "part": rows["part"].iloc[0],
            "block": (int(rows["part"].iloc[0]) << 32) + number, "first": rows["id"].iloc[0],
            "lows": cells.min(0).astype("<i8").tobytes(), "highs": cells.max(0).astype("<i8").tobytes(),
            "ids": rows["id"].to_numpy("<i8").tobytes(), "labels": rows["label"].to_numpy("<i8").tobytes(),
            "asked": rows["asked"].to_numpy(np.uint8).tobytes(), "kind": narrow.dtype.str, "cells": narrow.tobytes()}


def ordered_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS,
                   bits: int = CURVE_BITS) -> DataFrame:
    """``rows`` (id, label, v, asked) as a Parquet table in the shared folder, one row a block, in the order of the curve."""
    ends = (rows.select(F.size("v").alias("length"), F.posexplode("v").alias("at", "x")).groupBy("length", "at")
            .agg(F.min("x").alias("low"), F.max("x").alias("high")).groupBy("length")
            .agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("e"))
            .select("length", F.col("e.low").alias("lows"), F.col("e.high").alias("highs")))
    n = rows.count()
    shards = max(1, -(-n // max(shard_rows, -(-n // MOST_SHARDS))))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, number = None, 0
        for batch in batches:
            kept = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            made = []
            while len(kept):
                fit = int((kept["length"].iloc[:block_rows] == kept["length"].iloc[0]).to_numpy().cumprod().sum())
                if fit == len(kept) and fit < block_rows:
                    break                                      # more of the same block may come
                made.append(_block(kept.iloc[:fit], number + len(made)))
                kept = kept.iloc[fit:]
            if made:
                number += len(made)
                yield pd.DataFrame(made)
        if kept is not None and len(kept):
            yield pd.DataFrame([_block(kept, number)])

    placed = (rows.withColumn("length", F.size("v")).join(ends, "length")
              .withColumn("curve", _curve(F.col("v"), F.col("lows"), F.col("highs"), bits))
              .select("length", "curve", "id", "label", "asked", "v"))
    order = ["length", "curve", "id", "label"]
    folder = run_folder(rows.sparkSession, "hilbert-blocks")
    (placed.repartitionByRange(shards, *order).sortWithinPartitions(*order)
     .withColumn("part", F.spark_partition_id()).mapInPandas(cut, BLOCK).write.parquet(f"{folder}/blocks"))
    blocks = rows.sparkSession.read.parquet(f"{folder}/blocks")
    # Parts are as many as the shuffle made them; a shard is as many of them in a row as it has room for.
    sizes = blocks.groupBy("part").agg(F.sum(F.length("ids") / 8).alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")                  # over one row per part
    shard = F.floor(before / max(shard_rows, -(-n // MOST_SHARDS))).cast("int")
    return blocks.join(F.broadcast(settled(sizes.select("part", shard.alias("shard")))), "part").drop("part")


def bounds(points: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product that each of ``points`` can have with a vector between each of ``lows``
    and ``highs``, rounding of large sums allowed for."""
    up, down = np.maximum(points, 0).astype(float), np.minimum(points, 0).astype(float)
    lows, highs = lows.T.astype(float), highs.T.astype(float)
    least, most = up @ lows + down @ highs, up @ highs + down @ lows
    slack = 1e-12 * (up @ np.maximum(np.abs(lows), np.abs(highs)) - down @ np.maximum(np.abs(lows), np.abs(highs)))
    return np.floor(least - slack), np.ceil(most + slack)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


# ---------------------------------------------------------------- a group of anchors and the blocks it reads

@dataclass
class Anchors:
    """A group of anchors, and for each the ``windows`` it looks in: the lowest and the highest score (anchors x windows)."""
    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def chosen(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which blocks some window needs, by the bounds of anchors x blocks."""
        out = np.zeros(most.shape[1], bool)
        for w in range(self.low.shape[1]):
            out |= ((most >= self.low[:, w, None]) & (least <= self.high[:, w, None])).any(0)
        return out


def search(group: Anchors, blocks: list[dict], k: int, same_label: bool) -> tuple[np.ndarray, ...]:
    """Places of anchors, windows, ids and scores of the ``k`` best rows in each window, among rows of the anchor's label or
    of others, never the anchor itself."""
    n, windows = group.low.shape
    worst, last = group.low.copy(), np.full((n, windows), ALL)     # the score to reach, and the id to stay below if just that
    held = np.zeros((0, 3), np.int64)                              # anchor and window as one number, id, score
    least, most = bounds(group.points, np.stack([b["lows"] for b in blocks]), np.stack([b["highs"] for b in blocks]))
    for at in np.argsort(-most.max(0), kind="stable"):
        block = blocks[at]
        promising = ((most[:, at, None] > worst) | ((most[:, at, None] >= worst) & (block["first"] < last))) & (
            least[:, at, None] <= group.high)
        found = [held]
        asking = np.flatnonzero(promising.any(1))
        for some in np.split(asking, range(ANCHORS_AT_ONCE, len(asking), ANCHORS_AT_ONCE)):
            score = products(group.points[some], block["points"])
            fits = (group.labels[some, None] == block["labels"]) == same_label
            fits &= group.ids[some, None] != block["ids"]
            for w in range(windows):
                one, other = np.nonzero(fits & (score >= worst[some, w, None]) & (score <= group.high[some, w, None]))
                hits = np.stack([some[one] * windows + w, block["ids"][other], score[one, other]], 1)
                found.append(hits[best(hits[:, 0], hits[:, 1], hits[:, 2], k)])
        if sum(map(len, found[1:])):
            held = np.concatenate(found)
            held = held[best(held[:, 0], held[:, 1], held[:, 2], k)]
            count = np.bincount(held[:, 0], minlength=n * windows)
            full = np.flatnonzero(count == k)
            end = np.cumsum(count)[full] - 1
            worst.reshape(-1)[full], last.reshape(-1)[full] = held[end, 2], held[end, 1]
    return held[:, 0] // windows, held[:, 0] % windows, held[:, 1], held[:, 2]


def _matrix(data: bytes, length: int, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, length)


def _read_group(row: pd.Series) -> Anchors:
    numbers = {c: np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "low", "high")}
    n = len(numbers["ids"])
    return Anchors(numbers["ids"], numbers["labels"], _matrix(row["points"], row["length"]),
                   numbers["low"].reshape(n, -1).copy(), numbers["high"].reshape(n, -1))


def _read_block(row: dict) -> dict:
    return {"first": row["first"], "lows": np.frombuffer(row["lows"], "<i8"), "highs": np.frombuffer(row["highs"], "<i8"),
            "ids": np.frombuffer(row["ids"], "<i8"), "labels": np.frombuffer(row["labels"], "<i8"),
            "points": _matrix(row["cells"], row["length"], row["kind"])}


def _anchors(blocks: DataFrame, k: int) -> DataFrame:
    """id, label, length, shard and v of every anchor, and the k-th best score among the rows of its label in its own
    block, if there are as many."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                block = _read_block(row)
                asked = np.flatnonzero(np.frombuffer(row["asked"], np.uint8))
                for some in np.split(asked, range(ANCHORS_AT_ONCE, len(asked), ANCHORS_AT_ONCE)):
                    if not len(some):
                        continue
                    score = products(block["points"][some], block["points"])
                    other = (block["labels"][some, None] != block["labels"]) | (block["ids"][some, None] == block["ids"])
                    score[other] = NONE
                    seed = np.sort(score, 1)[:, -k] if score.shape[1] >= k else np.full(len(some), NONE)
                    yield pd.DataFrame({
                        "id": block["ids"][some], "label": block["labels"][some], "length": row["length"],
                        "shard": row["shard"], "seed": seed,
                        "v": [block["points"][i].astype("<i8").tobytes() for i in some]})

    rows = blocks.mapInPandas(of, "id bigint, label bigint, length int, shard int, seed bigint, v binary")
    # An id of several rows is asked once.
    return rows.groupBy("id").agg(F.min(F.struct("label", "length", "v", "shard", "seed")).alias("r")).select("id", "r.*")


def _groups(anchors: DataFrame) -> DataFrame:
    """``anchors`` (with arrays ``low`` and ``high``) in one row for those of a shard."""
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        row = {"length": rows["length"].iloc[0], "near": rows["shard"].iloc[0], "points": b"".join(rows["v"]),
               "ids": rows["id"].to_numpy("<i8").tobytes(), "labels": rows["label"].to_numpy("<i8").tobytes()}
        return pd.DataFrame([row | {c: np.stack(rows[c].to_numpy()).astype("<i8").tobytes() for c in ("low", "high")}])

    return settled(anchors.groupBy("length", "shard").applyInPandas(
        pack, "length int, near int, points binary, ids binary, labels binary, low binary, high binary"))


def _found(groups: DataFrame, blocks: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``id``, ``at`` (of the window), ``other`` and ``score`` of the best ``k`` that each group finds in each shard."""
    def zones(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"length": rows["length"].iloc[0], "shard": rows["shard"].iloc[0],
                              "blocks": rows["block"].to_numpy("<i8").tobytes(),
                              "all_lows": b"".join(rows["lows"]), "all_highs": b"".join(rows["highs"])}])

    maps = settled(blocks.select("length", "shard", "block", "lows", "highs").groupBy("length", "shard").applyInPandas(
        zones, "length int, shard int, blocks binary, all_lows binary, all_highs binary"))
    n_pairs = max(1, groups.count() * maps.count())
    shards = [row[0] for row in maps.select("shard").distinct().collect()]              # MOST_SHARDS numbers at most
    asked = groups.withColumn("shard", F.explode(F.array(*map(F.lit, shards)).cast("array<int>")))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                group, length = _read_group(row), row["length"]
                needed = group.chosen(*bounds(group.points, _matrix(row["all_lows"], length), _matrix(row["all_highs"], length)))
                numbers = np.frombuffer(row["blocks"], "<i8")[needed]
                yield pd.DataFrame({"length": length, "near": row["near"], "shard": row["shard"], "block": numbers})

    wanted = (asked.join(maps, ["length", "shard"]).repartition(min(n_pairs, MOST_TASKS), "near", "shard")
              .mapInPandas(choose, "length int, near int, shard int, block bigint"))
    read = wanted.join(blocks.drop("asked"), ["length", "shard", "block"])

    def look(group: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(rows):
            return pd.DataFrame({"id": [], "at": [], "other": [], "score": []})
        anchors = _read_group(group.iloc[0])
        blocks = [_read_block(row) for row in rows.sort_values("block").to_dict("records")]
        one, window, other, score = search(anchors, blocks, k, same_label)
        return pd.DataFrame({"id": anchors.ids[one], "at": window, "other": other, "score": score})

    both = ["length", "near", "shard"]
    n_tasks = min(n_pairs, MOST_TASKS)
    return (asked.repartition(n_tasks, *both).groupBy(*both).cogroup(read.repartition(n_tasks, *both).groupBy(*both))
            .applyInPandas(look, "id bigint, at int, other bigint, score bigint"))


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    """``rank`` among the finds of all shards, and the first ``k``: at most that many came from each shard."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _share(score: Column, percent: int) -> Column:
    """``percent`` of a whole number, rounded down, in whole numbers."""
    part = score * percent
    return ((part - F.pmod(part, F.lit(100))) / 100).cast("bigint")


def _rows(vectors: DataFrame, is_anchor: Column, key: str, vector: str, label: str, scale: int) -> DataFrame:
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
                           F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & fine)
            .select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("v"),
                    F.coalesce(is_anchor, F.lit(False)).alias("asked")).distinct())


def mine(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, shares: tuple[int, int] = SHARES, scale: int = SCALE,
         **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where ``is_anchor`` (a condition on ``id``) holds. Its positives are the ``positives`` other
    rows of its label with the largest inner products; for each, the ``negatives`` best rows of other labels whose
    score is between ``shares`` percent of the positive's. Ties go to the smaller id. ``sizes`` (``block_rows``,
    ``shard_rows``, ``bits``) go to the blocks.
    """
    blocks = ordered_blocks(settled(_rows(vectors, is_anchor, key, vector, label, scale)), **sizes)
    anchors = settled(_anchors(blocks, positives))
    whole = anchors.withColumns({"low": F.array("seed"), "high": F.array(F.lit(ALL))})
    near = settled(_best(_found(_groups(whole), blocks, positives, same_label=True), positives, "id").select(
        "id", "rank", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))
    # Every positive opens a window; where there are fewer positives, the rest are empty ones.
    low, high = -_share(F.col("positive_score"), -shares[0]), _share(F.col("positive_score"), shares[1])
    opened = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", low.alias("low"), high.alias("high")))).alias("w"))
    def filled(name: str, empty: int) -> Column:
        return F.slice(F.concat(F.col(f"w.{name}"), F.array_repeat(F.lit(empty), positives)), 1, positives)
    looking = anchors.join(opened, "id").withColumns({"low": filled("low", ALL), "high": filled("high", NONE)}).drop("w")
    found = _best(_found(_groups(looking), blocks, negatives, same_label=False), negatives, "id", "at")
    return (found.withColumnRenamed("rank", "place").withColumn("rank", F.col("at") + 1).join(near, ["id", "rank"])
            .select(F.col("id").alias("anchor_id"), "positive_id", F.col("place").alias("rank"),
                    F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
