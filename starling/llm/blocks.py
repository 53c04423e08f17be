"""Searching a set of query vectors in all vectors, in blocks.

Vectors are dealt into shards of bounded size by a hash, each built into an index in one task; queries into blocks
likewise. Every block meets every index once, in a task that holds one of each, and gives each query its best few;
a window per query then keeps the best over all shards.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from starling.session import settled

SHARD_ROWS, BLOCK_QUERIES = 4096, 1024
#: Most tasks that pairs of a shard and a block are dealt to.
MOST_TASKS = 20_000


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part: those with an id and a vector of finite components.
    Repeated rows count once."""
    inf = float("inf")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf)))
    return (df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & (F.size("v") > 0) & fine).distinct())


def _packed(df: DataFrame, size: int, name: str, make: Callable[[np.ndarray, np.ndarray], object],
            *spread_by: str) -> tuple[DataFrame, int]:
    """``df`` dealt into groups of about ``size`` rows (apart by vector length), each made into one object."""
    groups = max(1, -(-df.count() // size))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        made = pickle.dumps(make(rows["id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy())))
        return pd.DataFrame({"length": [len(rows["v"].iloc[0])], name: [int(rows[name].iloc[0])], f"{name}_data": [made]})

    dealt = df.withColumns({"length": F.size("v"), name: F.pmod(F.xxhash64(*spread_by), F.lit(groups))})
    # As many tasks as groups: Spark would judge by their small size and put all of them into a few.
    built = (dealt.repartition(min(groups, MOST_TASKS), "length", name).groupBy("length", name)
             .applyInPandas(build, f"length int, {name} bigint, {name}_data binary"))
    return settled(built), groups


def nearest(vectors: DataFrame, is_query: Column, k: int, build: Callable, prepare: Callable, search: Callable,
            score_type: str, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best of ``vectors`` (``id``, ``v``) for those that are queries, ties
    to the smaller id.

    ``build(ids, vectors)`` makes an index, ``prepare(ids, vectors)`` a query block, and ``search(index, block, k)``
    gives arrays of query ids, found ids and scores, without a query's own id. A query id that
    stands for several vectors is asked once, with the smallest of them.
    """
    index, shards = _packed(vectors, shard_rows, "shard", build, "id", "v")
    asked = vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    queries, blocks = _packed(asked, block_queries, "block", prepare, "id")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, block in zip(batch["shard_data"], batch["block_data"]):
                asked, found, scores = search(pickle.loads(shard), pickle.loads(block), k)
                yield pd.DataFrame({"query_id": asked, "vec_id": found, "score": scores})

    # The stated query set against all rows, block by block: one row for each pair of a shard and a block.
    pairs = (queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
             .join(index, ["length", "shard"])
             .repartition(min(shards * blocks, MOST_TASKS), "shard", "block"))
    found = pairs.select("shard_data", "block_data").mapInPandas(
        look, f"query_id bigint, vec_id bigint, score {score_type}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(asked: np.ndarray, found: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best entries of each query, ties to the smaller id."""
    order = np.lexsort((found, -scores, asked))
    who = asked[order]
    start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, int)
    rank = np.arange(len(who)) - np.repeat(start, np.diff(np.r_[start, len(who)]))
    return order[rank < k]
