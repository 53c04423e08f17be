"""Approximate nearest neighbours by largest inner product: one hierarchical navigable small-world graph per shard, kept
as flat neighbour arrays, with the shards' results merged.

Vectors get one more component that makes all of a shard equally long, so that the order by inner product is an order
by distance, which the graph needs; a query's is 0. Rows enter the graph in batches that are
searched together: the beams of all rows of a batch move on by one gather and one product.

Equal vectors are one node that lists its ids, so ties among copies go to the smaller ids exactly. Vectors that are
NULL, empty or zero, or hold a NULL or non-finite component, take no part, neither do rows without an id, and
repeated rows count once. Only vectors of like length are compared. Scores are exact inner products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from starling.llm.blocks import best, nearest, usable

LINKS, BEAM_BUILD, BEAM_SEARCH = 16, 96, 160
#: Rows of a shard. A search visits a few thousand nodes of a shard of any size, so shards should be as large as a task has
#: memory and time to build; this many take about half a minute. With larger ones a wider beam keeps the recall.
SHARD_ROWS = 25_000
BATCH, STEP, SELECTED_FROM = 256, 4, 64
NONE = -1


@dataclass
class Graph:
    ids: np.ndarray          # ids of all rows, those of a node together and in order
    first: np.ndarray        # per node, its first id; one more at the end
    vectors: np.ndarray      # per node, as given
    spread: np.ndarray       # per node, made equally long
    links: list[np.ndarray]  # per level, nodes by neighbours, NONE where there are fewer
    entry: int


def beam(spread: np.ndarray, links: np.ndarray, asked: np.ndarray, entries: np.ndarray, width: int,
         visited: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes found for each row of ``asked`` (NONE if fewer), nearest first, and their products,
    going out from its row of ``entries``. ``visited`` is raised by the nodes that each row's product was taken with."""
    n, rows = len(asked), np.arange(len(asked))[:, None]
    seen = np.zeros((n, len(spread) + 1), bool)             # the last column stands for NONE
    seen[:, -1] = True
    seen[rows, entries] = True
    near = np.einsum("bmd,bd->bm", spread[entries], asked)
    near[entries == NONE] = -np.inf
    nodes, open_ = entries.copy(), entries != NONE
    going = np.arange(n)
    out_nodes, out_near = np.full((n, width), NONE), np.full((n, width), -np.inf, np.float32)
    while len(going):
        ready = np.where(open_, near, -np.inf)
        step = min(STEP, ready.shape[1])
        place = np.argpartition(-ready, step - 1, axis=1)[:, :step]
        at = np.arange(len(going))[:, None]
        picked = np.where(open_[at, place], nodes[at, place], NONE)
        done = (picked == NONE).all(1)
        if done.any():
            order = np.argsort(-near[done], axis=1, kind="stable")[:, :width]
            some = np.arange(done.sum())[:, None]
            out_nodes[going[done], :order.shape[1]] = nodes[done][some, order]
            out_near[going[done], :order.shape[1]] = near[done][some, order]
            keep = ~done
            going, nodes, near, open_, picked, place = (x[keep] for x in (going, nodes, near, open_, picked, place))
            if not len(going):
                break
            at = np.arange(len(going))[:, None]
        open_[at, place] = False
        fresh = np.where(picked[:, :, None] == NONE, NONE, links[picked]).reshape(len(going), -1)
        fresh.sort(axis=1)                                  # neighbours of several picked nodes count once
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = NONE
        fresh[seen[going[:, None], fresh]] = NONE
        seen[going[:, None], fresh] = True
        new = np.einsum("bmd,bd->bm", spread[fresh], asked[going])
        new[fresh == NONE] = -np.inf
        if visited is not None:
            visited[going] += (fresh != NONE).sum(1)
        nodes, near = np.concatenate([nodes, fresh], 1), np.concatenate([near, new], 1)
        open_ = np.concatenate([open_, fresh != NONE], 1)
        if nodes.shape[1] > width:
            top = np.argpartition(-near, width - 1, axis=1)[:, :width]
            nodes, near, open_ = nodes[at, top], near[at, top], open_[at, top]
    return out_nodes, out_near


def diverse(spread: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, nearest first, up to ``most`` neighbours: those nearer to the row than to any neighbour
    taken before, then the nearest of the others."""
    nodes, near = nodes[:, :SELECTED_FROM], near[:, :SELECTED_FROM]
    points = spread[nodes]
    among = points @ points.transpose(0, 2, 1)
    taken, nearest_taken = np.zeros(nodes.shape, bool), np.full(nodes.shape, -np.inf, np.float32)
    for j in range(nodes.shape[1]):
        accept = (nodes[:, j] != NONE) & (nearest_taken[:, j] < near[:, j]) & (taken.sum(1) < most)
        taken[:, j] = accept
        nearest_taken[accept] = np.maximum(nearest_taken[accept], among[accept, :, j])
    order = np.argsort(np.where(nodes == NONE, 2, ~taken), axis=1, kind="stable")[:, :most]
    found = np.take_along_axis(nodes, order, 1)
    return np.pad(found, ((0, 0), (0, most - found.shape[1])), constant_values=NONE) if found.shape[1] < most else found


def _link_back(spread: np.ndarray, links: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> None:
    """Adds each row to its neighbours' lists; lists that overflow are chosen anew."""
    to, who = chosen.ravel(), np.repeat(rows, chosen.shape[1])
    there = to != NONE
    to, who = to[there], who[there]
    order = np.argsort(to, kind="stable")
    to, who = to[order], who[order]
    some, start, count = np.unique(to, return_index=True, return_counts=True)
    more = np.full((len(some), count.max()), NONE)
    more[np.repeat(np.arange(len(some)), count), np.arange(len(to)) - np.repeat(start, count)] = who
    for part in np.split(np.arange(len(some)), range(BATCH, len(some), BATCH)):
        nodes = np.concatenate([links[some[part]], more[part]], 1)
        near = np.einsum("bmd,bd->bm", spread[nodes], spread[some[part]])
        near[nodes == NONE] = -np.inf
        order = np.argsort(-near, axis=1, kind="stable")
        links[some[part]] = diverse(spread, np.take_along_axis(nodes, order, 1), np.take_along_axis(near, order, 1),
                                    links.shape[1])


def build(ids: np.ndarray, vectors: np.ndarray) -> Graph:
    """A graph of the rows; their levels follow from a fixed seed, so a task that runs again builds the same."""
    nodes, who = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, who.ravel()))
    first = np.concatenate(([0], np.cumsum(np.bincount(who.ravel(), minlength=len(nodes)))))
    rng = np.random.default_rng(len(nodes))
    shuffled = rng.permutation(len(nodes))                  # sorted vectors would enter the graph one region at a time
    starts, sizes = first[:-1][shuffled], np.diff(first)[shuffled]
    ids = ids[order][np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))]
    vectors, first = nodes[shuffled], np.concatenate(([0], np.cumsum(sizes)))
    square = np.einsum("ij,ij->i", vectors, vectors)
    longest = square.max()
    spread = np.concatenate([vectors, np.sqrt(np.maximum(longest - square, 0))[:, None]], 1)
    spread = (spread / np.sqrt(longest)).astype(np.float32)
    level = np.minimum((-np.log(1 - rng.random(len(nodes))) / np.log(LINKS)).astype(int), 6)
    level[0] = max(1, level.max())
    links = [np.full((len(nodes), LINKS * (2 if i == 0 else 1)), NONE) for i in range(level[0] + 1)]
    at = 1
    while at < len(nodes):
        rows = np.arange(at, min(len(nodes), at + max(1, min(BATCH, at // 4))))
        entries = np.zeros((len(rows), 1), int)
        for i in range(len(links) - 1, -1, -1):
            part = level[rows] >= i
            found, near = beam(spread, links[i], spread[rows], entries, BEAM_BUILD if part.any() else 8)
            entries = found[:, :8]
            if part.any():
                some = rows[part]
                within = spread[some] @ spread[some].T      # rows of the batch may be neighbours too
                within[np.triu_indices(len(some))] = -np.inf
                both = np.concatenate([found[part], np.where(within > -np.inf, some, NONE)], 1)
                close = np.concatenate([near[part], within], 1)
                order = np.argsort(-close, axis=1, kind="stable")[:, :SELECTED_FROM]
                chosen = diverse(spread, np.take_along_axis(both, order, 1), np.take_along_axis(close, order, 1), LINKS)
                links[i][some, :LINKS] = chosen
                _link_back(spread, links[i], some, chosen)
        at = rows[-1] + 1
    return Graph(ids, first, vectors, spread, links, 0)


def search(graph: Graph, block: tuple[np.ndarray, np.ndarray], k: int, width: int = BEAM_SEARCH,
           visited: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and scores of the ``k`` nearest found for each query; ``visited`` as in ``beam``."""
    asked_ids, asked = block
    out = []
    for start in range(0, len(asked_ids), BATCH):
        who, vectors = asked_ids[start:start + BATCH], asked[start:start + BATCH]
        flat = np.concatenate([vectors, np.zeros((len(vectors), 1))], 1).astype(np.float32)
        found = np.full((len(who), 1), graph.entry)
        for i in range(len(graph.links) - 1, -1, -1):
            found, _ = beam(graph.spread, graph.links[i], flat, found[:, :8], max(width, k + 1) if i == 0 else 8,
                            None if visited is None else visited[start:start + BATCH])
        row, column = np.nonzero(found != NONE)
        node = found[row, column]
        score = np.einsum("ij,ij->i", graph.vectors[node], vectors[row])
        # Of a node's ids, one more than wanted: one may be the query itself.
        size = np.minimum(np.diff(graph.first)[node], k + 1)
        ids = graph.ids[np.repeat(graph.first[node] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        row, score = np.repeat(row, size), np.repeat(score, size)
        other = ids != who[row]
        row, ids, score = row[other], ids[other], score[other]
        top = best(row, ids, score, k)
        out.append((who[row[top]], ids[top], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3


def search_all(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding",
               **sizes: int) -> DataFrame:
    """query_id, rank, vec_id, score: ``k`` near rows for each row that is a query (a condition on ``id``), without
    the query itself. Every row is in an index."""
    some = usable(vectors, key, vector).where(F.exists("v", lambda x: x != 0))
    return nearest(some, is_query, k, build, lambda ids, points: (ids, points), search, "double",
                   **{"shard_rows": SHARD_ROWS} | sizes)
