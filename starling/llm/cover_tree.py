"""Exact search for the largest integer inner products, by dual-tree search over cover trees.

Each shard of vectors and each block of queries becomes a cover tree: a node's children lie within its radius and
their centres more than half of it apart, the centre being a child of its own; children of few
points share leaves. The search goes down both trees at once. For a query node with centre q and covering radius
a and a node with centre r and radius b, no product of their points exceeds q.r + b|q| + a|r| + ab; where that is
below the worst k-th score of the query node's group, the pair is left out with all below it.

Vectors that are NULL or empty or hold a NULL or non-finite component take no part, neither do rows without an id, and
repeated rows count once. Only vectors of like length are compared. Components are floor(scale * x); products
are exact while the sums stay below 2**53, and in 64-bit integers beyond.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from starling.llm.blocks import best, nearest, usable

LEAF = 32
SCALE = 1024


@dataclass
class CoverTree:
    ids: np.ndarray         # of points, in the order of the leaves
    points: np.ndarray
    centre: np.ndarray      # per node
    radius: np.ndarray
    first: np.ndarray       # per node, its points (leaf) or children (inner node)
    beyond: np.ndarray
    leaf: np.ndarray
    under: np.ndarray       # per node, all points below: first and beyond


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _children(points: np.ndarray, rows: np.ndarray, centre: int, radius: float) -> list[tuple[int, np.ndarray]]:
    """Centres, each more than ``radius`` from those before, and the rows within ``radius`` of them that no
    earlier one has. The parent's centre is the first."""
    found, left = [], np.concatenate(([centre], rows[rows != centre]))
    while len(left):
        near = _distances(points[left], points[left[0]]) <= radius
        near[0] = True
        found.append((int(left[0]), left[near]))
        left = left[~near]
    return found


def build(ids: np.ndarray, points: np.ndarray, leaf_size: int = LEAF) -> CoverTree:
    """A tree over rows of ``points``, breadth first, so that a node's children follow one another."""
    points = np.asarray(points, float)
    nodes: list[dict] = [{"centre": 0, "rows": np.arange(len(ids))}]
    at = 0
    while at < len(nodes):
        node = nodes[at]
        rows, centre = node["rows"], node["centre"]
        far = _distances(points[rows], points[centre])
        node["radius"] = float(far.max(initial=0.0))
        if len(rows) <= leaf_size or node["radius"] == 0:
            node["leaf"] = True
        else:
            parts = _children(points, rows, centre, node["radius"] / 2)
            small = [p for p in parts if len(p[1]) <= leaf_size // 2]
            below = [{"centre": c, "rows": r} for c, r in parts if len(r) > leaf_size // 2]
            while small:                                    # few points each: several to a leaf
                rows, centre, n = [], small[0][0], 0
                while small and n + len(small[0][1]) <= leaf_size:
                    rows.append(small.pop(0)[1])
                    n += len(rows[-1])
                below.append({"centre": centre, "rows": np.concatenate(rows)})
            node |= {"leaf": False, "first": len(nodes), "beyond": len(nodes) + len(below)}
            nodes += below
        at += 1
    order, placed, visits = [], 0, [0]
    while visits:                                           # depth first, so that the points below a node follow one another
        node = nodes[visits.pop()]
        node["under"] = placed
        if node["leaf"]:
            order.append(node["rows"])
            placed += len(node["rows"])
            node |= {"first": node["under"], "beyond": placed}
        else:
            visits += range(node["beyond"] - 1, node["first"] - 1, -1)
    order = np.concatenate(order)
    column = lambda name, kind: np.array([n[name] for n in nodes], kind)
    leaf, first, beyond = column("leaf", bool), column("first", int), column("beyond", int)
    under = np.stack([column("under", int), beyond], 1)
    for i in range(len(nodes) - 1, -1, -1):                 # children come after their parent
        if not leaf[i]:
            under[i, 1] = under[beyond[i] - 1, 1]
    return CoverTree(ids[order], points[order], points[column("centre", int)], column("radius", float), first,
                     beyond, leaf, under)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    largest = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    return (a @ b.T).astype(np.int64) if largest < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def search(tree: CoverTree, queries: CoverTree, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and scores of each query's ``k`` best points."""
    n = len(queries.ids)
    lowest = np.iinfo(np.int64).min
    who, found, scores = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64)
    worst = np.full(n, lowest)
    size, q_size = np.linalg.norm(tree.centre, axis=1), np.linalg.norm(queries.centre, axis=1)
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    pairs = [(0, np.zeros(1, int))] if n and len(tree.ids) else []
    while pairs:
        q, nodes = pairs.pop()
        limit = (queries.centre[q] @ tree.centre[nodes].T + tree.radius[nodes] * q_size[q]
                 + queries.radius[q] * (size[nodes] + tree.radius[nodes]))
        limit += 1e-9 * (np.abs(limit) + 1)                 # rounding of the bound itself
        a, b = queries.under[q]
        order = np.argsort(-limit, kind="stable")
        nodes, limit = nodes[order], limit[order]
        inner = nodes[~tree.leaf[nodes] & (limit >= worst[a:b].min())]
        below = [np.arange(x, y) for x, y in zip(tree.first[inner], tree.beyond[inner])]
        if not queries.leaf[q]:
            kept = nodes[tree.leaf[nodes] & (limit >= worst[a:b].min())]
            if len(kept) or below:
                pairs += [(c, np.concatenate([kept, *below])) for c in range(queries.first[q], queries.beyond[q])]
            continue
        leaves, limit = nodes[tree.leaf[nodes]], limit[tree.leaf[nodes]]
        for start in range(0, len(leaves), 16):             # most promising first, the limit rising on the way
            some = leaves[start:start + 16][limit[start:start + 16] >= worst[a:b].min()]
            if not len(some):
                break
            rows = np.concatenate([np.arange(x, y) for x, y in zip(tree.first[some], tree.beyond[some])])
            product = _products(queries.points[a:b], tree.points[rows])
            one, other = np.nonzero((product >= worst[a:b, None]) & (queries.ids[a:b, None] != tree.ids[rows]))
            old = held.get(q, (np.zeros((0, 3), np.int64),))[0]
            now = np.concatenate([old, np.stack([one + a, tree.ids[rows[other]], product[one, other]], 1)])
            now = now[best(now[:, 0], now[:, 1], now[:, 2], k)]
            held[q] = (now,)
            count = np.bincount(now[:, 0] - a, minlength=b - a)
            full = np.flatnonzero(count == k)
            last = np.cumsum(count) - 1
            worst[a + full] = now[last[full], 2]
        if below:
            pairs.append((q, np.concatenate(below)))
    if held:
        rows = np.concatenate([x[0] for x in held.values()])
        who, found, scores = rows[:, 0], rows[:, 1], rows[:, 2]
    return queries.ids[who], found, scores


def search_all(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding",
               scale: int = SCALE, **sizes: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the largest inner product of floor(scale * x) for each row
    that is a query (a condition on ``id``), without the query itself."""
    whole = usable(vectors, key, vector).select("id", F.transform(
        "v", lambda x: F.floor(x * scale).cast("double")).alias("v")).distinct()
    return nearest(whole, is_query, k, build, lambda ids, points: build(ids, points, 16), search, "bigint", **sizes)
