import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.llm import blocks, cover_tree, hnsw, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, v int, id string"


def nearest(ids, vectors, asked, k):
    """Brute force: (query, rank, id, score), ties to the smaller id."""
    out = []
    for q in asked:
        own = vectors[ids.index(q)]
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in zip(ids, vectors) if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


def clustered(n, seed, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width)) * 3
    return (centres[rng.integers(0, 8, n)] + rng.normal(size=(n, width)) * 0.3).astype(np.float32)


@pytest.mark.parametrize("leaf", [2, 32])
def test_cover_tree_holds_its_radii(leaf):
    points = np.floor(clustered(500, 1) * 50)
    tree = cover_tree.build(np.arange(500), points, leaf)
    assert sorted(tree.ids.tolist()) == list(range(500))
    assert np.array_equal(points[tree.ids], tree.points)
    for i in range(len(tree.centre)):
        below = tree.points[tree.under[i, 0]:tree.under[i, 1]]
        assert np.linalg.norm(below - tree.centre[i], axis=1).max() <= tree.radius[i] + 1e-9


def test_cover_tree_search_leaves_out_node_pairs(monkeypatch):
    points = np.floor(clustered(4000, 11, 8) * 100)
    asked, made = points[::20], []
    plain = cover_tree._products
    monkeypatch.setattr(cover_tree, "_products", lambda a, b: made.append(len(a) * len(b)) or plain(a, b))
    tree, queries_ = cover_tree.build(np.arange(4000), points), cover_tree.build(np.arange(0, 4000, 20), asked, 16)
    who, found, scores = cover_tree.search(tree, queries_, 10)
    assert sum(made) < 0.4 * 4000 * len(asked)
    for q in range(0, 4000, 400):
        exact = points @ points[q]
        exact[q] = -np.inf
        assert sorted(scores[who == q]) == sorted(np.sort(exact)[-10:])


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 60, "block_queries": 7}])
def test_cover_tree_search_is_exact(spark, sizes):
    vectors = clustered(300, 2)
    vectors[10:40] = vectors[5]                                    # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1001, []), (1002, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 6),
           (1004, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), rows[3], rows[0]]
    found = cover_tree.search_all(table(spark, rows + odd), F.col("id") % 10 == 0, 10, **sizes)
    whole = [[int(x) for x in np.floor(np.float64(v) * 1024)] for _, v in rows]
    want = nearest([i for i, _ in rows], whole, range(0, 300, 10), 10)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_large_components_stay_exact(spark):
    big = [(i, [float(2 ** 20 + i), float(-i), 3.0]) for i in range(30)]
    found = cover_tree.search_all(table(spark, big), F.col("id") == 0, 5)
    whole = [[int(x * 1024) for x in v] for _, v in big]
    assert sorted(map(tuple, found.collect())) == sorted(nearest(list(range(30)), whole, [0], 5))


@pytest.mark.parametrize("search", [cover_tree.search_all, hnsw.search_all])
def test_small_tables(spark, search):
    assert search(table(spark, []), F.col("id") % 10 == 0, 10).collect() == []
    assert search(table(spark, [(0, [1.0, 2.0])]), F.col("id") % 10 == 0, 10).collect() == []
    few = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [5.0]), (10, [3.0])]
    found = search(table(spark, few), F.col("id") % 10 == 0, 10).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(found)] == [(0, 1), (10, 2)]     # like lengths only


def test_hnsw_finds_copies_by_id_and_skips_zeros(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(80)] + [(100, [0.0, 0.0, 0.0]), (101, [0.9, 0.0, 0.0]), (0, [1.0, 0.0, 0.5])]
    found = hnsw.search_all(table(spark, rows), F.col("id") == 40, 20).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == list(range(20))
    assert all(r["score"] == 1.25 for r in found)
    assert hnsw.search_all(table(spark, rows), F.col("id") == 100, 20).collect() == []


def test_hnsw_recall_and_scores():
    rng = np.random.default_rng(5)
    for vectors in (rng.normal(size=(3000, 32)), clustered(3000, 6, 16).astype(float)):
        graph = hnsw.build(np.arange(3000) * 3, vectors)
        asked = rng.choice(3000, 100, replace=False)
        who, found, scores = hnsw.search(graph, (asked * 3, vectors[asked]), 20)
        right = 0
        for q in asked:
            exact = vectors @ vectors[q]
            exact[q] = -np.inf
            mine = found[who == q * 3] // 3
            assert len(mine) == 20 and q not in mine
            assert np.allclose(scores[who == q * 3], exact[mine], rtol=1e-12)
            right += len(set(np.argsort(-exact)[:20]) & set(mine.tolist()))
        assert right >= 0.93 * 2000


def test_a_search_visits_few_nodes():
    """20,000 vectors without any clusters, the hardest kind: found by a walk over a small part of them."""
    vectors = np.random.default_rng(9).normal(size=(20_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    graph, asked = hnsw.build(np.arange(20_000), vectors), np.arange(0, 20_000, 100)
    visited = np.zeros(len(asked), int)
    who, found, _ = hnsw.search(graph, (asked, vectors[asked]), 20, visited=visited)
    assert visited.max() < 0.25 * 20_000 and visited.mean() < 0.2 * 20_000
    right = 0
    for q in asked:
        exact = vectors @ vectors[q]
        exact[q] = -np.inf
        right += len(set(np.argsort(-exact)[:20]) & set(found[who == q].tolist()))
    assert right >= 0.9 * 20 * len(asked)


def test_graph_is_the_same_again():
    vectors = np.random.default_rng(8).normal(size=(400, 8))
    one, two = (hnsw.build(np.arange(400), vectors) for _ in range(2))
    assert all(np.array_equal(a, b) for a, b in zip(one.links, two.links))


def test_query_recall(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.table(spark, folder, "embeddings").collect()
    ids = [r["vec_id"] for r in rows]
    vectors = [np.float64(r["embedding"]).tolist() for r in rows]
    want = {(q, i) for q, _, i, _ in nearest(ids, vectors, [i for i in ids if i % 20 == 0], 20)}
    found = {(r["query_id"], r["vec_id"]) for r in queries.op4_hnsw(spark, folder).collect()}
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)


def test_best_breaks_ties_by_id():
    asked, found, scores = np.array([1, 1, 1, 2]), np.array([9, 3, 5, 1]), np.array([7, 7, 8, 0])
    assert blocks.best(asked, found, scores, 2).tolist() == [2, 1, 3]
