import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import cases
from starling.llm import components, jaccard
from starling.llm.batches import stored

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = BLANKS.findall((text or "").translate(str.maketrans(jaccard.UPPER, jaccard.LOWER)))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def plain(rows):
    """{key: (n_shingles, component, n_links, n_copies)} by comparing all with all."""
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}
    links = {k: set() for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    if sets[a] != sets[b]:
                        links[a].add(sets[b])
                        links[b].add(sets[a])
                    old, new = max(root[a], root[b]), min(root[a], root[b])
                    root = {k: new if r == old else r for k, r in root.items()}
    return {k: (len(s), root[k], len(links[k]), sum(s == t for t in sets.values()) if s else 1)
            for k, s in sets.items()}


def found(df, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"], r["n_copies"])
            for r in jaccard.link(df, **options).collect()}


def corpus(n=220, seed=1):
    """Families of texts that differ in more and more words, copies, and a passage that half of all hold."""
    pick = random.Random(seed)
    word = lambda: f"w{pick.randint(0, 4000)}"
    passage = " ".join(word() for _ in range(14))
    rows, family = [], []
    for i in range(n):
        if not family or pick.random() < 0.25:
            family = [word() for _ in range(pick.choice([1, 3, 4, 5, 6, 8, 30, 60, 200]))]
            if pick.random() < 0.5:
                family += passage.split()
        if pick.random() < 0.7 and len(family) > 5:
            family = list(family)
            for _ in range(pick.choice([0, 1, 1, 2, 4])):
                family[pick.randrange(len(family))] = word()
        rows.append((i, pick.choice([" ", "\n", "\t "]).join(family)))
    pick.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed=seed)
        assert found(cases.texts(spark, *rows)) == plain(rows)


def test_small_tasks_give_the_same(spark):
    rows = corpus(seed=3) + [(1000 + i, " ".join(f"hot{j}" for j in range(60)) + f" end{i}") for i in range(60)]
    df = cases.texts(spark, *rows)
    assert found(df, task_shingles=500) == found(df) == plain(rows)


def test_threshold_is_met_exactly(spark):
    words = [f"w{i}" for i in range(13)]                      # nine shingles
    rows = [(1, " ".join(words)), (2, " ".join(words[1:])), (3, " ".join(words[:9])), (4, " ".join(words[:8]))]
    assert plain(rows)[1][1] == 1 and found(cases.texts(spark, *rows)) == plain(rows)
    exact = [(1, " ".join(words[:9])), (2, " ".join(words[:8]))]      # 4 of 5 shingles
    assert found(cases.texts(spark, *exact)) == {1: (5, 1, 1, 1), 2: (4, 1, 1, 1)}


def test_links_of_links(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(9 - k, " ".join(base[k * 5:k * 5 + 60])) for k in range(5)]
    want = plain(rows)
    assert len({w[1] for w in want.values()}) == 1 and found(cases.texts(spark, *rows)) == want


def test_odd_rows(spark):
    out = jaccard.link(cases.documents(spark, clashing=True)).collect()
    assert len(out) == len(cases.ROWS)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    n = len(shingles(cases.ROWS[0][1]))
    assert by[1] == [(n, 1, 0, 3)] and by[2] == [(n, 1, 0, 3)] * 2
    assert by[3] == by[4] == [(0, 3, 0, 1)] or (by[3], by[4]) == ([(0, 3, 0, 1)], [(0, 4, 0, 1)])
    assert sorted(r[1] is None for r in by[None]) == [True, True]
    assert by[6][0][0] == len(shingles(cases.LONG)) and by[8] == [(0, 8, 0, 1)] and by[7] == [(1, 7, 0, 1)]
    assert found(cases.texts(spark)) == {}


def test_rows_of_one_key_are_one_document(spark):
    out = jaccard.link(cases.texts(spark, (1, "a b c d e f g"), (1, "quite another text of its own"), (2, "a b c d e f g")))
    assert {r["component_id"] for r in out.collect()} == {1}


def test_case_and_blanks(spark):
    rows = [(1, "A b\tC d\x0be F"), (2, "a B c D e f"), (3, "a b c d e f"), (4, "É b c d e f"), (5, "é b c d e f")]
    assert found(cases.texts(spark, *rows)) == plain(rows)


def test_both_ways_of_counting_agree():
    pick = np.random.default_rng(4)
    base = pick.choice(10**6, 120, replace=False)
    sets = [np.unique(np.concatenate([base[pick.random(120) > 0.1], pick.choice(10**6, 6)])) for _ in range(150)]
    ids, sizes = np.arange(150) * 7, np.array([len(s) for s in sets])
    count, forest = jaccard.links_among(ids, sizes, sets)
    similar = [[len(np.intersect1d(a, b)) * 100 >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets]
    assert (count == np.array(similar).sum(1) - 1).all() and len(forest) < 150
    side = np.arange(150) % 2
    crossed, _ = jaccard.links_among(ids, sizes, sets, side)
    assert (crossed == (np.array(similar) & (side[:, None] != side)).sum(1)).all()


def test_components(spark):
    pick = random.Random(6)
    links = [(pick.randrange(400), pick.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    root = {x: x for pair in links for x in pair}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    out = components.components(spark.createDataFrame(pd.DataFrame(links, columns=["a", "b"])))
    assert {r["node"]: r["component"] for r in out.collect()} == {k: v for k, v in root.items() if k != v}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
    assert out.where(F.col("node") <= F.col("component")).count() == 0


def test_merging_touches_only_the_window():
    sizes = np.array([5, 6, 7, 8, 9])
    lists = jaccard.Lists(sizes, np.array([0, 3, 5, 5, 9]), np.array([0, 2, 4, 1, 2, 0, 1, 2, 3]))
    texts, count = lists.merged(np.array([0, 1, 2, 3]), 1, 4)
    assert dict(zip(texts.tolist(), count.tolist())) == {1: 2, 2: 3, 3: 1}
    assert lists.merged(np.array([2]), 0, 5)[0].tolist() == []


def test_many_short_texts_take_time_in_proportion():
    import time

    def seconds(n):
        pick = np.random.default_rng(n)
        sets = [np.unique(pick.integers(0, 10 ** 9, 6)) for _ in range(n)]
        start = time.perf_counter()
        count, forest = jaccard.links_among(np.arange(n), np.array([len(s) for s in sets]), sets)
        assert not count.any() and not forest
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(100_000) < 12 * 5 * max(seconds(20_000), 0.2)


def test_texts_that_share_one_passage_are_one_tied_group(spark):
    """A passage that all hold ties texts that are not alike; each in blocks of a few texts still finds its copies."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} " + " ".join(f"w{i // 2}x{j}" for j in range(90)) + (" end" if i % 2 else "")) for i in range(60)]
    df = cases.texts(spark, *rows)
    assert found(df, task_shingles=400) == plain(rows)


def test_each_shuffle_is_read_twice(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    sets = cases.texts(spark).select(F.col("doc_id").alias("rep"), F.lit(1).cast("bigint").alias("n"),
                                     F.array(F.xxhash64("text")).alias("sh"))
    sets = stored(sets, "test")
    by_shingle = jaccard._by_frequency(sets)._jdf.queryExecution().executedPlan().toString()
    assert by_shingle.count("ReusedExchange") == 1
    rows = sets.select(F.col("rep").alias("id"), "n", F.col("rep").alias("h1"), F.col("rep").alias("h2"), F.col("sh").alias("first"))
    rows = stored(rows, "test")
    pairable = jaccard._pairable(rows)._jdf.queryExecution().executedPlan().toString()
    assert pairable.count("ReusedExchange") == 1
