import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import cases
from starling.llm import queries, resampling

TARGET = [(1, "one two three\nfour five"), (2, None), (3, "Second line here and one two"), (4, "")]


def plain_features(text, buckets=10_000):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [zlib.crc32(f.encode()) % buckets for f in words + [" ".join(p) for p in zip(words, words[1:])]]


def plain(rows, target, buckets=10_000, percent=25, least_words=20, seed=7):
    """Per row in order: id, n_features, weight, score, rank."""
    made = [plain_features(t, buckets) for _, t in rows]
    s = Counter(b for _, f in made for b in f)
    t = Counter(b for _, text in target for b in plain_features(text, buckets)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out, fit = [], []
    for (i, _), (words, found) in zip(rows, made):
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None])
        fit += [out[-1]] if words >= least_words else []
    # Rows without an id come first among ties, as in Spark's order.
    for rank, row in enumerate(sorted(fit, key=lambda r: (-r[3], r[0] is not None, r[0]))[:percent * len(fit) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def target(spark):
    return spark.createDataFrame(TARGET, "item_id bigint, text string")


@pytest.mark.parametrize("options", [{}, {"buckets": 40_000, "percent": 60, "least_words": 3, "seed": 1}, {"buckets": 3}])
@pytest.mark.parametrize("clashing", [False, True])
def test_odd_documents(spark, options, clashing):
    df = cases.documents(spark, clashing=clashing)
    got = resampling.ranked(df, target(spark), **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert found(got) == plain([(r[0], r[1]) for r in cases.ROWS], TARGET, **options)


def test_lines_in_every_position(spark):
    texts = ["a b\nc", "a b\n\n \n- c d\ne\r\nf g", "\na", "a\n", "x\n" * 30 + "y", "A\nB\nC\n", "--\n!!\n", "ß\n日本\x0b語\ta",
             "a b\nc", " x\n y", "9\n8 7\n", "ab\ncd_ef\ngh"]
    rows = list(enumerate(texts))
    got = resampling.ranked(cases.texts(spark, *rows), target(spark), least_words=1, percent=50)
    assert found(got) == plain(rows, TARGET, least_words=1, percent=50)


def test_counts_of_texts(spark):
    rows = [(1, "Same line here\nother"), (2, "same LINE here\nother"), (3, "same line here")]
    got = {r["bucket"]: r["n"] for r in resampling.text_counts(cases.texts(spark, *rows), "text").collect()}
    assert got == Counter(b for _, t in rows for b in plain_features(t)[1])
    cut = cases.texts(spark, *rows).select(F.split(F.lower("text"), "\n").alias("lines"))
    lines = resampling._distinct_lines(cut, 10_000).collect()
    assert sorted(r["n"] for r in lines) == [2, 3]                 # each taken apart once


def test_seams_of_a_long_text_without_a_break(spark):
    rows = [(1, "x" * 300_000), (2, "\n" * 100_000 + "a"), (3, "a\n" * 50_000)]
    assert found(resampling.ranked(cases.texts(spark, *rows), target(spark))) == plain(rows, TARGET)


def test_empty_tables(spark):
    none = cases.documents(spark, [])
    assert resampling.ranked(none, target(spark)).collect() == []
    rows = [(i, f"word{i} " * 30) for i in range(8)]
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert found(resampling.ranked(cases.texts(spark, *rows), empty)) == plain(rows, [])


def test_ties_and_repeats(spark):
    rows = [(5, "a b c " * 10)] * 4 + [(6, "a b c " * 10), (None, "a b c " * 10), (None, "d " * 25)]
    got = found(resampling.ranked(cases.texts(spark, *rows), target(spark), percent=100))
    assert sorted(r[4] for r in got) == list(range(1, 8))
    assert sorted(r[:4] for r in got if r[0] is not None) == sorted(
        r[:4] for r in plain(rows, TARGET, percent=100) if r[0] is not None)


def test_drawn_rows_keep_their_columns(spark):
    rows = [(i, f"one two three word{i} " * (1 + i), "en", "s", i) for i in range(40)]
    df = cases.documents(spark, rows, clashing=True)
    drawn = resampling.resample(df, target(spark))
    assert drawn.columns == df.columns
    want = {r[0] for r in plain([(r[0], r[1]) for r in rows], TARGET) if r[4]}
    assert {r["doc_id"] for r in drawn.collect()} == want and len(want) == 9
    assert all(r["text"] == rows[r["doc_id"]][1] for r in drawn.collect())


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, folder, "documents").collect()]
    wanted = [(r["item_id"], r["text"]) for r in queries.table(spark, folder, "benchmark").collect()]
    assert found(queries.op13_resampling(spark, folder)) == plain(rows, wanted)
