import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from starling.llm import toxicity

S = toxicity.SYMBOLS
ROOTS = ("grimbol", "snarvok", "zuthrek")


def symbols(text):
    out = []
    for c in text.lower():
        code = (ord(c) - 96 if "a" <= c <= "z" else 27 if c in "0123456789" else 1 + ord(c) % 26 if c.isalpha() else 0)
        if code or not out or out[-1]:
            out.append(code)
    return out


def test_grams_in_order():
    texts = ["ab  cd", "", "x", "--", "日a", "id1ot 22", "Ты ИДИОТ, κακός", "ты идиот, ΚΑΚΌ"]
    codes, sizes = toxicity.grams(texts)
    want = []
    for text in texts:
        padded = [0, 0, 0, 0, *symbols(text)]
        want += [sum(s * S ** (4 - k) for k, s in enumerate(padded[i:i + 5])) for i in range(len(padded) - 4)]
    assert codes.tolist() == want and sizes.tolist() == [len(symbols(t)) for t in texts]
    assert toxicity.symbol_table()[[ord(c) for c in "éÉñÇa"]].tolist() == [5, 5, 14, 3, 1]


def test_scripts_and_digits_make_shapes_of_their_own():
    def codes(text):
        return toxicity.grams([text])[0].tolist()
    for one, other in (("ты идиот и дурак", "мы пирог и салат"), ("id1ot", "id ot"), ("κακός", "καλός"), ("笨蛋", "天才")):
        assert codes(one) != codes(other)
    assert codes("ИДИОТ") == codes("идиот") and codes("ΚΑΚΌ") == codes("κακό")


def test_toxic_words_of_other_scripts_are_learned(spark):
    pick = random.Random(6)
    clean = {"ru": "мы вчера были дома и пили чай с мёдом утром когда пришла почта".split(),
             "el": "σήμερα πήγαμε στην αγορά για ψωμί και τυρί με τα παιδιά".split(),
             "zh": "今天 我们 去 市场 买 面包 和 水果 然后 回家 吃饭".split()}
    bad = {"ru": "идиот дурак подонок".split(), "el": "ηλίθιε κάθαρμα βλάκα".split(), "zh": "笨蛋 混蛋 白痴".split()}
    rows = []
    for i in range(600):
        name, toxic = list(clean)[i % 3], int(pick.random() < 0.5)
        words = [pick.choice(clean[name]) for _ in range(12)]
        for _ in range(3 * toxic):
            words[pick.randrange(12)] = pick.choice(bad[name])
        rows.append((i, " ".join(words), toxic))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    fitted = toxicity.fit(df.where("doc_id < 450"))
    held = df.where("doc_id >= 450").withColumn("score", toxicity.score(spark, fitted, F.col("text"))).collect()
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in held) >= 0.95 * len(held)


def plain_kneser_ney(texts, both):
    """P(symbol | four before) of one class from dictionaries; ``both``: texts of either class, for the low orders."""
    def full(some):
        n = {}
        for t in some:
            padded = (0, 0, 0, 0, *symbols(t))
            for i in range(len(padded) - 4):
                n[padded[i:i + 5]] = n.get(padded[i:i + 5], 0) + 1
        return n

    def shorter(n):
        out = {}
        for g in n:
            out[g[1:]] = out.get(g[1:], 0) + 1
        return out

    def discount(n):
        once, twice = (sum(v == k for v in n.values()) for k in (1, 2))
        return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5

    five = full(texts)
    four = shorter(five)
    three = shorter(four)
    two = {}
    for group in both:
        for g, v in shorter(shorter(shorter(full(group)))).items():
            two[g] = two.get(g, 0) + v
    orders = [shorter(two), two, three, four, five]

    def p(gram):
        found = 1 / S
        for k, n in enumerate(orders, 1):
            g = gram[-k:]
            same = [v for h, v in n.items() if h[:-1] == g[:-1]]
            if same:
                d = discount(n)
                found = (max(n.get(g, 0) - d, 0) + d * len(same) * found) / sum(same)
        return found

    return p


def test_ratios_are_those_of_plain_kneser_ney():
    ordinary, toxic = ["the cat sat", "a cat and the hat"], ["the bad cat", "bad bad"]
    counts = []
    for texts in (ordinary, toxic):
        code, _ = toxicity.grams(texts)
        counts.append(np.bincount(code, minlength=S ** 5))
    code = np.flatnonzero(counts[0] + counts[1])
    ratios = toxicity.log_ratios(code, counts[0][code], counts[1][code])
    p0, p1 = (plain_kneser_ney(t, (ordinary, toxic)) for t in (ordinary, toxic))
    for text in ("the bad cat", "zebra", "a cat", "cab at"):
        for c in toxicity.grams([text])[0].tolist():
            gram = tuple(c // S ** (4 - k) % S for k in range(5))
            assert np.isclose(ratios[c], np.log(p1(gram) / p0(gram)), atol=0.01)


def test_features_against_loops():
    ratios = np.random.default_rng(3).normal(size=S ** 5).astype(np.float16)
    texts = ["some words here, and more of them than a passage holds", "", "ab", "?"]
    for text, row in zip(texts, toxicity.features(ratios, texts)):
        values = ratios[toxicity.grams([text])[0]].astype(float)
        sums = [values[max(0, i + 1 - toxicity.PASSAGE):i + 1].sum() / toxicity.PASSAGE for i in range(len(values))]
        assert np.allclose(row, [max(sums, default=0.0), values.mean() if len(values) else 0.0])


def rows(n=600, seed=1):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice(["the", "an", "er", "on", "ing", "ha", "sto"]) for _ in range(pick.randint(1, 3)))
    out = []
    for i in range(n):
        words, bad = [word() for _ in range(pick.randint(5, 200))], i % 4 == 0
        for _ in range(pick.randint(1, 3) if bad else 0):
            words.insert(pick.randrange(len(words)), pick.choice(ROOTS) + word())
        out.append((i, " ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.createDataFrame(rows(), "doc_id bigint, text string, toxic int"))


def test_unseen_texts(spark, model):
    df = spark.createDataFrame(rows(300, 2), "doc_id bigint, text string, toxic int")
    found = df.withColumn("s", toxicity.score(spark, model, F.col("text"))).collect()
    assert all(0 <= r["s"] <= 1 for r in found)
    assert sum((r["s"] >= toxicity.THRESHOLD) == r["toxic"] for r in found) >= 0.97 * len(found)


def test_one_bad_sentence_in_a_long_text(spark, model):
    clean = " ".join(t for _, t, bad in rows(200, 5) if not bad)
    df = cases.texts(spark, (1, clean), (2, clean[:5000] + " grimbol snarvok zuthrek " + clean[5000:]), (3, None), (4, ""))
    found = dict(df.select("doc_id", toxicity.score(spark, model, F.col("text"))).collect())
    assert found[2] > 0.7 > found[1] and found[3] == found[4] < 0.7


def test_odd_rows_and_missing_labels(spark, model):
    df = cases.documents(spark, clashing=True)
    assert all(0 <= r["s"] <= 1 for r in df.withColumn("s", toxicity.score(spark, model, F.col("text"))).collect())
    one_class = df.withColumn("toxic", F.lit(0))
    none = toxicity.fit(one_class)
    assert {r[0] for r in df.select(toxicity.score(spark, none, F.col("text"))).collect()} == {0.0}
    assert toxicity.fit(one_class.limit(0)).ratios is None
    strange = df.withColumn("toxic", F.when(F.col("doc_id") == 1, 1).when(F.col("doc_id") == 6, 0).when(
        F.col("doc_id") == 5, 3))
    few = toxicity.fit(strange)
    assert few.ratios is None or len(few.weights) == 2
