import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import cases
import corpus_pipeline as pipeline
from starling.llm import packing
from test_jaccard import plain as plain_links
from test_line_dedup import plain as plain_lines

PATH = public_tokenizers.path("word_bpe_49k.json")


def corpus():
    """English and German documents: unique ones, copies, near copies, shared passages, secrets, and junk."""
    pick = random.Random(9)
    english = ["the", "and", "that", "with", "thing", "here", "from", "ration", "other", "those", "when", "through"]
    german = ["der", "und", "eine", "keit", "schön", "nicht", "über", "durch", "wenn", "zwischen", "auch", "sein"]
    line = lambda words: " ".join(pick.choice(words) + pick.choice(["", "er", "ing", "en"]) for _ in range(12))
    rows, passage = [], [line(english) for _ in range(4)]
    for i in range(90):
        words, lang = (english, "en") if i % 3 else (german, "de")
        lines = [line(words) for _ in range(pick.randint(2, 9))]
        if i % 10 == 1:
            lines[1:1] = passage
        if i % 9 == 2:
            lines[0] += " AKIA" + "".join(pick.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
        if i % 9 == 5:
            lines[0] += " 4929" + "".join(pick.choice("0123456789") for _ in range(12))
        rows.append((i, "\n".join(lines), lang, f"src{i % 4}", 0))
    one_line = " ".join(line(english) for _ in range(6))
    rows += [(100 + k, one_line + f" last{k}", "en", "src0", 0) for k in range(4)]              # near copies
    rows += [(110 + k, rows[4][1], "en", "src0", 0) for k in range(3)]                           # copies
    rows += [(120, "12 34 !! --", "en", "s", 0), (121, "", "en", "s", 0), (122, None, "en", "s", 0),
             (None, "a text without any id, of the other kind", "en", None, 0)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    cases.documents(spark, corpus()).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    known = pipeline.known_language(spark, docs, folder)
    assert known.columns == columns
    kept = sorted((r for r in known.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    want = [r for r in corpus() if r[0] not in (120, 121, 122)]
    assert {r["doc_id"] for r in kept} == {r[0] for r in want}

    cut = pipeline.without_repeated_lines(spark, known, folder)
    lines = [(k, t) for k, t, n in plain_lines([(r["doc_id"], r["text"]) for r in kept]) if t or not n]
    assert cut.columns == columns
    assert sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=str) == sorted(lines, key=str)
    assert {110, 111, 112}.isdisjoint(r["doc_id"] for r in cut.collect())
    assert cut.where("n_chars != length(text)").count() == 0

    single = pipeline.one_of_each_group(spark, cut, folder)
    links = plain_links([x for x in lines if x[0] is not None])
    assert single.columns == columns
    assert {r["doc_id"] for r in single.collect()} == {k for k, (_, c, *_) in links.items() if c == k} | {None}
    assert {101, 102, 103}.isdisjoint(r["doc_id"] for r in single.collect())

    masked = pipeline.without_secrets(spark, single, folder)
    assert masked.columns == columns
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in masked.collect():
        assert "AKIA" not in r["text"] and r["n_chars"] == len(r["text"])
        assert ("AKIA" in before[r["doc_id"]]) == (r["text"] != before[r["doc_id"]])

    rows = pipeline.packed(spark, masked, folder).collect()
    words = packing.word_tokenizer(PATH)
    sizes = {r["doc_id"]: len(words.by_library([r["text"]])[0]) // 4 + 1 for r in masked.collect()}
    assert {r["doc_id"]: r["length"] for r in rows} == {k: n for k, n in sizes.items()}


def test_run_is_the_stages_in_turn(spark, folder):
    rows = pipeline.run(spark, folder).collect()
    assert [name for name, _ in pipeline.STAGES] == ["language", "line_dedup", "ngram_jaccard", "secrets", "packing"]
    total = np.sum([r["length"] for r in rows])
    assert len({r["sequence_id"] for r in rows}) == -(-total // 4096)


def test_odd_rows_and_empty_table(spark, tmp_path):
    for name, rows in (("odd", cases.ROWS), ("empty", [])):
        path = str(tmp_path / name)
        cases.documents(spark, rows, clashing=True).write.parquet(f"{path}/documents.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, docs, path).columns == docs.columns
        out = pipeline.run(spark, path).collect()
        assert bool(out) == bool(rows)
    # Of rows 1, 2 and 2 one stays; those without a letter, NULL texts among them, go.
    assert {r["doc_id"] for r in pipeline.run(spark, str(tmp_path / "odd")).collect()} <= {None, 1, 2, 6, 7, 9, 10}


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    pick = random.Random(4)
    text = lambda: " ".join("".join(pick.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    near, copied = text(), text()
    rows = [(0, text(), "en", "s", 0) for _ in range(6)] + [
        (0, near, "en", "s", 0), (0, near + " last", "en", "s", 0), (7, near, "en", "s", 0),      # one of these three
        (0, copied, "en", "s", 0), (0, copied, "en", "t", 0), (3, copied, "en", "s", 0),          # and of these
        (None, copied, "en", "s", 0), (None, None, "en", "s", 0), (None, None, "en", "s", 0)]
    kept = pipeline.one_of_each_group(spark, cases.documents(spark, rows), "").collect()
    texts = [r["text"] for r in kept if r["doc_id"] is not None]
    assert sorted(set(texts)) == sorted(texts) and len(texts) == 8
    assert {t for _, t, *_ in rows[:6]} < set(texts) and copied in texts
    assert {r["doc_id"] for r in kept} == {0, None} and sum(r["doc_id"] is None for r in kept) == 3


UNLIKE = {
    "Russian": "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 10,
    "Chinese": "人人生而自由，在尊严和权利上一律平等。" * 20,
    "Polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. " * 10,
    "Finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * 10,
    "noise": " ".join("".join(random.Random(i).choices("bcdfghjklmnpqrstvwxz", k=6)) for i in range(200)),
    "one letter": "x" * 3000,
    "base64": "".join(random.Random(1).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1500)),
}


def test_texts_unlike_every_language_go_and_mixed_ones_stay(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long = given.where("length(text) > 1500").groupBy("lang").agg({"text": "min"}).collect()
    mixed = "".join(t[at:at + 60] for at in range(0, 1500, 60) for _, t in sorted(long))
    extra = [(-1 - i, t, None, name, len(t)) for i, (name, t) in enumerate(UNLIKE.items())]
    extra += [(-100, mixed, None, "mixed", len(mixed)), (-101, UNLIKE["Russian"] + mixed, None, "partly", 0)]
    docs = given.unionByName(spark.createDataFrame(extra, cases.SCHEMA).select(
        *[F.col(c).cast(given.schema[c].dataType) for c in given.columns]))
    kept = {r["doc_id"] for r in pipeline.known_language(spark, docs, "").select("doc_id").collect()}
    assert {k for k in kept if k is not None and k < 0} == {-100, -101}
    lettered = given.where("text RLIKE '[a-zA-Z]' AND doc_id IS NOT NULL").select("doc_id").collect()
    assert {r["doc_id"] for r in lettered} <= kept
