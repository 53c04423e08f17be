import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings as rounds, strategies as st
from pyspark.sql import functions as F

import cases
from starling.llm import byte_bpe, pieces, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def words():
    return byte_bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={token: i for i, token in enumerate(words.token)})


def numbers(raw):
    return np.frombuffer(raw, "<u4").tolist()


@rounds(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbst'  \n\t dlevrm09é日€…²ǅ\x85\xa0 \x1c\U0001f600"), max_size=40), max_size=6))
def test_ids_are_those_of_the_library(texts):
    words = byte_bpe.vocabulary(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks={token: i for i, token in enumerate(words.token)})
    assert [numbers(x) for x in words.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_contractions_and_blanks(words, library):
    odd = ["'s't's don't I'LL we'll '' 's\n\n x  y\t\tz    \x85q", " '", "'", "a'", "'s", "  ", "a  ", "''s", " 's x's", ""]
    assert [numbers(x) for x in words.encode(odd)] == [library.encode_ordinary(t) for t in odd]


def test_long_pieces_and_hash_collisions(words, library, monkeypatch):
    long = ["a" * 3000, "ab" * 2000, "日本" * 600, "x" * 257, "x" * 256]
    assert [numbers(x) for x in words.encode(long)] == [library.encode_ordinary(t) for t in long]
    monkeypatch.setattr(pieces, "_SPREAD", np.ones(256, np.uint64))       # many pieces get one hash
    text = ["the hat eth teh cat act hat eht"]
    assert [numbers(x) for x in words.encode(text)] == [library.encode_ordinary(t) for t in text]


def test_slices_do_not_change_ids(words):
    rows = [t or "" for _, t, *_ in cases.ROWS]
    one_by_one = [words.encode([t])[0] for t in rows]
    assert words.encode(rows) == one_by_one


def test_columns_on_odd_rows(spark, library):
    df = cases.documents(spark, clashing=True)
    ids = byte_bpe.encode(F.col("text"), PATH)
    rows = (df.withColumn("coded", ids).withColumn("back", byte_bpe.decode(F.col("coded"), PATH))
            .withColumn("list", byte_bpe.id_list(F.col("coded"))).collect())
    assert len(rows) == len(cases.ROWS) and "ids" in rows[0]
    for row in rows:
        text = row["text"] or ""
        assert numbers(row["coded"]) == row["list"] == library.encode_ordinary(text)
        assert bytes(row["back"]).decode() == text
    assert df.limit(0).select(ids).collect() == []
    with pytest.raises(ValueError):
        byte_bpe.encode(F.col("text"), PATH, r"\w+")


def test_query_against_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    found = {r["doc_id"]: r for r in queries.op1_byte_bpe(spark, folder).collect()}
    rows = queries.table(spark, folder, "documents").collect()
    assert len(found) == len(rows)
    for row in rows:
        ids = np.array(library.encode_ordinary(row["text"] or ""), "<u4")
        digest = found[row["doc_id"]]
        assert (digest["n_tokens"], digest["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert digest["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
