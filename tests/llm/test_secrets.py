import random
import re

import pytest
from pyspark.sql import functions as F

import cases
from starling.llm import secrets

CANDIDATE = re.compile(secrets.CANDIDATE)
HEX, UP, LOW = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz"


def rows(n=240, seed=1):
    """Texts and the secrets that each holds; among them numbers, paths and addresses that are none."""
    pick = random.Random(seed)
    some = lambda chars, k: "".join(pick.choice(chars) for _ in range(k))
    out = []
    for i in range(n):
        words = [pick.choice(["with", "that", "thing", "from", "here", "ration"]) for _ in range(pick.randint(4, 30))]
        held, kind = [], i % 6
        if kind == 0:
            held.append("AKIA" + some(UP, 16))
            words.insert(3, held[0] + pick.choice(["", ".", ","]))
        elif kind == 1:
            held.append(some(HEX, 39) + "a1"[:2])
            words.insert(2, f'token = "{held[0]}"')
        elif kind == 2:
            held.append("1" + some(HEX, 17) + "b")
            words.insert(2, f"password={held[0]}")
        elif kind == 3:
            words.insert(2, some("0123456789", 16))
        elif kind == 4:
            words.insert(2, f"https://host{i}.example.com/path/to/the/{some(LOW, 12)}{i}")
        else:
            words.insert(2, some(LOW, 18) + str(i % 10))
        out.append((i, " ".join(words[:4]) + "\n" + " ".join(words[4:]), held))
    return out


@pytest.fixture(scope="module")
def found(spark):
    return secrets.scan(cases.texts(spark, *[(i, t) for i, t, _ in rows()])).persist()


def test_places_are_exact(spark):
    data = [(i, t) for i, t, _ in rows(60)] + [
        (900, "key=aaaaaaaaaaaaaaaa1;bbbbbbbbbbbbbbbb2"), (901, "é日\U0001f600 x\t0123456789abcdef0 end"),
        (902, None), (903, ""), (904, "password: correcthorsebatterystaple"), (905, "justaverylongordinaryword")]
    out = sorted((r["_key"], r["start"], r["candidate"]) for r in secrets.candidates(cases.texts(spark, *data)).collect())
    want = []
    for key, text in data:
        for m in CANDIDATE.finditer(text or ""):
            before = text[:m.start()]
            named = re.search(r"[=:]\s*[\"']?$", before) and re.search(secrets.NAMES, " ".join(before.split()[-2:]))
            if re.search("[0-9]|^[A-Z]+$", m.group()) or named:
                want.append((key, m.start(), m.group()))
    assert out == sorted(want)


def test_secrets_are_told_from_others(found):
    held = {(i, s) for i, _, some in rows() for s in some}
    said = {(r["_key"], r["candidate"]) for r in found.where("is_secret").collect()}
    assert said == held
    assert found.where("NOT is_secret").count() > 0


def test_forest_judges_what_the_form_leaves_open(spark, found):
    model = secrets.fit(found)
    new = cases.texts(spark, (1, f"here secret = \"{'9f8e7d6c5b4a' * 3}\" with that"), (2, "call 5551234567890123 with that"))
    judged = secrets.judged(secrets.with_features(secrets.candidates(new), ["with", "that"]), model)
    assert {r["_key"]: r["is_secret"] for r in judged.collect()} == {1: True, 2: False}


def test_features(spark):
    df = cases.texts(spark, (1, "token = \"abcd1234withABCD\" next"))
    r = secrets.with_features(secrets.candidates(df), ["with", "abcd", "zzzz"]).first()
    f = dict(zip(secrets.FEATURES, r["features"].toArray().tolist()))
    assert f["length"] == 16 and f["digits"] == 0.25 and f["capitals"] == 0.25 and f["changes"] == 2 / 16
    assert f["covered"] == 0.5 and f["longest_word"] == 0.5 and f["distinct"] == 1
    assert f["assigned"] == f["quoted"] == f["named_before"] == f["word_after"] == 1 and f["hexadecimal"] == 0


def test_labelled_findings_of_the_caller(spark, found):
    none = found.withColumn("label", F.lit(0))
    out = secrets.scan(cases.texts(spark, (1, "x 1234567890123456 y")), labelled=none).collect()
    assert [(r["score"], r["is_secret"]) for r in out] == [(1.0, True)]         # one class only: nothing is removed


def test_mask(spark, found):
    df = cases.texts(spark, *[(i, t) for i, t, _ in rows()], (5000, None), (5001, "")).withColumn("_row", F.lit(1))
    out = {r["doc_id"]: r["text"] for r in secrets.mask(df, found).collect()}
    for i, text, held in rows():
        for s in held:
            text = text.replace(s, secrets.MASK)
        assert out[i] == text
    assert out[5000] is None and out[5001] == "" and secrets.mask(df, found).columns == df.columns


def test_odd_rows(spark):
    df = cases.documents(spark, clashing=True)
    out = secrets.scan(df, path="source")
    assert out.where("is_secret").select("_key").distinct().count() <= out.count()
    assert secrets.mask(df, out).count() == len(cases.ROWS)
    assert secrets.scan(df.limit(0)).collect() == []


def test_native(spark, found):
    plan = secrets.mask(cases.texts(spark, (1, "a")), found)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_corpus_without_secrets_stays_as_it_is(spark):
    """Numbers, hashes, paths and UUIDs only: no form-labelled secret to learn from."""
    clean = [(1, "call 5551234567890123 with that"), (2, "at commit " + "9f8e7d6c5b" * 4 + " here"),
             (3, "see https://host.example.com/path/to/thing12345678901234 next"),
             (4, "row 123e4567-e89b-12d3-a456-426614174000 here"), (5, "the HttpServerConnectionPool2 class")]
    df = cases.texts(spark, *clean)
    found = secrets.scan(df)
    assert {r["is_secret"] for r in found.collect()} == {False}
    assert dict(secrets.mask(df, found).collect()) == dict(clean)


def test_one_class_by_form_leaves_the_rest_to_the_stored_examples(spark):
    key, bare = "AKIA" + "QRSTUVWXYZ012345", "Zq8Lk3Vt9Xw2Rb7Nc4Md6Pf1Hs5Jg0Ty"
    only_secrets = cases.texts(spark, (1, f"with {key} here"), (2, f"see {bare} and"))
    assert {r["candidate"]: r["is_secret"] for r in secrets.scan(only_secrets).collect()} == {key: True, bare: True}
    none = cases.texts(spark, (1, "call 5551234567890123 with that"), (2, f"see {bare} and"))
    assert {r["candidate"]: r["is_secret"] for r in secrets.scan(none).collect()} == {"5551234567890123": False, bare: True}


def test_examples_are_labelled_by_their_form(spark):
    known = secrets.label_by_form(secrets.candidates(secrets.examples(spark), "i", "t"))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    assert set(n) == {0, 1} and sum(n.values()) == secrets.EXAMPLES
