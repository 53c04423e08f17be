from hypothesis import given, settings as rounds, strategies as st

import cases
from starling.llm import line_dedup


def plain(rows):
    """Kept text and number of removed lines for (key, text) rows in order of key."""
    seen, out = set(), []
    for key, text in rows:
        if text is None:
            out.append((key, None, 0))
            continue
        lines, covered = text.split("\n"), set()
        for at in range(len(lines) - 2):
            three = tuple(lines[at:at + 3])
            if "".join(three).strip(" "):
                if three in seen:
                    covered.update((at, at + 1, at + 2))
                seen.add(three)
        out.append((key, "\n".join(x for i, x in enumerate(lines) if i not in covered), len(covered)))
    return out


def found(df):
    return sorted(((r["doc_id"], r["text"], r["lines_removed"]) for r in line_dedup.remove_repeats(df).collect()),
                  key=lambda r: (r[0] is not None, r))


def test_against_plain_python(spark):
    import random
    pick = random.Random(2)
    rows = [(i, "\n".join(pick.choice("abc ") for _ in range(pick.randint(0, 12)))) for i in range(60)]
    assert found(cases.texts(spark, *rows)) == plain(rows)


def test_overlaps_merge_and_first_stays(spark):
    passage = "p1\np2\np3\np4\np5"
    rows = [(1, "a\n" + passage + "\nb"), (2, passage), (3, "x\n" + passage + "\ny\n" + passage), (4, "p1\np2"),
            (5, "p1\np2\nother"), (6, None), (7, ""), (8, "p2\np3\np4\nend")]
    assert found(cases.texts(spark, *rows)) == [
        (1, "a\n" + passage + "\nb", 0), (2, "", 5), (3, "x\ny", 10), (4, "p1\np2", 0), (5, "p1\np2\nother", 0),
        (6, None, 0), (7, "", 0), (8, "end", 3)]


def test_odd_rows(spark):
    df = cases.documents(spark, clashing=True)
    out = line_dedup.remove_repeats(df)
    assert out.columns == [*df.columns, "lines_removed"]
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r["doc_id"], []).append((r["text"], r["lines_removed"]))
        assert r["_lines"] == 7
    assert by_id[1] == [(cases.ROWS[0][1], 0)] and by_id[2] == [("", 4), ("", 4)]    # repeated rows alike
    assert by_id[4] == [(None, 0)] and by_id[8] == [("\n\n\n\n", 0)] and by_id[6][0][0] == cases.LONG
    assert len(by_id[None]) == 2


def test_key_without_value_comes_first(spark):
    text = "a\nb\nc"
    out = found(cases.texts(spark, (1, text), (None, text)))
    assert out == [(None, text, 0), (1, "", 3)]


def test_existing_column_and_empty_table(spark):
    df = cases.texts(spark, (1, "a\nb\nc"), (2, "a\nb\nc")).selectExpr("*", "9 AS lines_removed")
    out = line_dedup.remove_repeats(df)
    assert out.columns == df.columns and sorted(r["lines_removed"] for r in out.collect()) == [0, 3]
    assert line_dedup.remove_repeats(df.limit(0)).collect() == []
    assert line_dedup.remove_repeats(df, removed=None).columns == df.columns


def test_native_and_split_when_hot(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    df = cases.texts(spark, *[(i, f"same\nlines\nhere\nown {i}") for i in range(300)])
    out = line_dedup.remove_repeats(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Window" not in plan
    assert sum(r["lines_removed"] for r in out.collect()) == 299 * 3


@rounds(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("ab "), max_size=9))
def test_plain_version_removes_nothing_alone(lines):
    text = "\n".join(lines)
    key, kept, n = plain([(1, text)])[0]
    assert len(kept.split("\n")) + n in (len(text.split("\n")), len(text.split("\n")) + 1)


def test_texts_that_share_a_key_or_have_none_are_told_apart(spark):
    shared = "one line here\nand a second one\nand the third"
    texts = [f"{shared}\nown line {i}" for i in range(6)]
    for key in (None, 0, 2 ** 63 - 1, -2 ** 63):
        df = spark.createDataFrame([(key, t) for t in texts], "doc_id bigint, text string")
        rows = line_dedup.remove_repeats(df).collect()
        assert sorted(r["lines_removed"] for r in rows) == [0] + [3] * 5
        assert sorted(r["text"].split("\n")[-1] for r in rows) == [f"own line {i}" for i in range(6)]
