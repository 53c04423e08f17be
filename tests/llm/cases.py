"""Small tables of odd documents that every operator must get through."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns of a table that bear names the operators might use themselves.
CLASHING = ("_key", "_hash", "_lines", "_covered", "_row", "rep", "n", "id", "v", "ids", "piece", "length", "number", "t",
            "label", "features", "score", "_removed", "component", "sh")

LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(20_000))
ROWS = [
    (1, "One two three four five six seven.\nSecond line here.\nThird line here.\nFourth line.", "en", "a", 10),
    (2, "One two three four five six seven.\nSecond line here.\nThird line here.\nFourth line.", "en", "a", 10),
    (2, "One two three four five six seven.\nSecond line here.\nThird line here.\nFourth line.", "en", "a", 10),
    (3, "", "en", "a", 0),
    (4, None, None, None, None),
    (None, "A row without an id, with words enough to be shingled twice over.", "en", None, 5),
    (None, None, None, None, None),
    (5, "12 34 -- !!", None, "b", 11),
    (6, LONG, "en", "b", len(LONG)),
    (7, "x" * 5000, None, "b", 5000),
    (8, "\n\n\n\n", "de", "b", 4),
    (9, "Größe über alles\tund weiter so… 日本語 \U0001f600 ¿qué?", "de", "c", 40),
    (10, " leading and trailing ", "en", "c", 22),
]


def documents(spark, rows=None, clashing=False):
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit(7).alias(c) for c in CLASHING])
    return df


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
