"""Secrets in texts: candidates by form, and a random forest that removes the false ones.

A candidate is a run of 16 or more characters of keys and hashes that holds a digit, is in capitals, or is assigned to a
name such as ``password``. The forest judges it by length, by how often the kind of character changes, by how much of it the
corpus's common words cover, by the path it stands in (slashes and dots around it, and the path of its document)
and by neighbouring words. It learns from labelled findings; ``label_by_form`` labels those whose form leaves no doubt,
for a corpus without labels of its own. Where these are not of both classes, they stand as they are, and a forest learned
from ``examples`` judges the findings whose form does not tell.

DataFrame functions and Spark's own forest only. Texts are cut at single blanks, so places are exact. NULL and empty
texts have no candidate. Repeated rows give their findings each. If a caller's own labelled findings are not of both
classes, no finding is removed: all score 1.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from starling.session import settled

CANDIDATE = r"([A-Za-z0-9_+/\-]{16,})"
#: Names that secrets are assigned to.
NAMES = r"(?i)(pass|pwd|token|secret|api|key|auth|credential)"
MASK = "[SECRET]"
#: Bounds of what is fitted on: labelled findings of either class, and words in the dictionary.
SAMPLE_FINDINGS, DICTIONARY_WORDS = 10_000, 400
TREES, DEPTH = 24, 6
#: Stored examples, made from hashes of their numbers.
EXAMPLES = 800

FEATURES = (
    "length", "digits", "capitals", "changes", "distinct", "longest_word", "hexadecimal", "covered",
    "path_marks", "document_path_depth", "document_path_trial", "assigned", "quoted", "named_before", "word_after",
)


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per candidate: _key, _hash (of its text), start (characters before it), candidate, and what stands around it."""
    own_path = F.col(path) if path else F.lit(None)
    rows = (df.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), own_path.cast("string").alias("_path"),
                      F.col(text).alias("_text")).where(F.col("_text").rlike(CANDIDATE))
            .select("_key", "_hash", "_path", F.split("_text", r"[ \t\r\n]", -1).alias("_words")))
    def about(word, i):
        return F.struct(i.alias("at"), word.alias("word"))
    hits = F.filter(F.transform("_words", about), lambda x: x["word"].rlike(CANDIDATE))
    rows = rows.withColumn("_hit", F.explode(hits)).select(
        "_key", "_hash", "_path", F.col("_hit.word").alias("_word"), F.col("_hit.at").alias("_at"),
        F.get("_words", F.col("_hit.at") - 1).alias("_one"), F.get("_words", F.col("_hit.at") - 2).alias("_two"),
        F.get("_words", F.col("_hit.at") + 1).alias("_next"),
        (F.aggregate(F.slice("_words", F.lit(1), F.col("_hit.at")), F.lit(0), lambda n, w: n + F.length(w))
         + F.col("_hit.at")).alias("_offset"))
    # What stands before each candidate of a word: the pieces between them, in turn.
    found = F.regexp_extract_all("_word", F.lit(CANDIDATE), F.lit(1))
    between = F.split("_word", CANDIDATE, -1)
    rows = rows.withColumns({"_found": found, "_between": between}).select("*", F.posexplode("_found").alias("_nth", "candidate"))
    inner = F.aggregate(F.slice("_found", F.lit(1), F.col("_nth")), F.lit(0), lambda n, w: n + F.length(w)) + F.aggregate(
        F.slice("_between", F.lit(1), F.col("_nth") + 1), F.lit(0), lambda n, w: n + F.length(w))
    before = F.concat_ws(" ", "_two", "_one", F.get("_between", F.col("_nth")))
    rows = rows.select(
        "_key", "_hash", "_path", "_word", "candidate", (F.col("_offset") + inner).cast("bigint").alias("start"),
        before.alias("_before"), F.coalesce("_next", F.lit("")).alias("_after"))
    return rows.where(F.col("candidate").rlike("[0-9]") | F.col("candidate").rlike("^[A-Z]+$") | (
        F.col("_before").rlike(NAMES) & F.col("_before").rlike(r"[=:]\s*[\"']?$")))


def dictionary(df: DataFrame, text: str = "text", most: int = DICTIONARY_WORDS) -> list[str]:
    """The words of four to eight letters that most texts hold, counted over all texts."""
    words = F.filter(F.array_distinct(F.split(F.lower(text), "[^a-z]+")), lambda w: F.length(w).between(4, 8))
    rows = (df.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "w").limit(most).collect())
    return [r["w"] for r in rows]


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    c, low = F.col("candidate"), F.lower("candidate")
    length = F.length(c).cast("double")

    def share(kept):
        return F.length(F.regexp_replace(c, kept, "")) / length

    # A kind for each character, and then the runs of one kind.
    kinds = F.translate(low, "abcdefghijklmnopqrstuvwxyz0123456789_+/-", "a" * 26 + "0" * 10 + "----")
    changes = F.length(F.regexp_replace(kinds, r"(.)\1*", "$1")) - 1
    covered = F.aggregate(F.filter(F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>"),
                                   lambda w: F.contains(low, w)), F.lit(0), lambda n, w: n + F.length(w))
    marks = F.length(F.regexp_replace("_word", r"[^/.@:]", ""))
    depth = F.coalesce(F.length(F.regexp_replace("_path", "[^/]", "")), F.lit(0))
    numbers = {
        "length": length, "digits": share("[^0-9]"), "capitals": share("[^A-Z]"), "changes": changes / length,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / length,
        "longest_word": F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), lambda w: F.length(w))) / length,
        "hexadecimal": c.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "covered": F.least(F.lit(1.0), covered / length),
        "path_marks": marks, "document_path_depth": depth,
        "document_path_trial": F.coalesce(F.col("_path").rlike(r"(?i)test|example|sample|fixture|doc/"), F.lit(False)),
        "assigned": F.col("_before").rlike(r"[=:]\s*[\"']?$"), "quoted": F.col("_before").rlike("[\"']$"),
        "named_before": F.col("_before").rlike(NAMES), "word_after": F.col("_after").rlike("^[A-Za-z]+[.,;]?$"),
    }
    return found.withColumn("features", array_to_vector(F.array(*[numbers[f].cast("double") for f in FEATURES])))


def label_by_form(found: DataFrame) -> DataFrame:
    """Adds ``label``: 1 for a published key format and for a mixed value assigned to a name, 0 for numbers, words, parts
    of addresses and paths, and values that nothing near names; NULL where the form does not tell."""
    c, before = F.col("candidate"), F.col("_before")
    named = before.rlike(NAMES) & before.rlike(r"[=:]\s*[\"']?$")
    mixed = c.rlike("[0-9]") & c.rlike("[A-Za-z]")
    label = (F.when(c.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$") | c.rlike(r"^gh[pousr]_[A-Za-z0-9]{36}$"), 1)
             .when(named & mixed, 1)
             .when(c.rlike("^[0-9+/_-]+$") | c.rlike("^[A-Za-z]+[0-9]{1,3}$"), 0)
             .when(F.col("_word").rlike(r"@|://|^/|\.\w{2,4}$|(\w+/){2}"), 0)
             .when(c.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), 0)
             .when(~named & c.rlike("^[a-z0-9_-]+$"), 0))
    return found.withColumn("label", label)


def examples(spark: SparkSession, most: int = EXAMPLES) -> DataFrame:
    """Texts ``t`` with ids ``i``, each with one candidate: keys and assigned values, and numbers, addresses, UUIDs, hashes
    and names with a number, as many of each. Their form labels all of them."""
    digest = F.sha2(F.col("i").cast("string"), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", "x")
    letters, digits = F.translate(digest, "0123456789", "ghijklmnop"), F.translate(digest, "abcdef", "012345")
    def part(of, start, size):
        return F.substring(of, start, size)
    uuid = F.concat_ws("-", part(digest, 1, 8), part(digest, 9, 4), part(digest, 13, 4), part(digest, 17, 4), part(digest, 21, 12))
    kinds = [
        F.concat(F.lit("with that AKIA"), F.upper(part(digest, 1, 16)), F.lit(" here")),
        F.concat(F.lit("see ghp_"), part(mixed, 1, 36), F.lit(" and")),
        F.concat(F.lit('token = "'), part(mixed, 1, 32), F.lit('" next')),
        F.concat(F.lit("password="), part(digest, 1, 20), F.lit("1a next")),
        F.concat(F.lit("call "), part(digits, 1, 16), F.lit(" with that")),
        F.concat(F.lit("see https://host.example.com/path/to/"), part(letters, 1, 12), part(digits, 1, 4), F.lit(" with that")),
        F.concat(F.lit("the row "), uuid, F.lit(" with that")),
        F.concat(F.lit("at commit "), part(digest, 1, 40), F.lit(" with that")),
        F.concat(F.lit("the "), F.initcap(part(letters, 1, 9)), F.initcap(part(letters, 10, 9)), part(digits, 1, 1), F.lit(" with that")),
    ]
    return spark.range(most).withColumnRenamed("id", "i").select(
        "i", F.get(F.array(*kinds), (F.col("i") % len(kinds)).cast("int")).alias("t"))


def fit(labelled: DataFrame, most: int = SAMPLE_FINDINGS, trees: int = TREES, depth: int = DEPTH,
        seed: int = 42) -> RandomForestClassificationModel | None:
    """A forest from ``features`` and ``label`` (0 or 1), at most ``most`` of each class: those with the smallest
    hashes. None without both classes."""
    known = labelled.where("label IN (0, 1)").select(F.col("label").cast("double").alias("label"), "features",
                                                     F.xxhash64("candidate", "start", "_hash").alias("h"))
    parts = [known.where(F.col("label") == c).orderBy("h").limit(most) for c in (0, 1)]
    sample = settled(parts[0].unionByName(parts[1]).drop("h"))
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    total = sum(n.values())
    weight = F.when(F.col("label") == 1, total / (2 * n[1.0])).otherwise(total / (2 * n[0.0]))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight").fit(
        sample.withColumn("weight", weight))


def judged(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Adds ``score``, the share of the forest for a secret, and ``is_secret``."""
    if model is None:
        return found.withColumns({"score": F.lit(1.0), "is_secret": F.lit(True)})
    return (model.transform(found).withColumn("score", F.round(vector_to_array("probability")[1], 6))
            .drop("rawPrediction", "probability", "prediction").withColumn("is_secret", F.col("score") >= 0.5))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
         labelled: DataFrame | None = None) -> DataFrame:
    """All candidates of ``df`` with ``score`` and ``is_secret``. ``labelled`` holds findings with ``features`` and
    ``label``; without it those labelled by form are learned from, or, if a class has none, the stored examples."""
    words = dictionary(df, text)
    found = settled(label_by_form(with_features(candidates(df, key, text, path), words)))
    model = fit(found if labelled is None else labelled)
    if model is not None or labelled is not None:
        return judged(found, model)
    by_form = F.col("label").cast("double")
    if found.where("label IS NULL").isEmpty():
        return found.withColumns({"score": by_form, "is_secret": F.col("label") == 1})
    stored = candidates(examples(df.sparkSession), "i", "t")
    rest = judged(found, fit(label_by_form(with_features(stored, words))))
    return rest.withColumn("score", F.coalesce(by_form, "score")).withColumn("is_secret", F.col("score") >= 0.5)


def mask(df: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with every secret of ``found`` replaced in its text."""
    secrets = (found.where("is_secret").groupBy("_key", "_hash")
               .agg(F.array_sort(F.collect_set("candidate")).alias("_secrets")))
    rows = df.select(F.struct(*df.columns).alias("_row"))     # no name of its own can clash
    own_text = F.col("_row")[text]
    joined = rows.join(secrets, F.col("_row")[key].eqNullSafe(F.col("_key"))
                       & (F.xxhash64(own_text) == F.col("_hash")), "left")
    # Longer ones first: one secret may be part of another.
    by_length = F.array_sort("_secrets", lambda a, b: F.length(b) - F.length(a))
    masked = F.when(F.col("_secrets").isNull(), own_text).otherwise(
        F.aggregate(by_length, own_text, lambda t, s: F.replace(t, s, F.lit(MASK))))
    return joined.select(*[masked.alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns])
