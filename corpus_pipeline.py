"""A corpus from raw documents to training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last
return the columns of ``documents``; the last returns the pieces of the sequences. NULL ids and texts, empty
texts, repeated rows and empty tables pass as the stages' operators define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from starling.llm import jaccard, language, line_dedup, packing, secrets
from starling.llm.batches import small_batches, stored
from starling.operators.membership import maybe_in
from starling.session import run_folder

WORD_FILE = "word_bpe_49k.json"


def _same_columns(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs`` and the number of characters as it is now."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``docs`` itself labels. Those without a letter and those of which no passage
    resembles these languages go."""
    small_batches(spark)
    model, familiar = language.fit(docs), language.fit_familiar(docs)
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    return rows.where(language.resembles(spark, model, familiar, F.col("_row")["text"])).select("_row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated windows go; so does a document of which nothing is left, being all copied."""
    count = "_removed"
    while count in docs.columns:
        count += "_"
    cut = line_dedup.remove_repeats(docs, removed=count)
    return _same_columns(docs, cut.where(F.col("text").isNull() | (F.col("text") != "") | (F.col(count) == 0)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity, the one with the smallest id stays; of several equal rows, one. Rows that share an
    id but not their text are documents of their own. Rows without an id all stay.

    Only ids and hashes are grouped. Texts stay where they are but for those of rows that may have to go: a map of fixed
    size tells them from the rest. Should two different documents ever have the same 64 bits, both stay."""
    named = docs.where("doc_id IS NOT NULL")
    key, check = F.xxhash64("doc_id", "text").alias("_key"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_check")
    each = stored(named.select(key, check, "doc_id").groupBy("_key").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), (F.min("_check") != F.max("_check")).alias("unlike")),
        "documents")
    found = jaccard.link(named.select(key, "text"), key="_key").select("_key", "component_id").distinct()
    grouped = stored(each.join(found, "_key"), "groups")
    first = grouped.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key"))["_key"].alias("_first"))
    goes = F.col("_first").isNull() | (F.col("_first") != F.col("_key"))
    # What is not simply kept: documents that go, and those of which there are several.
    loose = stored(grouped.join(first, F.col("_first") == F.col("_key"), "left").withColumn("goes", goes)
                   .where("NOT unlike AND (goes OR n > 1)").select("_key", "goes"), "loose")
    rows = named.select(key, F.struct(*docs.columns).alias("_row"))
    asked = maybe_in(rows, loose, "_key").join(loose, "_key", "left")
    one = asked.where("NOT goes").groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    kept = maybe_in(rows, loose, "_key", inside=False).select("_row")
    for part in (asked.where("goes IS NULL").select("_row"), one.select("_row")):
        kept = kept.unionByName(part)
    return kept.select("_row.*").unionByName(docs.where("doc_id IS NULL"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    found = secrets.scan(docs, path="source" if "source" in docs.columns else None)
    return _same_columns(docs, secrets.mask(docs, found))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(WORD_FILE))


STAGES = [
    ("language", known_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard", one_of_each_group),
    ("secrets", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Between stages the documents are written to the shared checkpoint folder; they go when
    the driver ends."""
    folder = run_folder(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn their models from the data, which SQL cannot express; the tests hold them to plain versions.
ORACLE_SQL = None
