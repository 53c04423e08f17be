"""The registered queries of this subpackage and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from starling.llm import (
    byte_bpe, chat, cover_tree, hard_negatives, hnsw, jaccard, language, line_dedup, packing, resampling, secrets, simhash,
    toxicity,
)
from starling.llm.batches import small_batches
from starling.llm.oracles import ORACLES  # noqa: F401

BYTE_RANKS, WORD_FILE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(key: str, folds: int, fold: int):
    """Whether a row is kept from training; one without an id is not."""
    return F.coalesce(language.fold(F.col(key), folds) == fold, F.lit(False))


def op1_byte_bpe(spark, folder):
    """Encodes and decodes every text; digests of ids and bytes."""
    path = public_tokenizers.path(BYTE_RANKS)
    coded = (table(spark, folder, "documents")
             .select("doc_id", byte_bpe.encode(F.col("text"), path, public_tokenizers.PATTERN).alias("ids"))
             .withColumn("decoded", byte_bpe.decode(F.col("ids"), path)))
    return coded.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_cover_tree(spark, folder):
    """The 10 largest integer inner products for every hundredth vector."""
    return cover_tree.search_all(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, 10)


def op3_secret_scan(spark, folder):
    """Every candidate in the texts, where it stands, and what the forest says of it."""
    found = secrets.scan(table(spark, folder, "documents"), path="source")
    return found.select(F.col("_key").alias("doc_id"), "start", F.length("candidate").cast("bigint").alias("length"),
                        F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op4_hnsw(spark, folder):
    """20 near neighbours of every twentieth vector."""
    return hnsw.search_all(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, 20)


def op5_toxicity(spark, folder):
    """A toxicity score for every text, from the labels of two thirds of the documents."""
    documents = table(spark, folder, "documents")
    kept_out = held_out("doc_id", 3, 1)
    labels = table(spark, folder, "labels").where(~kept_out).select("doc_id", "toxic")
    # Labels grow with the documents, so they are never broadcast.
    training = documents.where(~kept_out).select("doc_id", "text").join(labels.hint("merge"), "doc_id")
    model = toxicity.fit(training)
    scored = documents.select("doc_id", kept_out.alias("held_out"),
                              toxicity.score(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op6_line_dedup(spark, folder):
    """Every document without the lines of windows that occur earlier."""
    return line_dedup.remove_repeats(table(spark, folder, "documents")).select("doc_id", "text", "lines_removed")


def op7_language(spark, folder):
    """The language of every text, learned from four fifths of the documents."""
    documents = table(spark, folder, "documents")
    kept_out = held_out("doc_id", 5, 0)
    model = language.fit(documents.where(~kept_out))
    return (documents.select("doc_id", kept_out.alias("held_out"),
                             language.predict(spark, model, F.col("text")).alias("found"))
            .select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score"))


def op8_chat(spark, folder):
    """Every conversation as a transcript, parsed again: the roles found, and the turns in one form. The model learns
    from four fifths of the conversations."""
    said = chat.transcripts(table(spark, folder, "conversations"))
    kept_out = held_out("conv_id", 5, 0)
    model = chat.fit(said.where(~kept_out))
    parsed = said.select("conv_id", "part", kept_out.alias("held_out"), "roles",
                         chat.parse(spark, model, F.col("transcript")).alias("p"))
    roles = F.transform("p.turns", lambda t: t["role"])
    return parsed.select("conv_id", F.col("part._part").alias("part"), F.col("part._sub").alias("sub_part"), "held_out",
                         F.size("roles").alias("n_turns"), F.size(roles).alias("n_found"),
                         (F.col("roles") == roles).alias("all_right"), F.col("p.rendered").alias("rendered"))


def op9_ngram_jaccard(spark, folder):
    """Groups of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard.link(table(spark, folder, "documents"))


def op10_packing(spark, folder):
    """Packs every document into sequences of 4096 tokens."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(WORD_FILE))


def op11_hard_negatives(spark, folder):
    """For every fiftieth vector and its five best of the same label, the best of other labels that score somewhat lower."""
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", "embedding", label.alias("label")), F.col("id") % 50 == 0)


def op12_simhash(spark, folder):
    """Groups of documents whose fingerprints of 3-word shingles differ in 3 bits or fewer."""
    return simhash.groups(table(spark, folder, "documents"))


def op13_resampling(spark, folder):
    """Documents drawn towards the benchmark's texts, with the weights of all of them."""
    return resampling.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query for query in (
        op1_byte_bpe, op2_cover_tree, op3_secret_scan, op4_hnsw, op5_toxicity, op6_line_dedup, op7_language, op8_chat,
        op9_ngram_jaccard, op10_packing, op11_hard_negatives, op12_simhash, op13_resampling)
}
