"""Language identification by string kernels.

The kernel of two passages counts the n-grams of one to three characters that both hold (presence, not frequency),
divided by the geometric mean of their own counts. Letters of any script are told apart, other runs count as one
character, and n-grams are hashed to ``PRESENCE`` places, some of which two of them share. Some labelled passages serve as Nystroem landmarks; one-versus-rest
kernel ridge regression on the landmark features gives each language a weight per landmark. Scoring a batch is two
matrix products: passages by n-grams times n-grams by landmarks, then times landmarks by languages. A text's margins are
the mean of those of its passages, which cover it whole: in one piece, a long text would hold every n-gram.

Whether a text resembles any of the languages is another question, as a margin only compares them. ``Familiar`` asks how
much of a passage consists of n-grams that are usual in labelled passages, with all letters told apart.

NULL texts and texts without a letter are ``und`` with score 0. So is every text if there is nothing to learn from.
Labels are read from the training rows only. Of equal scores the first language by name wins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from starling.llm.byte_bpe import slices
from starling.llm.pieces import LETTER, Slice, character_classes

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
#: Bounds of what is fitted on: labelled texts (a passage of each) and landmarks over all languages.
SAMPLE_TEXTS, LANDMARKS = 2000, 192
#: Places that n-grams are hashed to for the kernel: many times what a passage holds.
PRESENCE = 1 << 17
RIDGE = 1e-2
PASSAGE_CHARS = 1500
BATCH_PASSAGES, SLICE_CHARS = 256, 400_000
#: Passages of a batch that are flagged at a time: workers keep the memory of their largest arrays while they are idle.
AT_ONCE = 64
#: Places that n-grams of two and three characters are hashed to, and one in how many labelled passages of a language must
#: hold an n-gram that is usual in it.
PLACES, USUAL = 1 << 22, 100
#: The share of passages taken for unlike their own language when the limit is set, and how much a short passage is
#: forgiven: this over the root of its number of n-grams.
OUTLIERS, ALLOWANCE = 0.01, 3.0


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, any run of other characters than letters as a single 0, and the text that
    each belongs to."""
    s = Slice.of([t.lower() for t in texts])
    if not len(s.points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points, row = np.where(character_classes()[s.points] == LETTER, s.points, 0), np.repeat(np.arange(len(texts)), s.lengths)
    keep = (points > 0) | s.first[:-1]
    keep[1:] |= points[:-1] > 0
    return points[keep].astype(np.int64), row[keep]


def present(texts: list[str]) -> np.ndarray:
    """Per text a row of flags, one for each place that an n-gram of it is hashed to."""
    points, row = letters_of(texts)
    flags = np.zeros((len(texts), PRESENCE), bool)
    gram = np.zeros(len(points), np.uint64)
    for n in ORDERS:
        whole = slice(0, max(len(points) - n + 1, 0))
        gram = gram[whole] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1:].astype(np.uint64) + np.uint64(n)
        place = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 17)
        inside = row[whole] == row[n - 1:]
        flags[row[whole][inside], place[inside]] = True
    return flags


def passages(text: str) -> list[str]:
    return [text[at:at + PASSAGE_CHARS] for at in range(0, len(text), PASSAGE_CHARS)] or [""]


@dataclass
class LanguageModel:
    languages: list[str]
    columns: np.ndarray      # places of the n-grams that some landmark holds
    landmarks: np.ndarray    # n-grams by landmarks, each landmark divided by its norm
    weights: np.ndarray      # landmarks by languages

    def kernel(self, flags: np.ndarray) -> np.ndarray:
        return self.products([(flags[:, self.columns], flags.sum(1))])

    def kernel_of(self, texts: list[str]) -> np.ndarray:
        """The kernel of one batch, of whose flags only the landmarks' columns are held for all texts."""
        parts = (present(texts[at:at + AT_ONCE]) for at in range(0, len(texts), AT_ONCE))
        return self.products([(flags[:, self.columns], flags.sum(1)) for flags in parts])

    def products(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        held, own = (np.concatenate(some) for some in zip(*parts))
        own = np.sqrt(np.maximum(own, 1)).astype(np.float32)
        return held.astype(np.float32) @ self.landmarks / own[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        letter = character_classes()
        found = [any(letter[ord(c)] == LETTER for c in t) for t in texts]
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        cut = [passages(t) for t in texts]
        every, size = [p for some in cut for p in some], [len(p) + 1e-9 for some in cut for p in some]
        margins = np.concatenate([self.kernel_of(every[at:at + BATCH_PASSAGES]) @ self.weights
                                  for at in range(0, len(every), BATCH_PASSAGES)]).astype(float)
        start = np.cumsum([0, *map(len, cut)])[:-1]
        margins = (np.add.reduceat(margins * np.array(size)[:, None], start)
                   / np.add.reduceat(np.array(size), start)[:, None])
        best = margins.argmax(1)
        score = np.clip((margins[np.arange(len(texts)), best] + 1) / 2, 0, 1)
        return ([self.languages[i] if ok else UNDETERMINED for i, ok in zip(best, found)],
                np.where(found, score, 0.0))


def training_sample(labelled: DataFrame, text: str, lang: str, key: str, most: int) -> list[tuple[str, str]]:
    """Language and one passage of at most ``most`` different labelled texts, as many of each language, those with the
    smallest hashes of key and text. Rows are never ranked: a cut-off per language that twice as many pass leaves a bounded
    number of hashes to choose from, and only the chosen passages, cut where the texts lie, come to the driver."""
    row_hash = F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text)), 1)
    usable = (labelled.select(row_hash.alias("h"), F.col(text).alias("t"), F.col(lang).alias("l"))
              .where("l IS NOT NULL AND t IS NOT NULL"))
    counts = usable.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not counts:
        return []
    each = max(2, most // len(counts))

    def below(limits: dict[str, int]) -> DataFrame:
        cut = labelled.sparkSession.createDataFrame(list(limits.items()), "l string, cut bigint")
        return usable.join(F.broadcast(cut), "l").where("h <= cut")

    loose = {r["l"]: (2**63 - 1) * min(2 * each, r["n"]) // max(r["n"], 1) for r in counts}
    hashes: dict[str, list[int]] = {}
    for r in below(loose).select("l", "h").distinct().collect():
        hashes.setdefault(r["l"], []).append(r["h"])
    chosen = {name: sorted(found)[:each][-1] for name, found in hashes.items()}
    if not chosen:
        return []
    n_passages = F.greatest(F.ceil(F.length("t") / PASSAGE_CHARS), F.lit(1))
    start = F.pmod(F.crc32(F.col("t").cast("binary")), n_passages) * PASSAGE_CHARS + 1
    rows = (below(chosen).select("l", "h", F.substring("t", start.cast("int"), F.lit(PASSAGE_CHARS)).alias("p"))
            .dropDuplicates(["l", "h"]).collect())
    return sorted((r["l"], r["p"]) for r in rows)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        sample: int = SAMPLE_TEXTS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """A model from ``labelled``, of which a bounded sample of passages is looked at."""
    found = training_sample(labelled, text, lang, key, sample)
    languages = sorted({name for name, _ in found})
    if not languages:
        return LanguageModel([], np.zeros(0, int), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    names = np.array([languages.index(name) for name, _ in found])
    each = max(1, landmarks // len(languages))
    picked = np.concatenate([np.flatnonzero(names == i)[:each] for i in range(len(languages))])
    # Flagged twice, so that the driver never holds the flags of more than a few passages.
    few = [[found[i][1] for i in picked[at:at + AT_ONCE]] for at in range(0, len(picked), AT_ONCE)]
    columns = np.flatnonzero(np.logical_or.reduce([present(texts).any(0) for texts in few]))
    parts = [(flags[:, columns], flags.sum(1)) for flags in map(present, few)]
    chosen = np.concatenate([held for held, _ in parts]).astype(np.float32).T
    chosen /= np.sqrt(np.maximum(np.concatenate([own for _, own in parts]), 1)).astype(np.float32)
    model = LanguageModel(languages, columns, chosen, np.zeros((0, 0), np.float32))
    among = model.products(parts).astype(float)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    strong = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, strong] / np.sqrt(values[strong])
    features = np.concatenate([model.kernel_of([p for _, p in found[at:at + BATCH_PASSAGES]])
                               for at in range(0, len(found), BATCH_PASSAGES)]).astype(float) @ root
    wanted = np.where(names[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each language weighs the same, however many texts it has.
    weight = (1 / np.bincount(names))[names] * len(names) / len(languages)
    gram = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
    model.weights = (root @ np.linalg.solve(gram, features.T @ (wanted * weight[:, None]))).astype(np.float32)
    return model


def predict(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """A struct of ``lang`` and ``score`` (0 to 1) for a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [shared.value.predict(some) for some in slices(batch, SLICE_CHARS)]
            yield pd.DataFrame({"lang": [x for names, _ in parts for x in names],
                                "score": np.concatenate([s for _, s in parts]) if parts else np.zeros(0)})

    return scored(text)


# ---------------------------------------------------------------- texts that resemble no language

def hashed_grams(text: str) -> np.ndarray:
    """The places of the runs of two and three characters, all letters told apart and other runs as one."""
    points, _ = letters_of([text])
    if not len(points):
        return points
    two = points[:-1] * 1_000_003 + points[1:]
    three = two[:-1] * 1_000_003 + points[2:]
    return np.concatenate([(two * 0x9E3779B1 >> 7) % PLACES, (three * 0x9E3779B1 >> 11) % PLACES])


def usual_grams(passages_of: list[list[np.ndarray]]) -> np.ndarray:
    """Flags of the places that enough passages of some language hold."""
    flags = np.zeros(PLACES, bool)
    for some in passages_of:
        if some:
            place, n = np.unique(np.concatenate([np.unique(x) for x in some]), return_counts=True)
            flags[place[n * USUAL >= len(some)]] = True
    return flags


def familiarity(flags: np.ndarray, places: np.ndarray) -> float:
    """The share of usual n-grams in a passage, and what it is forgiven for being short."""
    return float(flags[places].mean() + ALLOWANCE / np.sqrt(len(places))) if len(places) else 0.0


@dataclass
class Familiar:
    flags: np.ndarray               # places of usual n-grams
    limits: dict[str, float]        # by language

    def holds(self, text: str, language: str) -> bool:
        """Whether any passage of the text resembles the languages learned from."""
        limit = self.limits.get(language, 0.0)
        return any(familiarity(self.flags, hashed_grams(p)) >= limit for p in passages(text))


def fit_familiar(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
                 sample: int = SAMPLE_TEXTS) -> Familiar:
    """What is usual in one passage of each labelled text of the sample. A language's limit lies halfway between what nearly
    all of its own passages reach when the other half of the sample is learned from, and what unlike ones usually
    reach: passages of a language that is not learned from, or with their letters in disorder."""
    by_language: dict[str, list[str]] = {}
    for name, passage in training_sample(labelled, text, lang, key, sample):
        by_language.setdefault(name, []).append(passage)
    names = sorted(by_language)
    texts = [sorted(by_language[name], key=lambda t: (zlib.crc32(t.encode()), t)) for name in names]
    grams = [[x.astype(np.int32) for x in map(hashed_grams, some) if len(x)] for some in texts]
    flags = usual_grams(grams)
    shuffle = np.random.default_rng(42)
    unlike = [familiarity(flags, hashed_grams("".join(shuffle.permutation(list(t)))))
              for some in texts for t in some[:max(1, BATCH_PASSAGES // len(names))]]
    reached = [float(np.median(unlike))] if unlike else [0.0]
    if len(names) > 1:
        others = (usual_grams(grams[:i] + grams[i + 1:]) for i in range(len(names)))
        reached.append(float(np.median([np.median([familiarity(f, x) for x in some])
                                        for f, some in zip(others, grams) if some] or [0.0])))
    halves = [usual_grams([some[side::2] for some in grams]) for side in (0, 1)]
    limits = {}
    for name, some in zip(names, grams):
        own = [familiarity(halves[1 - i % 2], x) for i, x in enumerate(some)]
        least = float(np.quantile(own, OUTLIERS, method="lower")) if own else 0.0
        limits[name] = (least + min(least, max(reached))) / 2
    return Familiar(flags, limits)


def resembles(spark: SparkSession, model: LanguageModel, familiar: Familiar, text: Column) -> Column:
    """Whether a text has a letter and resembles one of the languages, if only in one of its passages."""
    shared = spark.sparkContext.broadcast((model, familiar))

    @F.pandas_udf("boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            told, usual = shared.value
            yield pd.Series([name != UNDETERMINED and usual.holds(t, name)
                             for some in slices(batch, SLICE_CHARS) for t, name in zip(some, told.predict(some)[0])], dtype=bool)

    return judged(text)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))
