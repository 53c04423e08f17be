"""Chat formatting: who speaks in a transcript, by a hidden Markov model over its lines, and the turns in one form.

A state is a role and whether the line opens its turn. A line shows whether it begins with a speaker marker and whose,
whether a blank line or the beginning comes before it, its length, and how it begins and ends. Starts, transitions and the
probabilities of these features are counted over labelled transcripts with one added to every count; the Viterbi path
gives the roles, and its turns are rendered alike, without the markers they had.

NULL transcripts give no turns and an empty rendering; so does any transcript if there is nothing to learn from. Equal
paths: the first state by name wins. Repeated rows are parsed each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Names that speakers go by in transcripts, and the role each stands for.
SPEAKERS = {
    "user": "user", "human": "user", "customer": "user", "question": "user", "q": "user", "instruction": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant",
    "response": "assistant", "system": "system", "context": "system", "prompt": "system",
}
MARKER = re.compile(r"^\s*(?:#{1,4}\s*|<\|(?:im_start\|>)?\s*|\[|\*\*)?([A-Za-z]{1,12})(?:\s*:\*\*|\|>|\]:?|\s*:|(?<=\w)$)\s*")
OPENS, GOES_ON = "+", ""


def speaker(line: str) -> tuple[str, int]:
    """The role whose marker a line begins with ("" for none, "?" for an unknown name), and the marker's length."""
    found = MARKER.match(line)
    if not found:
        return "", 0
    whole, name = found.group(0), found.group(1).lower()
    bare = whole.strip().lower() == name
    if name in SPEAKERS and not bare:
        return SPEAKERS[name], len(whole)
    return ("", 0) if bare else ("?", 0)


def observed(lines: list[str]) -> list[tuple[str, ...]]:
    """What each line shows, one value for each feature."""
    out, before = [], ""
    for i, line in enumerate(lines):
        bare = line.strip()
        out.append((
            speaker(line)[0], "first" if i == 0 else "after blank" if not before else "after text",
            str(min(6, len(bare).bit_length() - 3 if len(bare) > 7 else int(bool(bare)))),
            bare[-1:] if bare[-1:] in "?!.:," else "other",
            "capital" if bare[:1].isupper() else "small" if bare[:1].isalpha() else "other"))
        before = bare
    return out


@dataclass
class ChatModel:
    states: list[str]                  # role, and OPENS where a line opens a turn
    start: np.ndarray = field(default_factory=lambda: np.zeros(0))
    step: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    shown: dict[tuple[int, str], np.ndarray] = field(default_factory=dict)
    unseen: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def path(self, lines: list[str]) -> list[str]:
        """The likeliest states of the lines."""
        if not self.states or not lines:
            return []
        emit = np.array([sum(self.shown.get((k, v), self.unseen[k]) for k, v in enumerate(values))
                         for values in observed(lines)])
        best, back = self.start + emit[0], np.zeros(emit.shape, int)
        for i in range(1, len(lines)):
            via = best[:, None] + self.step
            back[i] = via.argmax(0)
            best = via[back[i], np.arange(len(best))] + emit[i]
        at, states = int(best.argmax()), []
        for i in range(len(lines) - 1, -1, -1):
            states.append(self.states[at])
            at = back[i, at]
        return states[::-1]

    def turns(self, text: str | None) -> list[tuple[str, str]]:
        """Roles and contents, markers left out."""
        lines = (text or "").split("\n") if text else []
        found: list[list] = []
        for line, state in zip(lines, self.path(lines)):
            role = state.rstrip(OPENS)
            if not found or state.endswith(OPENS) or role != found[-1][0]:
                found.append([role, []])
                line = line[speaker(line)[1]:]
            found[-1][1].append(line)
        return [(role, "\n".join(content).strip()) for role, content in found]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{content}\n<|end|>\n" for role, content in turns)


def fit(labelled: DataFrame, lines: str = "lines", states: str = "states") -> ChatModel:
    """A model from transcripts as arrays of lines and of their states, every role of theirs among them. Only counts come to
    the driver: a few for each state and feature, and one for each pair of states that follow one another."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for some, named in zip(batch["l"], batch["s"]):
                named = list(named)
                found.update(("start", named[0], "") for _ in named[:1])
                found.update(("step", a, b) for a, b in zip(named, named[1:]))
                for values, state in zip(observed(list(some)), named):
                    found.update((str(k), state, v) for k, v in enumerate(values))
            if found:
                yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["kind", "state", "value", "n"])

    rows = (labelled.where(F.size(lines) > 0).select(F.col(lines).alias("l"), F.col(states).alias("s"))
            .mapInPandas(count, "kind string, state string, value string, n bigint")
            .groupBy("kind", "state", "value").agg(F.sum("n").alias("n")).collect())
    names = sorted({r["state"] for r in rows} | {r["value"] for r in rows if r["kind"] == "step"})
    if not names:
        return ChatModel([])
    at = {name: i for i, name in enumerate(names)}
    start, step = np.ones(len(names)), np.ones((len(names), len(names)))
    shown: dict[tuple[int, str], np.ndarray] = {}
    for r in rows:
        if r["kind"] == "start":
            start[at[r["state"]]] += r["n"]
        elif r["kind"] == "step":
            step[at[r["state"]], at[r["value"]]] += r["n"]
        else:
            shown.setdefault((int(r["kind"]), r["value"]), np.ones(len(names)))[at[r["state"]]] += r["n"]
    n_features = 1 + max(k for k, _ in shown)
    unseen = np.zeros((n_features, len(names)))
    for k in range(n_features):
        total = sum(v for (i, _), v in shown.items() if i == k) + 1       # one for values never seen
        unseen[k] = -np.log(total)
        for (i, value), n in shown.items():
            if i == k:
                shown[i, value] = np.log(n / total)
    return ChatModel(names, np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), shown, unseen)


def parse(spark: SparkSession, model: ChatModel, transcript: Column) -> Column:
    """A struct of ``turns`` (an array of role and content) and ``rendered`` for a transcript."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("turns array<struct<role: string, content: string>>, rendered string")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.turns(t) for t in batch]
            yield pd.DataFrame({"turns": [[{"role": r, "content": c} for r, c in turns] for turns in found],
                                "rendered": [render(turns) for turns in found]})

    return parsed(transcript)


# ---------------------------------------------------------------- transcripts from tables of turns

#: Turns of a conversation in one transcript: a longer one is several parts, each parsed from its start.
PART_TURNS = 256
#: How speakers are marked in a transcript, by conversation.
STYLES = (
    {"user": "User: ", "assistant": "Assistant: ", "system": "System: "},
    {"user": "Human: ", "assistant": "AI: ", "system": "Context: "},
    {"user": "### Instruction: ", "assistant": "### Response: ", "system": "### System: "},
    {"user": "Q: ", "assistant": "A: ", "system": "Prompt: "},
)
#: Of the turns, one in so many bears no marker.
UNMARKED = 5


def transcripts(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
                ) -> DataFrame:
    """key, part, roles, lines, states and transcript of every conversation: its turns in order, a blank line
    between them, most with a speaker marker in the style of the conversation. Repeated rows are one turn, a NULL text
    is an empty one, and a NULL role is that of a user. Turns are dealt to parts by their number; where one number holds
    more rows than a part has turns, by their text as well, so no conversation is gathered whole."""
    rows = turns.select(F.col(key).alias("_k"), F.col(turn).cast("bigint").alias("_t"),
                        F.coalesce(role, F.lit("user")).alias("_r"), F.coalesce(text, F.lit("")).alias("_x")).distinct()
    rows = rows.withColumn("_part", F.floor(F.coalesce("_t", F.lit(-1)) / PART_TURNS))
    crowded = (rows.groupBy("_k", "_part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * PART_TURNS)
               .select(F.col("_k").alias("_ck"), F.col("_part").alias("_cp"), F.ceil(F.col("_n") / PART_TURNS).alias("_m")))
    rows = (rows.join(crowded, F.col("_k").eqNullSafe(F.col("_ck")) & (F.col("_part") == F.col("_cp")), "left")
            .withColumn("_sub", F.when(F.col("_m").isNull(), 0).otherwise(F.pmod(F.xxhash64("_x", "_r"), "_m"))))
    style = F.pmod(F.xxhash64("_k"), F.lit(len(STYLES)))
    marker = F.lit("")
    for i, marks in enumerate(STYLES):
        for name, mark in marks.items():
            marker = F.when((style == i) & (F.col("_r") == name), F.lit(mark)).otherwise(marker)
    marked = F.pmod(F.xxhash64("_k", "_t", "_x"), F.lit(UNMARKED)) > 0
    said = F.split(F.concat(F.when(marked, marker).otherwise(F.lit("")), "_x", F.lit("\n")), "\n", -1)
    states = F.transform(said, lambda _, i: F.concat("_r", F.when(i == 0, OPENS).otherwise(GOES_ON)))
    rows = rows.withColumn("_turn", F.struct("_t", "_r", F.xxhash64("_x").alias("_h"), said.alias("l"), states.alias("s")))
    # Ends of turns: the last line of each is blank but for the last turn's, which is dropped.
    whole = rows.groupBy("_k", "_part", "_sub").agg(F.array_sort(F.collect_list("_turn")).alias("_all"))
    lines = F.flatten(F.col("_all.l"))
    return whole.select(
        F.col("_k").alias(key), F.struct("_part", "_sub").alias("part"), F.col("_all._r").alias("roles"),
        F.slice(lines, F.lit(1), F.size(lines) - 1).alias("lines"),
        F.slice(F.flatten(F.col("_all.s")), F.lit(1), F.size(lines) - 1).alias("states"),
        F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), "\n").alias("transcript"))
