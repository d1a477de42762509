"""Transcripts to chat turns by a hidden Markov model over their lines.

Each line is in one of six states: a role (system, user, assistant) that begins
or continues. A line emits four features: the speaker marker it starts with,
whether a blank line or a new chunk precedes it, how it ends, and its length.
Transition and emission tables are counted on a bounded sample of labelled
chunks (``TRAINING_ROWS``). Viterbi recovers the states; lines that begin a role
start a turn, which is rendered as ``<|role|>`` and the text without its marker.

A conversation may hold any share of all rows. Viterbi is a product of max-plus
matrices, so blocks of ``BLOCK`` turn numbers reduce to one matrix each, a scan
over the blocks of a conversation fixes the states at their borders, and blocks
are then solved independently. Where turn numbers repeat so often that a block
holds over ``CROWDED`` rows, it is split by turn, then by text, then among equal
rows. The scan holds 36 numbers for each block of one conversation.

Null texts are empty and count as one blank line; null turns sort first; equal
turns are ordered by text, in crowded blocks by a hash of it first. Null
conversations are one conversation of their own. Repeated rows are all parsed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, groups

ROLES = ("system", "user", "assistant")
STATES = 6  # 2 * role begins, 2 * role + 1 continues
TRAINING_ROWS = 3000
BLOCK = 256
CROWDED = 4 * BLOCK
#: Fixed speaker markers by style, for system, user and assistant.
MARKERS = (("System:", "User:", "Assistant:"), ("Instructions:", "Human:", "AI:"), ("### System", "### Instruction", "### Response"), ("Context:", "Q:", "A:"))
MARKER = re.compile(r"^\s*(?:\*\*|\[|<)?(System|Instructions|### System|Context|User|Human|### Instruction|Q|Assistant|AI|### Response|A)(?:\*\*|\]|>)?\s*(?::|$|(?<=System)|(?<=Instruction)|(?<=Response))\s*", re.IGNORECASE)
_ROLE_OF = {m.rstrip(":").lower(): r for style in MARKERS for r, m in enumerate(style)}
SIZES = (4, 3, 4, 5)


def line_features(lines: list[str]) -> np.ndarray:
    """(n, 4) categories: marker (0 none, 1 + role), before (chunk start, blank, text), ending, length."""
    out = np.zeros((len(lines), 4), dtype=np.int64)
    before = 0
    for k, line in enumerate(lines):
        m = MARKER.match(line)
        body = line.strip()
        end = 0 if not body else 1 if body[-1] == "?" else 2 if body[-1] in ".!:" else 3
        out[k] = (1 + _ROLE_OF[m.group(1).lower()] if m else 0, before, end, min(4, len(body) // 40))
        before = 1 if not body else 2
    return out


class Model:
    """Log tables: first state, transition, and one emission table per feature."""

    def __init__(self, sequences: list[tuple[np.ndarray, np.ndarray]], opens: list[bool] | None = None):
        """From sequences of (features, states); only those that open a conversation say how one begins."""
        first, step = np.ones(STATES), np.full((STATES, STATES), 0.1)
        emit = [np.full((STATES, n), 0.1) for n in SIZES]
        for k, (feature, state) in enumerate(sequences):
            first[state[0]] += opens is None or opens[k]
            np.add.at(step, (state[:-1], state[1:]), 1)
            for k in range(len(SIZES)):
                np.add.at(emit[k], (state, feature[:, k]), 1)
        # A role's lines can only continue the role that began.
        for a in range(STATES):
            for b in range(1, STATES, 2):
                if a // 2 != b // 2:
                    step[a, b] = 0
        with np.errstate(divide="ignore"):
            self.first = np.log(first / first.sum())
            self.step = np.log(step / step.sum(1, keepdims=True))
            self.emit = [np.log(e / e.sum(1, keepdims=True)) for e in emit]

    def scores(self, feature: np.ndarray) -> np.ndarray:
        return sum(e[:, feature[:, k]].T for k, e in enumerate(self.emit))

    def matrix(self, feature: np.ndarray) -> np.ndarray:
        """Best score from the state before these lines to the state of the last one."""
        m = None
        for row in self.scores(feature):
            one = self.step + row[None, :]
            m = one if m is None else (m[:, :, None] + one[None]).max(1)
        return m

    def path(self, feature: np.ndarray, entry: int, leave: int) -> np.ndarray:
        """The best states of these lines given the state before (-1: none) and the last one (-1: any)."""
        score = self.scores(feature)
        best = self.first + score[0] if entry < 0 else self.step[entry] + score[0]
        back = np.zeros((len(score), STATES), dtype=np.int64)
        for t in range(1, len(score)):
            both = best[:, None] + self.step
            back[t] = both.argmax(0)
            best = both.max(0) + score[t]
        state = np.empty(len(score), dtype=np.int64)
        state[-1] = leave if leave >= 0 else best.argmax()
        for t in range(len(score) - 1, 0, -1):
            state[t - 1] = back[t, state[t]]
        return state


def labelled(text: str, role: str) -> tuple[np.ndarray, np.ndarray]:
    f = line_features(text.split("\n"))
    r = ROLES.index(role)
    return f, np.array([2 * r] + [2 * r + 1] * (len(f) - 1))


def fit(rows: list[tuple[int, int, str, str]], start: int | None = None) -> Model:
    """From (conversation, turn, text, role) rows; unknown roles are left out.

    Only rows of consecutive turns follow each other. With ``start``, the number
    that turns begin with, only sequences from there on open a conversation.
    """
    sequences, opens, last = [], [], None
    for conv, turn, text, role in sorted(rows, key=lambda r: (str(r[0]), r[1] or 0, r[2] or "")):
        if role in ROLES:
            f, s = labelled(text or "", role)
            if last in ((conv, (turn or 0) - 1), (conv, turn or 0)) and sequences:
                sequences[-1] = (np.concatenate([sequences[-1][0], f]), np.concatenate([sequences[-1][1], s]))
            else:
                sequences.append((f, s))
                opens.append(start is None or turn == start)
            last = conv, turn or 0
    return Model(sequences, opens)


#: A block's place: conversation, whether its turns are numbered, their range, and what a crowded one is split by.
KEY = ["conv", "known", "range", "only", "part", "copy"]
KEY_TYPES = "conv string, known boolean, range bigint, only bigint, part bigint, copy bigint"


def _blocks(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (conv, *block), g in groups(frames, KEY):
            f = np.concatenate([line_features(t.split("\n")) for t in g["text"]])
            first = model.first + model.scores(f[:1])[0]
            alone = first if len(f) == 1 else (first[:, None] + model.matrix(f[1:])).max(0)
            yield pd.DataFrame({"conv": [conv], **{c: [v] for c, v in zip(KEY[1:], block)}, "m": [model.matrix(f).ravel()], "alone": [alone]})

    return run


def _borders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for (conv,), g in groups(frames, ["conv"]):
        before = [np.asarray(g["alone"].iloc[0])]
        ms = [np.asarray(m).reshape(STATES, STATES) for m in g["m"]]
        for m in ms[1:]:
            before.append((before[-1][:, None] + m).max(0))
        leave = [int(before[-1].argmax())]
        for k in range(len(ms) - 1, 0, -1):
            leave.append(int((before[k - 1] + ms[k][:, leave[-1]]).argmax()))
        leave.reverse()
        yield g[KEY].assign(entry=[-1, *leave[:-1]], leave=leave)


def render(role: str, lines: list[str], starts: bool) -> str:
    """Canonical text of a turn or, if it does not start here, of its continuation."""
    if not starts:
        return "\n".join(lines)
    body = [MARKER.sub("", lines[0], count=1), *lines[1:]]
    return f"<|{role}|>\n" + "\n".join(body).strip("\n")


def _turns(model: Model):
    names = ["conv", "known", "turn", "piece", "role", "starts", "n_lines", "rendered"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for _, g in groups(frames, KEY):
            chunks = [t.split("\n") for t in g["text"]]
            f = np.concatenate([line_features(c) for c in chunks])
            states = model.path(f, int(g["entry"].iloc[0]), int(g["leave"].iloc[0]))
            at = 0
            for conv, known, turn, lines in zip(g["conv"], g["known"], g["turn"], chunks):
                s = states[at : at + len(lines)]
                at += len(lines)
                bounds = [0, *[k for k in range(1, len(s)) if s[k] % 2 == 0], len(s)]
                for piece, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                    role, starts = ROLES[s[lo] // 2], bool(s[lo] % 2 == 0)
                    rows.append((conv, known, turn, piece, role, starts, hi - lo, render(role, lines[lo:hi], starts)))
            if len(rows) >= 4096:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


def blocked(rows: DataFrame, block: int, crowded: int) -> DataFrame:
    """Rows (conv, known, turn, text) with the rest of the ``KEY`` of their block."""
    none = F.lit(0).cast("bigint")
    rows = rows.withColumn("range", F.floor(F.col("turn") / F.lit(block))).withColumns({"only": none, "part": none, "copy": none})
    full = cut(rows.groupBy("conv", "known", "range").agg(F.count("*").alias("c")).where(F.col("c") > crowded).drop("c"))
    if full.isEmpty():
        return rows
    by = ["conv", "known", "range", "turn"]
    # A number for each row, kept, so that equal rows stay where they are when a task runs again.
    many = cut(rows.join(full, by[:3], "left_semi").withColumn("salt", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("text")))
    turns = many.groupBy(*by).agg(F.count("*").alias("c2"))
    texts_ = many.groupBy(*by, "h").agg(F.count("*").alias("c3"))
    many = many.join(turns, by).join(texts_, [*by, "h"])
    part = F.when(F.col("c2") > crowded, F.pmod("h", F.ceil(F.col("c2") / block))).otherwise(none)
    copy = F.when(F.col("c3") > crowded, 1 + F.pmod("salt", F.ceil(F.col("c3") / block))).otherwise(none)
    many = many.withColumns({"only": F.col("turn"), "part": part, "copy": copy})
    return rows.join(full, by[:3], "left_anti").unionByName(many.select(*rows.columns))


def parse(chunks: DataFrame, model: Model, block: int = BLOCK, crowded: int = CROWDED) -> DataFrame:
    """Turns of transcripts whose chunks are rows (conv_id, turn, text), in order of turn.

    Returns (conv_id, turn, piece, role, starts, n_lines, rendered): pieces of a
    chunk in order; a piece that does not start continues the turn before it.
    """
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    rows = chunks.select(F.coalesce(conv.cast("string"), F.lit("")).alias("conv"), turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = blocked(rows, block, crowded)
    order = [*KEY, "turn", "text"]
    place = F.struct(*KEY[1:])
    ends = rows.groupBy("conv").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("conv")
    long = rows.join(ends, "conv", "left_semi")
    deal = lambda df: df.repartition(*KEY).sortWithinPartitions(*order)
    blocks = cut(deal(long).mapInPandas(_blocks(model), KEY_TYPES + ", m array<double>, alone array<double>"))
    borders = blocks.repartition("conv").sortWithinPartitions(*KEY).mapInPandas(_borders, KEY_TYPES + ", entry int, leave int")
    # A conversation of one block has nothing to fix at its borders.
    alone = rows.join(ends, "conv", "left_anti").withColumn("entry", F.lit(-1)).withColumn("leave", F.lit(-1))
    solved = deal(long.join(borders, KEY).select(*alone.columns).union(alone))
    made = solved.mapInPandas(_turns(model), "conv string, known boolean, turn bigint, piece int, role string, starts boolean, n_lines bigint, rendered string")
    return made.select(F.when(F.col("conv") != "", F.col("conv").cast("bigint")).alias("conv_id"), F.when(F.col("known"), F.col("turn")).alias("turn"), "piece", "role", "starts", "n_lines", "rendered")


def transcripts(conversations: DataFrame) -> DataFrame:
    """Plain transcript chunks of labelled turns: one of four marker styles per conversation, and every fifth marker lost."""
    style = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(len(MARKERS)))
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    marker = F.coalesce(*(F.when((style == s) & (role == r + 1), F.lit(m)) for s, names in enumerate(MARKERS) for r, m in enumerate(names)), F.lit(""))
    lost = F.pmod(F.coalesce("conv_id", F.lit(0)) + F.coalesce("turn", F.lit(0)), F.lit(5)) == 4
    body = F.coalesce("text", F.lit(""))
    return conversations.select("conv_id", "turn", "role", F.when(lost | (marker == ""), body).otherwise(F.concat(marker, F.lit(" "), body)).alias("text"))


def training_rows(chunks: DataFrame, most: int = TRAINING_ROWS) -> tuple[list[tuple], int | None]:
    """At most ``most`` labelled rows and as many that follow them, and the number that turns begin with.

    Rows are taken by a threshold on their own hash, so no conversation, however
    long, is the sample, and what reaches the driver does not grow.
    """
    size = chunks.agg(F.count("*").alias("n"), F.min("turn").alias("start")).first()
    if not size["n"]:
        return [], None
    h = F.xxhash64("conv_id", "turn", "text")
    least = int(min(1.0, 2.0 * most / size["n"]) * (1 << 64)) - (1 << 63)
    near = chunks.select("conv_id", "turn", "text", "role").where(h < F.lit(least)) if least < 1 << 63 else chunks.select("conv_id", "turn", "text", "role")
    picked = near.distinct().orderBy(h, "conv_id", "turn").limit(most)
    keys = picked.select(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t")).distinct()
    after = chunks.select("conv_id", "turn", "text", "role").join(F.broadcast(keys), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")))
    after = after.select("conv_id", "turn", "text", "role").distinct().orderBy(h, "conv_id", "turn").limit(most)
    return sorted({tuple(r) for r in picked.union(after).collect()}, key=str), size["start"]


def report(conversations: DataFrame) -> DataFrame:
    """Transcripts of the table parsed back into turns."""
    chunks = transcripts(conversations)
    rows, start = training_rows(chunks)
    return parse(chunks, fit(rows, start))
