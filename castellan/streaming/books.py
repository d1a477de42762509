"""Books that arrive page by page, and windowed counts of events.

An extension: the batch plans do not need it. Pages of a book must arrive in
order; between micro-batches only the open game's moves stay with the book.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import tokens, tree
from ..operators.books import box_row, lean, page_text

MOVE = "book_id string, id string, parent_id string, san string, fen string, ply int, page int, status string, item string"


def moves(pages: DataFrame, letters: str = "KQRBN", timeout_minutes: int = 60) -> DataFrame:
    """A stream of moves from a stream of pages; a book idle for the timeout is forgotten."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # The state is written by this very function and by nobody else.
        builder: tree.Builder = pickle.loads(state.get[0]) if state.exists else tree.Builder()
        for f in sorted((r for frame in frames for r in frame.itertuples(index=False)), key=lambda r: r.page):
            builder.feed(tokens.tokenize(page_text(f.page, f.text, f.boxes, f.eaten), letters))
        new = builder.forget().moves
        state.update((pickle.dumps(builder),))
        state.setTimeoutDuration(timeout_minutes * 60_000)
        if new:
            yield pd.DataFrame([(key[0], m.id, m.parent_id, m.san, m.fen, m.ply, m.page, m.status, json.dumps(vars(m) | {"bbox": box_row(m.bbox)})) for m in new], columns=["book_id", "id", "parent_id", "san", "fen", "ply", "page", "status", "item"])

    return lean(pages).groupBy("book_id").applyInPandasWithState(step, MOVE, "builder binary", "append", "ProcessingTimeTimeout")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type; rows later than ``late`` behind the watermark are dropped by design."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
