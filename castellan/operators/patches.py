"""A reader's corrections laid over a book's moves."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schemas
from ..kernels import rules
from ..kernels.rules import Ambiguous, Illegal
from .groups import in_order


def latest(patches: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last patch of each key, in order."""
    w = W.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))
    return patches.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def of_edition(patches: DataFrame, archives: DataFrame) -> DataFrame:
    """Patches made for the very source that an archive holds; others are refused."""
    return patches.join(archives.select("book_id", "sha256").distinct(), ["book_id", "sha256"], "left_semi")


def apply(moves: DataFrame, patches: DataFrame) -> DataFrame:
    """Moves with their latest patches, then replayed: a subtree stops at its first illegal move.

    A patched move is read on its parent's board; its descendants are replayed
    from there. The first that is illegal becomes broken, and what stands below
    it stays as it was.
    """
    last = latest(patches, ["book_id", "move_id", "type"], ["ord"])
    by_type = last.groupBy("book_id", F.col("move_id").alias("id")).agg(*(F.max(F.when(F.col("type") == t, F.col("value"))).alias(t) for t in schemas.PATCH_TYPES))
    joined = moves.join(by_type, ["book_id", "id"], "left")
    b = lambda k: F.get_json_object("bbox_edit", f"$.{k}").cast("double").alias(k)
    joined = joined.withColumn("bbox", F.when(F.col("bbox_edit").isNotNull(), F.struct(*map(b, "xywh"))).otherwise(F.col("bbox"))).drop("bbox_edit")

    columns = [f.split()[0] for f in ("book_id", "ord", "id", "game_id", "parent_id", "san", "uci", "fen", "ply", "page", "bbox", "variation_index", "comment", "confidence", "status", "repair")]
    first = F.col("first_fen") if "first_fen" in joined.columns else F.lit(None).cast("string").alias("first_fen")
    joined = joined.select(*columns, first, "san_edit", "fen_override")
    at = {c: k for k, c in enumerate(joined.columns)}

    def replay(_: tuple, rows: list[tuple]) -> Iterator[tuple]:
        fen, stale, stopped = {r[at["id"]]: r[at["fen"]] for r in rows}, set(), set()
        for r in rows:
            move, up = r[at["id"]], r[at["parent_id"]]
            if up in stopped:
                stopped.add(move)
                yield r[: len(columns)]
                continue
            edit = json.loads(r[at["san_edit"]])["san"] if r[at["san_edit"]] is not None else None
            forced = json.loads(r[at["fen_override"]])["fen"] if r[at["fen_override"]] is not None else None
            if edit is None and forced is None and up not in stale:
                yield r[: len(columns)]
                continue
            text = edit or r[at["san"]]
            try:
                row = dict(zip(("san", "uci", "fen"), _played(fen.get(up) if up is not None else r[at["first_fen"]], text)), status="ok", confidence=1.0)
            except (Illegal, Ambiguous, ValueError, AttributeError, TypeError):
                row = {"san": text, "uci": None, "fen": None, "status": "broken", "confidence": 0.0}
            if forced is not None:
                row["fen"] = forced
            elif row["fen"] is None:
                stopped.add(move)
            fen[move] = row["fen"]
            stale.add(move)
            yield tuple(row.get(c, r[k]) for k, c in enumerate(columns))

    schema = schemas.MOVES.replace("book_id string, ", "book_id string, ord int, ", 1)
    return in_order(joined, ["book_id", "game_id"], ["ord"], replay, schema)


@lru_cache(maxsize=10_000)
def _played(before: str, text: str) -> tuple[str, str, str]:
    """SAN, UCI and FEN of a move read on a position."""
    board = rules.position(before)
    move = board.read(text)
    return board.san(move), move.uci(), board.play(move).fen()
