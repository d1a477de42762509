"""Chess notation over columns."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..kernels import boards, distance, resolve, rules


def pandas_udf(kind: str):
    """A vectorised function made on its first use, when a session is there to read its type."""

    def wrap(f):
        made: list = []

        def function():
            if not made:
                made.append(F.pandas_udf(f, kind))
            return made[0]

        @functools.wraps(f)
        def call(*columns):
            return function()(*columns)

        call.function = function
        return call

    return wrap


def move_label(ply: Column | str, san: Column | str) -> Column:
    """``12. Nf3`` for white, ``12… e5`` for black."""
    p = F.col(ply) if isinstance(ply, str) else ply
    return F.concat(F.floor((p + 1) / 2).cast("string"), F.when(p % 2 == 1, ". ").otherwise("… "), san)


def ply_of(number: Column, black: Column) -> Column:
    """Half-move that a printed number announces, white's first being 0."""
    return 2 * (number - 1) + black.cast("int")


def ply_awaited(fen: Column | str) -> Column:
    parts = F.split(fen, " ")
    return 2 * (parts[5].cast("int") - 1) + (parts[1] == "b").cast("int")


def grid(placement: Column | str) -> Column:
    """Eight strings of eight squares, rank eight first."""
    spread = F.col(placement) if isinstance(placement, str) else placement
    for n in range(8, 0, -1):
        spread = F.replace(spread, F.lit(str(n)), F.lit("." * n))
    return F.split(spread, "/")


def full_fen(placement: Column | str, number: Column, black: Column) -> Column:
    """A whole position; castling rights follow from kings and rooks on their squares."""
    g = grid(placement)
    white, blacks = F.element_at(g, 8), F.element_at(g, 1)
    right = lambda row, king, at, rook, sign: F.when((row.substr(5, 1) == king) & (row.substr(at, 1) == rook), sign).otherwise("")
    rights = F.concat(right(white, "K", 8, "R", "K"), right(white, "K", 1, "R", "Q"), right(blacks, "k", 8, "r", "k"), right(blacks, "k", 1, "r", "q"))
    return F.concat_ws(" ", placement, F.when(black, "b").otherwise("w"), F.when(rights == "", "-").otherwise(rights), F.lit("-"), F.lit("0"), number.cast("string"))


def piece_count(placement: Column | str, piece: str) -> Column:
    return F.regexp_count(placement, F.lit(piece))


def _once(function: Callable, *columns: pd.Series) -> list:
    """A function of each row, computed once for rows that are alike; null where an argument is."""
    known: dict[tuple, object] = {}
    out = []
    for row in zip(*columns):
        if row not in known:
            known[row] = None if any(v is None for v in row) else function(*row)
        out.append(known[row])
    return out


@pandas_udf("double")
def confusable_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance in which look-alike characters cost half."""
    return pd.Series(_once(distance.confusable_distance, a, b), dtype="float64")


@pandas_udf("int")
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_once(distance.common_subsequence, a, b), dtype="Int32")


@pandas_udf("array<string>")
def legal_moves(fen: pd.Series) -> pd.Series:
    """SAN of every legal move."""
    return pd.Series(_once(lambda f: [rules.position(f).san(m) for m in rules.position(f).legal], fen))


@pandas_udf("boolean")
def is_valid(fen: pd.Series) -> pd.Series:
    return pd.Series(_once(lambda f: rules.position(f).valid(), fen), dtype="boolean")


@pandas_udf("move_uci string, san string, fen string, status string, confidence double, reason string, candidates array<string>, settled_by string")
def resolve_move(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """A printed move (fen, text, consumed, wreck) read on a board."""
    for fens, texts, consumed, wrecks in batches:
        rows = []
        for fen, text, eaten, wreck in zip(fens, texts, consumed, wrecks):
            board = rules.position(fen)
            r = resolve.resolve(board, text, eaten or "", wreck or "")
            rows.append((r.move.uci() if r.move else None, r.san, board.play(r.move).fen() if r.move else None, r.status, r.confidence, r.reason, list(r.candidates), r.settled_by))
        yield pd.DataFrame(rows, columns=["move_uci", "san", "fen", "status", "confidence", "reason", "candidates", "settled_by"])


@pandas_udf("string")
def origin_hints(square: pd.Series) -> pd.Series:
    """File and rank of a square number, as two characters."""
    return square.map(rules.name)


def settled(candidates: Column, hints: Column) -> Column:
    """The one candidate that the hints name; null when they name none or several."""
    named = F.array_intersect(candidates, hints)
    return F.when(F.size(named) == 1, F.element_at(named, 1))


@pandas_udf("string")
def case_partner(char: pd.Series) -> pd.Series:
    return char.map(boards.partner)


@pandas_udf("string")
def decode_rows(rows: pd.Series, keys: pd.Series, pieces: pd.Series) -> pd.Series:
    """Placement of printed rows under a table given as two strings; null with an unknown character."""
    return pd.Series([None if r is None or k is None else boards.decode(list(r), dict(zip(k, p))) for r, k, p in zip(rows, keys, pieces)])


#: Functions of rows that SQL can call by name once they are registered.
NAMED = {f.__name__: f for f in (confusable_distance, common_subsequence, legal_moves, is_valid, origin_hints, case_partner, decode_rows)}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the functions of rows callable by name from SQL in this session; returns their names."""
    for name, f in NAMED.items():
        spark.udf.register(prefix + name, f.function())
    return [prefix + name for name in NAMED]
