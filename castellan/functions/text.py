"""Text functions over columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels.constants import ALPHABETS, CASTLES, CONFUSABLE, FIGURINES, FIXES, GAME_START, MAX_COMMENT, MAX_TITLE, PIECE_MOVE, SAN_LETTERS

LETTERS = "".join(sorted(set("".join(ALPHABETS.values()))))
__all__ = ["ALPHABETS", "CONFUSABLE", "GAME_START", "LETTERS"]


def normalise(text: Column | str) -> Column:
    """One-to-one fixes of figurines, dashes and spaces; offsets stay."""
    table = FIGURINES | FIXES
    return F.translate(text, "".join(table), "".join(table.values()))


def figurines_to_letters(text: Column | str) -> Column:
    return F.translate(text, "".join(FIGURINES), "".join(FIGURINES.values()))


def to_san(text: Column | str, alphabet: str) -> Column:
    """Piece letters of one alphabet to SAN in a single pass, so that exchanged letters don't chain."""
    return F.translate(text, alphabet, SAN_LETTERS)


def rewrite(text: Column | str, mapping: dict[str, str]) -> Column:
    return F.translate(text, "".join(mapping), "".join(mapping.values())) if mapping else F.col(text) if isinstance(text, str) else text


def squeeze(text: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"\s+", "")


def collapse(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bare_move(text: Column | str) -> Column:
    """Without trailing marks, castling with letters."""
    plain = F.regexp_replace(F.trim(text), r"[!?]+$", "")
    return F.replace(F.replace(plain, F.lit("0-0-0"), F.lit("O-O-O")), F.lit("0-0"), F.lit("O-O"))


def without_check(text: Column | str) -> Column:
    return F.regexp_replace(text, r"[+#]+$", "")


def comment(*parts: Column | str) -> Column:
    return F.left(F.concat_ws(" ", *parts), F.lit(MAX_COMMENT))


def title(text: Column | str) -> Column:
    return F.left(text, F.lit(MAX_TITLE))


def sanitise(name: Column | str) -> Column:
    """A file name of letters, digits, dots, underscores and hyphens."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def ends_in_word(text: Column | str) -> Column:
    """Whether the last word reads as prose."""
    last = F.element_at(F.split(F.trim(text), r"\s+"), -1)
    return F.coalesce(last.rlike(r"^[A-Za-z][a-z]*[.,;:!?)\"”»]*$"), F.lit(False))


def neutral_moves(text: Column | str) -> Column:
    """Moves that name no piece, in any language: words that begin with a pawn's move, and castlings."""
    words = F.split(text, "[^A-Za-z0-9]+")
    pawns = F.size(F.filter(words, lambda w: w.rlike("^[a-h]x?[a-h]?[1-8]([0-9]|$)")))
    return pawns + F.regexp_count(text, F.lit(f"(?<![A-Za-z0-9])(?:{'|'.join(CASTLES)})(?![A-Za-z])"))


def piece_letters(text: Column | str) -> Column:
    """The piece letter of every move that names one, as an array."""
    return F.regexp_extract_all(text, F.lit(PIECE_MOVE.format(letters=LETTERS)), 1)


def saturating(count: Column, full: int) -> Column:
    return F.least(F.lit(1.0), count / F.lit(full))


def offsets_of_lines(text: Column | str) -> Column:
    """Array of (line, start, end) of a text, offsets in code points."""
    t = F.col(text) if isinstance(text, str) else text
    step = lambda acc, part: F.array_append(acc, F.struct(part.alias("line"), (F.element_at(acc, -1)["end"] + 1).alias("start"), (F.element_at(acc, -1)["end"] + 1 + F.length(part)).alias("end")))
    zero = F.array(F.struct(F.lit("").alias("line"), F.lit(-1).alias("start"), F.lit(-1).alias("end")))
    return F.slice(F.aggregate(F.split(t, "\n"), zero, step), 2, 1 << 30)
