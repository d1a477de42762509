"""Printed lines rebuilt from character boxes, and symbols spliced into them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

from .constants import GLYPH_FONT, MOVE_BODY, MOVE_NUMBER
from .tokens import ASCII_LETTERS, ASCII_WORD, SQUARE, Box, PageText, union

# Fixed values.
MIN_HEIGHT, MIN_COVERAGE = 6.0, 0.6
CHAR_COVER, MAX_LEFTOVERS = 0.8, 3
WHITE_FIGURINE = dict(zip("KQRBN", "♔♕♖♗♘"))
NUMBER = re.compile(MOVE_NUMBER)
REACH = 5  # how far into a word a move's square may stand, a capture's sign not counted


def ends_in_number(word: str) -> bool:
    """Whether a word closes with one to three digits that no letter precedes."""
    n = 0
    while n < len(word) and word[-1 - n].isdecimal():
        n += 1
    return 1 <= n <= 3 and word[: len(word) - n][-1:] not in ASCII_LETTERS


def opens_as_move(word: str) -> bool:
    """Whether a word begins like a castling or has a whole square near its front."""
    if word[:1] in tuple("Oo0") and word[1:2] == "-" and word[2:3] in tuple("Oo0"):
        return True
    return any(m.start() - (word[m.start() - 1 : m.start()] == "x") <= REACH and word[m.end() : m.end() + 1] not in ASCII_WORD for m in SQUARE.finditer(word))


def has_dotless_number(text: str) -> bool:
    words = text.split()
    return any(ends_in_number(a) and opens_as_move(b) for a, b in zip(words, words[1:]))


@dataclass(frozen=True)
class Line:
    page: int
    bbox: Box
    text: str
    spans: tuple[tuple[int, int], ...]
    column: int
    coverage: float

    @property
    def has_notation(self) -> bool:
        return bool(NUMBER.search(self.text)) or has_dotless_number(self.text)


@dataclass(frozen=True)
class Fragment:
    start: int
    end: int
    text: str
    bbox: Box


def top(b: Box) -> float:
    return b[1] + b[3]


def fragments(page: PageText) -> Iterator[Fragment]:
    at = 0
    for part in page.text.split("\n"):
        box = page.box(at, at + len(part)) if part else None
        if box:
            yield Fragment(at, at + len(part), part, box)
        at += len(part) + 1


def column_cut(boxes: list[Box], width: float) -> float | None:
    """The integer x that fewest boxes cross, nearest the middle, if it parts the page."""
    if len(boxes) < 8:
        return None
    xs = range(int(0.25 * width), int(0.75 * width))
    cut = min(xs, key=lambda x: (sum(b[0] < x < b[0] + b[2] for b in boxes), abs(x - width / 2)))
    n = len(boxes)
    crossing = sum(b[0] < cut < b[0] + b[2] for b in boxes)
    left, right = sum(b[0] + b[2] <= cut for b in boxes), sum(b[0] >= cut for b in boxes)
    return float(cut) if crossing <= max(3, 0.05 * n) and min(left, right) >= 0.2 * n else None


def columns(found: list[Fragment], cut: float | None) -> list[tuple[int, list[Fragment]]]:
    """Fragments by column; each one across the cut is alone in column -1."""
    if cut is None:
        return [(0, found)]
    across = [f for f in found if f.bbox[0] < cut < f.bbox[0] + f.bbox[2]]
    rest = [f for f in found if f not in across]
    sides = [(k, [f for f in rest if (f.bbox[0] >= cut) == bool(k)]) for k in (0, 1)]
    return [(k, fs) for k, fs in sides if fs] + [(-1, [f]) for f in across]


def overlaps(a: Box, b: Box, share: float = 0.5) -> bool:
    """Whether the boxes overlap vertically by a share of the lower one."""
    return min(top(a), top(b)) - max(a[1], b[1]) >= share * min(a[3], b[3])


def rows(found: list[Fragment]) -> Iterator[list[Fragment]]:
    row: list[Fragment] = []
    for f in sorted(found, key=lambda f: (-top(f.bbox), f.bbox[0])):
        if row and not any(overlaps(f.bbox, o.bbox) for o in row):
            yield sorted(row, key=lambda f: f.bbox[0])
            row = []
        row.append(f)
    if row:
        yield sorted(row, key=lambda f: f.bbox[0])


def covered(intervals: list[tuple[float, float]]) -> float:
    """Length of a union of intervals."""
    total, reach = 0.0, float("-inf")
    for a, b in sorted(intervals):
        total += max(0.0, b - max(a, reach))
        reach = max(reach, b)
    return total


def segment(page: PageText, width: float, min_height: float = MIN_HEIGHT, min_coverage: float = MIN_COVERAGE) -> list[Line]:
    """The printed lines of a page by column and height; a box stops where the line above begins."""
    found = [f for f in fragments(page) if f.bbox[3] >= min_height and f.text.strip()]
    made = []
    for column, group in columns(found, column_cut([f.bbox for f in found], width)):
        for row in rows(group):
            box = row[0].bbox
            for f in row[1:]:
                box = union([box, f.bbox])
            share = covered([(f.bbox[0], f.bbox[0] + f.bbox[2]) for f in row]) / box[2] if box[2] else 0.0
            if share >= min_coverage:
                made.append(Line(page.number, box, " ".join(f.text.strip() for f in row), tuple((f.start, f.end) for f in row), column, share))
    made.sort(key=lambda x: (x.column, -top(x.bbox)))
    for k in range(1, len(made)):
        above, line = made[k - 1], made[k]
        reach = top(line.bbox) - above.bbox[1]
        if above.column == line.column and reach > 0:
            x, y, w, h = line.bbox
            made[k] = replace(line, bbox=(x, y, w, round(h - reach, 2)))
    return made


def with_notation(found: list[Line], context: int = 1) -> list[Line]:
    """Lines with a move number and the next ``context`` lines of their column."""
    keep = {k + d for k, line in enumerate(found) if line.has_notation for d in range(context + 1) if k + d < len(found) and found[k + d].column == line.column}
    return [line for k, line in enumerate(found) if k in keep]


# --- symbols written into a page ---


@dataclass
class Char:
    char: str
    bbox: Box
    font: str
    size: float
    consumed: str = ""


def on_row(char: Box, glyph: Box) -> bool:
    return char[2] > 0 and char[3] > 0 and overlaps(char, glyph)


def inside(char: Box, glyph: Box) -> bool:
    return min(char[0] + char[2], glyph[0] + glyph[2]) - max(char[0], glyph[0]) >= CHAR_COVER * char[2]


def covered_range(chars: list[Char], glyph: Box) -> tuple[int, int]:
    """Characters printed under a symbol, with up to three leftovers that no move contains; else where it belongs."""
    row = [k for k, c in enumerate(chars) if on_row(c.bbox, glyph)]
    under = [k for k in row if inside(chars[k].bbox, glyph)]
    if under:
        end = under[-1] + 1
        for c in chars[end : end + MAX_LEFTOVERS]:
            if c.char.isspace() or c.char in MOVE_BODY:
                break
            end += 1
        return under[0], end
    at = next((k for k in row if chars[k].bbox[0] >= glyph[0]), row[-1] + 1 if row else len(chars))
    return at, at


def repair(chars: list[Char], glyphs: list[tuple[str, Box]]) -> list[Char]:
    """The page's characters with each (piece, box) spliced in, from right to left."""
    edits = []
    for piece, box in glyphs:
        start, end = covered_range(chars, box)
        edits.append((start, end, Char(WHITE_FIGURINE[piece], box, GLYPH_FONT, round(box[3], 2), "".join(c.char for c in chars[start:end]))))
    out = list(chars)
    for start, end, char in sorted(edits, key=lambda e: -e[0]):
        out[start:end] = [char]
    return out


