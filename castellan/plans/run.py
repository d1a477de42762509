"""From pages to moves: the whole reading of books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import books, diagnosis, notation, pictures, relations
from ..operators.books import Options
from .checkpoints import cut


def letters_of(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """(book_id, letters) to read moves with."""
    report = notation.overridden(notation.reports(pages), options.force_notation, options.force_language)
    return report.select("book_id", notation.piece_letters().alias("letters"))


def run(pages: DataFrame, options: Options = Options(), glyphs: DataFrame | None = None, drawn: DataFrame | None = None, rasters: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a reading.

    ``pages`` follow ``schemas.PAGES``. ``glyphs`` are piece symbols recognised
    on page images (``schemas.GLYPHS``), used for books that need them; ``drawn``
    are stored pictures and ``rasters`` whole pages, searched for boards as
    ``pictures.on_pages`` does on pages without a diagram set in a font.
    """
    if options.infer_symbols:
        found = cut(books.symbol_meanings(pages, letters_of, options))
        if not found.isEmpty():
            pages = books.rewrite_symbols(pages, found)
    report = cut(notation.reports(pages))
    if glyphs is not None:
        wanting = report.where(notation.needs_glyph_recovery()).select("book_id")
        pages = cut(books.repair_pages(pages, glyphs.join(wanting, "book_id", "left_semi")))
        report = cut(notation.reports(pages))
    report = notation.overridden(report, options.force_notation, options.force_language)
    printed = cut(books.find_diagrams(pages))
    blocks, extra, seen = printed, None, None
    if options.read_pictures and not (drawn is None and rasters is None):
        seen = cut(pictures.read(pictures.on_pages(pages, drawn, rasters, printed)))
        blocks = relations.together(printed, seen.select(*printed.columns))
        extra = seen.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "start", "rows"))), lambda x: x.rows).alias("drawn"), F.first("twins").alias("twins"), F.first("empty").alias("empty"))
    tokens = cut(books.tokenize(pages, report.select("book_id", notation.piece_letters().alias("letters")), blocks))
    parsed = cut(books.parse(tokens, options, extra))
    out = {"pages": pages, "notation": report, "diagrams": printed, "tokens": tokens}
    if seen is not None:
        out["pictures"] = seen
    for name, kind in (("games", "game"), ("moves", "move"), ("skipped", "skipped"), ("ambiguities", "ambiguity"), ("checks", "check"), ("contradicted", "contradicted"), ("main_lines", "main_line"), ("letters", "letter"), ("errors", "error")):
        out[name] = books.table_of(parsed, kind)
    out["counts"] = diagnosis.counts(out["games"], out["moves"], out["skipped"], out["ambiguities"])
    return out
