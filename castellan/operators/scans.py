"""Page rasters: crops of printed lines, and boards on scanned sheets.

A raster is a rendered or scanned page as 8-bit grey bytes, row by row, with its
size in pixels and the page's size in points. Where a page comes from is the
caller's: a PDF renderer, where one is installed, or image files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..kernels import images
from .pictures import SQUARES

# Fixed values.
LINE_DPI, SHEET_DPI, PADDING = 360, 200, 2.0
RASTERS = "book_id string, page int, page_width double, page_height double, width int, height int, pixels binary"
CROPS = f"book_id string, page int, idx int, clip {schemas.BOX}, scale double, width int, height int, pixels binary"


def grey(pixels: bytes, width: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(-1, int(width))


def read_rasters(spark, path: str, dpi: int = SHEET_DPI) -> DataFrame:
    """Pages of PDF files as rasters, by an installed PDF reader (``pymupdf``)."""
    import pymupdf  # noqa: F401  (absent readers fail here, on the driver)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for f in frames:
            for where, content in zip(f["path"], f["content"]):
                with pymupdf.open(stream=content, filetype="pdf") as doc:
                    for number, page in enumerate(doc, 1):
                        made = page.get_pixmap(dpi=dpi, colorspace=pymupdf.csGRAY)
                        yield pd.DataFrame([(where, number, page.rect.width, page.rect.height, made.width, made.height, bytes(made.samples))], columns=["book_id", "page", "page_width", "page_height", "width", "height", "pixels"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RASTERS)


def clip_of(box: dict, page_width: float, page_height: float, padding: float = PADDING) -> tuple[float, float, float, float]:
    """A line's box (x, y, w, h), wider by the padding and within its page; its height is its own."""
    left, bottom = max(0.0, box["x"] - padding), max(0.0, box["y"])
    right, top = min(page_width, box["x"] + box["w"] + padding), min(page_height, box["y"] + box["h"])
    return round(left, 2), round(bottom, 2), round(right - left, 2), round(top - bottom, 2)


def line_crops(rasters: DataFrame, lines: DataFrame, padding: float = PADDING) -> DataFrame:
    """The picture of every printed line (``schemas.LINES``); a page's raster meets all its lines at once."""
    by_page = lines.groupBy("book_id", "page").agg(F.array_sort(F.collect_list(F.struct("idx", "bbox"))).alias("wanted"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                sheet, rows = grey(r.pixels, r.width), []
                scale = r.width / r.page_width
                for want in r.wanted:
                    x, y, w, h = clip_of(want["bbox"], r.page_width, r.page_height, padding)
                    top = r.page_height - (y + h)
                    cut = sheet[int(top * scale) : int(np.ceil((top + h) * scale)), int(x * scale) : int(np.ceil((x + w) * scale))]
                    rows.append((r.book_id, r.page, want["idx"], dict(zip("xywh", (x, y, w, h))), scale, cut.shape[1], cut.shape[0], cut.tobytes()))
                yield pd.DataFrame(rows, columns=["book_id", "page", "idx", "clip", "scale", "width", "height", "pixels"])

    return rasters.join(by_page, ["book_id", "page"]).mapInPandas(run, CROPS)


def framed_boards(rasters: DataFrame) -> DataFrame:
    """Signatures of the boards on scanned sheets, found by the frames around them, as ``pictures.squares`` gives them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                sheet = grey(r.pixels, r.width).astype(np.float32) / 255.0
                points = r.page_width / r.width
                for top, bottom, left, right in images.framed_boards(sheet, points):
                    board = sheet[top:bottom, left:right]
                    found = images.signatures(board, (0, *board.shape[:1], 0, *board.shape[1:]))
                    if found:
                        box = dict(x=round(left * points, 2), y=round(r.page_height - bottom * points, 2), w=round((right - left) * points, 2), h=round((bottom - top) * points, 2))
                        rows.append((r.book_id, r.page, len(rows), 0, box, [s.tolist() for s in found]))
            yield pd.DataFrame(rows, columns=["book_id", "page", "ord", "start", "bbox", "squares"])

    return rasters.mapInPandas(run, SQUARES)
