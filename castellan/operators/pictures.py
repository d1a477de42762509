"""Boards drawn as pictures: signatures per image, clusters per book."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..kernels import images
from ..plans.checkpoints import cut
from .relations import together, without

SQUARES = "book_id string, page int, ord int, start int, bbox " + schemas.BOX + ", squares array<array<float>>"
READ = f"book_id string, page int, start int, end int, rows array<string>, bbox {schemas.BOX}, twins array<struct<a:string,b:string>>, empty string"


def shaped_like_boards(pictures: DataFrame, aspect: tuple[float, float] = (0.85, 1.18), min_width: float = 60.0, share: float = 0.5, min_pixels: int = 64) -> DataFrame:
    """Images (bbox, page_area, width, height) wide enough, square enough and not most of a page."""
    b = F.col("bbox")
    return pictures.where((b.w >= min_width) & (b.h > 0) & (b.w / b.h).between(*aspect) & (b.w * b.h <= share * F.col("page_area")) & (F.least("width", "height") >= min_pixels))


def squares(pictures: DataFrame) -> DataFrame:
    """Signatures of the boards among images (book_id, page, ord, start, bbox, width, pixels as float32 bytes)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                image = np.frombuffer(r.pixels, np.float32).reshape(-1, int(r.width))
                region = images.board_region(image)
                found = images.signatures(image, region) if region else None
                if found:
                    rows.append((r.book_id, r.page, r.ord, r.start, r.bbox, [s.tolist() for s in found]))
            yield pd.DataFrame(rows, columns=["book_id", "page", "ord", "start", "bbox", "squares"])

    return pictures.select("book_id", "page", "ord", "start", "bbox", "width", "pixels").mapInPandas(run, SQUARES)


def on_pages(pages: DataFrame, pictures: DataFrame | None = None, rasters: DataFrame | None = None, skip: DataFrame | None = None) -> DataFrame:
    """The boards of all pages, ``start`` being their place in the page's text.

    Stored pictures (with ``page_area`` and ``height``) come first; a page whose
    pictures show no board is searched as a scanned sheet. Pages of ``skip``
    (book_id, page) are read already.
    """
    from .scans import framed_boards

    by = ["book_id", "page"]
    left = lambda df, done: df if done is None else without(df, done, by)
    found = None if pictures is None else cut(squares(shaped_like_boards(left(pictures, skip))))
    if rasters is not None:
        drawn = framed_boards(left(left(rasters, skip), found))
        found = drawn if found is None else together(found, drawn)
    if found is None:
        raise ValueError("neither pictures nor rasters to look for boards in")
    found = cut(found)
    return found.drop("start").join(place(found, pages), [*by, "ord"]).select(*(f.name for f in found.schema.fields))


def read(found: DataFrame) -> DataFrame:
    """Boards as rows of characters; one book is clustered in order, as one group."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["page", "ord"], kind="stable")
        cells = [np.asarray(s, dtype=np.float32) for board in f["squares"] for s in board]
        labels = images.cluster(cells)
        empty, pairs = images.twins(cells, labels)
        text = "".join(chr(images.FIRST_CHAR + k) for k in labels)
        rows = [[text[64 * k + 8 * r : 64 * k + 8 * r + 8] for r in range(8)] for k in range(len(f))]
        return pd.DataFrame({"book_id": f["book_id"], "page": f["page"], "start": f["start"], "end": f["start"], "rows": rows, "bbox": f["bbox"], "twins": [[{"a": a, "b": b} for a, b in pairs]] * len(f), "empty": empty})

    return found.groupBy("book_id").applyInPandas(solve, READ)


def place(boards: DataFrame, pages: DataFrame) -> DataFrame:
    """Text offset of each picture (book_id, page, ord, bbox): the first character below its lower edge and mostly under it, moved back to its word's start."""
    chars = pages.select("book_id", "page", "text", F.posexplode("chars").alias("pos", "c"))
    c, b = F.col("c.bbox"), F.col("bbox")
    across = F.least(c.x + c.w, b.x + b.w) - F.greatest(c.x, b.x)
    below = (c.w > 0) & (c.h > 0) & (c.y + c.h <= b.y) & (across > 0.5 * c.w)
    hit = boards.select("book_id", "page", "ord", "bbox").join(chars, ["book_id", "page"]).where(below)
    first = hit.groupBy("book_id", "page", "ord").agg(F.min("pos").alias("pos"))
    text = pages.select("book_id", "page", "text")
    at = boards.select("book_id", "page", "ord").join(first, ["book_id", "page", "ord"], "left").join(text, ["book_id", "page"])
    word = F.length(F.regexp_extract(F.expr("substring(text, 1, pos)"), r"(\S*)$", 1))
    return at.select("book_id", "page", "ord", F.coalesce(F.col("pos") - word, F.length("text")).cast("int").alias("start"))


def centroids(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by, k, centre): the mean of each of a group's coordinates, k from 1."""
    return rows.select(*by, F.posexplode(vector).alias("__p", "__v")).groupBy(*by, (F.col("__p") + 1).alias("k")).agg(F.avg(F.col("__v").cast("double")).alias("centre"))


def ground_shades(rows: DataFrame, by: list[str], shades: str, side: int = images.SIDE) -> DataFrame:
    """(by, light, dark, is_board): mean shade of either parity of a board's squares, row by row, and whether they differ enough."""
    k = F.col("__p")
    parity = (F.floor(k / side) + k % side) % 2
    mean = lambda p: F.avg(F.when(parity == p, F.col("__v").cast("double")))
    both = rows.select(*by, F.posexplode(shades).alias("__p", "__v")).groupBy(*by).agg(mean(0).alias("light"), mean(1).alias("dark"))
    return both.withColumn("is_board", F.abs(F.col("light") - F.col("dark")) >= images.MIN_CONTRAST)
