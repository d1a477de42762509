"""Lookups of a reader: moves on a page, labels, tap zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chess, geometry
from .relations import next_page

INFLATE = 2.0


def annotated_pages(moves: DataFrame) -> DataFrame:
    """(book_id, page, moves, broken, uncertain) of the pages that hold moves."""
    return moves.groupBy("book_id", "page").agg(F.count("*").alias("moves"), F.count_if(F.col("status") == "broken").alias("broken"), F.count_if(F.col("status") == "uncertain").alias("uncertain"))


def page_after(moves: DataFrame, page: int) -> DataFrame:
    return next_page(moves.select("book_id", "page").distinct(), ["book_id"], "page", F.lit(page))


def tap_zones(moves: DataFrame, pages: DataFrame, width: float, height: float) -> DataFrame:
    """Each move's zone on a page shown at ``width`` by ``height``."""
    m = moves.join(pages.select("book_id", "page", F.col("width").alias("pw"), F.col("height").alias("ph")), ["book_id", "page"])
    zone = geometry.page_rect("zone", F.col("pw"), F.col("ph"), F.lit(width), F.lit(height))
    return m.withColumn("zone", geometry.inflated("bbox", INFLATE)).select("book_id", "page", "id", chess.move_label("ply", F.col("san")).alias("label"), (F.col("variation_index") > 0).alias("is_variation"), zone.alias("rect"))
