"""A survey of books before they are read, and figures of books after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import GAME_START
from ..kernels.constants import MOVE_NUMBER
from .relations import best_window


def survey(pages: DataFrame) -> DataFrame:
    """(book_id, pages, starts, numbers), the books with most games first."""
    start = F.col("text").rlike(GAME_START)
    return pages.groupBy("book_id").agg(F.count("*").alias("pages"), F.count_if(start).alias("starts"), F.sum(F.regexp_count("text", F.lit(MOVE_NUMBER))).alias("numbers")).orderBy(F.desc("starts"), F.desc("numbers"), "book_id")


def windows(pages: DataFrame, size: int = 12) -> DataFrame:
    """The run of pages of each book worth reading first."""
    return best_window(pages, "book_id", "page", F.col("text").rlike(GAME_START).cast("int"), F.regexp_count("text", F.lit(MOVE_NUMBER)), size)


def summary(counts: DataFrame, breaks: DataFrame) -> DataFrame:
    return counts.join(breaks, "book_id", "left").orderBy("book_id")
