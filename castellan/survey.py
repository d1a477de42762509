"""``python -m castellan.survey PAGES [--window N]``: which books, and which of their pages, to read first."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import survey
from .sources.pages import read_pages


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("pages", help="Parquet of pages")
    parser.add_argument("--window", type=int, help="also name the best run of so many pages")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    pages = read_pages(spark, given.pages)
    survey.survey(pages).show(1000, truncate=False)
    if given.window:
        survey.windows(pages, given.window).show(1000, truncate=False)


if __name__ == "__main__":
    main()
