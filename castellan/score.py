"""``python -m castellan.score GLYPHS TRUTH [--pages 5-6] [--confidence C | --sweep]``: recognised symbols against a transcript."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import glyphs
from .sources.pages import read_truth


def page_numbers(spec: str) -> list[int]:
    """``5-6,9`` as 5, 6, 9."""
    out = []
    for part in spec.split(","):
        first, _, last = part.partition("-")
        out += range(int(first), int(last or first) + 1)
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("glyphs", help="Parquet of (page, line_no, ord, piece, confidence)")
    parser.add_argument("truth", help="JSON transcript")
    parser.add_argument("--pages", type=page_numbers)
    parser.add_argument("--confidence", type=float, default=glyphs.MIN_CONFIDENCE)
    parser.add_argument("--sweep", action="store_true")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    found, truth = spark.read.parquet(given.glyphs), read_truth(spark, given.truth)
    if given.pages:
        found, truth = found.where(F.col("page").isin(given.pages)), truth.where(F.col("page").isin(given.pages))
    glyphs.scores(found, truth, ["page", "line_no"], glyphs.THRESHOLDS if given.sweep else [given.confidence]).orderBy("threshold").show()


if __name__ == "__main__":
    main()
