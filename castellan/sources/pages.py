"""Pages of characters: from Parquet, from plain texts, or from PDF files where a reader is installed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schemas
from ..functions import geometry
from ..operators.groups import tasks


def read_pages(spark: SparkSession, path: str, first: int = 1, last: int | None = None) -> DataFrame:
    """A pages table, pruned to pages first to last (inclusive)."""
    return page_range(spark.read.schema(schemas.PAGES).parquet(path), first, last)


def page_range(pages: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    kept = pages.where(F.col("page") >= first)
    return kept if last is None else kept.where(F.col("page") <= last)


def page_count(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book_id").agg(F.max("page").alias("page_count"))


def page_texts(pages: DataFrame) -> DataFrame:
    return pages.select("book_id", "page", "text")


def of_texts(texts: DataFrame, width: float = 595.0, height: float = 842.0, font: str = "Serif") -> DataFrame:
    """Pages set in one row from (book_id, page, text); for texts that come without geometry.

    A small file of texts makes much work, so they are dealt out before they grow.
    """
    texts = texts.repartition(tasks(texts.sparkSession), "book_id", "page")
    letters = F.split("text", "")
    box = lambda i: geometry.box(i.cast("double"), F.lit(700.0), F.lit(1.0), F.lit(10.0))
    chars = F.transform(letters, lambda c, i: F.struct(c.alias("char"), box(i).alias("bbox"), F.lit(font).alias("font"), F.lit(10.0).alias("size"), F.lit("").alias("consumed")))
    chars = F.when(F.length("text") > 0, chars).otherwise(F.array().cast(f"array<{schemas.CHAR}>"))
    return texts.select("book_id", F.col("page").cast("int").alias("page"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.coalesce("text", F.lit("")).alias("text"), chars.alias("chars"))


def of_blocks(blocks: DataFrame, sort_blocks: bool = False) -> DataFrame:
    """Pages from text blocks (book_id, page, width, height, block, x0, y0, lines array<array<char>>).

    Lines are separated by a newline and blocks by two, which carry empty boxes.
    Blocks keep their order, or go by height and then left edge.
    """
    filler = lambda t: F.struct(F.lit(t).alias("char"), geometry.filler().alias("bbox"), F.lit("").alias("font"), F.lit(0.0).alias("size"), F.lit("").alias("consumed"))
    none = F.array().cast(f"array<{schemas.CHAR}>")
    glue = lambda parts, n: F.aggregate(parts, none, lambda acc, part: F.when(F.size(acc) == 0, part).otherwise(F.concat(acc, F.array(*[filler("\n")] * n), part)))
    by = ["page_y", "page_x", "block"] if sort_blocks else ["block"]
    one = blocks.withColumn("page_y", F.bround("y0", 1)).withColumn("page_x", F.bround("x0", 1)).withColumn("chars", glue(F.col("lines"), 1))
    held = one.groupBy("book_id", "page").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.array_sort(F.collect_list(F.struct(*by, "chars"))).alias("b"))
    chars = glue(F.transform("b", lambda x: x.chars), 2)
    return held.withColumn("chars", chars).select("book_id", "page", "width", "height", F.array_join(F.transform("chars", lambda c: c.char), "").alias("text"), "chars")


def discover(files: DataFrame, directory_rank: Column | None = None) -> DataFrame:
    """One file per stem: copies named ``stem (2).pdf`` fold into the shortest name, then path; earlier directories first."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r" \(\d+\)$", "")
    w = W.partitionBy("stem").orderBy("rank", F.length("name"), "path")
    named = files.withColumn("name", name).withColumn("stem", stem).withColumn("rank", directory_rank if directory_rank is not None else F.lit(0))
    return named.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "rank")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Hand transcripts ``{page: [{pieces, text}, ..]}`` as (page, line_no, pieces, text)."""
    raw = spark.read.text(path, wholetext=True)
    pages = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("page", "lines")).where(F.col("page").rlike(r"^\d+$"))
    lines = pages.select(F.col("page").cast("int").alias("page"), F.posexplode(F.from_json("lines", "array<struct<pieces:string,text:string>>")).alias("line_no", "l"))
    return lines.select("page", "line_no", "l.pieces", "l.text")


def read_pdf(spark: SparkSession, path: str, sort_blocks: bool = False) -> DataFrame:
    """Pages of PDF files by an installed PDF reader (``pymupdf``); one file is one task's work at a time."""
    import pymupdf  # noqa: F401  (absent readers fail here, on the driver)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for f in frames:
            for where, content in zip(f["path"], f["content"]):
                with pymupdf.open(stream=content, filetype="pdf") as doc:
                    for number, page in enumerate(doc, 1):
                        rows = []
                        for k, block in enumerate(b for b in page.get_text("rawdict")["blocks"] if b["type"] == 0):
                            held = []
                            for line in block["lines"]:
                                chars = [(c, s["font"], s["size"]) for s in line["spans"] for c in s["chars"]]
                                box = lambda b, h=page.rect.height: {"x": round(b[0], 2), "y": round(h - b[3], 2), "w": round(b[2] - b[0], 2), "h": round(b[3] - b[1], 2)}
                                held.append([{"char": c["c"], "bbox": box(c["bbox"]), "font": font, "size": round(size, 2), "consumed": ""} for c, font, size in chars])
                            rows.append((where, number, page.rect.width, page.rect.height, k, block["bbox"][0], block["bbox"][1], held))
                        yield pd.DataFrame(rows, columns=["book_id", "page", "width", "height", "block", "x0", "y0", "lines"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    blocks = files.mapInPandas(run, f"book_id string, page int, width double, height double, block int, x0 double, y0 double, lines array<array<{schemas.CHAR}>>")
    return of_blocks(blocks, sort_blocks)
