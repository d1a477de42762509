"""How a book writes its moves: counts per book, then a decision list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..kernels.constants import ALPHABETS, FIGURINE_FONTS, FIGURINES, GLYPH_FONT, OCR_FONT, SAN_LETTERS

MANY, FULL_FIGURINES, FULL_LETTERS = 20, 200, 100


def font_inventory(pages: DataFrame) -> DataFrame:
    """(book_id, font, n, first): characters that are not blank per font, first seen place for ties."""
    blank = r"[\s\u0000\u0085\u2028\u2029]"  # what ``^\s*$`` finds in single characters, and the mark between them
    held = pages.select("book_id", "page", "chars", F.array_distinct("chars.font").alias("names"), F.array_join("chars.char", "\u0000", " ").alias("joined"))
    marks = F.length("joined") - F.length(F.replace("joined", F.lit("\u0000"), F.lit("")))
    # A page of one font and single characters is counted as text.
    plain = (F.size("names") == 1) & (F.length("joined") == 2 * F.size("chars") - 1) & (marks == F.size("chars") - 1)
    lead = F.regexp_extract("joined", f"^{blank}*", 0)
    whole = F.struct(F.element_at("names", 1).alias("font"), F.length(F.regexp_replace("joined", f"{blank}+", "")).alias("n"), (F.length(lead) - F.length(F.replace(lead, F.lit("\u0000"), F.lit("")))).cast("int").alias("pos"))
    seen = F.filter(F.transform("chars", lambda c, i: F.struct(c.font.alias("font"), i.alias("pos"), c.char.rlike(r"^\s*$").alias("blank"))), lambda x: ~x.blank)
    held = held.withColumn("plain", plain).withColumn("whole", F.when(F.col("plain"), whole)).withColumn("seen", F.when(F.coalesce("plain", F.lit(False)), None).otherwise(seen)).drop("chars", "joined", "names")
    # Elsewhere a page has few fonts, so its characters are counted in place and only fonts become rows.
    names = F.array_distinct(F.transform("seen", lambda x: x.font))
    own = lambda f: F.filter("seen", lambda x: x.font.eqNullSafe(f))
    per = F.transform(names, lambda f: F.struct(f.alias("font"), F.size(own(f)).alias("n"), F.element_at(own(f), 1).pos.alias("pos")))
    fonts = held.select("book_id", "page", F.explode(F.when(F.col("plain"), F.array("whole")).otherwise(per)).alias("f")).where("f.n > 0")
    return fonts.groupBy("book_id", F.col("f.font").alias("font")).agg(F.sum(F.col("f.n").cast("bigint")).alias("n"), F.min(F.struct("page", F.col("f.pos").alias("pos"))).alias("first"))


def ranked_fonts(pages: DataFrame) -> DataFrame:
    order = W.partitionBy("book_id").orderBy(F.desc("n"), "first")
    return font_inventory(pages).withColumn("rank", F.row_number().over(order))


def letter_hits(pages: DataFrame) -> DataFrame:
    """(book_id, letter, hits) over moves that name a piece."""
    return pages.select("book_id", F.explode(T.piece_letters("text")).alias("letter")).groupBy("book_id", "letter").agg(F.count("*").alias("hits"))


def language_scores(hits: DataFrame) -> DataFrame:
    """(book_id, language, alphabet, score): hits of each language's letters, in the languages' fixed order."""
    dim = hits.sparkSession.createDataFrame([(k, lang, alphabet, letter) for k, (lang, alphabet) in enumerate(ALPHABETS.items()) for letter in alphabet], "ord int, language string, alphabet string, letter string")
    return hits.join(F.broadcast(dim), "letter").groupBy("book_id", "ord", "language", "alphabet").agg(F.sum("hits").alias("score"))


def best_language(scores: DataFrame) -> DataFrame:
    """(book_id, language, best, runner): the winner, and the best score of a different alphabet."""
    first = F.max(F.struct("score", (-F.col("ord")).alias("o"), "language", "alphabet"))
    best = scores.groupBy("book_id").agg(first.alias("b")).select("book_id", F.col("b.language").alias("language"), F.col("b.alphabet").alias("won"), F.col("b.score").alias("best"))
    other = F.max(F.when(F.col("alphabet") != F.col("won"), F.col("score")))
    return scores.drop("language").join(best, "book_id").groupBy("book_id", "language", "best").agg(F.coalesce(other, F.lit(0)).alias("runner"))


def reports(pages: DataFrame) -> DataFrame:
    """One notation report per book."""
    figurine = "[" + "".join(FIGURINES) + "]"
    # Pages are joined by a newline, across which no move or symbol is matched.
    counts = pages.groupBy("book_id").agg(
        F.sum(F.regexp_count("text", F.lit(figurine))).cast("int").alias("figurine_count"),
        F.sum(T.neutral_moves("text")).cast("int").alias("neutral_move_count"),
        F.sum(F.size(F.filter("chars", lambda c: c.font == GLYPH_FONT))).cast("int").alias("glyphs_recovered"),
    )
    fonts = ranked_fonts(pages)
    like = lambda *hints: F.lower("font").rlike("|".join(hints))
    named = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "font")))), lambda x: x.font)
    found = fonts.groupBy("book_id").agg(named(like(OCR_FONT)).alias("ocr"), named(like(*FIGURINE_FONTS)).alias("suspect"))
    hits = letter_hits(pages)
    scores = language_scores(hits)
    by_letter = hits.groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("letter", "hits")))).alias("letter_hits"))
    by_language = scores.groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "score")))).alias("language_scores"))
    b = counts.join(found, "book_id", "left").join(best_language(scores), "book_id", "left").join(by_letter, "book_id", "left").join(by_language, "book_id", "left")
    none = F.array().cast("array<string>")
    ocr, suspect = F.coalesce("ocr", none), F.coalesce("suspect", none)
    n, m, best, runner = F.col("figurine_count"), F.col("neutral_move_count"), F.coalesce("best", F.lit(0)), F.coalesce("runner", F.lit(0))
    scan = (F.size(ocr) > 0) & (F.col("glyphs_recovered") == 0)
    rule = F.when(scan, 1).when(n >= MANY, 2).when((F.size(suspect) > 0) & (m >= MANY), 3).when(best == 0, 4).when(runner >= best, 5).otherwise(6)
    margin = T.saturating(best, FULL_LETTERS) * (0.5 + 0.5 * (best - runner) / F.nullif(best, F.lit(0)))
    out = b.withColumn("rule", rule)
    r = F.col("rule")
    return out.select(
        "book_id",
        F.when(r == 2, "figurine_unicode").when(r == 3, "figurine_font").otherwise("letters").alias("style"),
        F.when(r == 6, F.col("language")).alias("language"),
        F.when(r == 2, T.saturating(n, FULL_FIGURINES)).when(r == 3, 0.8 * T.saturating(m, FULL_FIGURINES)).when(r == 6, margin).otherwise(0.0).alias("confidence"),
        "figurine_count",
        "neutral_move_count",
        F.when(r == 1, ocr).when((r == 2) & (F.size(ocr) > 0), ocr).otherwise(suspect).alias("font_names"),
        F.when(r >= 3, F.col("language_scores")).alias("language_scores"),
        F.when(r >= 3, F.col("letter_hits")).alias("letter_hits"),
        ((r <= 2) & (F.size(ocr) > 0)).alias("is_ocr_layer"),
        F.when(r == 2, F.col("glyphs_recovered")).otherwise(0).alias("glyphs_recovered"),
    )


def overridden(report: DataFrame, style: str | None = None, language: str | None = None) -> DataFrame:
    if style:
        report = report.withColumn("style", F.lit(style)).withColumn("confidence", F.lit(1.0))
    return report.withColumn("language", F.lit(language)) if language else report


def piece_letters() -> Column:
    """The alphabet to read a book's moves with, from its report."""
    own = F.coalesce(*(F.when(F.col("language") == k, F.lit(v)) for k, v in ALPHABETS.items()), F.lit(SAN_LETTERS))
    return F.when(F.col("style") == "letters", own).otherwise(SAN_LETTERS)


def is_supported() -> Column:
    readable = (F.col("style") == "figurine_unicode") | ((F.col("style") == "letters") & F.col("language").isNotNull())
    return readable & ~(F.col("is_ocr_layer") & (F.col("glyphs_recovered") == 0))


def needs_glyph_recovery() -> Column:
    unread = (F.col("style") == "letters") & F.col("language").isNull() & (F.col("neutral_move_count") >= MANY)
    return (F.col("glyphs_recovered") == 0) & (F.col("is_ocr_layer") | (F.col("style") == "figurine_font") | unread)
