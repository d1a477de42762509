"""How far a reading can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .trees import ancestors


def status_counts(rows: DataFrame, by: list[str], status: Column, names: dict[str, str]) -> DataFrame:
    """Rows per group and per status; ``names`` maps a status to its output column."""
    return rows.groupBy(*by).agg(F.count("*").alias("moves"), *(F.count_if(status == s).alias(n) for s, n in names.items()))


def counts(games: DataFrame, moves: DataFrame, skipped: DataFrame, ambiguities: DataFrame) -> DataFrame:
    """One row per book."""
    per = lambda df, name: df.groupBy("book_id").agg(F.count("*").alias(name))
    out = per(games, "games").join(status_counts(moves, ["book_id"], F.col("status"), {s: s for s in ("ok", "uncertain", "broken")}), "book_id", "full")
    out = out.join(per(skipped, "skipped"), "book_id", "full").join(per(ambiguities, "ambiguous"), "book_id", "full")
    return out.na.fill(0)


def break_diagnosis(moves: DataFrame, by: list[str], id_col: str, parent_col: str, broken: Column, sound: Column, contradicted: Column, unscored: Column) -> DataFrame:
    """first_breaks, cascade, clean, below_break, contradicted and unscored per group."""
    up = ancestors(moves, id_col, parent_col, broken, F.lit(False)).select(F.col("id").alias("__id"), "tainted")
    m = moves.select(*by, F.col(id_col).alias("__m"), broken.alias("b"), sound.alias("s"), F.coalesce(contradicted, F.lit(False)).alias("c"), F.coalesce(unscored, F.lit(False)).alias("u")).join(up, F.col("__m") == F.col("__id"))
    n = lambda cond, name: F.count_if(cond & ~F.col("u")).alias(name)
    t, b, s, c = F.col("tainted"), F.col("b"), F.col("s"), F.col("c")
    return m.groupBy(*by).agg(n(b & ~t, "first_breaks"), n(b & t, "cascade"), n(s & ~t & ~c, "clean"), n(s & t, "below_break"), n(s & ~t & c, "contradicted"), F.count_if("u").alias("unscored"))


def book_breaks(moves: DataFrame, games: DataFrame, contradicted: DataFrame) -> DataFrame:
    """Break diagnosis of parsed books."""
    key = lambda c: F.concat_ws("\u0001", "book_id", c)
    m = moves.withColumn("node", key("id")).withColumn("up", F.when(F.col("parent_id").isNotNull(), key("parent_id")))
    against = contradicted.select("book_id", F.col("move_id").alias("id"), F.lit(True).alias("against")).distinct()
    unknown = games.where("not position_known").select("book_id", F.col("id").alias("game_id"), F.lit(True).alias("unknown"))
    m = m.join(against, ["book_id", "id"], "left").join(unknown, ["book_id", "game_id"], "left")
    return break_diagnosis(m, ["book_id"], "node", "up", F.col("status") == "broken", F.col("status") == "ok", F.col("against"), F.col("unknown"))


def ambiguity_diagnosis(ambiguities: DataFrame, by: list[str] = ["book_id"]) -> DataFrame:  # noqa: B006
    d = F.col("upstream_repair_distance")
    return ambiguities.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(d.isNotNull()).alias("downstream_of_repair"), F.count_if(d.isNull()).alias("clean_line"),
        F.count_if(F.col("settled_by") == "consumed").alias("settled_from_consumed"), F.array_sort(F.collect_list(d)).alias("nearest_repair_plies"),
    )


def problems(moves: DataFrame, by: list[str], limit: int = 20) -> DataFrame:
    """The moves most in need of a look: broken first, then the least sure; a report of at most ``limit``."""
    order = W.partitionBy(*by).orderBy((F.col("status") != "broken").cast("int"), "confidence", "ord")
    return moves.where("status <> 'ok'").withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).drop("k")


def verdicts(checks: DataFrame, by: list[str] = ["book_id"]) -> DataFrame:  # noqa: B006
    return checks.groupBy(*by, "verdict").agg(F.count("*").alias("n"))


def report(counts_row: dict, breaks: dict, notation: dict, verdict_counts: dict) -> str:
    """A book's figures as text."""
    language = f", {notation['language']}" if notation.get("language") else ""
    lines = [
        f"notation: {notation['style']}{language} (confidence {notation['confidence']:.2f})",
        f"games: {counts_row['games']}, moves: {counts_row['moves']} ({counts_row['ok']} ok, {counts_row['uncertain']} uncertain, {counts_row['broken']} broken)",
        f"skipped: {counts_row['skipped']}, ambiguous: {counts_row['ambiguous']}",
        f"clean: {breaks['clean']}, below a break: {breaks['below_break']}, contradicted: {breaks['contradicted']}, first breaks: {breaks['first_breaks']}, cascade: {breaks['cascade']}, unscored: {breaks['unscored']}",
    ]
    if verdict_counts:
        lines.append("diagrams: " + ", ".join(f"{n} {v}" for v, n in sorted(verdict_counts.items())))
    return "\n".join(lines)
