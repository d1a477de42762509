"""Schemas of the engine's tables and the contract checks on archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,w:double,h:double>"
CHAR = f"struct<char:string,bbox:{BOX},font:string,size:double,consumed:string>"
PAGES = f"book_id string, page int, width double, height double, text string, chars array<{CHAR}>"
TOKENS = f"book_id string, seq bigint, kind string, text string, raw string, page int, start int, end int, bbox {BOX}, consumed string, lost_symbol string"
GAMES = "book_id string, id string, title string, initial_fen string, root_move_id string, page_start int, position_known boolean"
REPAIR = "struct<raw:string,reason:string>"
MOVES = (
    f"book_id string, id string, game_id string, parent_id string, san string, uci string, fen string, ply int, page int, bbox {BOX}, "
    f"variation_index int, comment string, confidence double, status string, repair {REPAIR}"
)
SKIPPED = f"book_id string, ord int, kind string, text string, raw string, page int, start int, end int, bbox {BOX}, consumed string, lost_symbol string, reason string"
AMBIGUITIES = "book_id string, move_id string, page int, raw string, consumed string, candidates array<string>, settled_by string, upstream_repair_distance int"
CHECKS = "book_id string, ord int, page int, rows array<string>, reached string, game string, index int, printed string, sound boolean, verdict string"
CONTRADICTED = "book_id string, move_id string"
MAIN_LINES = "book_id string, game_id string, placements array<string>"
DIAGRAMS = f"book_id string, page int, start int, end int, rows array<string>, bbox {BOX}"
GLYPHS = f"book_id string, piece string, confidence double, page int, bbox {BOX}, width_ratio double"
LINES = f"book_id string, page int, idx int, bbox {BOX}, text string, spans array<struct<start:int,end:int>>, column int, coverage double, has_notation boolean"
PATCHES = "ord int, move_id string, type string, value string, source string, ts timestamp"
TRUTH = "page int, line_no int, pieces string, text string"

MANIFEST = (
    "schema_version string, source struct<path:string,filename:string,media_type:string,sha256:string,page_count:int>, "
    "notation struct<style:string,language:string,confidence:double>, generator struct<name:string,version:string,generated_at:string>, "
    "counts struct<games:int,moves:int,ok:int,uncertain:int,broken:int>"
)
MOVES_DOCUMENT = (
    "schema_version string, games array<struct<id:string,title:string,initial_fen:string,root_move_id:string,page_start:int,position_known:boolean>>, "
    f"moves array<struct<id:string,game_id:string,parent_id:string,san:string,uci:string,fen:string,ply:int,page:int,bbox:{BOX},variation_index:int,comment:string,confidence:double,status:string,repair:{REPAIR}>>"
)

# Fixed values of the exchange format.
STATUSES = ("ok", "uncertain", "broken")
STYLES = ("figurine_unicode", "figurine_font", "letters")
PATCH_TYPES = ("san_edit", "bbox_edit", "fen_override")
PATCH_SOURCES = ("user", "auto")
MEDIA_TYPES = {".pdf": "application/pdf", ".epub": "application/epub+zip"}
OTHER_MEDIA = "application/octet-stream"
ARTEFACTS = ("pages", "glyphs", "notation", "diagrams", "pictures", "tokens", "moves")


def with_default(column: Column | str, allowed: tuple[str, ...], default: str) -> Column:
    """An enumeration read tolerantly: unknown and null values become the default."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isin(list(allowed)), c).otherwise(F.lit(default))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each row and each named rule that is not true; null counts as broken."""
    broken = F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()))
    return df.select(F.col(key).alias("key"), F.explode(F.array_compact(broken)).alias("rule"))


def move_rules() -> dict[str, Column]:
    """What the exchange format asks of a move."""
    return {
        "id": F.col("id").rlike(r"^\S+$"),
        "game_id": F.col("game_id").isNotNull(),
        "san": F.length("san") > 0,
        "ply": F.col("ply") >= 0,
        "page": F.col("page") >= 1,
        "variation_index": F.col("variation_index") >= 0,
        "confidence": F.col("confidence").between(0, 1),
        "status": F.col("status").isin(list(STATUSES)),
        "uci": F.col("uci").isNull() | F.col("uci").rlike("^[a-h][1-8][a-h][1-8][qrbn]?$"),
        "broken has no fen": (F.col("status") != "broken") | F.col("fen").isNull(),
    }


def patch_rules() -> dict[str, Column]:
    """What it asks of a patch; ``value`` is JSON, and its shape follows the type."""
    has = lambda path: F.get_json_object("value", path).isNotNull()
    shape = F.when(F.col("type") == "san_edit", has("$.san")).when(F.col("type") == "fen_override", has("$.fen")).when(F.col("type") == "bbox_edit", has("$.x") & has("$.y") & has("$.w") & has("$.h"))
    return {"move_id": F.col("move_id").isNotNull(), "type": F.col("type").isin(list(PATCH_TYPES)), "source": F.col("source").isin(list(PATCH_SOURCES)), "ts": F.col("ts").isNotNull(), "value": shape}


def manifest_rules() -> dict[str, Column]:
    return {
        "schema_version": F.col("schema_version").rlike(r"^\d+\.\d+\.\d+$"),
        "media_type": F.col("source.media_type").isin(list(MEDIA_TYPES.values())),
        "sha256": F.col("source.sha256").rlike("^[0-9a-f]{64}$"),
        "style": F.col("notation.style").isin(list(STYLES)),
        "confidence": F.col("notation.confidence").between(0, 1),
        "page_count": F.col("source.page_count") >= 1,
    }
