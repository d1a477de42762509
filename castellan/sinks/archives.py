"""Writing archives and stage tables."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__, schemas

VERSION = "1.0.0"
NAME = "castellan"


def content_hash(content: Column | str) -> Column:
    """What a source is known by, JVM-side; ``manifest`` writes the same."""
    return F.sha2(content, 256)


def media_type(filename: str) -> str:
    return schemas.MEDIA_TYPES.get("." + filename.rsplit(".", 1)[-1].lower(), schemas.OTHER_MEDIA)


def manifest(filename: str, source: bytes, page_count: int, notation: dict, counts: dict, now: datetime | None = None) -> dict:
    stamp = (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {
        "schema_version": VERSION,
        "source": {"path": f"source/{filename}", "filename": filename, "media_type": media_type(filename), "sha256": hashlib.sha256(source).hexdigest(), "page_count": page_count},
        "notation": notation,
        "generator": {"name": NAME, "version": __version__, "generated_at": stamp},
        "counts": {k: counts[k] for k in ("games", "moves", "ok", "uncertain", "broken") if k in counts},
    }


def archive(manifest_: dict, source: bytes, games: list[dict], moves: list[dict]) -> bytes:
    """ZIP bytes; the source is stored as it is, documents are deflated."""
    out = io.BytesIO()
    document = {"schema_version": VERSION, "games": games, "moves": moves}
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(manifest_["source"]["path"], source, compress_type=zipfile.ZIP_STORED)
        for name, value in (("manifest.json", manifest_), ("moves.json", document)):
            z.writestr(name, json.dumps(value, ensure_ascii=False, indent=2), compress_type=zipfile.ZIP_DEFLATED)
    return out.getvalue()


def sparse_json(row: dict, places: dict[str, int] | None = None) -> dict:
    """A row as JSON without an absent repair, decimals as asked."""
    d = {k: v.item() if hasattr(v, "item") else v for k, v in row.items()}
    for k, n in (places or {}).items():
        d[k] = round(d[k], n)
    if d.get("repair") is None:
        d.pop("repair", None)
    return {k: None if isinstance(v, float) and v != v else v for k, v in d.items()}


def archives(sources: DataFrame, reports: DataFrame, games: DataFrame, moves: DataFrame) -> DataFrame:
    """(book_id, filename, content): an archive per book.

    ``sources`` has (book_id, filename, content, page_count). A book's moves are
    packed beside its source in one row, as an archive must be.
    """
    g = games.groupBy("book_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*[c for c in games.columns if c not in ("book_id", "ord")]).alias("v")))), lambda x: x.v), {"ignoreNullFields": "false"}).alias("games"))
    m = moves.groupBy("book_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*[c for c in moves.columns if c not in ("book_id", "ord")]).alias("v")))), lambda x: x.v), {"ignoreNullFields": "false"}).alias("moves"),
        F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(s) for s in schemas.STATUSES),
    )
    r = reports.select("book_id", F.struct("style", "language", "confidence").alias("notation"))
    rows = sources.join(r, "book_id").join(g, "book_id", "left").join(m, "book_id", "left")

    def run(frames):
        for f in frames:
            out = []
            for b in f.itertuples(index=False):
                games_, moves_ = json.loads(b.games or "[]"), json.loads(b.moves or "[]")
                for x in moves_:
                    x["confidence"] = round(x["confidence"], 3)
                    if x.get("repair") is None:
                        x.pop("repair", None)
                counts = {"games": len(games_), "moves": len(moves_)} | {s: sum(x["status"] == s for x in moves_) for s in schemas.STATUSES}
                out.append((b.book_id, b.filename, archive(manifest(b.filename, bytes(b.content), int(b.page_count), dict(b.notation), counts), bytes(b.content), games_, moves_)))
            yield pd.DataFrame(out, columns=["book_id", "filename", "content"])

    return rows.select("book_id", "filename", "content", "page_count", "notation", "games", "moves").mapInPandas(run, "book_id string, filename string, content binary")


def write_stages(tables: dict[str, DataFrame], where: str, only: tuple[str, ...] | None = None) -> None:
    """Each stage table as Parquet under ``where``."""
    for name, df in tables.items():
        if only is None or name in only:
            df.write.mode("overwrite").parquet(f"{where}/{name}")
