"""Book archives: ZIP files of a source document, a manifest and the moves."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

OPENED = "path string, error string, manifest string, moves string, source_bytes bigint, cache_name string"


class ArchiveError(ValueError):
    """An archive that cannot be shown, with the reason for its reader."""


def open_bytes(content: bytes) -> tuple[dict, dict, bytes]:
    """(manifest, moves, source) of an archive whose parts agree."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ArchiveError("not an archive") from e
    with archive:
        names = set(archive.namelist())
        if not names:
            raise ArchiveError("empty archive")

        def document(name: str) -> dict:
            if name not in names:
                raise ArchiveError(f"{name} is missing")
            try:
                value = json.loads(archive.read(name))
            except ValueError as e:
                raise ArchiveError(f"{name} is not JSON") from e
            if not isinstance(value, dict):
                raise ArchiveError(f"{name} is not an object")
            return value

        manifest = document("manifest.json")
        source = manifest.get("source") or {}
        if source.get("media_type", schemas.OTHER_MEDIA) != "application/pdf":
            raise ArchiveError("only PDF sources can be shown")
        moves = document("moves.json")
        where = source.get("path", "")
        if where not in names:
            raise ArchiveError(f"{where or 'the source'} is missing")
        data = archive.read(where)
        if hashlib.sha256(data).hexdigest() != source.get("sha256"):
            raise ArchiveError("the source is not the one the moves were read from")
        return manifest, moves, data


def cache_name(filename: str, sha256: str) -> str:
    """Content-addressed name of a cached source."""
    return f"{sha256[:12]}-{re.sub('[^A-Za-z0-9._-]', '_', filename)}"


def opened(files: DataFrame) -> DataFrame:
    """Archives (path, content) opened; a bad one keeps its reason in ``error``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    manifest, moves, data = open_bytes(content)
                    source = manifest["source"]
                    rows.append((path, None, json.dumps(manifest), json.dumps(moves), len(data), cache_name(source.get("filename", ""), source["sha256"])))
                except ArchiveError as e:
                    rows.append((path, str(e), None, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "error", "manifest", "moves", "source_bytes", "cache_name"])

    return files.select("path", "content").mapInPandas(run, OPENED)


def cached(files: DataFrame, root: str) -> DataFrame:
    """Sources of archives (path, content) kept as files below ``root``, a folder that all executors share.

    Their names carry the content's hash, so another edition never takes a
    file's place, and a file of the right length is not written again. Returns
    (path, cache_path, written); archives that cannot be opened are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(root, exist_ok=True)
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    manifest, _, data = open_bytes(content)
                except ArchiveError:
                    continue
                source = manifest["source"]
                target = os.path.join(root, cache_name(source.get("filename", ""), source["sha256"]))
                there = os.path.exists(target) and os.path.getsize(target) == len(data)
                if not there:
                    part = f"{target}.{uuid.uuid4().hex}"
                    with open(part, "wb") as out:
                        out.write(data)
                    os.replace(part, target)
                rows.append((path, target, not there))
            yield pd.DataFrame(rows, columns=["path", "cache_path", "written"])

    return files.select("path", "content").mapInPandas(run, "path string, cache_path string, written boolean")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return opened(spark.read.format("binaryFile").load(path))


def manifests(archives: DataFrame) -> DataFrame:
    """Manifests read tolerantly: unknown fields are ignored, absent ones get defaults."""
    m = archives.where("error is null").select("path", F.from_json("manifest", schemas.MANIFEST).alias("m")).select("path", "m.*")
    style = schemas.with_default("notation.style", schemas.STYLES, "letters")
    media = F.coalesce("source.media_type", F.lit(schemas.OTHER_MEDIA))
    return m.select(
        "path", F.coalesce("schema_version", F.lit("0.0.0")).alias("schema_version"), "source.filename", media.alias("media_type"), "source.sha256", "source.page_count",
        style.alias("style"), "notation.language", F.coalesce("notation.confidence", F.lit(0.0)).alias("confidence"), "counts", (media == "application/pdf").alias("is_pdf"),
    )


def _document(archives: DataFrame) -> DataFrame:
    return archives.where("error is null").select(F.col("path").alias("book_id"), F.from_json("moves", schemas.MOVES_DOCUMENT).alias("d"))


def moves(archives: DataFrame) -> DataFrame:
    """Moves of all archives; an unknown status reads as broken, a missing confidence as 0."""
    m = _document(archives).select("book_id", F.posexplode("d.moves").alias("ord", "m")).select("book_id", "ord", "m.*")
    return m.withColumn("status", schemas.with_default("status", schemas.STATUSES, "broken")).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("variation_index", F.coalesce("variation_index", F.lit(0)))


def games(archives: DataFrame) -> DataFrame:
    return _document(archives).select("book_id", F.posexplode("d.games").alias("ord", "g")).select("book_id", "ord", "g.*")
