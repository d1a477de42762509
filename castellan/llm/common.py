"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
WORD_SPACE = b" \t\n\x0b\x0c\r"
MASK = (1 << 64) - 1


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, below the cluster's shared one; it goes when the driver's Python ends.

    Where none is named, a local master gets a temporary one and a cluster an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="castellan-ckpt-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    folder = sc.getCheckpointDir()
    if folder not in _LEAVING:
        _LEAVING.add(folder)
        atexit.register(remove, spark, folder)
    return folder


_LEAVING: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is; what is gone or out of reach stays so."""
    sc = spark.sparkContext
    if sc._jvm is not None and sc._jsc is not None and not sc._jsc.sc().isStopped():
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, rows: int | None = None, per_file: int = 100_000) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    With a bound on its ``rows``, it goes into as few files as hold ``per_file``
    rows each: many partitions of a small table would be as many files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, nulls as empty."""
    return [b"" if v is None else v for v in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Whole groups of a partition that is sorted by ``keys``, across batch borders."""
    held: list[pd.DataFrame] = []
    held_key: tuple | None = None
    for frame in frames:
        if not len(frame):
            continue
        changed = np.zeros(len(frame), dtype=bool)
        for k in keys:
            v = frame[k].to_numpy()
            changed[1:] |= v[1:] != v[:-1]
        bounds = [0, *np.flatnonzero(changed).tolist(), len(frame)]
        for lo, hi in zip(bounds, bounds[1:]):
            part = frame.iloc[lo:hi]
            key = tuple(part[k].iloc[0] for k in keys)
            if held and key != held_key:
                yield held_key, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held_key = key
            held.append(part)
    if held:
        yield held_key, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


class Forest:
    """Union-find over dense integers; the smaller root always wins."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has two long columns ``a`` and ``b``; self-loops and repeats are
    allowed. Returns ``(node, component)`` for every node that an edge names,
    where ``component`` is the smallest node id reachable. Each round is cut
    with a checkpoint in the shared folder, so a lost executor costs one round.
    A star's centre may have very many neighbours, so minima are computed by
    map-side combined aggregates and joined back instead of gathered in lists.
    """
    fold = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = cut(fold(edges))
    nodes = current.select(F.col("a").alias("node")).union(current.select(F.col("b").alias("node"))).distinct()
    before, n = None, current.count()
    nodes = cut(nodes, 2 * n)
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = fold(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        current = cut(fold(small), 2 * n)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    stars = current.groupBy("a").agg(F.min("b").alias("b"))
    return nodes.join(stars, nodes.node == stars.a, "left").select("node", F.coalesce("b", "node").alias("component"))


def once(make: Callable):
    """A per-process lazily built value, for tables that each Python worker loads once."""
    made: dict = {}

    def get(*key):
        if key not in made:
            made[key] = make(*key)
        return made[key]

    return get


def stored(df: DataFrame, rows: int | None = None, per_file: int = 200_000) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again.

    A bound on its ``rows`` limits the number of files, as in ``cut``.

    For larger intermediates than ``cut``: columns compress, and the reader
    knows their size. The folder is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/castellan-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    df.write.parquet(root)
    _WRITTEN.append(root)
    return spark.read.schema(df.schema).parquet(root)


_WRITTEN: list[str] = []


def tables_stored() -> int:
    """How many tables ``stored`` has written; a mark for ``discard``."""
    return len(_WRITTEN)


def discard(spark: SparkSession, mark: int) -> None:
    """Remove the tables stored since ``mark`` but for the last one, which needs none of them.

    Shuffle files go when the driver collects what named them, so it is asked to.
    """
    for root in _WRITTEN[mark:-1]:
        remove(spark, root)
    del _WRITTEN[mark:-1]
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bits of a page, fixed by Spark's bitmap functions, and the most pages that are broadcast: 32 MB.
PAGE, MOST_PAGES = 32_768, 8_192


def apart(df: DataFrame, key: Column, marks: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose ``key``, a bigint, may be among ``marks`` (one bigint column, ``n`` rows), and rows whose key is not.

    The first need an exact join; the others pass without an exchange. A bitmap
    of at most 32 MB is broadcast. Where so many marks would fill it, all rows
    count as the first kind and there are no others.
    """
    pages = 1
    while pages < MOST_PAGES and pages * PAGE < 16 * n:
        pages *= 2
    if 2 * n > pages * PAGE:
        return df, None
    of = lambda h: F.pmod(F.xxhash64(h), F.lit(pages * PAGE))
    place = of(marks[marks.columns[0]])
    bitmap = marks.select(place.alias("p")).groupBy(F.expr(f"p div {PAGE}").alias("__page")).agg(F.expr(f"bitmap_construct_agg(p % {PAGE})").alias("__bits"))
    rows = df.withColumn("__place", of(key)).join(F.broadcast(bitmap), F.expr(f"__place div {PAGE}") == F.col("__page"), "left")
    byte = F.conv(F.hex(F.expr(f"substring(__bits, cast(__place % {PAGE} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(__place % 8 as int))")) != 0, F.lit(False))
    return rows.where(hit).select(*df.columns), rows.where(~hit).select(*df.columns)
