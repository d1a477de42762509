"""Exact deduplication with a cuckoo-filter index of content digests.

``CuckooIndex`` keeps short fingerprints in two candidate buckets per digest and
the whole digests beside them. A fingerprint hit counts only after the digest
stored in that bucket agrees, a failed chain of evictions doubles the table and
places the stored digests anew, and deletion frees the slot of a live digest.

The distributed form folds twice. Each input task runs an index over its own
rows, so a text that fills a third of the table leaves one row per task; the
folded rows are then dealt by digest and a second index per shard merges them.
Shards follow from the number of rows, and an index that holds ``MOST`` digests
hands them on and starts anew, so no task holds more.

Equality is content's. Digests are SHA-256 over the UTF-8 bytes and their
number; whatever digest is found twice has its contents compared, bucket by
bucket, as partial minima and maxima of the texts that have it. Should contents
differ, those rows get their whole content as digest.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import apart, cut, shuffle_partitions, text_or_empty

SLOTS = 4
MAX_KICKS = 64
MOST = 1_000_000  # digests that one index holds


class CuckooIndex:
    """A cuckoo filter over live digests with the digests and a value kept per slot."""

    def __init__(self, buckets: int = 64):
        self.n = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.digests: list[bytes | None] = [None] * (SLOTS * buckets)
        self.values: list = [None] * (SLOTS * buckets)

    def _home(self, digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[:8], "little") & self.mask, int.from_bytes(digest[8:10], "little") | 1

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> int:
        """Slot of a live digest, or -1. The filter answers first, the stored digest decides."""
        bucket, print_ = self._home(digest)
        for b in (bucket, self._other(bucket, print_)):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[s] == print_ and self.digests[s] == digest:
                    return s
        return -1

    def insert(self, digest: bytes, value) -> None:
        """Add a digest that is not live."""
        self.n += 1
        homeless = self._place(digest, value)
        while homeless is not None:
            homeless = self._resize(*homeless)

    def _place(self, digest: bytes, value) -> tuple | None:
        bucket, print_ = self._home(digest)
        for b in (bucket, self._other(bucket, print_)):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.prints[s]:
                    self.prints[s], self.digests[s], self.values[s] = print_, digest, value
                    return None
        for kick in range(MAX_KICKS):
            s = bucket * SLOTS + (kick + print_) % SLOTS
            print_, self.prints[s] = self.prints[s], print_
            digest, self.digests[s] = self.digests[s], digest
            value, self.values[s] = self.values[s], value
            bucket = self._other(bucket, print_)
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[s]:
                    self.prints[s], self.digests[s], self.values[s] = print_, digest, value
                    return None
        return digest, value

    def _resize(self, digest: bytes, value) -> tuple | None:
        """Double the table from the stored digests, the evicted one included."""
        held = [(d, v) for d, v in zip(self.digests, self.values) if d is not None] + [(digest, value)]
        buckets = 2 * (self.mask + 1)
        while True:
            self._clear(buckets)
            if all(self._place(d, v) is None for d, v in held):
                return None
            buckets *= 2

    def delete(self, digest: bytes) -> bool:
        s = self.find(digest)
        if s < 0:
            return False
        self.prints[s], self.digests[s], self.values[s] = 0, None, None
        self.n -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((d, v) for d, v in zip(self.digests, self.values) if d is not None)


def _fold(keep: str, partial: bool):
    """A partition function: (digest, id, n) rows to one row per digest of the partition, or a few where they are ``partial``."""

    def better(a, b):
        if a is None or b is None:
            return b if a is None else a
        return max(a, b) if keep == "max" else min(a, b)

    def rows_of(index: CuckooIndex, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows = list(index.items())
        for lo in range(0, len(rows), 50_000):
            part = rows[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.binary()), pa.array([v[0] for _, v in part], kind), pa.array([v[1] for _, v in part], pa.int64())], names=["digest", "id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, kind = CuckooIndex(), None
        for batch in batches:
            kind = batch.schema.field(1).type
            for digest, doc, n in zip(*(c.to_pylist() for c in batch.columns)):
                s = index.find(digest)
                if s < 0:
                    index.insert(digest, (doc, n))
                else:
                    old, m = index.values[s]
                    index.values[s] = (better(old, doc), m + n)
            if partial and index.n >= MOST:
                yield from rows_of(index, kind)
                index = CuckooIndex()
        if kind is not None:
            yield from rows_of(index, kind)

    return run


def digest_of(text_col: str) -> Column:
    """32 bytes of SHA-256, then eight bytes of length; null texts are empty."""
    text = text_or_empty(text_col)
    return F.concat(F.unhex(F.sha2(text, 256)), F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0")))


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest) of every row."""
    return df.select(F.col(id_col).alias("id"), digest_of(text_col).alias("digest"))


def classes(rows: DataFrame, keep: str = "max", total: int | None = None) -> DataFrame:
    """(digest, id that stays, group size) of the classes of equal texts, from ``total`` (id, digest) rows.

    Null ids never win over others; a class of null ids keeps null.
    """
    kind = dict(rows.dtypes)["id"]
    schema = f"digest binary, id {kind}, n bigint"
    total = rows.count() if total is None else total
    shards = max(shuffle_partitions(rows.sparkSession), -(-total // (MOST // 2)))
    local = rows.select("digest", "id", F.lit(1).cast("bigint").alias("n")).mapInArrow(_fold(keep, True), schema)
    return local.repartition(shards, "digest").mapInArrow(_fold(keep, False), schema)


def verified(df: DataFrame, id_col: str, text_col: str, keep: str) -> tuple[DataFrame, DataFrame, DataFrame, int, DataFrame]:
    """(rows, classes, repeated digests, their number, clashes): all by digests that stand for one content each.

    ``rows`` is (id, digest). ``clashes`` names the plain digests of several contents, which SHA-256 is not known to have.
    """
    rows = cut(digests(df, id_col, text_col))
    total = rows.count()
    found = cut(classes(rows, keep, total), total)
    many = found.where("n > 1").select("digest")
    n = many.count()
    docs = df.select(digest_of(text_col).alias("digest"), text_or_empty(text_col).alias("text"))
    again, _ = apart(docs, F.xxhash64("digest"), many.select(F.xxhash64("digest").alias("h")), n)
    content = again.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    clashes = cut(content.where("lo <> hi").select("digest").join(many, "digest", "left_semi"), total)
    if not clashes.isEmpty():
        own = df.select(F.col(id_col).alias("id"), digest_of(text_col).alias("digest"), text_or_empty(text_col).alias("__text"))
        rows = cut(told_apart(own, "digest", "__text", clashes).drop("__text"))
        found = cut(classes(rows, keep, total), total)
        many = found.where("n > 1").select("digest")
        n = many.count()
    return rows, found, many, n, clashes


def told_apart(rows: DataFrame, digest: str, text_col: str, clashes: DataFrame) -> DataFrame:
    """``rows``, those whose ``digest`` is among ``clashes`` with their content in it."""
    both = rows.join(clashes.select(F.col("digest").alias("__clash")), F.col(digest) == F.col("__clash"), "left")
    whole = F.concat(digest, F.encode(text_or_empty(text_col), "utf-8"))
    return both.withColumn(digest, F.when(F.col("__clash").isNotNull(), whole).otherwise(F.col(digest))).drop("__clash")


def members(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: its id, the id that stays, the size of its group, whether it stays, and the digest.

    Rows that repeat both text and id count in the group and share one verdict.
    """
    rows, found, *_ = verified(df, id_col, text_col, keep)
    found = found.select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    return rows.join(found, "digest").select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256")
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``df`` that stay, every column unchanged; of rows that repeat both id and text one stays.

    Only rows whose digest may be among the repeated ones are exchanged.
    """
    _, found, many, n, clashes = verified(df, id_col, text_col, keep)
    plain = many.select(F.substring("digest", 1, 40).alias("digest")).union(clashes)
    again, alone = apart(df.withColumn("__digest", digest_of(text_col)), F.xxhash64("__digest"), plain.select(F.xxhash64("digest").alias("h")), n + clashes.count())
    if not clashes.isEmpty():
        again = told_apart(again, "__digest", text_col, clashes)
    # By digest and id, so that the copies of a hot text spread over all tasks.
    stays = found.select(F.col("id").alias("__stays"), F.col("digest").alias("__content"))
    kept = again.join(stays, (F.col("__digest") == F.col("__content")) & F.col(id_col).eqNullSafe(F.col("__stays")), "left_semi")
    one = kept.withColumn("__k", F.row_number().over(W.partitionBy("__digest", id_col).orderBy(F.xxhash64(*df.columns)))).where("__k = 1").select(*df.columns)
    return one if alone is None else one.union(alone.select(*df.columns))


def replay(changes: DataFrame) -> DataFrame:
    """Live digests after a log of changes: rows (digest, op) with op ``insert`` or ``delete``.

    A digest is live while it was inserted more often than deleted, whatever
    the order in which tasks see the log. Returns (digest, n) with n above 0.
    Deletions run in the index of each task, so a digest whose changes cancel
    there leaves no row to shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, n in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or not n:
                    continue
                s = index.find(digest)
                if s < 0:
                    index.insert(digest, n)
                elif index.values[s] + n == 0:
                    index.delete(digest)
                else:
                    index.values[s] += n
        rows = list(index.items())
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([v for _, v in rows], pa.int64())], names=["digest", "n"])

    delta = changes.select(F.col("digest").cast("binary").alias("digest"), F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).cast("bigint").alias("n"))
    schema = "digest binary, n bigint"
    return delta.mapInArrow(run, schema).repartition("digest").mapInArrow(run, schema).where("n > 0")
