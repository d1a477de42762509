"""Bounded-space online best-fit packing of tokenised documents.

A document becomes its token ids followed by one separator id. Only documents
longer than a sequence are cut; their first piece takes the remainder. Pieces
go one by one, in the order in which they arrive, to the open bin they fill
best. At most ``OPEN_BINS`` bins are open: a bitset keyed by free space finds the
best bin, and when a new bin is needed the fullest open one closes first.

Tasks pack shards of pieces independently, in the order of a hash of their
document. The pieces of bins that are open at the end of a shard arrive once
more, from all shards in far fewer and the longest first, so the waste of
unfinished bins does not grow with the number of tasks. That is so at every
size, also when one shard holds all pieces.

Null texts are empty: one token, the separator. Repeated rows are packed row by
row. A text that spells a special token of the vocabulary gets that token's id,
as the tokenizers library has it; ``add_special_tokens`` only adds none around.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, once

SEQUENCE = 2048
OPEN_BINS = 1024
SEPARATOR = 0
#: Pieces that one task packs; leftovers are OPEN_BINS bins of it.
SHARD = 400_000
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@once
def encoder(vocabulary: str):
    """Text to ids by a byte-level BPE file of the tokenizers library.

    The file's merges number its ids upwards, so the ids are ranks and a rank
    encoder gives what the library gives. A file without that property, or whose
    special tokens do more than stand for themselves, goes to the library.
    """
    import public_tokenizers

    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], file.get("added_tokens") or []
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab = model["vocab"]
    plain_tokens = all(a["special"] and not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in added)
    if plain_tokens and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)):
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
        fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={a["content"]: a["id"] for a in added})
        return lambda text: fast.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary)
    return lambda text: own.encode(text, add_special_tokens=False).ids


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes the remainder."""
    first = n % size or size if n > size else n
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for whole in batches:
            rows = []
            for doc, text in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist()):
                ids = encode(text or "")
                ids.append(SEPARATOR)
                raw = np.array(ids, dtype="<u4").tobytes()
                rows += [(doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cuts(len(ids), size))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Open bins in a bitset keyed by free space."""

    def __init__(self, size: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.size, self.most = size, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``size`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, free = self.made, self.size
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.size - free

    def unfinished(self) -> set[int]:
        return {b for bins in self.by_free for b in bins}


def _pack(round_: int, size: int, open_bins: int, last: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fit = BestFit(size, open_bins)
        held = [frame for frame in frames if len(frame)]
        if not held:
            return
        shard = pd.concat(held, ignore_index=True)
        length = shard["length"].to_numpy()
        bins, offsets = np.empty(len(shard), dtype=np.int64), np.empty(len(shard), dtype=np.int64)
        for k, n in enumerate(length.tolist()):
            bins[k], offsets[k] = fit.place(n)
        left = fit.unfinished() if not last else set()
        base = (round_ << 60) | (TaskContext.get().partitionId() << 36)
        yield shard.assign(sequence_id=bins + base, offset=offsets, open=np.isin(bins, list(left)))

    return run


def pack(rows: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS, shard: int = SHARD) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) into sequences of at most ``size`` tokens.

    Returns the rows with ``sequence_id`` and ``offset``; offsets in a sequence
    leave no gap. Within a shard pieces arrive in the order of a hash of their
    document, so a task that runs again places them as before.
    """
    rows = cut(rows)
    schema = PACKED + ", open boolean"
    n = rows.count()
    order = [F.xxhash64("doc_id", "piece"), "doc_id", "piece", "start", "length", "ids_crc32"]
    deal = lambda df, n: df.repartition(max(1, -(-n // shard)), F.xxhash64("doc_id", "piece", "start"))
    first = cut(deal(rows, n).sortWithinPartitions(*order).mapInPandas(_pack(0, size, open_bins, False), schema))
    left = first.where("open").select("doc_id", "piece", "start", "length", "ids_crc32")
    again = deal(left, left.count()).sortWithinPartitions(F.desc("length"), *order).mapInPandas(_pack(1, size, open_bins, True), schema)
    return first.where("not open").union(again).drop("open")


def pack_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces(df, vocabulary, id_col, text_col))
