"""Byte-level BPE as a monoid: encode halves, join at the border, decode up a tree.

``encode`` splits a match in two until a leaf is short, merges leaves by rank
and joins neighbours. A join re-encodes a window of border tokens and widens it
until the tokens outside provably stay: a token sequence is the encoding of its
bytes exactly if every adjacent pair encodes to itself, and pairs away from the
window were adjacent before, so only the two pairs at the window's ends need
the check. Texts are first split by the vocabulary's pattern, each match is
encoded alone, and concatenation joins matches. ``decode`` halves the ids and
concatenates bytes up the tree. Null texts are empty and give no ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once

LEAF = 8
#: Matches whose ids a worker remembers; a full memory starts anew.
REMEMBERED = 600_000


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memory: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of a short byte string: the pair of least rank merges first, leftmost of equals."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        scores = [rank(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        while scores:
            best = min(scores)
            if best == 1 << 40:
                break
            i = scores.index(best)
            parts[i] += parts.pop(i + 1)
            scores.pop(i)
            if i < len(scores):
                scores[i] = rank(parts[i] + parts[i + 1], 1 << 40)
            if i:
                scores[i - 1] = rank(parts[i - 1] + parts[i], 1 << 40)
        return [self.ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side encode to themselves."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the concatenated bytes, from the ids of both sides."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        k = 2
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self.merge(b"".join(map(self.bytes.__getitem__, left[a:] + right[:b])))
            if (a == 0 or self.stable(left[a - 1], window[0])) and (b == len(right) or self.stable(window[-1], right[b])):
                return left[:a] + window + right[b:]
            k *= 2

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def encode_match(self, data: bytes) -> list[int]:
        """Ids of one pattern match: a vocabulary entry stands for itself."""
        known = self.ranks.get(data)
        return [known] if known is not None else self.tree(data)

    def packed(self, match: str) -> bytes:
        known = self.memory.get(match)
        if known is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = np.array(self.encode_match(match.encode()), dtype="<u4").tobytes()
            if len(match) <= 64:
                self.memory[match] = known
        return known

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed, self.find(text)))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up the tree."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@once
def load(ranks_path: str) -> TreeBPE:
    import public_tokenizers

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return TreeBPE(ranks, public_tokenizers.PATTERN)


def encode_column(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row: ``ids`` is an array of token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(t or ""), dtype="<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    picked = df.select(id_col, F.col(text_col).cast("string").alias("__text"))
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, ids array<int>")


def decode_column(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) of every row of ids; null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(i or []) for i in batch.column(1).to_pylist()], pa.binary())], names=[id_col, "bytes"])

    picked = df.select(id_col, F.col(ids_col).alias("__ids"))
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, bytes binary")


def round_trip(df: DataFrame, ranks_path: str) -> DataFrame:
    """Digests of the ids of every text and of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch.column(1).to_pylist():
                packed = bpe.encode(text or "")
                n.append(len(packed) // 4)
                ids_hash.append(hashlib.sha256(packed).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(np.frombuffer(packed, dtype="<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
