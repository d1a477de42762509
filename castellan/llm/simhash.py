"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint takes, bit by bit, the majority of the hashes of its
word shingles. Equal fingerprints fold into one representative first, so large
groups of copies cost one row. Fingerprints are then laid out in tiles by
population count. Flipping one bit changes one population count by one, so
fingerprints within ``radius`` bits differ by at most ``radius`` in the sum of
the differences of their counts: tile pairs beyond that are skipped, all other
pairs are compared exactly with numpy exclusive-or and bit counts.

Narrow radii tile by the population counts of four 16-bit blocks, which prunes
far more than the whole count. Wide radii prune nothing that way, and a cut of
the radius loses pairs. ``keep_one`` therefore works on sets: its fingerprints
and sizes are those of the distinct shingles, its tiles hold sets of like sizes,
since sets that are 0.8 similar differ by at most that factor in size, and its
candidates are decided by parity bitmaps. Each element flips one bit of its
set's bitmap, so two bitmaps differ in at most as many bits as the sets have
elements that are in one of them only. That number is bounded by the similarity
and the sizes, so no similar pair is lost.

A task's links leave it as stars, each row with the smallest of its group,
which keeps connectivity and bounds the rows. Null texts are empty. A document without
words has fingerprint zero and is linked like any other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, apart, connected_components, cut, groups, texts

SEED = 42
CHUNK = 1 << 16  # shingles whose bits are unpacked at once
TILE_ROWS = 1 << 16  # rows of a tile that one task compares with its neighbours
SET_HASHES = 4_000_000  # shingle hashes of a tile that one task holds of either side
SUB_A, SUB_B = 256, 4096
BITMAP_A, BITMAP_B = 64, 2048  # the same for bitmaps, which have more lanes
BITMAP_LEAST = 256  # bits
SLACK = 1e-6  # for bounds in floating point, which may admit a pair too many
LANE_STEP = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle of a lower-cased text, repeats included."""
    import xxhash

    w = text.lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), dtype=np.uint64, count=len(w) - words + 1)


def lane(h: np.ndarray, k: int) -> np.ndarray:
    """Further independent 64 bits of each hash; lane 0 is the hash itself."""
    if k == 0:
        return h
    z = h + np.uint64((LANE_STEP * k) & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The majority bits of each array of hashes; zero for an empty one."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    held: list[int] = []

    def settle() -> None:
        full = [i for i in held if len(hashes[i])]
        if not full:
            return
        all_ = np.concatenate([hashes[i] for i in full]).astype("<u8")
        starts = np.cumsum([0] + [len(hashes[i]) for i in full[:-1]])
        counts = np.zeros((len(full), 64), dtype=np.int64)
        if len(full) == 1:
            for lo in range(0, len(all_), CHUNK):
                counts[0] += np.unpackbits(all_[lo : lo + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            bits = np.unpackbits(all_.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        n = np.array([len(hashes[i]) for i in full])
        out[full] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()

    size = 0
    for i, h in enumerate(hashes):
        if held and size + len(h) > CHUNK:
            settle()
            held, size = [], 0
        held.append(i)
        size += len(h)
    settle()
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, lanes: int = 1) -> DataFrame:
    """(id, n shingles, f0, f1, ..) of every row; each lane is a signed 64-bit column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                part = whole.slice(lo, 128)
                hashes = [shingle_hashes(t, words) for t in texts(part, "text")]
                prints = [majority([lane(h, k) for h in hashes]).view(np.int64) for k in range(lanes)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(h) for h in hashes], pa.int64()), *map(pa.array, prints)], names=["id", "n", *(f"f{k}" for k in range(lanes))])

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, n long, " + ", ".join(f"f{k} long" for k in range(lanes)))


def parity_bitmap(h: np.ndarray) -> bytes:
    """A bit for each place, odd numbers of elements set it; 0.7 to 1.4 bits an element and 256 bits at least.

    The places are the lowest bits of the elements, so the exclusive-or of both
    halves of a bitmap is the bitmap of half the size.
    """
    bits = BITMAP_LEAST
    while bits < 0.7 * len(h):
        bits *= 2
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def set_prints(df: DataFrame, id_col: str, text_col: str, words: int, lanes: int) -> DataFrame:
    """(id, n, f0, .., same, p): size, fingerprint, digest and parity bitmap of every row's set of shingles."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                part = whole.slice(lo, 128)
                held = [np.unique(shingle_hashes(t, words)) for t in texts(part, "text")]
                prints = [majority([lane(h, k) for h in held]).view(np.int64) for k in range(lanes)]
                same = np.array([xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), SEED) for h in held], dtype=np.uint64).view(np.int64)
                columns = [part.column(0), pa.array([len(h) for h in held], pa.int64()), *map(pa.array, prints), pa.array(same), pa.array([parity_bitmap(h) for h in held], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", *(f"f{k}" for k in range(lanes)), "same", "p"])

    picked = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, n long, " + "".join(f"f{k} long, " for k in range(lanes)) + "same long, p binary")


def _near(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, least: int, radius: int, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) over ``least`` and up to ``radius`` bits apart and within ``ratio`` in size, sub-tile by sub-tile."""
    in_a, in_b = (np.argsort(np.bitwise_count(x).sum(1, dtype=np.int64), kind="stable") for x in (a, b))
    a, b, size_a, size_b = a[in_a], b[in_b], size_a[in_a], size_b[in_b]
    pop_a, pop_b = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    lanes = a.shape[1]
    early = min(2, lanes)
    for i in range(0, len(a), SUB_A):
        low, high = pop_a[i], pop_a[min(i + SUB_A, len(a)) - 1]
        first, last = np.searchsorted(pop_b, low - radius), np.searchsorted(pop_b, high + radius, "right")
        for j in range(first, last, SUB_B):
            x, y = a[i : i + SUB_A], b[j : min(j + SUB_B, last)]
            d = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            for k in range(1, early):
                d = d + np.bitwise_count(x[:, None, k] ^ y[None, :, k])
            p, q = np.nonzero(d <= radius)
            if len(p) and (lanes > early or least >= 0):
                whole = np.bitwise_count(x[p] ^ y[q]).sum(1, dtype=np.int64)
                near = (whole <= radius) & (whole > least)
                p, q = p[near], q[near]
            if len(p) and ratio > 0:
                m, n = size_a[i + p], size_b[j + q]
                near = np.minimum(m, n) >= ratio * np.maximum(m, n)
                p, q = p[near], q[near]
            if len(p):
                yield in_a[i + p], in_b[j + q]


def _unite(forest: Forest, u: np.ndarray, v: np.ndarray, agree=None) -> None:
    """Unite the trees of pairs unless ``agree`` refuses; pairs within a tree are not looked at."""
    for lo in range(0, len(u), 2048):
        x, y = u[lo : lo + 2048], v[lo : lo + 2048]
        apart = _roots(forest, x) != _roots(forest, y)
        for i, j in zip(x[apart].tolist(), y[apart].tolist()):
            if forest.find(i) != forest.find(j) and (agree is None or agree(i, j)):
                forest.union(i, j)


def _roots(forest: Forest, nodes: np.ndarray) -> np.ndarray:
    known, back = np.unique(nodes, return_inverse=True)
    return np.fromiter(map(forest.find, known.tolist()), dtype=np.int64, count=len(known))[back]


def _bitmaps(p: list[bytes]) -> np.ndarray:
    """A row of 64-bit lanes for each bitmap, all folded to the shortest."""
    sizes = np.fromiter(map(len, p), dtype=np.int64, count=len(p))
    least = int(sizes.min())
    out = np.empty((len(p), least // 8), dtype=np.uint64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        held = np.frombuffer(b"".join(p[k] for k in at.tolist()), dtype=np.uint64)
        out[at] = np.bitwise_xor.reduce(held.reshape(len(at), size // least, least // 8), axis=1)
    return out


def _alike(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float, upward: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) that sizes and bitmaps allow to be ``similarity`` alike; ``upward`` leaves out larger rows of a.

    A pair is dropped early where its first lanes already differ in more bits
    than the pairs of its sub-tile may.
    """
    in_a, in_b = np.argsort(size_a, kind="stable"), np.argsort(size_b, kind="stable")
    a, b, size_a, size_b = a[in_a], b[in_b], size_a[in_a], size_b[in_b]
    columns = np.ascontiguousarray(b.T)
    share = (1 - similarity) / (1 + similarity)
    for i in range(0, len(a), BITMAP_A):
        x, m = a[i : i + BITMAP_A], size_a[i : i + BITMAP_A]
        first = np.searchsorted(size_b, m[0] if upward else m[0] * similarity - SLACK)
        last = np.searchsorted(size_b, m[-1] / similarity + SLACK, "right")
        for j in range(first, last, BITMAP_B):
            till = min(j + BITMAP_B, last)
            n = size_b[j:till]
            top = share * (m[-1] + n[-1]) + SLACK
            early = 1
            while early < a.shape[1] and 32 * early - 16 * early**0.5 <= top:
                early += 1
            d = np.zeros((len(x), till - j), dtype=np.uint16 if early < 1000 else np.uint32)
            for k in range(early):
                d += np.bitwise_count(x[:, k, None] ^ columns[None, k, j:till])
            p, q = np.nonzero(d <= top)
            if len(p):
                whole = np.bitwise_count(x[p] ^ b[j + q]).sum(1, dtype=np.int64)
                fits = (whole <= share * (m[p] + n[q]) + SLACK) & (np.minimum(m[p], n[q]) >= similarity * np.maximum(m[p], n[q]) - SLACK)
                if fits.any():
                    yield in_a[i + p[fits]], in_b[j + q[fits]]


def _compare_sets(similarity: float, lanes: int = 0, radius: int = 0):
    """Tasks of ``tiles`` to links (a, b) of pairs that bitmaps ``p`` allow; with lanes, only of pairs whose sets ``s`` are alike, closer fingerprints first."""
    names = [f"f{k}" for k in range(lanes)]
    bounds = [-1, radius * 3 // 5, radius * 4 // 5, radius, 64 * lanes]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, i, j), g in groups(frames, ["tile", "i", "j"]):
            home = g["side"].to_numpy() == 0
            if home.all() or not home.any():
                continue
            ids, first, at = np.unique(g["rep"].to_numpy(), return_index=True, return_inverse=True)
            maps, n = _bitmaps(g["p"].tolist()), g["n"].to_numpy()
            forest = Forest(len(ids))
            pairs = lambda: _alike(maps[home], maps[~home], n[home], n[~home], similarity, i == j)  # noqa: B023, E731
            if not lanes:
                for p, q in pairs():
                    _unite(forest, at[home][p], at[~home][q])
            else:
                prints, sets = g[names].to_numpy().view(np.uint64), g["s"].to_numpy()[first]
                one, two = prints[home], prints[~home]
                agree = lambda x, y, sets=sets: jaccard(sets[x], sets[y]) >= similarity
                for least, most in zip(bounds, bounds[1:]):
                    for p, q in pairs():
                        d = np.bitwise_count(one[p] ^ two[q]).sum(1, dtype=np.int64)
                        turn = (d > least) & (d <= most)
                        _unite(forest, at[home][p[turn]], at[~home][q[turn]], agree)
            yield from _stars(forest, ids)

    return run


def _stars(forest: Forest, ids: np.ndarray) -> Iterator[pd.DataFrame]:
    root = np.fromiter(map(forest.find, range(len(ids))), dtype=np.int64, count=len(ids))
    moved = np.flatnonzero(root != np.arange(len(ids)))
    if len(moved):
        yield pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})


def _compare(lanes: int, radius: int, ratio: float):
    """Tasks of ``tiles`` to links (a, b)."""
    names = [f"f{k}" for k in range(lanes)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, g in groups(frames, ["tile", "i", "j"]):
            home = g["side"].to_numpy() == 0
            if home.all() or not home.any():
                continue
            ids, at = np.unique(g["rep"].to_numpy(), return_inverse=True)
            prints, n = g[names].to_numpy().view(np.uint64), g["n"].to_numpy()
            forest = Forest(len(ids))
            for p, q in _near(prints[home], prints[~home], n[home], n[~home], -1, radius, ratio):
                _unite(forest, at[home][p], at[~home][q])
            yield from _stars(forest, ids)

    return run


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sorted sets; empty ones are alike."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return both / (len(x) + len(y) - both)


def half_ball(dims: int, radius: int) -> list[tuple[int, ...]]:
    """Offsets with absolute sum up to ``radius`` whose first non-zero entry is positive."""
    out = []
    for o in itertools.product(range(-radius, radius + 1), repeat=dims):
        if 0 < sum(map(abs, o)) <= radius and next(x for x in o if x) > 0:
            out.append(o)
    return out


def tiles(reps: DataFrame, lanes: int, radius: int, ratio: float, load: Column, most: int, rows: int | None = None, per_file: int = 100_000) -> DataFrame:
    """Representatives (rep, n, f0, .., more) dealt to the tasks that compare them, sorted by task.

    Rows of side 0 are at home in their tile, rows of side 1 are compared with
    them: the tile's own rows and guests from the neighbouring tiles of one half
    of the ball. A tile whose ``load`` sums to over ``most`` is split into as
    many blocks as that takes, and every pair of blocks is a task. Rows are
    copied only as often as their own tile or one that they visit is split.
    """
    if ratio > 0:
        tile = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.log(F.lit(1 / ratio))).cast("long")
        offsets = [1]
    else:
        blocks = [(0, s) for s in (0, 16, 32, 48)] if lanes == 1 else [(k, None) for k in range(lanes)]
        step = 2 * radius + 70
        counts = [F.bit_count(F.col(f"f{k}") if s is None else F.shiftrightunsigned(f"f{k}", s).bitwiseAND(0xFFFF)).cast("long") + radius for k, s in blocks]
        tile = sum((c * step**k for k, c in enumerate(counts)), F.lit(0).cast("long"))
        offsets = [sum(x * step**k for k, x in enumerate(o)) for o in half_ball(len(blocks), radius)]
    cols = reps.columns
    base = cut(reps.withColumn("tile", tile), rows, per_file)
    # A row for each tile that has rows: at most 17 ** 4 population counts, or the logarithm of the largest set.
    split = cut(base.groupBy("tile").agg(F.greatest(F.lit(1), F.ceil(F.sum(load) / most)).cast("int").alias("g")), 1)
    each = F.explode(F.array(*(F.lit(o).cast("long") for o in offsets)))
    guests = split.select(F.col("g").alias("h"), "tile", each.alias("o")).select((F.col("tile") - F.col("o")).alias("tile"), "h")
    split = cut(split.join(guests.groupBy("tile").agg(F.max("h").alias("h")), "tile", "left").select("tile", "g", F.coalesce("h", F.lit(0)).alias("h")), 1)
    base = base.join(F.broadcast(split), "tile").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    home = base.select(*cols, "tile", F.col("own").alias("i"), upto(F.greatest("g", "h")).alias("j"), F.lit(0).alias("side"))
    own = base.select(*cols, "tile", upto(F.col("g")).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")).where("i <= j")
    guest = base.select(*cols, F.col("own").alias("j"), "tile", each.alias("o")).select(*cols, "j", (F.col("tile") - F.col("o")).alias("tile"))
    # A guest is of use only where a tile has residents.
    guest = guest.join(F.broadcast(split.select("tile", "g")), "tile").select(*cols, "tile", upto(F.col("g")).alias("i"), "j", F.lit(1).alias("side"))
    return home.union(own).union(guest).repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "side", "rep")


def links(reps: DataFrame, lanes: int, radius: int, ratio: float = 0.0, tile_rows: int = TILE_ROWS, rows: int | None = None) -> DataFrame:
    """Spanning links (a, b) between representatives (rep, n, f0, ..) within ``radius`` bits.

    With ``ratio`` above 0 a link also needs sizes n within that factor, and
    tiles go by size; else they go by population counts of 16-bit blocks.
    Ids are longs.
    """
    return tiles(reps, lanes, radius, ratio, F.lit(1), tile_rows, rows).mapInPandas(_compare(lanes, radius, ratio), "a long, b long")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, lanes: int = 1, radius: int = 2, ratio: float = 0.0) -> DataFrame:
    """(id, n, f0, .., component): the smallest id reachable over links, itself included.

    Rows with equal ids share a fingerprint row each and are all returned; null
    ids are linked to nothing and get a null component.
    """
    prints = cut(fingerprints(df, id_col, text_col, words, lanes))
    names = [f"f{k}" for k in range(lanes)]
    by = names + (["n"] if ratio > 0 else [])
    folded = prints.where("id is not null").groupBy(*by).agg(F.min("id").alias("rep"), *([] if ratio > 0 else [F.max("n").alias("n")]))
    total = prints.count()
    reps = cut(folded, total)
    found = connected_components(links(reps.select("rep", "n", *names), lanes, radius, ratio, rows=total))
    # One id may have several texts; its classes are joined through the id itself.
    named = reps.join(found, reps.rep == found.node, "left").select(*by, F.coalesce("component", "rep").alias("component"))
    return prints.join(named, by).select("id", "n", *names, F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def radius_for(similarity: float, bits: int, deviations: float) -> int:
    """Bits that differ between sets of a Jaccard similarity, on average plus ``deviations`` standard deviations."""
    cosine = 2 * similarity / (1 + similarity)
    p = float(np.arccos(cosine) / np.pi)
    return int(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def sets(df: DataFrame, ends: DataFrame, n: int, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, s): the sorted set of shingle hashes of the documents whose id is among the ``n`` of ``ends``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                part = whole.slice(lo, 128)
                held = [np.sort(np.unique(shingle_hashes(t, words)).view(np.int64)) for t in texts(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.list_(pa.int64()))], names=["id", "s"])

    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked, _ = apart(docs, F.col("id"), ends, n)
    return asked.join(ends, "id", "left_semi").mapInArrow(run, "id long, s array<long>")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, lanes: int = 4, deviations: float = 3.0) -> DataFrame:
    """The rows of ``df`` of which each group of near-duplicates keeps the smallest id.

    Candidates are all pairs whose sizes and parity bitmaps do not rule that
    Jaccard similarity out. A first pass over the tiles finds the documents that
    have any. Those few are tiled again with their sets of shingles, and each
    candidate pair that its task has not yet united is compared exactly, in the
    order of ``64 * lanes`` bit fingerprints: first those as close as sets of
    that similarity are, give or take ``deviations`` standard deviations, then
    the rest. Ids are whole numbers; rows with a null id stay. Rows that no decision
    touches pass without an exchange.
    """
    radius = radius_for(similarity, 64 * lanes, deviations)
    names = [f"f{k}" for k in range(lanes)]
    prints = cut(set_prints(df, id_col, text_col, words, lanes))
    total = prints.count()
    by = [*names, "n", "same"]
    reps = cut(prints.where("id is not null").groupBy(*by).agg(F.min("id").alias("rep"), F.first("p").alias("p")), total)
    equal = cut(prints.join(reps.drop("p"), by).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct(), total)
    weight = F.sqrt(F.length("p") / 64)  # a task's work grows with the bits and the square of the rows
    found = tiles(reps.select("rep", "n", "p"), lanes, radius, similarity, weight, TILE_ROWS, total).mapInPandas(_compare_sets(similarity), "a long, b long")
    ends = cut(found.select(F.col("a").alias("id")).union(found.select(F.col("b").alias("id"))).distinct(), total)
    asked = ends.count()
    whole = sets(df, ends, asked, id_col, text_col, words).join(reps.withColumnRenamed("rep", "id"), "id").withColumnRenamed("id", "rep")
    near = tiles(whole.select("rep", "n", *names, "p", "s"), lanes, radius, similarity, F.size("s"), SET_HASHES, asked, 2_000)
    edges = near.mapInPandas(_compare_sets(similarity, lanes, radius), "a long, b long").union(equal)
    groups_ = connected_components(edges)
    gone = cut(groups_.where("node <> component").select(F.col("node").alias("__gone")), total)
    some, others = apart(df, F.col(id_col).cast("bigint"), gone, gone.count())
    kept = some.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    return kept if others is None else kept.union(others)
