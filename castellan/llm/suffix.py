"""Removal of long byte strings that occur more than once, by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else in the corpus, the same document included. Texts are UTF-8 bytes, matches
stay within documents, null texts are empty, and strings are judged on the
input. Shorter documents keep everything. Repeated rows match each other.

1. *Anchors* deal windows to shards. Each window of ``length`` bytes names the
   least hash of its grams of ``GRAM`` bytes. Equal windows name equal anchors
   at equal places, so a window can only repeat among places of one anchor.
   Neighbouring windows with one anchor form a region, on average some 140
   windows; an anchor that occurs once is done with.
2. *Pre-aggregation.* Regions of equal bytes are represented by at most two of
   them, the first and the last place, which is all a suffix array needs to see
   that they repeat. An anchor whose regions are all alike leaves two places;
   consecutive such regions of the same two documents join into two long
   strings.
3. *Suffix arrays* decide. Each task joins its strings into shards, builds the
   suffix array by induced sorting, and reads repeats off the permuted common
   prefixes of neighbours. Of anchors with different regions, places whose
   surroundings no other region shares are left out first.
4. *Cutting.* Repeated windows go back to every document that has the region.

An anchor with more than ``HOT_REGIONS`` different regions would fill one task.
Its windows are dealt one by one instead, by digest with partial sums, and the
first and last place of each go to suffix arrays like those of equal regions.

The same runs over words in place of bytes (``WORDS``): passages of over fifty
words that occur elsewhere can be reported beside what is removed, since many of
them are shorter than ``length`` bytes. Words are what white space parts and
stand as 64-bit hashes; nothing is removed for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import apart, discard, groups, stored, tables_stored, text_or_empty, texts
from .sais import permuted_lcp, suffix_array

LENGTH, PASSAGE = 400, 51
GRAM, WORD_GRAM = 128, 8
HOT_REGIONS = 2_000
SHARD_BYTES = 2_000_000
SEGMENT = 1 << 20
#: Bytes from which on two long strings that are alike are compared in parts.
RUN_BYTES = 1 << 19
VERDICT = "key bigint, rh bigint, starts array<int>, stops array<int>"
OCCURRENCE = "doc_id bigint, th bigint, a int, n int, d int, key bigint, rh bigint"


def _table() -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 64, size=256, dtype=np.uint64)


class Unit(NamedTuple):
    """What strings are made of: how a text becomes an array of it, and the sizes that go with it, all counted in it."""

    split: Callable[[bytes], np.ndarray]
    kind: type
    length: int  # of repeated strings
    gram: int  # a power of two
    block: int  # neighbouring window places that share one core when regions are compared


def as_bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, dtype=np.uint8)


def as_words(text: bytes) -> np.ndarray:
    """A hash for each word."""
    import xxhash

    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


BYTES = Unit(as_bytes, np.uint8, LENGTH, GRAM, 64)
WORDS = Unit(as_words, np.uint64, PASSAGE, WORD_GRAM, 8)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes or words, a power of two, by doubling."""
    h = _TABLE[data] if data.dtype == np.uint8 else data
    span, base = 1, 0x9E3779B97F4A7C15
    while span < gram:
        h = h[:-span] * np.uint64(base) + h[span:]
        base = base * base & (1 << 64) - 1
        span *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


_TABLE = _table()
_LOW = np.uint64((1 << 21) - 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(x)
    m = -(-n // width) * width
    top = np.full(m, np.uint64((1 << 64) - 1))
    top[:n] = x
    rows = top.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared, .. modulo 2 ** 64; kept, as all texts ask for the same."""
    if len(_KNOWN.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        _KNOWN[base] = np.multiply.accumulate(out)
    return _KNOWN[base][:n]


_KNOWN: dict[int, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def region_table(data: np.ndarray, u: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """Of all windows of a text, in order: first start, number of starts, distance from there to the anchor, anchor hash, and a hash of the whole region."""
    parts = []
    width = u.length - u.gram + 1
    for lo in range(0, len(data) - u.length + 1, SEGMENT):
        piece = data[lo : lo + SEGMENT + u.length - 1]
        h = gram_hashes(piece, u.gram)
        least = sliding_least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), width)
        at = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(first, len(at)))
        # A region's hash is a difference of prefix sums, moved to the region's own origin.
        one = _TABLE[piece] if piece.dtype == np.uint8 else piece
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one * _powers(_BASE, len(one)), dtype=np.uint64)])
        whole = (sums[first + count - 1 + u.length] - sums[first]) * _powers(_INVERSE, len(one))[first]
        whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + count.astype(np.uint64)
        parts.append((first + lo, count, at[first] - first, h[at[first]].view(np.int64), whole.view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


def regions(data: np.ndarray | bytes, u: Unit = BYTES) -> list[tuple[int, int, int, int]]:
    """(first start, number of starts, distance from there to the anchor, anchor hash) of all windows of a text."""
    data = u.split(data) if isinstance(data, bytes) else data
    return list(zip(*(c.tolist() for c in region_table(data, u)[:4])))


def _occurrences(u: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                part = whole.slice(lo, 256)
                tables, rows = [], []
                for k, text in enumerate(texts(part)):
                    data = u.split(text)
                    if len(data) >= u.length:
                        tables.append(region_table(data, u))
                        rows.append(np.full(len(tables[-1][0]), k))
                if tables:
                    a, n, d, key, rh = (np.concatenate(c) for c in zip(*tables))
                    at = pa.array(np.concatenate(rows))
                    places = [pa.array(c.astype(np.int32)) for c in (a, n, d)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *places, pa.array(key), pa.array(rh)], names=["doc_id", "th", "a", "n", "d", "key", "rh"])

    return run


def repeated_starts(parts: list[bytes], u: Unit = BYTES) -> list[np.ndarray]:
    """For each part, which of its starts has a string of the unit's length that starts elsewhere among the parts."""
    length = u.length
    arrays = [np.frombuffer(p, dtype=u.kind) for p in parts]
    sizes = np.array([len(p) for p in arrays])
    s = np.zeros(int(sizes.sum()) + len(parts) + 1, dtype=np.int64)
    begin = np.cumsum(np.append(0, sizes[:-1] + 1))
    held = np.concatenate(arrays)
    most = 256
    if u.kind != np.uint8:
        names, held = np.unique(held, return_inverse=True)
        most = len(names)
    border = np.zeros(len(s), dtype=bool)
    border[begin + sizes] = True
    border[-1] = True
    s[~border] = held.astype(np.int64) + 2
    s[border] = 1
    s[-1] = 0
    sa = suffix_array(s, most + 2)
    plcp = permuted_lcp(s, sa)
    # Borders match each other; what follows a border belongs to no window.
    border = np.flatnonzero(s <= 1)
    room = border[np.searchsorted(border, np.arange(len(s)))] - np.arange(len(s))
    fits = room >= length
    near = (plcp >= length) & fits
    hit = near.copy()
    previous = np.zeros(len(s), dtype=bool)
    previous[sa[:-1]] = near[sa[1:]]
    hit |= previous & fits
    return [hit[b : b + n - length + 1] for n, b in zip(sizes.tolist(), begin.tolist())]


def intervals(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def contenders(regions_: list[bytes], anchors: list[int], twice: list[bool], u: Unit = BYTES) -> list[tuple[int, int, int]]:
    """(region, first start, last start + 1) of the places that may repeat among regions of one anchor.

    Equal windows have their anchor at one distance. Windows whose distances lie
    in one block all contain the block's core, so a window can only repeat if
    another region has the same core; what has none is left out. A region that
    occurs ``twice`` contends with all its places and is named twice.
    """
    wide, block = np.dtype(u.kind).itemsize, u.block
    starts = [len(region) // wide - u.length + 1 for region in regions_]
    cores: dict[tuple[int, bytes], list[int]] = {}
    for k, (region, d) in enumerate(zip(regions_, anchors)):
        for j in range((d - starts[k] + 1) // block, d // block + 1):
            at = d - j * block
            cores.setdefault((j, region[wide * max(0, at) : wide * (at - block + 1 + u.length)]), []).append(k)
    reach: dict[int, tuple[int, int]] = {}
    for (j, _), held in cores.items():
        if len(held) > 1:
            for k in held:
                lo, hi = max(0, anchors[k] - j * block - block + 1), min(starts[k], anchors[k] - j * block + 1)
                old = reach.get(k, (lo, hi))
                reach[k] = min(lo, old[0]), max(hi, old[1])
    for k, again in enumerate(twice):
        if again:
            reach[k] = 0, starts[k]
    return [(k, lo, hi) for k, (lo, hi) in sorted(reach.items()) for _ in range(1 + twice[k])]


def _shards(u: Unit):
    """Sorted (key, rh, d, region, twice) rows to (key, rh, starts, stops) of repeated starts."""

    def solve(held: list[tuple[int, int, int, bytes]]) -> pd.DataFrame:
        rows, last = [], None
        for (key, rh, lo, _), hit in zip(held, repeated_starts([region for *_, region in held], u)):
            if (key, rh) != last and hit.any():  # of a region that is there twice, one answer is enough
                starts, stops = intervals(hit)
                rows.append((key, rh, [lo + x for x in starts], [lo + x for x in stops]))
            last = key, rh
        return pd.DataFrame(rows, columns=["key", "rh", "starts", "stops"])

    wide = np.dtype(u.kind).itemsize

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for (key,), g in groups(frames, ["key"]):
            parts, rh = [bytes(r) for r in g["region"]], g["rh"].tolist()
            for k, lo, hi in contenders(parts, g["d"].tolist(), g["twice"].tolist(), u):
                held.append((key, rh[k], lo, parts[k][wide * lo : wide * (hi - 1 + u.length)]))
                size += len(held[-1][-1])
            if size >= SHARD_BYTES:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    return run


def _twins(u: Unit):
    """Sorted (p, q, side, region, items) rows, two for each (p, q), to (key, rh, starts, stops) of the items' repeated starts."""

    def solve(held: list[tuple[bytes, list]]) -> pd.DataFrame:
        rows = []
        for (_, items), hit in zip(held, repeated_starts([region for region, _ in held], u)):
            for x in items if items is not None else ():
                starts, stops = intervals(hit[x["at"] : x["at"] + x["n"]])
                if starts:
                    rows.append((x["key"], x["rh"], starts, stops))
        return pd.DataFrame(rows, columns=["key", "rh", "starts", "stops"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for _, g in groups(frames, ["p", "q"]):
            for region, items in zip(g["region"], g["items"]):
                held.append((bytes(region), items))
                size += len(region)
            if size >= SHARD_BYTES:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    return run


def twin_runs(classes: DataFrame) -> DataFrame:
    """The two strings to compare for classes of equal strings (key, rh, lo, hi, n), lo and hi being places (x, y, a).

    Consecutive classes of the same two texts at the same distance join, up to
    ``RUN_BYTES``. Returns (p, q, side, x, y, a, n, items), two rows for each
    (p, q); the items (key, rh, at, n) of a run go with its first side.
    """
    texts_ = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("lo", "hi") for c in "xya"]
    rows = classes.select("key", "rh", "n", *texts_).withColumn("off", F.col("lo_a") - F.col("hi_a")).withColumn("seg", F.floor(F.col("lo_a") / RUN_BYTES))
    by = ["lo_x", "lo_y", "hi_x", "hi_y", "off", "seg"]
    order = W.partitionBy(*by).orderBy("lo_a", "key", "rh")
    new = F.when(F.lag(F.col("lo_a") + F.col("n")).over(order) == F.col("lo_a"), 0).otherwise(1)
    rows = rows.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    item = F.struct("lo_a", "key", "rh", "n")
    runs = rows.groupBy(*by, "run").agg(F.min("lo_a").alias("a"), F.sum("n").cast("int").alias("n"), F.array_sort(F.collect_list(item)).alias("held"))
    items = F.transform("held", lambda x: F.struct(x["key"].alias("key"), x["rh"].alias("rh"), (x["lo_a"] - F.col("a")).alias("at"), x["n"].alias("n")))
    who = [*by, "a"]
    runs = runs.select(*who, "n", items.alias("items"), F.xxhash64(*who).alias("p"), F.xxhash64(F.lit("q"), *who).alias("q"))
    one = runs.select("p", "q", F.lit(0).alias("side"), F.col("lo_x").alias("x"), F.col("lo_y").alias("y"), "a", "n", "items")
    none = F.lit(None).cast(dict(one.dtypes)["items"])
    two = runs.select("p", "q", F.lit(1).alias("side"), F.col("hi_x").alias("x"), F.col("hi_y").alias("y"), (F.col("a") - F.col("off")).alias("a"), "n", none.alias("items"))
    return one.union(two)


def _windows(u: Unit):
    """(key, rh, region, twice) rows to one row per window: its place and digest."""
    wide = np.dtype(u.kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, rh, region, twice in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(region) // wide - u.length + 1
                both = np.frombuffer(b"".join(hashlib.blake2b(region[wide * i : wide * (i + u.length)], digest_size=16).digest() for i in range(n)), dtype=np.int64).reshape(n, 2)
                columns = [pa.array([key] * n, pa.int64()), pa.array([rh] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([twice] * n)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "rh", "at", "v", "w", "twice"])

    return run


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", u: Unit = BYTES, hot_regions: int = HOT_REGIONS) -> DataFrame:
    """(doc_id, th, spans) of the documents that hold repeated strings of the unit's length.

    ``spans`` is an array of (start, stop) ranges that may overlap; ``th`` is
    the hash of the text, which tells apart rows that share an id.
    """
    docs = documents(df, id_col, text_col)
    occ = stored(docs.select("doc_id", "th", "text").mapInArrow(_occurrences(u), OCCURRENCE))
    total = occ.count()
    keys = occ.groupBy("key").agg(F.count("*").alias("c"), F.min("rh").alias("lo"), F.max("rh").alias("hi")).where("c > 1")
    # Stored, so that the join below reads two plain exchanges and a hot anchor can be split.
    keys = stored(keys.select("key", (F.col("lo") != F.col("hi")).alias("open")), total)
    # Most anchors occur once: those places pass no exchange.
    asked, _ = apart(occ, F.col("key"), keys.select("key"), keys.count())
    again = stored(asked.join(keys, "key"), total)
    place = F.struct(F.col("doc_id").alias("x"), F.col("th").alias("y"), "a", "n", "d")
    classes = again.groupBy("key", "rh", "open").agg((F.count("*") > 1).alias("twice"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    classes = stored(classes, total)

    # What is asked of each document: regions of anchors that have several, and both sides of those that are all alike.
    hot = classes.where("open").groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > hot_regions).select("key")
    hot = stored(hot, classes.count()).withColumn("hot", F.lit(True))
    undecided = classes.where("open").join(hot, "key", "left").select("lo.x", "lo.y", F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q"), "key", "rh", "lo.a", "lo.n", "lo.d", "twice", F.coalesce("hot", F.lit(False)).alias("hot"), F.lit(-1).alias("side")).alias("w"))
    runs = stored(twin_runs(classes.where("not open").select("key", "rh", F.col("lo.n").alias("n"), "lo", "hi")), total)
    nothing = F.lit(0).cast("bigint")
    sides = runs.select("x", "y", F.struct("p", "q", nothing.alias("key"), nothing.alias("rh"), "a", "n", F.lit(0).alias("d"), F.lit(False).alias("twice"), F.lit(False).alias("hot"), "side").alias("w"))
    wanted = undecided.union(sides).groupBy("x", "y").agg(F.collect_list("w").alias("want"))
    match = (docs.doc_id.eqNullSafe(F.col("x"))) & (docs.th == F.col("y"))
    schema = "p bigint, q bigint, key bigint, rh bigint, d int, twice boolean, hot boolean, side int, region binary"
    # Rows that repeat id and text all match; one of them is enough.
    sliced = docs.join(wanted, match).select("text", "want").mapInArrow(_slices(u), schema)
    sliced = stored(sliced.dropDuplicates(["p", "q", "key", "rh", "side"]), classes.count(), 10_000)

    cold = sliced.where("side < 0 and not hot").select("key", "rh", "d", "region", "twice").repartition("key").sortWithinPartitions("key", "rh")
    by_anchor = cold.mapInPandas(_shards(u), VERDICT)
    by_twins = _decide(runs.select("p", "q", "side", "items"), sliced.where("side >= 0").select("p", "q", "side", "region"), u)
    verdicts = by_anchor.union(by_twins).union(_by_window(sliced.where("hot").select("key", "rh", "region", "twice"), u))
    hits = again.select("doc_id", "th", "a", "key", "rh").join(verdicts, ["key", "rh"])
    spans = F.transform(F.arrays_zip("starts", "stops"), lambda z: F.struct((F.col("a") + z["starts"]).alias("start"), (F.col("a") + z["stops"] + (u.length - 1)).alias("stop")))
    return hits.select("doc_id", "th", spans.alias("spans")).groupBy("doc_id", "th").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _decide(runs: DataFrame, regions_: DataFrame, u: Unit) -> DataFrame:
    """Verdicts (key, rh, starts, stops) of suffix arrays over both sides of every run."""
    both = runs.join(regions_, ["p", "q", "side"]).select("p", "q", "side", "region", "items")
    return both.repartition("p", "q").sortWithinPartitions("p", "q", "side").mapInPandas(_twins(u), VERDICT)


def _by_window(regions_: DataFrame, u: Unit) -> DataFrame:
    """Verdicts (key, rh, starts, stops) of hot anchors' regions, whose windows are dealt by digest."""
    wide = np.dtype(u.kind).itemsize
    windows = stored(regions_.mapInArrow(_windows(u), "key bigint, rh bigint, at int, v bigint, w bigint, twice boolean"))
    place = F.struct(F.col("key").alias("x"), F.col("rh").alias("y"), F.col("at").alias("a"))
    same = windows.groupBy("v", "w").agg((F.count("*") + F.count_if("twice")).alias("c"), F.min(place).alias("lo"), F.max(place).alias("hi")).where("c > 1")
    runs = stored(twin_runs(same.select(F.col("v").alias("key"), F.col("w").alias("rh"), F.lit(1).alias("n"), "lo", "hi")))
    wanted = runs.groupBy("x", "y").agg(F.collect_list(F.struct("p", "q", "side", "a", "n")).alias("want"))
    cut_ = regions_.join(wanted, (F.col("key") == F.col("x")) & (F.col("rh") == F.col("y"))).select(F.explode("want").alias("w"), "region")
    both = cut_.select("w.p", "w.q", "w.side", F.expr(f"substring(region, {wide} * w.a + 1, {wide} * (w.n + {u.length - 1}))").alias("region"))
    sure = _decide(runs.select("p", "q", "side", "items"), both, u).select(F.col("key").alias("v"), F.col("rh").alias("w"))
    found = windows.join(sure, ["v", "w"]).groupBy("key", "rh").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    return found.select("key", "rh", "starts", F.transform("starts", lambda x: x + 1).alias("stops"))


def _slices(u: Unit):
    names = ["p", "q", "key", "rh", "d", "twice", "hot", "side"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                held = [(u.split(text), want) for text, want in zip(texts(part), part.column(1).to_pylist())]
                rows = [(*(w[c] for c in names), data[w["a"] : w["a"] + w["n"] - 1 + u.length].tobytes()) for data, want in held for w in want]
                columns = list(zip(*rows)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*names, "region"])

    return run


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _remaining(text: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of a text and the number of maximal removed runs."""
    if not spans:
        return text, 0
    parts, done, runs = [], 0, 0
    stop = -1
    for a, b in sorted((s["start"], s["stop"]) for s in spans):
        if a > stop:
            if stop >= 0:
                done = stop
            parts.append(text[done:a])
            runs += 1
        stop = max(stop, b)
    parts.append(text[stop:])
    return b"".join(parts), runs


def covered(spans: list[dict] | None) -> tuple[int, int]:
    """How many maximal runs spans make, and how much they cover."""
    runs = total = 0
    stop = -1
    for a, b in sorted((x["start"], x["stop"]) for x in spans or ()):
        runs += a > stop
        total += max(0, b - max(a, stop))
        stop = max(stop, b)
    return runs, total


def cut_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int = PASSAGE, hot_regions: int = HOT_REGIONS) -> DataFrame:
    """Per row: doc_id, the remaining bytes, the number of bytes before and of removed runs, and the passages of
    ``words`` or more that occur elsewhere, as maximal runs and the words in them; with 0 those are not searched for."""
    none = F.lit(None).cast("array<struct<start:int,stop:int>>")
    # Kept, so that all else of the first search can go before the second one.
    mark = tables_stored()
    cut_ = stored(repeats(df, id_col, text_col, BYTES._replace(length=length), hot_regions).select("doc_id", "th", "spans"))
    found = cut_.withColumn("passages", none)
    if words:
        discard(df.sparkSession, mark)
        mark = tables_stored()
        seen = stored(repeats(df, id_col, text_col, WORDS._replace(length=words), hot_regions).select("doc_id", "th", none.alias("spans"), F.col("spans").alias("passages")))
        discard(df.sparkSession, mark)
        found = found.union(seen).groupBy("doc_id", "th").agg(F.max("spans").alias("spans"), F.max("passages").alias("passages"))
    docs = documents(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                before = texts(part)
                left = [_remaining(t, s) for t, s in zip(before, part.column(2).to_pylist())]
                shared = [covered(s) for s in part.column(3).to_pylist()]
                counted = (map(len, before), (r for _, r in left), (n for n, _ in shared), (n for _, n in shared))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in left], pa.binary()), *(pa.array(list(c), pa.int64()) for c in counted)], names=["doc_id", "kept", "n_bytes", "n_spans", "n_passages", "n_passage_words"])

    match = (docs.doc_id.eqNullSafe(F.col("f.doc_id"))) & (docs.th == F.col("f.th"))
    return docs.join(found.alias("f"), match, "left").select(docs.doc_id, "text", "spans", "passages").mapInArrow(run, "doc_id bigint, kept binary, n_bytes bigint, n_spans bigint, n_passages bigint, n_passage_words bigint")


def report(df: DataFrame) -> DataFrame:
    """Counts and a digest of what ``cut_documents`` leaves; passages of words are not searched for."""
    return cut_documents(df, words=0).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
