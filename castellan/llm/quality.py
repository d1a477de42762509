"""Quality rules by document and by host.

Each document gets the counts below in one pass. Rule failures are summed by
host, and a host's failure rate is shrunk towards the corpus with a beta prior
fitted by moments to the hosts' own rates: a host with few documents borrows
from all others. A host is rejected when its shrunken rate, less
``HOST_DEVIATIONS`` posterior standard deviations, lies above a limit that is
fitted too: the prior's mean and ``PRIOR_DEVIATIONS`` of its standard
deviations, but within ``HOST_LIMITS``, so that no host is rejected of whose
documents most pass, and a host that nearly always fails is rejected however
far apart hosts are. The verdict is joined back to its documents.

Null texts have no words; documents without a host are judged alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, apart, cut, texts

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
HOST_LIMITS = (0.5, 0.75)
HOST_DEVIATIONS, PRIOR_DEVIATIONS = 2.0, 3.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ODD = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WINDOW + 1)]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    n = len(words)
    if n <= window:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    m = n - window + 1
    total = np.zeros(m, dtype=np.uint64)
    for k in range(window):
        total += h[k : k + m] * np.uint64(_ODD[k])
    order = np.argsort(total, kind="stable")
    s = total[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(m, dtype=bool)
    for at in np.flatnonzero(same).tolist():  # whoever shares a sum must share the words
        a, b = order[at], order[at + 1]
        if words[a : a + window] == words[b : b + window]:
            hit[a] = hit[b] = True
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    letters = text.translate(None, WORD_SPACE)
    word_chars = len(letters) if letters.isascii() else len(letters.decode())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), word_chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, the five counts, base_failed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(t) for t in texts(batch)]
            columns = list(zip(*rows)) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.int64()) for c in columns)], names=["id", "host", *COUNTS])

    picked = df.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    out = picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, host string, " + ", ".join(f"{c} long" for c in COUNTS))
    return out.withColumn("base_failed", _failed(F.col("n_words"), F.col("n_repeat_words")))


def host_verdicts(rows: DataFrame) -> DataFrame:
    """(host, n, failed, rate, host_ok) from rows (host, base_failed); null hosts have no verdict."""
    hosts = cut(rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed")))
    prior = hosts.agg(F.sum("n").alias("N"), F.sum("failed").alias("Y"), F.count("*").alias("H"), F.sum(F.col("n").cast("double") * F.col("n")).alias("N2"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("S")).first()
    alpha, beta = beta_prior(prior["N"] or 0, prior["Y"] or 0, prior["H"] or 0, prior["N2"] or 0.0, prior["S"] or 0.0)
    a, b = F.col("failed") + F.lit(alpha), F.col("n") - F.col("failed") + F.lit(beta)
    rate = a / (a + b)
    spread = F.sqrt(rate * (1 - rate) / (a + b + 1))
    return hosts.withColumn("rate", rate).withColumn("host_ok", rate - HOST_DEVIATIONS * spread <= host_limit(alpha, beta))


def host_limit(alpha: float, beta: float) -> float:
    """The rate above which a host stands out."""
    mean = alpha / (alpha + beta)
    least, most = HOST_LIMITS
    return min(max(least, mean + PRIOR_DEVIATIONS * (mean * (1 - mean) / (alpha + beta + 1)) ** 0.5), most)


def beta_prior(n: int, failed: int, hosts: int, squares: float, weighted: float) -> tuple[float, float]:
    """(alpha, beta) by moments of the hosts' rates, sizes as weights.

    ``squares`` is the sum of n squared, ``weighted`` that of failed squared
    over n. Without spread beyond chance the prior is as strong as 1000 rows;
    with no rows it is uniform.
    """
    if not n:
        return 1.0, 1.0
    mean = min(max(failed / n, 1e-6), 1 - 1e-6)
    between = weighted - n * mean * mean - (hosts - 1) * mean * (1 - mean)
    scale = n - squares / n
    share = between / (scale * mean * (1 - mean)) if scale > 0 else 0.0  # of the variance that lies between hosts
    strength = min(max(1 / share - 1, 2.0), 1000.0) if share > 0 else 1000.0
    return mean * strength, (1 - mean) * strength


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, counts, base_failed, kept) of every row."""
    rows = cut(measured(df, id_col, text_col, host_col))
    # Cut, so that the join reads two plain exchanges and a hot host can be split.
    verdict = host_verdicts(rows).select(F.col("host").alias("__host"), "host_ok")
    verdict = cut(verdict, rows.select("host").distinct().count())
    return rows.join(verdict, rows.host == F.col("__host"), "left").select("id", "host", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"))


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``df`` that pass, columns unchanged.

    Texts are read twice, for the hosts' rates and for the rows that stay, and
    not exchanged: only rows of what may be a rejected host meet the verdicts.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                part = whole.slice(lo, 512)
                found = [counts(b"" if v is None else v) for v in part.column(at).cast(pa.binary()).to_pylist()]
                stays = pa.array([not (c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT_PERCENT * c[0]) for c in found], pa.bool_())
                yield part.filter(stays)

    hosts = host_verdicts(measured(df, id_col, text_col, host_col))
    bad = cut(hosts.where("not host_ok").select(F.col("host").alias("__host")))
    n = bad.count()
    if n:
        host = F.col(host_col).cast("string")
        some, others = apart(df, F.xxhash64(host), bad.select(F.xxhash64("__host").alias("h")), n)
        left = some.join(bad, host == F.col("__host"), "left_anti")
        df = left if others is None else left.union(others)
    return df.mapInArrow(run, df.schema)
