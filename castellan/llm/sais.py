"""Suffix arrays by induced sorting, and permuted longest common prefixes.

All levels are vectorised. Suffixes are classified by whole runs. On the text's
level buckets are filled in waves, and leftmost-smaller substrings are named by
ragged comparison. The reduced strings, whose alphabets are as large as
themselves, recurse with all buckets at once.
"""

from __future__ import annotations

import numpy as np

#: Alphabets beyond this go without a step for each bucket.
MOST_BUCKETS = 1024


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last position is."""
    n = len(s)
    ends = np.flatnonzero(s[1:] != s[:-1])
    smaller = np.append(s[ends] < s[ends + 1], True)
    lengths = np.diff(np.concatenate([[-1], ends, [n - 1]]))
    return np.repeat(smaller, lengths)


def leftmost(smaller: np.ndarray) -> np.ndarray:
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array from leftmost-smaller suffixes in (bucket-consistent) order."""
    n = len(s)
    sizes = np.bincount(s, minlength=sigma)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n_larger = np.bincount(s[~smaller], minlength=sigma)
    sa = np.full(n, -1, dtype=np.int64)
    present = np.flatnonzero(sizes).tolist()
    by_char = s[seeds]
    seed_lo = np.searchsorted(by_char, np.arange(sigma), "left")
    seed_hi = np.searchsorted(by_char, np.arange(sigma), "right")
    head = starts.copy()

    def append(at: np.ndarray) -> None:
        ch = s[at]
        order = np.argsort(ch, kind="stable")
        ch, at = ch[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
        count = np.diff(np.append(first, len(ch)))
        sa[np.arange(len(ch)) - np.repeat(first, count) + head[ch]] = at
        head[ch[first]] += count

    for c in present:
        lo = starts[c]
        while lo < head[c]:
            wave = sa[lo : head[c]]
            lo = head[c]
            before = wave[wave > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                append(before)
        wave = seeds[seed_lo[c] : seed_hi[c]]
        before = wave[wave > 0] - 1
        if len(before):
            append(before[~smaller[before]])

    tail = ends.copy()

    def prepend(at: np.ndarray) -> None:
        """Rows in descending order go to the ends of their buckets."""
        ch = s[at]
        order = np.argsort(ch, kind="stable")
        ch, at = ch[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
        count = np.diff(np.append(first, len(ch)))
        sa[tail[ch] - 1 - (np.arange(len(ch)) - np.repeat(first, count))] = at
        tail[ch[first]] -= count

    for c in reversed(present):
        hi = ends[c]
        floor = starts[c] + n_larger[c]
        while hi > tail[c]:
            wave = sa[tail[c] : hi][::-1]
            hi = tail[c]
            before = wave[wave > 0] - 1
            before = before[smaller[before]]
            if len(before):
                prepend(before)
        # The end of the text has no successor to induce it.
        if s[n - 1] == c and tail[c] > floor:
            prepend(np.array([n - 1]))
        wave = sa[starts[c] : floor][::-1]
        before = wave[wave > 0] - 1
        before = before[smaller[before]]
        if len(before):
            prepend(before)
    return sa


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of leftmost-smaller substrings, given their sorted order; equal substrings share one."""
    n = len(s)
    stop = np.append(lms[1:], n - 1)
    at = np.empty(n, dtype=np.int64)
    at[lms] = np.arange(len(lms))
    rank = at[order]
    length = (stop - lms + 1)[rank]
    same = np.zeros(len(order), dtype=bool)
    pairs = np.flatnonzero(length[1:] == length[:-1]) + 1
    for lo in range(0, len(pairs), 1 << 17):
        p = pairs[lo : lo + (1 << 17)]
        k = length[p]
        first = np.cumsum(k) - k
        within = np.arange(int(k.sum())) - np.repeat(first, k)
        a, b = np.repeat(order[p - 1], k) + within, np.repeat(order[p], k) + within
        same[p] = np.minimum.reduceat((s[a] == s[b]).view(np.uint8), first) > 0
    if len(order):
        same[0] = False
    name = np.cumsum(~same) - 1
    out = np.empty(len(lms), dtype=np.int64)
    out[rank] = name
    return out, int(name[-1]) + 1


def _ranked(s: np.ndarray) -> np.ndarray:
    """Suffix array of a reduced string: integers whose last one is the unique smallest.

    Its alphabet is about as large as itself, so filling bucket after bucket
    would take a step of Python each. All buckets are induced at once instead.
    A suffix is its factor, the characters with their types up to the next
    leftmost-smaller position, and then the suffix there. No factor is a proper
    beginning of another, so suffixes sort by factor, then by the rank of the
    leftmost-smaller suffix that follows. Factors get their names by doubling;
    the names of leftmost-smaller factors are the next reduced string.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    smaller = classify(s)
    lms = leftmost(smaller)
    if not len(lms):  # descends to its end
        return np.arange(n - 1, -1, -1)
    # The next such position after each; behind the last one there is none but the end itself.
    follow = np.searchsorted(lms, np.arange(n), "right")
    stop = np.append(lms, n - 1)[follow]
    span = stop - np.arange(n)
    name = _dense(2 * s + smaller)
    reach = 1
    while reach <= int(span.max()):
        second = np.zeros(n, dtype=np.int64)
        more = np.flatnonzero(span >= reach)
        second[more] = name[more + reach] + 1
        name = _dense(name * (n + 1) + second)
        reach *= 2
    reduced = _dense(name[lms])
    if int(reduced.max()) + 1 == len(lms):
        rank = reduced
    else:
        rank = np.empty(len(lms), dtype=np.int64)
        rank[_ranked(reduced)] = np.arange(len(lms))
    tail = np.append(rank, 0)[follow]
    return np.argsort(name * (len(lms) + 1) + tail)


def _dense(x: np.ndarray) -> np.ndarray:
    """Ranks of values, equal ones share one."""
    order = np.argsort(x)
    sorted_ = x[order]
    rank = np.empty(len(x), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]]))
    return rank


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of integers below ``sigma`` whose last one is 0, found nowhere else."""
    s = np.ascontiguousarray(s, dtype=np.int64)
    if sigma > MOST_BUCKETS:
        return _ranked(s)
    smaller = classify(s)
    lms = leftmost(smaller)
    rough = lms[np.argsort(s[lms], kind="stable")]
    sa = _induce(s, smaller, rough, sigma)
    is_lms = np.zeros(len(s), dtype=bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    names, count = _names(s, lms, order)
    if count < len(lms):
        order = lms[_ranked(names)]
    return _induce(s, smaller, order, sigma)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the common prefix with the suffix sorted just before it.

    Where the preceding characters agree the value is one less than the one
    before; only the other, irreducible positions are compared.
    """
    n = len(s)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, dtype=np.int64)
    i = np.arange(n)
    known = phi >= 0
    reducible = known & (i > 0) & (phi > 0)
    r = np.flatnonzero(reducible)
    reducible[r] = (s[r - 1] == s[phi[r] - 1]) & (phi[r - 1] == phi[r] - 1)
    work = np.flatnonzero(known & ~reducible)
    a, b = work.copy(), phi[work]
    padded = np.concatenate([s, np.full(64, -1, dtype=s.dtype)])
    step = 8
    while len(work):
        span = np.arange(step)
        left, right = np.minimum(a[:, None] + span, n + 62), np.minimum(b[:, None] + span, n + 63)
        differ = (padded[left] != padded[right]) | (a[:, None] + span >= n) | (b[:, None] + span >= n)
        whole = ~differ.any(1)
        plcp[work] += np.where(whole, step, differ.argmax(1))
        a, b, work = a[whole] + step, b[whole] + step, work[whole]
        step = min(64, step * 2)
    last = np.maximum.accumulate(np.where(reducible, 0, i))
    return np.where(reducible, plcp[last] - (i - last), plcp)
