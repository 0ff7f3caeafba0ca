"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an integer array in order.

    Doubling as Larsson and Sadakane do it: groups of suffixes that are equal so far are refined by the rank of what
    follows, and groups of one are left alone.
    """
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int64)
    symbols = text.astype(np.int64) - int(text.min())
    if int(symbols.max()) < 1 << 24:  # dense symbols, so that more of them fit the first key
        present = np.bincount(symbols) > 0
        symbols = np.cumsum(present)[symbols]
    else:
        symbols = symbols + 1
    bits = int(symbols.max()).bit_length()
    key, h = symbols, 1
    while 2 * bits * h <= 62:  # several symbols in one first key
        shifted = np.zeros(n, np.int64)
        shifted[: n - h] = key[h:]
        key, h = (key << (bits * h)) | shifted, 2 * h
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    heads = np.flatnonzero(new)
    rank[sa] = np.repeat(heads, np.diff(np.append(heads, n)))
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of several
    while len(open_):
        at = sa[open_]
        group = rank[at]
        after = at + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = group * (n + 1) + second
        order = np.argsort(both, kind="stable")
        at, both = at[order], both[order]
        sa[open_] = at
        first = np.ones(len(at), bool)
        first[1:] = both[1:] != both[:-1]
        heads = np.flatnonzero(first)
        rank[at] = np.repeat(open_[heads], np.diff(np.append(heads, len(at))))
        open_ = open_[~(first & np.append(first[1:], True))]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Kasai's array, up to `most`: symbols that suffix sa[i] shares with suffix sa[i - 1]; 0 at i = 0.

    Kasai's rule (the prefix shared at the next place is shorter by one at most) holds along the text, so a
    block of places can start from the block's first value less the distance; within a step all blocks are compared at once.
    """
    n = len(text)
    plcp = np.zeros(n, np.int64)
    if n < 2:
        return plcp
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    block = 64
    heads = np.arange(0, n, block)
    known = np.zeros(len(heads), np.int64)
    for k in range(block):
        at = heads + k
        live = np.flatnonzero(at < n)
        at = at[live]
        other = before[at]
        have = np.maximum(known[live] - 1, 0)
        ok = other >= 0
        have[~ok] = 0
        run = np.flatnonzero(ok & (have < most))
        while len(run):
            i, j = at[run] + have[run], other[run] + have[run]
            same = (i < n) & (j < n)
            same &= text[np.minimum(i, n - 1)] == text[np.minimum(j, n - 1)]
            run = run[same]
            have[run] += 1
            run = run[have[run] < most]
        plcp[at] = have
        known[live] = have
    return plcp[sa]
