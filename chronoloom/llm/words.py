"""Word hashing over whole Arrow buffers in numpy.

A word's hash is a polynomial in an odd base over random 64-bit values of its bytes, modulo 2**64,
taken as a difference of prefix sums, so that no Python loop over words is needed.
"""

from __future__ import annotations

import functools

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values which spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ...; the common length is kept, longer ones serve one very long text."""
    return _kept_powers(base) if n == _CHUNK + 1 else _new_powers(base, n)


@functools.lru_cache(maxsize=4)
def _kept_powers(base: int) -> np.ndarray:
    return _new_powers(base, _CHUNK + 1)


def _new_powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
    return out


@functools.lru_cache(maxsize=8)
def _tables(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and the random value of each byte."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        value[65:91] = value[97:123]
    return inside, value


#: Bytes outside words, once capital letters count as small ones: the class [^\x00-\x2F\x3A-\x60\x7B-\x7F].
ALNUM_SEPARATORS = bytes(b for b in range(128) if b <= 0x2F or 0x3A <= b <= 0x60 and not 65 <= b <= 90 or b >= 0x7B)
#: The class [^\x20\x09-\x0D].
SPACE_SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])


#: Bytes whose words are hashed at once; a longer text is cut at separators.
_AT_ONCE = 8 << 20


def words(raw: np.ndarray, offsets: np.ndarray, separators: bytes, lower: bool = True):
    """Hash, first byte, end byte and row of each word; words never cross rows."""
    if len(raw) > _AT_ONCE:
        return _in_pieces(raw, offsets, separators, lower)
    return _words(raw, offsets, separators, lower)


def _in_pieces(raw: np.ndarray, offsets: np.ndarray, separators: bytes, lower: bool):
    """The words of a long stretch, in pieces that end where a word does, so that no more than a piece is worked on at once."""
    inside, _ = _tables(separators, lower)
    out, at, n = [], 0, len(raw)
    while at < n:
        end = min(n, at + _AT_ONCE)
        while end < n and inside[raw[end - 1]]:  # on to the next separator
            step = np.flatnonzero(~inside[raw[end : end + _AT_ONCE]])
            end = end + int(step[0]) + 1 if len(step) else min(n, end + _AT_ONCE)
        rows = np.clip(offsets, at, end) - at
        h, first, last, row = _words(raw[at:end], rows, separators, lower)
        out.append((h, first + at, last + at, row))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _words(raw: np.ndarray, offsets: np.ndarray, separators: bytes, lower: bool):
    inside, value = _tables(separators, lower)
    n = len(raw)
    if not n:
        zero = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), zero, zero, zero
    mask = inside[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | cut[1:n]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | cut[1:n]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    size = max(_CHUNK, 1 << (n - 1).bit_length()) + 1
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(value[raw] * _powers(_BASE, size)[:n], out=prefix[1:])
    hashes = mix((prefix[last] - prefix[first]) * _powers(_INVERSE, size)[first])
    row = np.searchsorted(offsets, first, side="right") - 1
    return hashes, first, last, row


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, width: int):
    """Hashes of all runs of `width` words in a row, and their rows; a row with fewer words gives one for all of them."""
    counts = np.bincount(row, minlength=n_rows)
    starts = np.concatenate(([0], np.cumsum(counts)))
    total = len(hashes)
    acc = np.zeros(max(0, total - width + 1), np.uint64)
    for k in range(width):
        acc = acc * np.uint64(0xA0761D6478BD642F) + hashes[k : k + len(acc)]
        acc = acc ^ (acc >> np.uint64(32))
    ok = np.zeros(len(acc), bool)
    if len(acc):
        ok = row[: len(acc)] == row[width - 1 :]
    out, out_row = mix(acc[ok]), row[: len(acc)][ok]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            h = np.array([counts[r]], np.uint64)
            for k in range(starts[r], starts[r + 1]):
                h = mix(h * np.uint64(3) + hashes[k : k + 1])
            extra[i] = h[0]
        out = np.concatenate((out, extra))
        out_row = np.concatenate((out_row, short))
        order = np.argsort(out_row, kind="stable")
        out, out_row = out[order], out_row[order]
    return out, out_row
