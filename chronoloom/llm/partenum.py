"""Jaccard self-join of word shingles by PartEnum signatures, and its connected components.

A document is the set of its distinct 5-word shingles. Sets a, b with Jaccard similarity 3/4 or more differ in at most
(|a| + |b|) / 7 elements and their sizes in a factor of at most 4/3. Sizes form bands of that factor; a set is signed for its
own band and, as the larger one of a pair, for the band below. For a band the domain of shingles is cut by hash into
partitions, each again into parts, and every subset of parts that leaves out as many as may differ is a signature:

* small bands: n1 partitions of 3 parts, of which 1 may differ, so 3 subsets of 2 parts each;
* large bands: n1 partitions of 2 parts, of which 1 may differ, so 2 subsets of 1 part. Parts that hold something in their order are signatures
  and only the first k + 1 are sent, k being what may differ: of two similar sets' parts the first k + 1 hold a common one.

Empty subsets say nothing and are not sent; that a pair still shares a signature needs a set with more filled parts
(partitions) than may differ. A set for which this fails is signed again: first over all shingles (before, those that
are frequent in a sample were left out, which takes nothing from the bound), then by its smallest shingles as partitions of one element.
One of the steps always holds, so no similar pair is missed, whatever the sample. Sets of up to 24 shingles, and what may be
similar to them, are signed by their smallest shingles.

Signatures go to buckets as packed bytes, each set's of a slice together, and are sorted there in numpy, a bounded number at a time.
Sets that share a signature are linked to one of them, the first met. Signatures that many sets of a sample share skip the buckets: a set
of the sample is what all others are linked to, wherever they are. A link is ruled out by sketches (parity bits, of which two
similar sets can differ in few) or else checked on the whole sets. What fails is held against the other sets which met the same one,
in blocks and by sketches first, unless they are in one component already; each asks for few partners at first and for
more in later rounds, so that sets which are linked by a few links are not asked for all of them. Equal sets are one from the start;
pairs within a group are never listed.

Defined results: null, empty and blank texts have no shingles and stay alone; a text with fewer words than the width has one
shingle of all of them. Repeated rows and repeated doc_ids are rows of their own; component_id is the smallest doc_id of the
component (null only if all are null). An empty table gives an empty result. Columns n_shingles and component_id are replaced.
"""

from __future__ import annotations

from collections import OrderedDict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_arrow, materialize, partitions, row_slices, text_buffer
from .components import components
from .words import SPACE_SEPARATORS, as_signed, mix, shingles, words

WIDTH = 5
#: Similarity 3/4 as a fraction of integers.
SIMILAR = (75, 100)
SMALL = 24  # sets up to this size are signed by elements
_PAIRED = 80  # band starts below this use subsets of two parts
_SLICE = 1 << 20
#: Shingles left out of signatures at first: at most this many, found in a sample of about this many distinct texts.
FREQUENT_SHINGLES = 200_000
SAMPLE_TEXTS = 4000
_BLOCK = 4000  # sets of a block in the last check; of each only a sketch is sent
#: Signatures that a bucket holds on average, and how many are sorted at once.
BUCKET_SIGNATURES, _AT_ONCE = 4_000_000, 4_000_000
#: A signature that so many sets of the sample share is not sent to a bucket.
HOT_SETS = 100
_MEMBERS = 1000  # sets checked against one in a block


def row_shingles(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
    """Distinct shingle hashes of each row in order, and their rows."""
    h, _, _, row = words(raw, offsets, SPACE_SEPARATORS)
    s, srow = shingles(h, row, len(offsets) - 1, width)
    bounds = np.searchsorted(srow, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (srow[1:] != srow[:-1])
    return s[new], srow[new]


def set_ids(s: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and identity of each row's set; identity 0 for the empty set."""
    sizes = np.bincount(row, minlength=n)
    ids = np.zeros(n, np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(sizes)))[full]
        ids[full] = mix(np.add.reduceat(mix(s), starts) ^ mix(np.bitwise_xor.reduceat(mix(s + np.uint64(7)), starts)) + sizes[full].astype(np.uint64)) | np.uint64(1)
    return sizes, ids


def _bands(most: int) -> np.ndarray:
    out = [SMALL + 1]
    while out[-1] <= most:
        out.append(-(-4 * out[-1] // 3))
    return np.array(out)


def _first_of_each(row: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which entries of a list in row order are among the first most[row] of their row."""
    if not len(row):
        return np.zeros(0, bool)
    head = np.ones(len(row), bool)
    head[1:] = row[1:] != row[:-1]
    at = np.flatnonzero(head)
    place = np.arange(len(row)) - np.repeat(at, np.diff(np.append(at, len(row))))
    return place < most[row]


def _parts(s, row, n_parts):
    """(row, part, sum of hashes) of every filled part; shingles are in order, so parts are runs."""
    part = ((s >> np.uint64(32)) * n_parts[row].astype(np.uint64)) >> np.uint64(32)
    head = np.ones(len(s), bool)
    head[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    at = np.flatnonzero(head)
    return row[at], part[at].astype(np.int64), np.add.reduceat(mix(s), at) if len(at) else np.zeros(0, np.uint64)


def _tag(level: int, band: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(place.astype(np.uint64) * np.uint64(4096) + band.astype(np.uint64) * np.uint64(8) + np.uint64(level))


def _by_elements(s, row, sizes, level):
    """Signatures of the smallest shingles: as many as no similar set can lack."""
    most = sizes - (SIMILAR[0] * sizes + SIMILAR[1] - 1) // SIMILAR[1] + 1
    keep = _first_of_each(row, most)
    return mix(s[keep] + np.uint64(level)), row[keep]


def _by_parts(s, row, n, level, band, start, k):
    """Signatures of large bands, their rows, and which rows hold the guarantee."""
    n_parts = 2 * np.ceil(0.25 * start + 0.3 * np.sqrt(start)).astype(np.int64)
    prow, part, total = _parts(s, row, n_parts)
    filled = np.bincount(prow, minlength=n)
    keep = _first_of_each(prow, k + 1)
    return mix(total[keep] ^ _tag(level, band[prow[keep]], part[keep])), prow[keep], filled > k


def _by_pairs(s, row, n, level, band, start, k):
    """Signatures of small bands: partitions of 3 parts, every 2 of them."""
    n1 = np.ceil(0.30 * start).astype(np.int64) + 1
    prow, part, total = _parts(s, row, 3 * n1)
    first = np.concatenate(([0], np.cumsum(n1)))
    cell = first[prow] + part // 3
    sums = np.zeros((first[-1], 3), np.uint64)
    sums[cell, part % 3] = total
    owner = np.repeat(np.arange(n), n1)
    place = np.arange(first[-1]) - first[owner]
    sigs, rows = [], []
    for c, (i, j) in enumerate(combinations(range(3), 2)):
        some = np.flatnonzero((sums[:, i] != 0) | (sums[:, j] != 0))
        sigs.append(mix(mix(sums[some, i] + np.uint64(c + 1)) + sums[some, j] ^ _tag(level, band[owner[some]], place[some] * 4 + c)))
        rows.append(owner[some])
    sure = np.bincount(owner, (sums != 0).sum(axis=1) >= 2, n)
    return np.concatenate(sigs), np.concatenate(rows), sure > k // 2


def signatures(s: np.ndarray, row: np.ndarray, sizes: np.ndarray, frequent: np.ndarray):
    """Signatures of each row's set and their rows."""
    n = len(sizes)
    out_s, out_r = [], []

    def put(sig, r):
        out_s.append(sig)
        out_r.append(r)

    small = sizes <= SMALL * 4 // 3
    pick = small[row]
    put(*_by_elements(s[pick], row[pick], sizes, 1))
    starts = _bands(int(sizes.max(initial=0)))
    own = np.searchsorted(starts, sizes, side="right") - 1
    common = np.zeros(len(s), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        common = frequent[at] == s
    for lower in (0, 1):
        band = own - lower
        rows = (own >= lower) & (own >= 0)
        if lower:
            rows &= -(-3 * sizes // 4) < starts[np.maximum(own, 0)]
        at_start = starts[np.maximum(band, 0)]
        k = sizes // 3 if not lower else 2 * sizes // 7
        for scheme, which in ((_by_pairs, rows & (at_start < _PAIRED)), (_by_parts, rows & (at_start >= _PAIRED))):
            todo = which
            for level in (2, 3):  # without frequent shingles, then with all
                if not todo.any():
                    break
                ids = np.flatnonzero(todo)
                number = np.full(n, -1)
                number[ids] = np.arange(len(ids))
                pick = todo[row] & (~common if level == 2 else True)
                sig, r, sure = scheme(s[pick], number[row[pick]], len(ids), level, band[ids], at_start[ids], k[ids])
                put(sig, ids[r])
                todo = todo.copy()
                todo[ids[sure]] = False
            if todo.any():
                pick = todo[row]
                put(*_by_elements(s[pick], row[pick], sizes, 4))
    return np.concatenate(out_s), np.concatenate(out_r)


def sketches(s: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity bits of each row's set: two bits or more for a shingle, each flipped once for every shingle that falls on it.

    Two sets differ in at least as many elements as their sketches do in bits, so a sketch can rule a pair out and never in error."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    start = np.concatenate(([0], np.cumsum(bits)))
    at = start[row] + (s & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((start[:-1] // 8).tolist(), (start[1:] // 8).tolist(), strict=True)]


def folded(sketch: int, bits: int, to: int) -> int:
    """A sketch as one of fewer bits."""
    while bits > to:
        bits //= 2
        sketch = (sketch >> bits) ^ (sketch & ((1 << bits) - 1))
    return sketch


def may_differ(a, b):
    """Elements in which similar sets of these sizes may differ: a seventh of all."""
    return (a + b) // 7


def possible(n: int, sketch: bytes, other_n: int, other: bytes) -> bool:
    """Whether sizes and sketches leave it open that two sets are similar."""
    if 4 * min(n, other_n) < 3 * max(n, other_n):
        return False
    bits = 8 * min(len(sketch), len(other))
    one, two = (folded(int.from_bytes(x, "little"), 8 * len(x), bits) for x in (sketch, other))
    return (one ^ two).bit_count() <= may_differ(n, other_n)


def _describe(width: int):
    """For mapInArrow: n_shingles, set id (null for the empty set) and sketch of each row."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            n, ids, made = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64), []
            for a, b in row_slices(offsets, _SLICE):
                s, row = row_shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                n[a:b], ids[a:b] = set_ids(s, row, b - a)
                made += sketches(s, row, n[a:b])
            keep = [i for i, c in enumerate(batch.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(n), pa.array(as_signed(ids), mask=ids == 0), pa.array(made, pa.binary())],
                names=[*(batch.schema.names[i] for i in keep), "n_shingles", "set_id", "sketch"],
            )

    return run


def signature_bits(n_docs: int) -> int:
    """Bits of a signature that keep chance meetings, which cost a check each, far below the documents in number."""
    return min(63, max(32, n_docs.bit_length() + 19))


def _quotient_bytes(bits: int, buckets: int) -> int:
    return max(1, -(-(((1 << bits) - 1) // buckets).bit_length() // 8))


def packed(sig: np.ndarray, ids: np.ndarray, row: np.ndarray, bits: int, buckets: int):
    """(bucket, bytes) of signatures of some bits: sets' ids, how many of its signatures follow each (255 at most), and the signatures.

    A signature's bucket is its remainder, so only its quotient is sent."""
    if not len(sig):
        return
    size = _quotient_bytes(bits, buckets)
    bucket = (sig % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((row, bucket))
    sig, row, bucket = sig[order] // np.uint64(buckets), row[order], bucket[order]
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1]))
    starts = np.flatnonzero(new)
    place = np.arange(len(sig)) - np.repeat(starts, np.diff(np.append(starts, len(sig))))
    heads = np.flatnonzero(place % 255 == 0)
    counts = np.diff(np.append(heads, len(sig)))
    body = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
    head = np.concatenate([ids[row[heads]].astype("<u8").view(np.uint8).reshape(-1, 8), counts.astype(np.uint8).reshape(-1, 1)], axis=1)
    of_bucket = np.flatnonzero(np.append(True, np.diff(bucket[heads]) != 0))
    ends = np.append(of_bucket[1:], len(heads))
    for a, b in zip(of_bucket.tolist(), ends.tolist(), strict=True):
        lo, hi = heads[a], heads[b] if b < len(heads) else len(sig)
        # Heads first, then all signatures, each part in order of sets.
        yield int(bucket[lo]), np.uint32(b - a).tobytes() + head[a:b].tobytes() + body[lo:hi].tobytes()


def unpacked(data: bytes, bits: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotients of signatures, and the set ids that they belong to."""
    size, n = _quotient_bytes(bits, buckets), int(np.frombuffer(data, "<u4", 1)[0])
    head = np.frombuffer(data, np.uint8, 9 * n, 4).reshape(n, 9)
    ids, counts = head[:, :8].copy().view("<u8").ravel(), head[:, 8]
    raw = np.frombuffer(data, np.uint8, offset=4 + 9 * n).reshape(-1, size)
    sig = np.zeros((len(raw), 8), np.uint8)
    sig[:, :size] = raw
    return sig.view("<u8").ravel(), np.repeat(ids, counts)


def _sign(frequent, width: int, bits: int, buckets: int, hot=None):
    """For mapInArrow: packed signatures of each distinct set that the task meets, by bucket; links (x, rep) of hot ones."""

    def run(batches):
        common, seen = frequent.value, OrderedDict()
        hot_sig, hot_rep = hot or (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            for a, b in row_slices(offsets, _SLICE):
                s, row = row_shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                sizes, ids = set_ids(s, row, b - a)
                fresh = np.zeros(b - a, bool)
                for i, x in enumerate(ids.tolist()):
                    if x and x not in seen:
                        seen[x] = None
                        fresh[i] = True
                while len(seen) > 500_000:  # only saves work: a set signed twice is one set still
                    seen.popitem(last=False)
                pick = fresh[row]
                sig, r = signatures(s[pick], row[pick], np.where(fresh, sizes, 0), common)
                sig = sig >> np.uint64(64 - bits)
                if len(hot_sig):
                    at = np.minimum(np.searchsorted(hot_sig, sig), len(hot_sig) - 1)
                    known = hot_sig[at] == sig
                    x, rep = ids[r[known]], hot_rep[at[known]]
                    pair, n = np.unique(np.stack([x, rep], axis=1)[x != rep], axis=0, return_counts=True)
                    if len(pair):
                        yield _rows(x=as_signed(pair[:, 0].copy()), rep=as_signed(pair[:, 1].copy()), n=n)
                    sig, r = sig[~known], r[~known]
                sent = list(packed(sig, ids, r, bits, buckets))
                for i in range(0, len(sent), 256):
                    yield _rows(bucket=[k for k, _ in sent[i : i + 256]], data=[x for _, x in sent[i : i + 256]])

    return run


_PACKED = "bucket long, data binary, x long, rep long, n long"


def _rows(**columns) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "data": pa.binary(), "x": pa.int64(), "rep": pa.int64(), "n": pa.int64()}
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in kinds.items()], names=list(kinds))


def _stars(bits: int, buckets: int):
    """For mapInArrow over packed signatures in order of bucket: links of the sets of a signature to one of them, with how often.

    Signatures are sorted _AT_ONCE at a time. Of what is done with, each signature's set to link to is kept: a bucket's
    different signatures, however many sets share one."""

    def met(sig, ids, known, reps):
        """Links of some signatures; the signatures known from now on and the sets that stand for them."""
        order = np.argsort(sig)
        sig, ids = sig[order], ids[order]
        at = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        own, rep = sig[at], np.minimum.reduceat(ids, at)
        if len(known):
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            there = known[place] == own
            rep = np.where(there, reps[place], rep)
            new = ~there
            both = np.concatenate((known, own[new]))
            sort = np.argsort(both, kind="stable")
            known, reps = both[sort], np.concatenate((reps, rep[new]))[sort]
        else:
            known, reps = own, rep
        of = np.repeat(rep, np.diff(np.append(at, len(sig))))
        far = ids != of
        pair, n = np.unique(np.stack([ids[far], of[far]], axis=1), axis=0, return_counts=True)
        return _links(pair, n), known, reps

    def run(batches):
        none = np.zeros(0, np.uint64)
        now, held, size, known, reps = None, [], 0, none, none
        for batch in batches:
            linked = batch.filter(batch.column("bucket").is_null()).select(["x", "rep", "n"])
            if linked.num_rows:
                yield linked
            batch = batch.filter(batch.column("bucket").is_valid())
            places, data = batch.column("bucket"), batch.column("data")
            for i in range(batch.num_rows):
                bucket = places[i].as_py()
                if bucket != now or size >= _AT_ONCE:
                    if held:
                        out, known, reps = met(*(np.concatenate(x) for x in zip(*held, strict=True)), known, reps)
                        yield out
                    held, size = [], 0
                    if bucket != now:
                        now, known, reps = bucket, none, none
                held.append(unpacked(data[i].as_py(), bits, buckets))
                size += len(held[-1][0])
        if held:
            yield met(*(np.concatenate(x) for x in zip(*held, strict=True)), known, reps)[0]

    return run


def _links(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"x": as_signed(pair[:, 0].copy()), "rep": as_signed(pair[:, 1].copy()), "n": n})


def _single(column, width: int) -> np.ndarray:
    raw = np.frombuffer(column, np.uint8)
    return row_shingles(raw, np.array([0, len(raw)]), width)[0]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    low, high = sorted((len(a), len(b)))
    if SIMILAR[1] * low < SIMILAR[0] * high:
        return False
    if low == 0:
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return SIMILAR[1] * shared >= SIMILAR[0] * (len(a) + len(b) - shared)


def _check_links(width: int):
    """For mapInArrow over (rep, block, role, id, text), the rep first in its block: x and whether it is similar to rep."""

    def run(batches):
        now, base, x_out, rep_out, ok = None, None, [], [], []
        for batch in batches:
            for rep, block, role, x, text in zip(*(batch.column(c).to_pylist() for c in ("rep", "block", "role", "id", "text")), strict=True):
                mine = _single(text.encode(), width)
                if (rep, block) != now:
                    now, base = (rep, block), None
                if role == 0:
                    base = mine
                elif base is not None:
                    x_out.append(x)
                    rep_out.append(rep)
                    ok.append(similar(mine, base))
            yield pa.RecordBatch.from_pydict({"x": pa.array(x_out, pa.int64()), "rep": pa.array(rep_out, pa.int64()), "ok": pa.array(ok, pa.bool_())})
            x_out, rep_out, ok = [], [], []

    return run


def _sketch_links(batches):
    """For mapInArrow over links with sizes and sketches of both sets: adds whether the pair may be similar."""
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("nx", "sx", "nr", "sr")]
        open_ = [possible(*r) for r in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("rep"), pa.array(open_, pa.bool_())], names=["x", "rep", "open"])


def _matrix(rows: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), -1)


def _half(m: np.ndarray) -> np.ndarray:
    """Sketches of half as many bits."""
    if m.shape[1] > 1:
        return m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
    return (m >> np.uint64(32)) ^ (m & np.uint64(0xFFFFFFFF))


def open_pairs(failed: list[tuple], others: list[tuple], most: int):
    """Pairs (id, id) of failed sets (id, label, n, sketch, failed, upto) and others with other labels that sizes and sketches leave open.

    Each failed set asks for the `most` smallest others beyond upto. Of two sets that both failed only one asks for the other."""
    by_size: dict[int, list[tuple]] = {}
    for r in others:
        by_size.setdefault(len(r[3]), []).append(r)
    ready = {k: (*(np.array([r[i] for r in v]) for i in (0, 1, 2, 4)), _matrix(v)) for k, v in by_size.items()}
    for x, label, n, sketch, _, upto in failed:
        mine, found = _matrix([(0, 0, 0, sketch)]), []
        for size in (len(sketch) // 2, len(sketch), 2 * len(sketch)):
            if size in ready:
                ids, labels, sizes, both, m = ready[size]
                fits = (labels != label) & (~both | (ids > x)) & (4 * np.minimum(sizes, n) >= 3 * np.maximum(sizes, n))
                if upto is not None:
                    fits &= ids > upto
                fits = np.flatnonzero(fits)
                if len(fits):
                    a, b = mine, m[fits]
                    if size < len(sketch):
                        a = _half(a)
                    elif size > len(sketch):
                        b = _half(b)
                    far = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
                    found += ids[fits[far <= may_differ(sizes[fits], n)]].tolist()
        for y in sorted(found)[:most]:
            yield x, y


def _check_blocks(most: int):
    """For mapInArrow over sketches of block pairs: pairs of failed sets (role 0) and others (role 1) that stay open."""

    def found(at, failed, others):
        pairs = list(open_pairs(failed, others, most))
        return pa.RecordBatch.from_pydict(
            {"met": pa.array([at[0]] * len(pairs), pa.int64()), "j": pa.array([at[2]] * len(pairs), pa.int32()), "x": pa.array([p[0] for p in pairs], pa.int64()), "rep": pa.array([p[1] for p in pairs], pa.int64())}
        )

    def run(batches):
        now, failed, others = None, [], []
        for batch in batches:
            for rep, i, j, role, *row in zip(*(batch.column(c).to_pylist() for c in ("rep", "i", "j", "role", "id", "label", "n", "sketch", "failed", "upto")), strict=True):
                if (rep, i, j) != now:
                    if failed and others:
                        yield found(now, failed, others)
                    now, failed, others = (rep, i, j), [], []
                (failed if role == 0 else others).append(tuple(row))
        if failed and others:
            yield found(now, failed, others)

    return run


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.coalesce("text", F.lit("")))


def frequent_shingles(docs: DataFrame, n: int, width: int) -> np.ndarray:
    """Shingles in 1 of 400 or more of a sample of distinct texts; only the order of work depends on them."""
    stride = max(1, n // SAMPLE_TEXTS)
    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(stride)) == 0).dropDuplicates(["text"])

    def each(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            for a, b in row_slices(offsets, _SLICE):
                s, _ = row_shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                v, c = np.unique(s, return_counts=True)
                yield pa.RecordBatch.from_pydict({"s": as_signed(v), "n": c})

    found = (
        sample.transform(map_arrow, each, "s long, n long")
        .groupBy("s")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= max(10, SAMPLE_TEXTS // 400))
        .orderBy(F.desc("n"), "s")
        .limit(FREQUENT_SHINGLES)
        .toArrow()
    )
    return np.sort(found.column("s").to_numpy().view(np.uint64))


def _relabel(frame: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
    return frame.join(labels.select(F.col("node").alias(node), F.col("label").alias("_l")), node, "left").withColumn(out, F.coalesce("_l", node)).drop("_l")


def hot_signatures(docs: DataFrame, n: int, frequent, width: int, bits: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Signatures that HOT_SETS sets or more of the sample share, and the set of each that all others are linked to."""
    stride = max(1, n // SAMPLE_TEXTS)
    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(stride)) == 0)

    def spread(batches):
        for batch in batches:
            for data in batch.column("data").drop_null():
                sig, ids = unpacked(data.as_py(), bits, 1)
                yield pa.RecordBatch.from_pydict({"sig": as_signed(sig.astype(np.uint64)), "set_id": as_signed(ids.astype(np.uint64))})

    found = (
        sample.transform(map_arrow, _sign(frequent, width, bits, 1), _PACKED)
        .transform(map_arrow, spread, "sig long, set_id long")
        .distinct()
        .groupBy("sig")
        .agg(F.count("*").alias("n"), F.min("set_id").alias("rep"))
        .where(F.col("n") >= HOT_SETS)
        .orderBy(F.desc("n"), "sig")
        .limit(FREQUENT_SHINGLES)
        .toArrow()
    )
    if not len(found):
        return None
    sig, rep = (found.column(c).to_numpy().view(np.uint64) for c in ("sig", "rep"))
    order = np.argsort(sig)
    return sig[order], rep[order]


def _counted(frame: DataFrame, by: str, name: str, least: int = 1) -> DataFrame:
    """frame with the number of its rows of the same `by`, if more than least; counted in parts, so that no value of it is one task's alone."""
    counts = frame.groupBy(by).agg(F.count("*").cast("int").alias(name)).where(F.col(name) > least)
    return frame.join(counts, by, "left").withColumn(name, F.coalesce(name, F.lit(least)))


def _verify(links: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """x, rep, ok of links (x, rep). A rep with many links is sent to one block for each _MEMBERS."""
    n = partitions(links.sparkSession)
    sized = _counted(links, "rep", "blocks", _MEMBERS).withColumn("blocks", F.ceil(F.col("blocks") / _MEMBERS).cast("int"))
    members = sized.select("rep", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), F.col("x").alias("id"))
    heads = sized.select("rep", "blocks").distinct().select("rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("rep").alias("id"))
    sent = members.unionAll(heads).join(texts.withColumnRenamed("set_id", "id"), "id")
    return (
        sent.repartition(n, "rep", "block")
        .sortWithinPartitions("rep", "block", "role")
        .select("rep", "block", "role", "id", "text")
        .transform(map_arrow, _check_links(width), "x long, rep long, ok boolean")
    )


def _met(links: DataFrame, failed: DataFrame, sets: DataFrame) -> DataFrame:
    """All sets that met a rep which some failed against: rep, x, n_failed, n_met, failed, n and sketch."""
    reps = failed.groupBy("rep").agg(F.count("*").cast("int").alias("n_failed"))
    met = _counted(links.select("rep", "x").join(reps, "rep"), "rep", "n_met", _BLOCK)  # fewer are one block
    met = met.join(failed.select("rep", "x", F.lit(True).alias("failed")), ["rep", "x"], "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    return materialize(met.join(sets.withColumnRenamed("set_id", "x"), "x"), "met")


def _open_rest(met: DataFrame, labels: DataFrame, asked: DataFrame | None, most: int) -> DataFrame:
    """(met, j, x, rep): pairs (x, rep) still open between sets that failed against `met` and all other sets that met it.

    asked: met, j, x, upto of what earlier rounds have asked for; only these go on then."""
    n = partitions(met.sparkSession)
    if asked is not None:
        met = met.join(asked.select(F.col("met").alias("rep")).distinct(), "rep", "left_semi")
    met = _relabel(met, labels, "x", "label")
    i_blocks, j_blocks = F.ceil(F.col("n_failed") / _BLOCK).cast("int"), F.ceil(F.col("n_met") / _BLOCK).cast("int")
    spread = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    block = lambda k: F.pmod(F.xxhash64("x"), k).cast("int")
    what = [F.col("x").alias("id"), "label", "n", "sketch", "failed"]
    nobody = F.lit(None).cast("long").alias("upto")

    def each(rows: DataFrame, count: Column, name: str) -> DataFrame:
        """A copy of the rows for each block of the other side; most have one."""
        return rows.where(count == 1).withColumn(name, F.lit(0)).unionAll(rows.where(count > 1).withColumn(name, spread(count)))

    one = each(met.where("failed").withColumn("i", block(i_blocks)), j_blocks, "j")
    one = one.withColumn("upto", nobody) if asked is None else one.join(asked.withColumnRenamed("met", "rep"), ["rep", "j", "x"])
    one = one.select("rep", "i", "j", F.lit(0).alias("role"), *what, "upto")
    other = each(met.withColumn("j", block(j_blocks)), i_blocks, "i").select("rep", "i", "j", F.lit(1).alias("role"), *what, nobody)
    return one.unionAll(other).repartition(n, "rep", "i", "j").sortWithinPartitions("rep", "i", "j").transform(map_arrow, _check_blocks(most), "met long, j int, x long, rep long")


def _texts(keyed: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """set_id and text of one row for each set in pairs (x, rep)."""
    wanted = pairs.select(F.explode(F.array("x", "rep")).alias("set_id")).distinct()
    # Of equal sets one row stands for all; rows repeated in doc_id and text are told apart by nothing.
    one = rows.select("set_id", "key").join(wanted, "set_id").groupBy("key").agg(F.first("set_id").alias("set_id"), F.count("*").alias("copies"))
    one = materialize(one.groupBy("set_id").agg(F.min_by(F.struct("key", "copies"), F.struct("copies", "key")).alias("r")).select("set_id", "r.*"), "one_row")
    texts = keyed.select("key", "text").join(one, "key").select("set_id", "text")
    if not one.where("copies > 1").isEmpty():
        texts = texts.dropDuplicates(["set_id"])
    return materialize(texts, "texts")


def set_components(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_shingles, set_id) of each row of docs, and (node, label) of sets in components of several sets."""
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = docs.select("doc_id", _key().alias("key"), "text")
    rows = materialize(keyed.transform(map_arrow, _describe(width), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n_shingles long, set_id long, sketch binary"), "rows")
    n_docs, n_shingles = rows.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    bits, buckets = signature_bits(n_docs), max(n, -(-int(n_shingles) // BUCKET_SIGNATURES))  # a set has fewer signatures than shingles
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, n_docs, width))
    hot = hot_signatures(docs, n_docs, frequent, width, bits)
    # Rows without a bucket are links already; they are dealt out by set.
    deal = F.pmod(F.coalesce("bucket", "x"), F.lit(n)).cast("int")
    links = materialize(
        docs.select("text")
        .transform(map_arrow, _sign(frequent, width, bits, buckets, hot), _PACKED)
        .repartitionById(n, deal)
        .sortWithinPartitions("bucket")
        .transform(map_arrow, _stars(bits, buckets), "x long, rep long, n long")
        .groupBy("x", "rep")
        .agg(F.sum("n").alias("n")),
        "links",
    )
    sets = materialize(rows.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "sets")
    side = lambda id_, n, sketch: sets.select(F.col("set_id").alias(id_), F.col("n").alias(n), F.col("sketch").alias(sketch))
    tested = links.join(side("x", "nx", "sx"), "x").join(side("rep", "nr", "sr"), "rep").transform(map_arrow, _sketch_links, "x long, rep long, open boolean")
    tested = materialize(tested, "tested")
    open_links = tested.where("open").select("x", "rep")
    labels = spark.createDataFrame([], "node long, label long")
    apart = lambda f: _relabel(_relabel(f, labels, "x", "lx"), labels, "rep", "lr").where("lx != lr").select("x", "rep")
    ok = lambda f: f.where("ok").select(F.col("x").alias("a"), F.col("rep").alias("b"))
    bad = tested.where(~F.col("open")).select("x", "rep")
    good = None
    if not open_links.isEmpty():
        checked = materialize(_verify(open_links, _texts(keyed, rows, open_links), width), "checked")
        bad, good = bad.unionAll(checked.where(~F.col("ok")).select("x", "rep")), ok(checked)
        labels = components(good)
    failed = materialize(apart(bad), "failed")
    met, asked, most = _met(links, failed, sets), None, 16
    while True:
        rest = materialize(_open_rest(met, labels, asked, most), "rest")
        if rest.isEmpty():
            break
        pairs = rest.select("x", "rep").distinct()
        more = ok(materialize(_verify(pairs, _texts(keyed, rows, pairs), width), "checked"))
        if not more.isEmpty():
            good = more if good is None else good.unionAll(more)
            labels = components(good)
        asked, most = rest.groupBy("met", "j", "x").agg(F.max("rep").alias("upto")), 256 * most
    return rows.drop("sketch"), labels


def jaccard_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, key (a hash of doc_id and text), n_shingles and component_id of each row of docs."""
    rows, labels = set_components(docs, width)
    labelled = _relabel(rows, labels, "set_id", "label")
    least = labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "label", "left").select("doc_id", "key", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without all but one row of each component: the one of the smallest doc_id, equal rows once."""
    found = jaccard_components(docs, width)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("key").agg(F.count("*").alias("copies"))
    key, copies = free_name(docs, "_key"), free_name(docs, "_copies")
    out = docs.withColumn(key, _key()).join(kept.withColumnsRenamed({"key": key, "copies": copies}), key)
    # Rows that are repeated in doc_id and text are told apart by nothing; they alone are shuffled to keep one.
    single = out.where(F.col(copies) == 1).select(*docs.columns)
    twice = out.where(F.col(copies) > 1).dropDuplicates([key]).select(*docs.columns)
    return single.unionByName(twice)
