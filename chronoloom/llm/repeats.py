"""Suffix-array deduplication: every byte covered by a string of `length` bytes that also starts elsewhere goes.

1. Sharding. Each window of `length` bytes has an anchor: its smallest 32-byte gram by a hash, the leftmost of equals. Equal
   windows have equal anchors at equal places, so windows that can be equal meet by content. An anchor's windows are
   dealt to three classes by where the anchor lies in them; windows of a class share a core of bytes, whose hash is their key. Spans
   of windows whose key no other span has cannot repeat anything and end here; most of a corpus does.
2. Spans equal as a whole are repeats entirely, and one of them stands for all in what follows.
3. Spans of one key that differ go to a shard as bytes. A shard's suffix array (Larsson-Sadakane) and common prefixes (Kasai)
   mark the windows equal to a neighbour. A key with more spans than a shard takes is dealt to several shards, whose windows are
   merged: hashes in order over all shards, in which each window finds its equals by binary search.
4. Marked windows are joined per document and cut out.

The same is done for words instead of bytes (`WORDS`): symbols are then hashes of words, and only windows that stand in another document
count. That finds passages of so many words which documents share, whatever their bytes, and cuts them at word ends.

Nothing is collected on the driver but the keys of HOT_SPANS spans or more in a sample of documents (MOST_HOT at most). Spans of these are
dealt to many tasks, counted there and summed; any other key takes few rows. The sample decides where work is done, never what is found.
Pairs of documents are never formed. A text longer than a slice is read in slices that overlap by a window.

Defined results: null text is empty; texts shorter than `length` keep everything. By bytes, rows equal in doc_id and text are
documents of their own, so both lose every repeated byte; by words, they are one document. Cutting bytes may split a character: `kept` is
binary. An empty table gives an empty result. Further columns pass through whatever their names; those named kept, n_bytes, n_removed and
spans (and n_passage_words if asked for) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_arrow, materialize, partitions, row_slices, text_buffer
from .suffix import common_prefixes, suffix_array
from .words import _BASE, _INVERSE, SPACE_SEPARATORS, _powers, as_signed, mix, words

LENGTH = 400
PASSAGE_WORDS = 50
_CLASSES = 3
#: Spans of one key that a shard takes, and bytes of spans in one suffix array.
SHARD_SPANS = 8000
SHARD_BYTES = 1 << 20
#: Spans of a key from which it is dealt to _SALTS tasks, told from one document in _SAMPLED; and how many such keys there may be.
HOT_SPANS, MOST_HOT, _SAMPLED, _SALTS = 4000, 2000, 64, 64


@dataclass(frozen=True)
class Unit:
    """What windows consist of."""

    of_words: bool
    gram: int  # symbols of an anchor; a power of two
    slice: int  # bytes of text read at once
    across: bool  # whether only what another document holds is a repeat

    def symbols(self, raw: np.ndarray, offsets: np.ndarray):
        """A value for each symbol, row offsets in symbols, and first and end byte of each symbol (None if symbols are bytes)."""
        if not self.of_words:
            return _VALUES[raw], offsets, None, None
        h, first, last, row = words(raw, offsets, SPACE_SEPARATORS, lower=False)
        return h, np.searchsorted(row, np.arange(len(offsets))), first, last

    def slices(self, offsets: np.ndarray, length: int):
        """Rows a to b and their bytes lo to hi; a long row comes in several slices if symbols are bytes."""
        for a, b in row_slices(offsets, self.slice):
            lo, hi = int(offsets[a]), int(offsets[b])
            if b - a > 1 or self.of_words or hi - lo <= 2 * self.slice:
                yield a, b, lo, hi
            else:
                for at in range(lo, hi - length + 1, self.slice):
                    yield a, b, at, min(hi, at + self.slice + length - 1)


BYTES, WORDS = Unit(False, 32, 1 << 19, False), Unit(True, 4, 1 << 20, True)

_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    h, size = values, 1
    while size < gram:
        h = h[: len(h) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    return mix(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, x
    while 2 * size <= width:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _prefix_hashes(values: np.ndarray):
    """A function for the hashes of the stretches a to b of values (arrays of bounds)."""
    n = len(values)
    size = max(1 << 21, 1 << n.bit_length()) + 1
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(values * _powers(_BASE, size)[:n], out=prefix[1:])
    inverse = _powers(_INVERSE, size)
    return lambda a, b: mix((prefix[b] - prefix[a]) * inverse[a] + (b - a).astype(np.uint64))


def window_spans(values: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """The spans of windows of a slice: row, first and last window start in the row, key and digest of each."""
    none = np.zeros(0, np.int64)
    n = len(values)
    if n < length:
        return none, none, none, none, none
    grams = length - gram + 1
    order = (_gram_hashes(values, gram) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - gram + 1, dtype=np.uint64)
    anchor = (_sliding_min(order, grams) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # for each window start
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[: n - length + 1]
    valid = np.arange(n - length + 1) + length <= offsets[row + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none, none
    heads = np.flatnonzero((new | np.concatenate(([True], ~valid[:-1])))[at])
    lo, hi = at[heads], at[np.append(heads[1:], len(at)) - 1]
    p = anchor[lo]
    hashed = _prefix_hashes(values)
    step = -(-grams // _CLASSES)
    out = []
    for j in range(_CLASSES):
        first = p - (grams - 1) + j * step
        a, b = np.maximum(lo, first), np.minimum(hi, first + step - 1)
        some = np.flatnonzero(a <= b)
        a, b, q = a[some], b[some], p[some]
        key = mix(hashed(np.minimum(q, q - (grams - 1) + (j + 1) * step - 1), q + gram + j * step) + np.uint64(j))
        out.append((row[a], a - offsets[row[a]], b - offsets[row[a]], as_signed(key), as_signed(hashed(a, b + length))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _emit_spans(length: int, unit: Unit, hot: np.ndarray):
    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            for a, b, lo, hi in unit.slices(offsets, length):
                values, at, _, _ = unit.symbols(raw[lo:hi], np.clip(offsets[a : b + 1], lo, hi) - lo)
                row, first, last, key, digest = window_spans(values, at, length, unit.gram)
                base = lo - int(offsets[a])  # of a slice within a long row
                if len(row):
                    who = doc[a:b][row]
                    salt = np.where(np.isin(key, hot), (mix((who ^ first).view(np.uint64)) % np.uint64(_SALTS)).astype(np.int8), np.int8(-1))
                    yield pa.RecordBatch.from_pydict({"key": key, "salt": salt, "doc": who, "first": first + base, "last": last + base, "digest": digest})

    return run


def _cut_bytes(length: int, unit: Unit):
    """For mapInArrow over documents with their wanted spans: the bytes of each span (of words: their hashes)."""
    kind, width = ("<u8", 8) if unit.of_words else (np.uint8, 1)

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            spans = batch.column("spans")
            counts = np.diff(spans.offsets.to_numpy()).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(counts)))
            flat = spans.flatten()
            for a, b in row_slices(offsets, unit.slice):
                values, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if unit.of_words:
                    values, at, _, _ = unit.symbols(values, at)
                data = values.astype(kind, copy=False).tobytes()
                rows = np.repeat(np.arange(a, b), counts[a:b])
                for i in range(int(ends[a]), int(ends[b]), 4096):
                    s = slice(i, min(i + 4096, int(ends[b])))
                    keys, first, last, alone, shard = (flat.field(x)[s].to_numpy(zero_copy_only=False) for x in ("key", "first", "last", "alone", "shard"))
                    row = rows[s.start - ends[a] : s.stop - ends[a]]
                    base = at[row - a]
                    pieces = [data[x:y] for x, y in zip((width * (base + first)).tolist(), (width * (base + last + length)).tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"key": keys, "shard": shard, "doc": docs[row], "first": first, "alone": alone, "bytes": pa.array(pieces, pa.binary())})

    return run


def repeated_windows(pieces: list[np.ndarray], length: int = LENGTH, docs: np.ndarray | None = None) -> list[np.ndarray]:
    """For each piece (whole numbers from 0), which of its windows occur more than once among all windows of all pieces.

    With docs, a number for each piece, only windows that occur in pieces of two numbers count."""
    if len(pieces) == 1 and (docs is not None or len(pieces[0]) < length + 1):
        return [np.zeros(max(0, len(pieces[0]) - length + 1), bool)]
    sizes = np.array([len(p) for p in pieces])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    text = np.zeros(starts[-1], np.int64)  # a 0 at the end of each piece; a window within a piece never holds one
    for s, p in zip(starts[:-1].tolist(), pieces, strict=True):
        text[s : s + len(p)] = p.astype(np.int64) + 1
    sa = suffix_array(text)
    equal = common_prefixes(text, sa, length) >= length
    marked = np.zeros(len(text), bool)
    if docs is None:
        marked[sa[equal]] = True
        marked[sa[:-1][equal[1:]]] = True
    else:
        owner = np.repeat(docs, sizes + 1)[sa]
        heads = np.flatnonzero(~equal)  # where runs of equal windows begin
        several = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
        marked[sa] = np.repeat(several, np.diff(np.append(heads, len(sa))))
    return [marked[s : s + max(0, n - length + 1)] for s, n in zip(starts[:-1].tolist(), sizes.tolist(), strict=True)]


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
    return edge[::2], edge[1::2] - 1


_MARKS = "doc long, first long, last long, window long"


def _mark_shards(length: int, unit: Unit):
    """For mapInArrow over bytes sorted by key and shard: runs of repeated windows; of split keys, each further window with its hash."""

    def emit(rows):
        kind = "<u8" if unit.of_words else np.uint8
        values = [np.frombuffer(r[5], kind) for r in rows]
        pieces, docs = values, None
        if unit.of_words:
            dense = np.unique(np.concatenate(values), return_inverse=True)[1]
            pieces = np.split(dense, np.cumsum([len(v) for v in values])[:-1])
        if unit.across:  # one that stands for several documents counts as another than each of them
            docs = np.unique(np.array([r[2] for r in rows], np.int64), return_inverse=True)[1]
            docs = np.where([r[4] for r in rows], docs, len(rows) + np.arange(len(rows)))
        marks = repeated_windows(pieces, length, docs)
        doc, first, last, window = [], [], [], []
        for (_, shard, d, at, alone, _), v, m in zip(rows, values, marks, strict=True):
            if alone:
                a, b = _runs(m)
                doc += [d] * len(a)
                first += (a + at).tolist()
                last += (b + at).tolist()
                window += [None] * len(a)
            if shard >= 0:
                # Windows without a document are there for others to find: they are repeats already.
                i = np.arange(len(m))
                doc += [d if alone and not x else None for x in m.tolist()]
                first += (i + at).tolist()
                last += (i + at).tolist()
                window += as_signed(_prefix_hashes(v if unit.of_words else _VALUES[v])(i, i + length)).tolist()
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(window, pa.int64())], names=["doc", "first", "last", "window"])

    def run(batches):
        rows, size, now = [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "shard", "doc", "first", "alone", "bytes")), strict=True):
                if r[:2] != now:
                    if size >= SHARD_BYTES:
                        yield emit(rows)
                        rows, size = [], 0
                    now = r[:2]
                rows.append(r)
                size += len(r[5])
        if rows:
            yield emit(rows)

    return run


def _merge_shards(across: bool):
    """For mapInArrow over windows sorted by hash: those whose hash is there again, found by binary search in the order.

    Across documents, those that another document or a window without one has."""

    def run(batches):
        held, sure = None, None  # undecided windows of the last hash; the last hash if all of its windows are repeats
        for batch in batches:
            if not batch.num_rows:
                continue
            w, first = batch.column("window").to_numpy(), batch.column("first").to_numpy()
            nobody = batch.column("doc").is_null().to_numpy(zero_copy_only=False)
            doc = batch.column("doc").fill_null(0).to_numpy()
            if held is not None and held[0][0] == w[0]:
                w, doc, first, nobody = (np.concatenate(x) for x in zip(held, (w, doc, first, nobody), strict=True))
            heads = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            size = np.diff(np.append(heads, len(w)))
            many = size > 1
            if across:
                many &= np.logical_or.reduceat(nobody, heads) | (np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads))
            many[0] |= sure == w[0]
            told = np.repeat(many, size) & ~nobody
            at = pa.array(first[told])
            yield pa.RecordBatch.from_arrays([pa.array(doc[told]), at, at], names=["doc", "first", "last"])
            tail = slice(heads[-1], len(w))
            held, sure = (None, w[-1]) if many[-1] else ((w[tail], doc[tail], first[tail], nobody[tail]), None)

    return run


def _with_key(docs: DataFrame, name: str) -> DataFrame:
    return docs.withColumn(name, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.coalesce("text", F.lit(""))))


def _hot_keys(keyed: DataFrame, length: int, unit: Unit) -> np.ndarray:
    """Keys that so many spans of a sample of documents have that they would be a task's main work."""
    none = np.zeros(0, np.int64)
    found = (
        keyed.where(F.pmod("doc", F.lit(_SAMPLED)) == 0)
        .transform(map_arrow, _emit_spans(length, unit, none), _SPANS)
        .groupBy("key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") * _SAMPLED >= HOT_SPANS)
        .orderBy(F.desc("n"), "key")
        .limit(MOST_HOT)
        .toArrow()
    )
    return np.sort(found.column("key").to_numpy()) if len(found) else none


_SPANS = "key long, salt byte, doc long, first long, last long, digest long"


def _met(spans: DataFrame, unit: Unit) -> DataFrame:
    """Spans with lead (one of each digest), alike (whether its digest is a repeat as a whole) and kinds (digests of its key).

    Spans whose key nothing else has are left out. Of hot keys each task counts its own part, and parts are summed."""
    by_key, by_span = W.partitionBy("key", "salt"), W.partitionBy("key", "salt", "digest")
    differ = F.min("digest").over(by_key) != F.max("digest").over(by_key)
    numbered = spans.withColumn("lead", F.row_number().over(by_span.orderBy("doc", "first")) == 1).withColumn("equal", F.count("*").over(by_span))
    alike = F.min("doc").over(by_span) != F.max("doc").over(by_span) if unit.across else F.col("equal") > 1
    return (
        numbered.withColumns({"differ": differ, "alike": alike})
        .where((F.col("salt") >= 0) | F.col("differ") | (F.col("equal") > 1))
        .withColumn("kinds", F.sum(F.col("lead").cast("int")).over(by_key))
        .select("key", "salt", "digest", "doc", "first", "last", "lead", "alike", "kinds")
    )


def _hot_met(hot: DataFrame, unit: Unit) -> DataFrame:
    """The same columns for spans of hot keys, whatever task they lie in: digests are counted in parts first.

    hot: of what a task found alike one span each, and all other spans; the rest are known to be repeats."""
    place = F.struct("doc", "first")
    repeated = F.min("doc") != F.max("doc") if unit.across else F.count("*") > 1
    digests = materialize(hot.groupBy("key", "digest").agg(F.min(place).alias("_lead"), (F.bool_or("alike") | repeated).alias("alike")), "hot")
    kinds = digests.groupBy("key").agg(F.count("*").alias("kinds"))
    known = digests.join(kinds, "key")
    return hot.drop("lead", "alike", "kinds").join(known, ["key", "digest"]).withColumn("lead", F.col("_lead") == place).select("key", "salt", "digest", "doc", "first", "last", "lead", "alike", "kinds")


def repeated_spans(docs: DataFrame, length: int = LENGTH, unit: Unit = BYTES) -> DataFrame:
    """doc (a hash of doc_id and text), first, last: runs of window starts that are repeats."""
    keyed = _with_key(docs.select("doc_id", "text"), "doc").select("doc", "text")
    n = partitions(docs.sparkSession)
    hot = _hot_keys(keyed, length, unit)
    spans = keyed.transform(map_arrow, _emit_spans(length, unit, hot), _SPANS).repartition(n, "key", "salt")
    spans = materialize(_met(spans, unit), "spans")
    whole = spans.where("alike").select("doc", "first", "last")
    if len(hot):
        told = F.col("alike") & ~F.col("lead")
        spans = spans.where("salt < 0").unionByName(_hot_met(spans.where((F.col("salt") >= 0) & ~told), unit))
        whole = whole.unionAll(spans.where("salt >= 0 and alike").select("doc", "first", "last"))
    # Across documents, equal spans of one document are each held against the others.
    shards = F.ceil(F.col("kinds") / F.lit(SHARD_SPANS)).cast("int")
    wanted = spans.where((F.col("kinds") > 1) & (F.col("lead") | ~F.col("alike"))).withColumn(
        "shard", F.when(shards > 1, F.pmod(F.xxhash64("doc", "first"), shards).cast("int")).otherwise(-1)
    )
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "first", "last", (~F.col("alike")).alias("alone"), "shard")).alias("spans"))
    # Rows equal in doc_id and text have the same spans; one of them gives the bytes of them all.
    pieces = (
        keyed.join(per_doc, "doc")
        .transform(map_arrow, _cut_bytes(length, unit), "key long, shard int, doc long, first long, alone boolean, bytes binary")
        .repartition(n, "key", "shard")
        .sortWithinPartitions("key", "shard")
    )
    marks = materialize(pieces.transform(map_arrow, _mark_shards(length, unit), _MARKS), "marks")
    inside = marks.where(F.col("window").isNull()).select("doc", "first", "last")
    across = (
        marks.where(F.col("window").isNotNull())
        .repartition(n, "window")
        .sortWithinPartitions("window")
        .transform(map_arrow, _merge_shards(unit.across), "doc long, first long, last long")
    )
    return whole.unionAll(inside).unionAll(across)


def _covered(n: int, found: list[dict], length: int) -> np.ndarray:
    """Which of n symbols the windows of these runs cover."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, [x["first"] for x in found], 1)
    np.add.at(delta, [x["last"] + length for x in found], -1)
    return np.cumsum(delta[:-1]) > 0


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(length: int, unit: Unit, runs: str, drop: tuple[str, ...]):
    """For mapInArrow over rows with their runs: kept, n_bytes, n_removed and spans, in bytes also where windows are words."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            kept, n_bytes, n_removed, spans = [], np.diff(offsets), np.zeros(batch.num_rows, np.int64), []
            for i, found in enumerate(batch.column(runs).to_pylist()):
                data = raw[offsets[i] : offsets[i + 1]]
                if not found:
                    kept.append(data.tobytes())
                    spans.append([])
                    continue
                if unit.of_words:
                    _, at, first, last = unit.symbols(data, np.array([0, len(data)]))
                    a, b = _runs(_covered(int(at[-1]), found, length))
                    a, b = first[a], last[b]
                    gone = np.zeros(len(data), bool)
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        gone[x:y] = True
                else:
                    gone = _covered(len(data), found, length)
                    a, b = _runs(gone)
                    b = b + 1
                kept.append(data[~gone].tobytes())
                n_removed[i] = gone.sum()
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
            keep = [k for k, c in enumerate(batch.schema.names) if c not in drop]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(kept, pa.binary()), pa.array(n_bytes), pa.array(n_removed), pa.array(spans, _SPAN)],
                names=[*(batch.schema.names[k] for k in keep), "kept", "n_bytes", "n_removed", "spans"],
            )

    return run


def _runs_of(docs: DataFrame, length: int, unit: Unit, key: str, runs: str) -> DataFrame:
    """key and runs of each document with repeats; a document's runs are no more than its windows."""
    return repeated_spans(docs, length, unit).groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("first", "last")).alias(runs))


def _covered_words(runs: str, length: int):
    """How many words runs cover: taken in order, each adds what lies beyond those before it."""
    ordered = F.sort_array(F.coalesce(F.col(runs), F.array().cast("array<struct<first:bigint,last:bigint>>")))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), x["last"] + length - F.greatest(x["first"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["last"] + length).alias("end")
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(ordered, start, step, lambda acc: acc["n"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, unit: Unit = BYTES, passage_words: int | None = None) -> DataFrame:
    """docs' columns with kept (binary), n_bytes, n_removed and spans (removed byte ranges).

    With passage_words also n_passage_words: how many words lie in passages of so many words or more that another document holds too."""
    docs = docs.drop("kept", "n_bytes", "n_removed", "spans", *(["n_passage_words"] if passage_words else []))
    key, runs, passages = (free_name(docs, x) for x in ("doc", "runs", "passages"))
    found = _with_key(docs, key).join(_runs_of(docs, length, unit, key, runs), key, "left")
    kept = [*docs.schema.fields]
    if passage_words:
        words_in = _covered_words(passages, passage_words)
        found = found.join(_runs_of(docs, passage_words, WORDS, key, passages), key, "left").withColumn("n_passage_words", words_in).drop(passages)
        kept.append(T.StructField("n_passage_words", T.LongType()))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*kept, T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span)])
    return found.select(*(f.name for f in kept), key, runs).transform(map_arrow, _cut(length, unit, runs, (key, runs)), schema)


def remove_passages(docs: DataFrame, length: int = PASSAGE_WORDS) -> DataFrame:
    """As remove_repeats, of passages of `length` words or more that another document holds too; kept is whole words."""
    return remove_repeats(docs, length, WORDS)
