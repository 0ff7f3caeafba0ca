"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents. Its words become symbols: 0 ends the text, 1 stands for everything that no test phrase
can cross (a document's end, or words that no test phrase has), the rest are the words of the test phrases. Runs of such words
too short for any phrase are left out, since no occurrence fits in them. The shard's suffix array gives the
Burrows-Wheeler transform, kept as a wavelet matrix; all phrases are searched backwards at once by its ranks, and occurrences
are located by walking to the nearest sampled suffix. Hits of all phrases are merged into spans of words to remove.

Defined results: null and empty texts have no words and no hits. A test item without words has no phrase. Items
which repeat an item_id count as one item with the phrases of all; a null item_id is named by the empty string. Empty tables
give no hits. Repeated documents get equal results.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, map_arrow, row_slices, text_buffer
from .suffix import suffix_array
from .words import ALNUM_SEPARATORS, words

WIDTH = 10
#: Bytes of test texts that one pass over the documents takes along; more are searched in further passes.
PASS_BYTES = 8 << 20
_SHARD = 2 << 20
_SAMPLE = 16


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with counts for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        current = symbols
        for level in range(bits - 1, -1, -1):
            bit = (current >> level) & 1
            ones = np.zeros(len(current) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(current) - int(ones[-1]))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place `end`."""
        start, end = np.zeros_like(end), end.copy()
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            s, e = self.ones[k][start], self.ones[k][end]
            start = np.where(one, self.zeros[k] + s, start - s)
            end = np.where(one, self.zeros[k] + e, end - e)
        return end - start


class FMIndex:
    """Backward search and location over a sequence of symbols of which the last is 0 and no other is."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        self.tree = WaveletMatrix(self.bwt, max(1, (n_symbols - 1).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))
        self.sampled = sa % _SAMPLE == 0
        self.place = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one rows of the suffixes which begin with each phrase (rows of equal length)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), len(self.bwt), np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffix rows."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            there = self.sampled[rows[live]]
            done = live[there]
            out[done] = self.samples[self.place[rows[done]]] + steps
            live = live[~there]
            c = self.bwt[rows[live]]
            rows[live] = self.before[c] + self.tree.rank(c, rows[live])
            steps += 1
        return out


@dataclass
class Phrases:
    """Test phrases of some items as symbols from 2 on, by length, with the items that hold each."""

    vocabulary: np.ndarray  # sorted hashes; symbol = index + 2
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]  # length: phrases, their ids
    holders: tuple[np.ndarray, np.ndarray]  # CSR: phrase id -> items
    names: list[str]


def build_phrases(items: list[tuple[object, str | None]], width: int = WIDTH) -> Phrases | None:
    names = sorted({"" if i is None else str(i) for i, _ in items})
    number = {x: k for k, x in enumerate(names)}
    column = pa.array([t for _, t in items], pa.string())
    raw, offsets = text_buffer(column)
    h, _, _, row = words(raw, offsets, ALNUM_SEPARATORS)
    if not len(h):
        return None
    vocabulary, symbol = np.unique(h, return_inverse=True)
    counts = np.bincount(row, minlength=len(items))
    starts = np.concatenate(([0], np.cumsum(counts)))
    found: dict[tuple[int, ...], set[int]] = {}
    for r, (i, _) in enumerate(items):
        s = symbol[starts[r] : starts[r + 1]] + 2
        size = min(width, len(s))
        for k in range(len(s) - size + 1 if size else 0):
            found.setdefault(tuple(s[k : k + size].tolist()), set()).add(number["" if i is None else str(i)])
    phrases = sorted(found)
    by_length = {}
    for size in sorted({len(p) for p in phrases}):
        ids = [k for k, p in enumerate(phrases) if len(p) == size]
        by_length[size] = (np.array([phrases[k] for k in ids], np.int64), np.array(ids, np.int64))
    held = [sorted(found[p]) for p in phrases]
    return Phrases(
        vocabulary, by_length, (np.concatenate(([0], np.cumsum([len(x) for x in held]))), np.array([i for x in held for i in x], np.int64)), names
    )


def find_phrases(raw: np.ndarray, offsets: np.ndarray, p: Phrases):
    """Hits in a shard: hit flag, first byte, end byte and row of each word, and the distinct (row, item) pairs."""
    h, first, last, row = words(raw, offsets, ALNUM_SEPARATORS)
    hit = np.zeros(len(h), bool)
    none = np.zeros((0, 2), np.int64)
    if not len(h):
        return hit, first, last, row, none
    at = np.minimum(np.searchsorted(p.vocabulary, h), len(p.vocabulary) - 1)
    known = p.vocabulary[at] == h
    # Runs of known words within a document, at least as long as the shortest phrase.
    begins = known.copy()
    begins[1:] &= ~known[:-1] | (row[1:] != row[:-1])
    ends = known.copy()
    ends[:-1] &= ~known[1:] | (row[1:] != row[:-1])
    run_from, run_to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    keep = run_to - run_from >= min(p.by_length)
    run_from, run_to = run_from[keep], run_to[keep]
    if not len(run_from):
        return hit, first, last, row, none
    size = run_to - run_from
    start = np.concatenate(([0], np.cumsum(size + 1)))  # of each run in the text, with a 1 after each
    text = np.ones(start[-1] + 1, np.int64)
    text[-1] = 0
    source = np.full(len(text), -1, np.int64)  # the word at each place
    place = np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)
    word = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(run_from, size)
    text[place] = at[word] + 2
    source[place] = word
    index = FMIndex(text, len(p.vocabulary) + 2)
    delta = np.zeros(len(h) + 1, np.int64)
    rows, items = [], []
    offsets_of, members = p.holders
    for length, (phrases, ids) in p.by_length.items():
        lo, hi = index.search(phrases)
        n = hi - lo
        got = np.flatnonzero(n)
        if not len(got):
            continue
        n = n[got]
        suffixes = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[got], n)
        w = source[index.locate(suffixes)]
        np.add.at(delta, w, 1)
        np.add.at(delta, w + length, -1)
        pair = np.unique(np.stack([row[w], np.repeat(ids[got], n)], axis=1), axis=0)
        many = offsets_of[pair[:, 1] + 1] - offsets_of[pair[:, 1]]
        i = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(offsets_of[pair[:, 1]], many)
        rows.append(np.repeat(pair[:, 0], many))
        items.append(members[i])
    hit = np.cumsum(delta[:-1]) > 0
    pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)], axis=1), axis=0) if rows else none
    return hit, first, last, row, pairs


_FOUND = "n_words long, hits array<struct<word:long,n_words:long,first:long,last:long>>, items array<string>"


def _search(phrases):
    """For mapInArrow: each row with n_words, merged hits (first word, words, first byte, end byte) and items."""

    def run(batches):
        p = phrases.value
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            n_words = np.zeros(batch.num_rows, np.int64)
            hits = [[] for _ in range(batch.num_rows)]
            items = [[] for _ in range(batch.num_rows)]
            for a, b in row_slices(offsets, _SHARD):
                hit, first, last, row, pairs = find_phrases(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], p)
                n_words[a:b] = np.bincount(row, minlength=b - a)
                if not hit.any():
                    continue
                starts = np.concatenate(([0], np.cumsum(n_words[a:b])))
                new = hit.copy()
                new[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
                end = hit.copy()
                end[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
                for s, e in zip(np.flatnonzero(new).tolist(), np.flatnonzero(end).tolist(), strict=True):
                    r, base = int(row[s]), int(offsets[a + row[s]] - offsets[a])
                    hits[a + r].append({"word": s - int(starts[r]), "n_words": e - s + 1, "first": int(first[s]) - base, "last": int(last[e]) - base})
                for r, i in pairs.tolist():
                    items[a + r].append(p.names[i])
            kinds = pa.list_(pa.struct([("word", pa.int64()), ("n_words", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words), pa.array(hits, kinds), pa.array(items, pa.list_(pa.string()))],
                names=[*batch.schema.names, "n_words", "hits", "items"],
            )

    return run


def _passes(benchmark: DataFrame, width: int) -> list[Phrases]:
    """The phrases of the items, in blocks of at most about PASS_BYTES of text each."""
    items = benchmark.select("item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) * 2 // PASS_BYTES))
    out = []
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(n)) == k)
        found = build_phrases([tuple(r) for r in block.toLocalIterator()], width)
        if found:
            out.append(found)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs' columns with n_words, hits (merged runs of hit words and their bytes in the text) and items (ids, sorted as strings).

    A benchmark beyond PASS_BYTES takes one pass for each block of items; the passes' hits are merged along the row."""
    spark: SparkSession = docs.sparkSession
    docs = docs.drop("n_words", "hits", "items")
    names = docs.columns
    blocks = _passes(benchmark, width)
    empty = Phrases(np.zeros(1, np.uint64), {1 << 40: (np.zeros((0, 1), np.int64), np.zeros(0, np.int64))}, (np.zeros(1, np.int64), np.zeros(0, np.int64)), [])
    out, old_hits, old_items = docs, free_name(docs, "_hits"), free_name(docs, "_items")
    for k, p in enumerate(blocks or [empty]):
        sent = spark.sparkContext.broadcast(p)
        if k:  # what earlier passes found rides along in its own columns
            out = out.withColumnsRenamed({"hits": old_hits, "items": old_items}).drop("n_words")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
        out = out.transform(map_arrow, _search(sent), f"{schema}, {_FOUND}")
        if k:
            out = out.withColumns({"hits": F.expr(_MERGE.replace("_hits", f"`{old_hits}`")), "items": F.array_sort(F.array_union(old_items, "items"))}).drop(old_hits, old_items)
    return out.select(*names, "n_words", "hits", F.array_sort("items").alias("items"))


#: Two lists of runs as one: runs which overlap or touch become one.
_MERGE = """
aggregate(array_sort(concat(_hits, hits)), cast(array() as array<struct<word:long,n_words:long,first:long,last:long>>),
  (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).word + element_at(acc, -1).n_words >= x.word,
    concat(slice(acc, 1, size(acc) - 1), array(named_struct('word', element_at(acc, -1).word,
      'n_words', greatest(element_at(acc, -1).word + element_at(acc, -1).n_words, x.word + x.n_words) - element_at(acc, -1).word,
      'first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, x.last)))),
    concat(acc, array(x))))
"""


def cut_spans(batches):
    """For mapInArrow: text without the bytes of its hits."""
    for batch in batches:
        texts, hits = batch.column("text").to_pylist(), batch.column("hits").to_pylist()
        for i, spans in enumerate(hits):
            if spans:
                data, at, kept = texts[i].encode(), 0, []
                for s in spans:
                    kept.append(data[at : s["first"]])
                    at = s["last"]
                texts[i] = b"".join([*kept, data[at:]]).decode()
        k = batch.schema.get_field_index("text")
        yield batch.set_column(k, "text", pa.array(texts, batch.schema.field(k).type))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without the test phrases in their texts; documents of which no word is left go. n_chars follows the text."""
    names = docs.columns
    found = find_contamination(docs, benchmark, width)
    clean = found.transform(map_arrow, cut_spans, found.schema)
    left = F.col("n_words") - F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["n_words"])
    clean = clean.where((left > 0) | (F.size("hits") == 0))
    if "n_chars" in names:
        clean = clean.withColumn("n_chars", F.when(F.size("hits") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*names)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
