"""Masked pseudo-likelihood: a bidirectional window network in numpy predicts every word from the words on both sides.

The network's vocabulary has the most frequent words of the corpus and hash buckets for all others. A word's probability given
two words before and two after it is that of its class times that of the word in its class (a factored softmax over 32 classes of 32);
for a word in a bucket, times the word's share of the bucket in the counts of the whole corpus. So every word itself is predicted.
Counts of words outside the vocabulary are as many as the corpus has words; they stay in a table that distinct texts are joined with.
Training goes over every document once: in a first round on one document of eight and in a second on the rest, each
partition trains its own copy by gradient descent from the round's common start, and the copies are averaged by the words they saw.
A document's score is the sum of its words' conditional log-probabilities.

The weights depend on how the scan is cut into partitions, since each trains a copy: other files, or another size of partitions, give
other scores of the same corpus. With the same partitions they are the same.

Defined results: null and empty texts have 0 tokens, log_likelihood 0 and mean_log_likelihood null. Repeated rows are scored
alike. An empty table gives an empty result. Further columns pass through; those of the three names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, row_slices, text_buffer
from .words import ALNUM_SEPARATORS, as_signed, mix, words

CLASSES, PER_CLASS = 32, 32
VOCABULARY = CLASSES * PER_CLASS
BUCKETS = 224  # ids for words out of the vocabulary
_DIM, _HIDDEN, _CONTEXT = 16, 32, (-2, -1, 1, 2)
_BATCH, _STEP, _SLICE = 8192, 2048, 1 << 20
_EDGE = VOCABULARY  # what stands beyond a text's ends


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted
    ids: np.ndarray

    def encode(self, h: np.ndarray) -> np.ndarray:
        out = VOCABULARY - BUCKETS + (mix(h) % np.uint64(BUCKETS)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            out[known] = self.ids[at[known]]
        return out


def shapes() -> list[tuple[int, ...]]:
    return [(VOCABULARY + 1, _DIM), (len(_CONTEXT) * _DIM, _HIDDEN), (_HIDDEN,), (_HIDDEN, CLASSES), (CLASSES,), (CLASSES, _HIDDEN, PER_CLASS), (CLASSES, PER_CLASS)]


def initial(seed: int = 5) -> np.ndarray:
    r = np.random.default_rng(seed)
    parts = [r.normal(0, 1 / np.sqrt(s[-2]) if len(s) > 1 and s[0] != VOCABULARY + 1 else 0.3, s) if len(s) > 1 else np.zeros(s) for s in shapes()]
    parts[-1] = np.zeros(shapes()[-1])
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes():
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def contexts(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The ids at the places around each word; _EDGE beyond its text."""
    out = np.full((len(ids), len(_CONTEXT)), _EDGE, np.int64)
    for k, d in enumerate(_CONTEXT):
        a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
        if len(ids) > abs(d):
            out[a, k] = np.where(row[a] == row[b], ids[b], _EDGE)
    return out


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shifts x in place to a largest value of 0 by row; gives the exponentials and their sums."""
    x -= x.max(axis=1, keepdims=True)
    e = np.exp(x)
    return e, e.sum(axis=1)


def _by_id(ids: np.ndarray) -> np.ndarray:
    return np.argsort(ids.astype(np.int16), kind="stable")  # small integers sort by radix


def _in_blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b by products of 64 rows each: a row's result in 32 bits else depends on how many rows are with it."""
    blocks = np.zeros((-(-len(a) // 64) * 64, a.shape[1]), a.dtype)
    blocks[: len(a)] = a
    return np.matmul(blocks.reshape(-1, 64, a.shape[1]), b).reshape(-1, b.shape[1])[: len(a)]


def _forward(p: list[np.ndarray], around: np.ndarray, y: np.ndarray, product=np.matmul):
    """Inputs, hidden values, class and word logits, and where classes begin; words must be in order of id."""
    e, w1, b1, wc, bc, ww, bw = p
    x = e[around].reshape(len(y), -1)
    h = np.tanh(product(x, w1) + b1)
    bounds = np.searchsorted(y, np.arange(CLASSES + 1) * PER_CLASS)
    z = np.empty((len(y), PER_CLASS), np.float32)
    for g in range(CLASSES):
        a, b = bounds[g], bounds[g + 1]
        if a < b:
            z[a:b] = product(h[a:b], ww[g])
            z[a:b] += bw[g]
    return x, h, product(h, wc) + bc, z, bounds


def log_probabilities(flat: np.ndarray, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Each word's log-probability given both sides."""
    p, around = unpack(flat), contexts(ids, row)
    out = np.empty(len(ids))
    for i in range(0, len(ids), _BATCH):
        y = ids[i : i + _BATCH]
        order = _by_id(y)
        y = y[order]
        _, _, c, z, _ = _forward(p, around[i : i + _BATCH][order], y, _in_blocks)
        n = np.arange(len(y))
        _, cs = _softmax(c)
        _, zs = _softmax(z)
        out[i + order] = c[n, y // PER_CLASS] + z[n, y % PER_CLASS] - np.log(cs) - np.log(zs)
    return out


def train_step(p: list[np.ndarray], around: np.ndarray, y: np.ndarray, rate: float) -> None:
    """One step of gradient descent on the mean log-loss, in place."""
    e, w1, b1, wc, bc, ww, bw = p
    order = _by_id(y)
    around, y = around[order], y[order]
    x, h, c, z, bounds = _forward(p, around, y)
    n, each = np.arange(len(y)), np.float32(rate / len(y))
    dc, sums = _softmax(c)
    dc /= sums[:, None]
    dw, sums = _softmax(z)
    dw /= sums[:, None]
    dc[n, y // PER_CLASS] -= 1
    dw[n, y % PER_CLASS] -= 1
    dh = dc @ wc.T
    for g in range(CLASSES):
        a, b = bounds[g], bounds[g + 1]
        if a < b:
            dh[a:b] += dw[a:b] @ ww[g].T
            ww[g] -= each * (h[a:b].T @ dw[a:b]) * CLASSES**0.5
            bw[g] -= each * dw[a:b].sum(axis=0) * CLASSES**0.5
    wc -= each * (h.T @ dc)
    bc -= each * dc.sum(axis=0)
    dz = dh * (1 - h * h)
    dx = (dz @ w1.T).reshape(-1, _DIM)
    w1 -= each * (x.T @ dz)
    b1 -= each * dz.sum(axis=0)
    # Gradients of equal words are summed by a sorted pass.
    flat = around.ravel()
    at = _by_id(flat)
    heads = np.flatnonzero(np.diff(flat[at], prepend=-1))
    e[flat[at][heads]] -= each * np.add.reduceat(dx[at], heads, axis=0) * 8


def _texts(batch, vocabulary: Vocabulary):
    raw, offsets = text_buffer(batch.column("text"))
    for a, b in row_slices(offsets, _SLICE):
        h, _, _, row = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM_SEPARATORS)
        yield a, b, vocabulary.encode(h), row


def count_words(docs: DataFrame) -> DataFrame:
    """w (a word's hash) and n for every word of the corpus."""

    def count(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            for a, b in row_slices(offsets, 2 * _SLICE):
                h, _, _, _ = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM_SEPARATORS)
                v, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_pydict({"w": as_signed(v), "n": n})

    return docs.select("text").transform(map_arrow, count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame) -> Vocabulary:
    top = counts.orderBy(F.desc("n"), "w").limit(VOCABULARY - BUCKETS).toPandas()
    h = top["w"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(h[order], np.arange(len(h))[order])


def build_vocabulary(docs: DataFrame) -> Vocabulary:
    """The words most frequent over all documents; classes are runs of the order by frequency."""
    return _most_frequent(count_words(docs))


def word_shares(counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """w and log_share of each word out of the vocabulary: the logarithm of its part of its bucket's tokens."""

    def place(batches):
        for batch in batches:
            ids = vocabulary.encode(batch.column("w").to_numpy(zero_copy_only=False).view(np.uint64))
            rare = pa.array(ids >= VOCABULARY - BUCKETS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], names=["w", "n", "bucket"]).filter(rare)

    placed = counts.select("w", "n").transform(map_arrow, place, "w long, n long, bucket long")
    totals = placed.groupBy("bucket").agg(F.sum("n").alias("total"))
    return placed.join(F.broadcast(totals), "bucket").select("w", F.log(F.col("n") / F.col("total")).alias("log_share"))


def rare_log_likelihood(docs: DataFrame, vocabulary: Vocabulary, shares: DataFrame) -> DataFrame:
    """_text (hash of a text) and rare: the sum of log_share over the text's words out of the vocabulary; of distinct texts."""

    def bags(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            key = batch.column("_text").to_numpy(zero_copy_only=False)
            for a, b in row_slices(offsets, _SLICE):
                h, _, _, row = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM_SEPARATORS)
                rare = vocabulary.encode(h) >= VOCABULARY - BUCKETS
                h, row = h[rare], row[rare]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                heads = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.append(heads, len(h)))
                yield pa.RecordBatch.from_pydict({"_text": key[a:b][row[heads]], "w": as_signed(h[heads]), "times": times.astype(np.int64)})

    texts = docs.select("text").where(F.col("text") != "").distinct().withColumn("_text", F.xxhash64("text"))
    found = texts.transform(map_arrow, bags, "_text long, w long, times long").join(shares, "w")
    return found.groupBy("_text").agg(F.sum(F.col("times") * F.col("log_share")).alias("rare"))


def train(docs: DataFrame, vocabulary: Vocabulary, rate: float = 1.0, seed: int = 5) -> np.ndarray:
    """Weights after two rounds of local training and averaging over all documents."""
    spark = docs.sparkSession
    flat = initial(seed)
    known = spark.sparkContext.broadcast(vocabulary)
    first = F.pmod(F.xxhash64("text"), F.lit(8)) == 0
    for part in (docs.where(first), docs.where(~first | F.col("text").isNull())):
        start = spark.sparkContext.broadcast(flat)

        def local(batches, start=start):
            mine = start.value.copy()
            p, seen, step = unpack(mine), 0, 0
            for batch in batches:
                for _, _, ids, row in _texts(batch, known.value):
                    around = contexts(ids, row)
                    for i in range(0, len(ids), _STEP):
                        train_step(p, around[i : i + _STEP], ids[i : i + _STEP], rate / (1 + step / 1000) ** 0.5)
                        step += 1
                    seen += len(ids)
            if seen:
                yield pa.RecordBatch.from_pydict({"i": np.arange(len(mine)), "v": mine.astype(float) * seen, "n": np.full(len(mine), float(seen))})

        mean = part.select("text").transform(map_arrow, local, "i long, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).orderBy("i").toPandas()
        if len(mean):
            flat = mean["v"].to_numpy(np.float32)
        start.unpersist()
    return flat


def score_documents(docs: DataFrame, rate: float = 1.0, seed: int = 5) -> DataFrame:
    """docs' columns with n_tokens, log_likelihood and mean_log_likelihood."""
    docs = docs.drop("n_tokens", "log_likelihood", "mean_log_likelihood")
    counts = materialize(count_words(docs), "words")
    vocabulary = _most_frequent(counts)
    model = docs.sparkSession.sparkContext.broadcast((vocabulary, train(docs, vocabulary, rate, seed)))
    rare = rare_log_likelihood(docs, vocabulary, word_shares(counts, vocabulary))

    def score(batches):
        vocabulary, flat = model.value
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b, ids, row in _texts(batch, vocabulary):
                if len(ids):
                    n[a:b] = np.bincount(row, minlength=b - a)
                    total[a:b] = np.bincount(row, log_probabilities(flat, ids, row), b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(total)], names=[*batch.schema.names, "n_tokens", "log_likelihood"])

    keyed = docs.withColumn("_text", F.xxhash64("text"))
    schema = T.StructType([*keyed.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType())])
    total = F.col("log_likelihood") + F.coalesce("rare", F.lit(0.0))
    return (
        keyed.transform(map_arrow, score, schema)
        .join(rare, "_text", "left")
        .withColumn("log_likelihood", total)
        .withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
        .drop("_text", "rare")
    )
