"""Toxicity by class-conditional Kneser-Ney bigram models.

Two models, one of toxic and one of ordinary texts, each interpolate discounted bigrams (n counts the different words before
a bigram, so that copies of a text count once), discounted continuation counts of
their own class and, for expressions rare in that class, continuation counts shared by both classes:

    P_c(w | v) = max(n_c(v, w) - D, 0) / n_c(v) + lambda_c(v) * P_c(w)
    P_c(w)     = max(N_c(. w) - D, 0) / N_c(. .) + gamma_c * P(w)
    P(w)       = (N(. w) + 1) / (N(. .) + V + 1)           N over both classes

The discount D is `rare`: an expression found so often or less in a class is left to the shared counts, in which
both classes agree, so that chance finds of rare words are no evidence. A text's evidence is the difference of its log-likelihoods, normalised by
length; a logistic curve fitted on labelled rows that took no part in the counts maps it to a score.

Only the fit reads a bounded sample: `per_class` rows of each class for the counts and `calibration` for the curve. Every whole
text is scored.

Defined results: null and empty texts have no evidence and get the score of evidence 0 at length 0. Labels that are null, or on
rows kept from learning, are not read. If a class has no row to learn from, every score is 0. Repeated rows are scored alike. An
empty table gives an empty result. doc_id passes through; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, row_slices, text_buffer
from .words import ALNUM_SEPARATORS, as_signed, mix, words

_SLICE = 1 << 20
_START = np.uint64(0x5DEECE66D)
#: A word's ratio from which it counts as strong evidence.
_STRONG = 1.0


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5; rows of fold 0 are never learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def _previous(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    v = np.empty_like(h)
    v[1:] = h[:-1]
    first = np.ones(len(h), bool)
    first[1:] = row[1:] != row[:-1]
    v[first] = _START
    return v


def _key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0x9FB21C651E98DF25) + w)


@dataclass
class KneserNey:
    """Log-likelihood ratios by bigram, and the two parts that make them for bigrams not seen."""

    bigrams: np.ndarray  # sorted keys
    ratios: np.ndarray
    words: np.ndarray  # sorted hashes
    history: np.ndarray  # log lambda_toxic(v) - log lambda_ordinary(v)
    lower: np.ndarray  # log P_toxic(w) - log P_ordinary(w)
    unseen: float
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0)

    def ratio(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        v = _previous(h, row)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        low = np.where(known, self.lower[at], self.unseen)
        hist = np.where(known, self.history[at], 0.0)
        before = np.zeros_like(hist)
        before[1:] = np.where(row[1:] == row[:-1], hist[:-1], 0.0)
        out = before + low
        # A bigram can only have been seen if both of its words have.
        may = known.copy()
        may[1:] &= known[:-1] | (row[1:] != row[:-1])
        i = np.flatnonzero(may)
        key = _key(v[i], h[i])
        place = np.minimum(np.searchsorted(self.bigrams, key), len(self.bigrams) - 1)
        hit = self.bigrams[place] == key
        out[i[hit]] = self.ratios[place[hit]]
        return out

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed ratio, words and summed positive surprise of each text."""
        raw, offsets = text_buffer(column)
        total, count, strong = (np.zeros(len(offsets) - 1) for _ in range(3))
        for a, b in row_slices(offsets, _SLICE):
            h, _, _, row = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM_SEPARATORS)
            if len(h):
                r = self.ratio(h, row)
                total[a:b] = np.bincount(row, r, b - a)
                strong[a:b] = np.bincount(row, np.maximum(r - _STRONG, 0.0), b - a)
                count[a:b] = np.bincount(row, minlength=b - a)
        return total, count, strong

    def score(self, evidence: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        z = _features(*evidence) @ np.array(self.curve)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _features(total: np.ndarray, count: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """The likelihood ratio normalised by length, and its strong part in two ways."""
    n = np.maximum(count, 1.0)
    return np.stack([np.ones_like(n), 10 * total / n, 10 * strong / n, strong / np.sqrt(n), np.log(n) / 10], axis=1)


def _trigrams(batches):
    """Distinct (u, v, w, toxic) of each slice of a batch; u and v are a mark where the text begins."""
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        toxic = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False)).astype(np.int64)
        for a, b in row_slices(offsets, 2 * _SLICE):
            h, _, _, row = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM_SEPARATORS)
            if not len(h):
                continue
            v = _previous(h, row)
            u = _previous(v, row)
            side = toxic[a:b][row]
            _, at = np.unique(mix(_key(u, v) + h) ^ mix(side.astype(np.uint64)), return_index=True)
            yield pa.RecordBatch.from_pydict({"u": as_signed(u[at]), "v": as_signed(v[at]), "w": as_signed(h[at]), "toxic": side[at].astype(np.int32)})


def _estimate(bigrams: DataFrame, rare: float) -> KneserNey | None:
    """The model from bigrams (v, w, n0, n1), n by class.

    Words and bigrams found `rare` times or less in both classes behave just as unseen ones do, so the driver gets only the rest."""
    word = bigrams.groupBy("w").agg(
        F.count_if(F.col("n0") > 0).alias("f0"), F.count_if(F.col("n1") > 0).alias("f1"), F.count("*").alias("both"), F.max(F.greatest("n0", "n1")).alias("most")
    )
    history = bigrams.groupBy("v").agg(
        *(F.sum(f"n{c}").alias(f"m{c}") for c in (0, 1)), *(F.sum(F.least(F.col(f"n{c}").cast("double"), F.lit(rare))).alias(f"l{c}") for c in (0, 1))
    )
    part = lambda c: F.coalesce(F.sum(F.least(F.col(f"f{c}").cast("double"), F.lit(rare))), F.lit(0.0)).alias(f"r{c}")
    total = word.agg(F.sum("f0").alias("f0"), F.sum("f1").alias("f1"), F.sum("both").alias("both"), F.count("*").alias("size"), part(0), part(1)).first()
    if not total["f0"] or not total["f1"]:
        return None
    own = word.where((F.col("f0") > rare) | (F.col("f1") > rare) | (F.col("most") > rare)).toPandas()
    past = history.where((F.col("m0") > rare) | (F.col("m1") > rare)).toPandas()
    pairs = bigrams.where((F.col("n0") > rare) | (F.col("n1") > rare)).toPandas()
    unsigned = lambda x: x.to_numpy(np.int64).view(np.uint64)
    vocabulary = np.unique(np.concatenate((unsigned(own["w"]), unsigned(past["v"]))))
    if not len(vocabulary):
        vocabulary = np.zeros(1, np.uint64)
    iw, iv = np.searchsorted(vocabulary, unsigned(own["w"])), np.searchsorted(vocabulary, unsigned(past["v"]))
    pv, pw = np.searchsorted(vocabulary, unsigned(pairs["v"])), np.searchsorted(vocabulary, unsigned(pairs["w"]))
    gamma = [total[f"r{c}"] / total[f"f{c}"] for c in (0, 1)]
    unseen = float(np.log(gamma[1]) - np.log(gamma[0]))
    shared = (own["both"].to_numpy(float) + 1.0) / (total["both"] + total["size"] + 1.0)
    lower, hist, seen = [], [], []
    for c in (0, 1):
        low = np.full(len(vocabulary), np.nan)
        low[iw] = np.maximum(own[f"f{c}"].to_numpy(float) - rare, 0) / total[f"f{c}"] + gamma[c] * shared
        mass, lam = np.ones(len(vocabulary)), np.ones(len(vocabulary))
        m = past[f"m{c}"].to_numpy(float)
        mass[iv] = np.maximum(m, 1)
        lam[iv] = np.where(m > 0, past[f"l{c}"].to_numpy(float) / np.maximum(m, 1), 1.0)
        seen.append(np.log(np.maximum(pairs[f"n{c}"].to_numpy(float) - rare, 0) / mass[pv] + lam[pv] * low[pw]))
        lower.append(np.log(low))
        hist.append(np.log(lam))
    key = _key(vocabulary[pv], vocabulary[pw])
    order = np.argsort(key)
    bigram_keys = key[order] if len(key) else np.zeros(1, np.uint64)
    ratios = (seen[1] - seen[0])[order] if len(key) else np.zeros(1)
    low = lower[1] - lower[0]
    return KneserNey(
        bigram_keys, ratios.astype(np.float32), vocabulary, (hist[1] - hist[0]).astype(np.float32), np.where(np.isnan(low), unseen, low).astype(np.float32), unseen
    )


def _fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression by Newton's method, both classes at their own weight."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return tuple(w.tolist())


def _sample(docs: DataFrame, labels: DataFrame, folds: tuple[int, ...], per_class: int) -> DataFrame:
    """text, toxic of at most per_class labelled rows of each class, the first by a hash of their id."""
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & fold(F.col("doc_id")).isin(*folds))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    first = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    # At most 2 * per_class rows of two numbers each.
    return docs.select("doc_id", "text").join(F.broadcast(first[0].unionAll(first[1])), "doc_id").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 6000, calibration: int = 3000, rare: float = 4.0) -> KneserNey | None:
    bigrams = materialize(
        _sample(docs, labels, (1, 2, 3), per_class)
        .transform(map_arrow, _trigrams, "u long, v long, w long, toxic int")
        .groupBy("u", "v", "w", "toxic")
        .count()
        .groupBy("v", "w")
        .agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1")),
        "bigrams",
    )
    model = _estimate(bigrams, rare)
    if model is None:
        return None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for b in batches:
            total, count, strong = sent.value.evidence(b.column("text"))
            yield pa.RecordBatch.from_pydict({"total": total, "n": count, "strong": strong, "toxic": b.column("toxic")})

    seen = _sample(docs, labels, (4,), calibration).transform(map_arrow, measure, "total double, n double, strong double, toxic int").toPandas()
    seen = seen.sort_values(["total", "n", "strong", "toxic"])
    if seen["toxic"].nunique() < 2:
        model.curve = (-1.0, 5.0, 0.0, 0.0, 0.0)
    else:
        model.curve = _fit_curve(_features(seen["total"].to_numpy(), seen["n"].to_numpy(), seen["strong"].to_numpy()), seen["toxic"].to_numpy(float))
    sent.unpersist()
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """docs' columns with score and predicted (1 from 0.5 on); columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    model = train(docs, labels, **fit)
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for b in batches:
            s = sent.value.score(sent.value.evidence(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.transform(map_arrow, score, schema)
