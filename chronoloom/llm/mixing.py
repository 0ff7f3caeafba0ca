"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is weight * total rows / rows of the source. Each document draws a uniform number from a
hash of seed, doc_id and text and inverts the Poisson distribution of that mean: its count is the number of values k whose
distribution function P(X <= k) lies at or below the draw. A mean above MOST_RATE is split into equal parts up to it, each
with a draw of its own; the sum of their counts has the Poisson distribution of the whole mean, however large. Values of k are
looked at up to 12 standard deviations and 25 above the mean; what lies beyond has a probability below a draw's last bit, so no draw reaches it. The document is exploded by its count and the copies are dealt
to partitions and sorted there by a second hash, which is a global shuffle that repeats exactly when tasks are rerun.

Defined results: a null source is the source "" for weights; sources without a weight get an equal share of what the named
weights leave of 1 (nothing if they leave nothing). Null doc_id and text hash as empty. Repeated rows draw equal counts.
An empty table, or a rate of 0, gives no rows. Further columns are passed through whatever their names; columns named copy, n_copies
or mix_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, partitions

#: Sources up to which the table of rates is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 200_000
#: Largest mean of one draw; a larger mean is a sum.
MOST_RATE = 64.0


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) of 48 bits from the MD5 of seed and columns."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def poisson_count(u: Column, rate: Column) -> Column:
    """How many k = 0, 1, ... have P(X <= k) <= u, by the recurrence p(k) = p(k-1) * rate / k."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), (F.exp(-rate) <= u).cast("long").alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), (acc["n"] + (acc["sum"] + p <= u).cast("long")).alias("n"))

    terms = F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("int")
    return F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda acc: acc["n"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """source_key, rate and parts (draws) of each source. size: wanted rows as a multiple of the rows there are."""
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("source_key")).agg(F.count("*").alias("n"))
    totals = counts.agg(
        F.sum("n").alias("total"),
        F.sum(F.when(~F.col("source_key").isin(list(weights or {}) or [""]) if weights else F.lit(True), 1).otherwise(0)).alias("unnamed"),
    )
    left = max(0.0, 1.0 - sum((weights or {}).values()))
    weight = F.lit(left) / F.col("unnamed")
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source_key") == name, F.lit(float(w))).otherwise(weight)
    total = totals.withColumn("_one", F.lit(1))
    rate = weight * F.lit(float(size)) * F.col("total") / F.col("n")
    return (
        counts.withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")  # one row
        .withColumn("rate", rate)
        .withColumn("parts", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rate") / MOST_RATE)))
        .select("source_key", "rate", "parts")
    )


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = 17) -> DataFrame:
    """docs exploded by their Poisson counts, in global random order, with n_copies, copy (from 1) and mix_key."""
    docs = docs.drop("copy", "n_copies", "mix_key")
    rates = source_rates(docs, weights, size)
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)  # three numbers and a name each
    source, rate, text = (free_name(docs, x) for x in ("_source", "_rate", "_text"))
    each, parts = F.col(f"{rate}.rate") / F.col(f"{rate}.parts"), F.col(f"{rate}.parts")
    draw = lambda *more: poisson_count(uniform(seed, F.col("doc_id"), F.col(text), *more), each)
    further = F.aggregate(F.sequence(F.lit(2).cast("long"), parts), F.lit(0).cast("long"), lambda n, k: n + draw(k))
    drawn = (
        docs.withColumn(source, F.coalesce("source", F.lit("")))
        .withColumn(text, F.md5(F.coalesce("text", F.lit(""))))
        .join(rates.select(F.col("source_key").alias(source), F.struct("rate", "parts").alias(rate)), source)
        .withColumn("n_copies", draw() + F.when(parts > 1, further).otherwise(0))
        .drop(source, rate)
        .where(F.col("n_copies") > 0)
    )
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    key = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(text), F.col("copy").cast("string")))
    return copies.withColumn("mix_key", key).drop(text).repartition(partitions(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")
