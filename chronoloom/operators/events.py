"""Merging, seeking, filtering and accounting on event DataFrames (columns as in plans.schema, at least the ones named).

A DataFrame has no order; where one matters, ORDER names it in full."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: The total order of events: time, then where they come from.
ORDER = ["ts_ns", "trace_idx", "stream_file", "packet_idx", "event_idx"]
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def mux(*streams: DataFrame, order: list[str] | None = None, sort: bool = True) -> DataFrame:
    """All events of several streams, in time order. Without sort the order is left to what reads it (one stream needs none)."""
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
    return together.orderBy(*(order or ORDER)) if sort and len(streams) >= 1 else together


def seek(events: DataFrame, ns: int | Column) -> DataFrame:
    """Events from a time on. Given to read_trace as begin_ns the same time also leaves out packets that end before."""
    return events.where(F.col("ts_ns") >= ns)


def time_range(events: DataFrame, begin: int = LOWEST, end: int = HIGHEST) -> DataFrame:
    """Events between two times, both included; the full range filters nothing."""
    if begin != LOWEST:
        events = events.where(F.col("ts_ns") >= begin)
    return events.where(F.col("ts_ns") <= end) if end != HIGHEST else events


def first_day(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row, day: the start of the UTC day (ns) of the first event in order."""
    first = F.min_by("ts_ns", F.struct(*(order or ORDER)))
    return events.agg((first - first % X.DAY_NS).alias("day"))


def time_range_of_day(events: DataFrame, begin: int | None = None, end: int | None = None, order: list[str] | None = None) -> DataFrame:
    """A range whose bounds are times of day: of the day of the first event. One small aggregate runs before."""
    day = first_day(events, order).first()["day"]
    if day is None:
        return events
    return time_range(events, LOWEST if begin is None else begin + day, HIGHEST if end is None else end + day)


def seek_in_range(events: DataFrame, ns: int, begin: int = LOWEST, end: int = HIGHEST) -> DataFrame:
    """A seek inside a range: not before its begin; beyond its end nothing is left."""
    return time_range(events, max(ns, begin), end)


def project(events: DataFrame, properties: list[str]) -> DataFrame:
    """Events with some of the six properties; none named are all."""
    from ..sources.decoder import PROPERTIES

    keep = [c for c in events.columns if c not in PROPERTIES or not properties or c in properties]
    return events.select(*keep)


def with_delta(events: DataFrame, order: list[str] | None = None, value: str = "ts_ns", by: list[str] | None = None, out: str = "delta") -> DataFrame:
    """Adds the time since the event before, null for the first.

    Given `by`, the events before are those of the same stream. Over all events a window would run in one task: instead, time is cut
    into ranges, the last event of each range is handed to the next non-empty one, and windows run within ranges."""
    order = order or ORDER
    if by:
        return events.withColumn(out, F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy(*order)))
    cut = _in_ranges(events, order[0])
    last = cut.groupBy("_range").agg(F.max_by(value, F.struct(*order)).alias("_last"))  # a row for each of n ranges
    before = last.withColumn("_before", F.lag("_last").over(W.orderBy("_range"))).select("_range", "_before")
    own = F.lag(value).over(W.partitionBy("_range").orderBy(*order))
    return cut.join(F.broadcast(before), "_range").withColumn(out, F.col(value) - F.coalesce(own, F.col("_before"))).drop("_range", "_before")


def _in_ranges(events: DataFrame, by: str) -> DataFrame:
    """Adds _range: as many stretches of a number as there are shuffle partitions, of equal length."""
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = events.agg(F.min(by).alias("low"), F.max(by).alias("high")).first()
    low, high = (int(x) if x is not None else 0 for x in bounds)
    width = max(1, (high - low) // n + 1)
    return events.withColumn("_range", ((F.col(by) - F.lit(low)).cast("double") / width).cast("int"))


def with_position(events: DataFrame, order: list[str] | None = None, out: str = "position") -> DataFrame:
    """Adds each event's place in the total order, from 1: numbered within ranges of time, each behind all events of those before it."""
    order = order or ORDER
    cut = _in_ranges(events, order[0])
    counts = cut.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return cut.join(F.broadcast(before), "_range").withColumn(out, place.cast("bigint")).drop("_range", "_before")


def packets(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row per packet: events, and first and last time."""
    return events.groupBy(*keys).agg(F.count("*").alias("n_events"), F.min("ts_ns").alias("begin_ns"), F.max("ts_ns").alias("end_ns"))


def packets_from(packet_index: DataFrame, ns: int) -> DataFrame:
    """Packets that a seek to a time has to read."""
    return packet_index.where(F.col("end_ns") >= ns)


def lost_events(packet_index: DataFrame, by: list[str], order: list[str], snapshot: str = "snapshot") -> DataFrame:
    """Adds n_lost: by how much the counter of discarded events grew since the packet before (0 if it fell).

    Empty `by` counts over all streams, in ranges of the first column of order, which must be a number then."""
    grown = with_delta(packet_index, order, snapshot, by, "_grown")
    return grown.withColumn("n_lost", F.greatest(F.coalesce("_grown", snapshot), F.lit(0))).drop("_grown")


def first_field(*candidates: tuple[bool, Column]) -> Column:
    """The first property that has a member of a name: resolved from the schema, not row by row."""
    return next((c for there, c in candidates if there), F.lit(None))


def find_field(events: DataFrame, name: str, packet: bool = False) -> Column:
    """A member by name from the first property that has it: header, common and specific context, payload; or of the packet."""
    order = ("packet_header", "packet_context") if packet else ("event_header", "common_context", "specific_context", "payload")
    for p in order:
        if p not in events.columns:
            continue
        f = events.schema[p]
        if json.loads(f.metadata.get("trace", "{}")).get("kind") == "merged":
            found = [F.col(p)[x.name].getField(name) for x in f.dataType.fields if name in x.dataType.names]
            if found:
                return F.coalesce(*found)
        elif name in f.dataType.names:
            return F.col(p).getField(name)
    return F.lit(None)


def count_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("n_events"))


def count_by_name(events: DataFrame, name: str = "event_name") -> DataFrame:
    return events.groupBy(F.coalesce(F.col(name), F.lit("UNNAMED EVENT")).alias("event_name")).agg(F.count("*").alias("n_events"))


def pair_intervals(events: DataFrame, key: str, kind: Column, state: Column, order: list[str]) -> DataFrame:
    """Total time by key and state. kind is begin or end: a begin sets the key's state and start, an end of the same state adds
    the time since, and any end closes the state."""
    marked = events.select(key, "ts_ns", *[c for c in order if c not in (key, "ts_ns")], kind.alias("_kind"), state.alias("_state")).where(F.col("_kind").isNotNull())
    by = W.partitionBy(key).orderBy(*order)
    before = lambda c: F.lag(c).over(by)
    paired = marked.withColumns({"_k": before("_kind"), "_s": before("_state"), "_t": before("ts_ns")})
    done = (F.col("_kind") == "end") & (F.col("_k") == "begin") & (F.col("_s") == F.col("_state"))
    return paired.where(done).groupBy(F.col(key), F.col("_state").alias("state")).agg(F.sum(F.col("ts_ns") - F.col("_t")).alias("total_ns"), F.count("*").alias("n_intervals"))


def unwrap_clock(events: DataFrame, low: str, bits: int, by: list[str], order: list[str], out: str = "cycles") -> DataFrame:
    """Whole clock values from their low bits: a fall means one turn. Exact if no step is longer than a turn."""
    window = W.partitionBy(*by).orderBy(*order)
    fell = F.when(F.col(low) < F.lag(low).over(window), 1).otherwise(0)
    running = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("_fell", fell).withColumn(out, F.col(low) + F.sum("_fell").over(running) * F.lit(1 << bits)).drop("_fell")


#: Ranges up to which label_join sends them to every task.
BROADCAST_RANGES = 10_000


def _blocks(batches):
    """For mapInArrow over (label, low, high): the fewest aligned blocks of 2**level numbers which make up each range."""
    for batch in batches:
        label, low, high, level, block = [], [], [], [], []
        for name, a, b in zip(*(batch.column(c).to_pylist() for c in ("label", "low", "high")), strict=True):
            at = a
            while at <= b:
                k = min((at & -at).bit_length() - 1 if at else 63, (b - at + 1).bit_length() - 1)
                label.append(name)
                low.append(a)
                high.append(b)
                level.append(k)
                block.append(at >> k)
                at += 1 << k
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), *(pa.array(x, pa.int64()) for x in (low, high, level, block))], names=["label", "low", "high", "level", "block"])


def label_join(values: DataFrame, ranges: DataFrame, value: str, most: int = BROADCAST_RANGES) -> DataFrame:
    """Rows with every label of a table (label, low, high) whose range holds the value. For mappings too large for literals.

    Up to `most` ranges go to every task. More are cut to aligned blocks of powers of two, and values meet the blocks that hold them: an
    equi-join on (level, block), with one copy of a value for each level there is."""
    if ranges.limit(most + 1).count() <= most:
        return values.join(F.broadcast(ranges), F.col(value).between(F.col("low"), F.col("high")))
    cut = ranges.select("label", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")).mapInArrow(_blocks, "label string, low long, high long, level long, block long")
    levels = sorted(r[0] for r in cut.select("level").distinct().collect())  # 64 at most
    own = F.col(value).cast("long")
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("level"), F.shiftright(own, k).alias("block")) for k in levels)))
    return values.withColumn("_at", each).withColumns({"level": F.col("_at.level"), "block": F.col("_at.block")}).drop("_at").join(cut, ["level", "block"]).drop("level", "block")


def write_text(events: DataFrame, path: str, **format_options) -> None:
    """One line per event in time order. Files are in order of name."""
    events.orderBy(*ORDER).select(X.event(events, **format_options).alias("value")).write.text(path)
