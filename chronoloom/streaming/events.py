"""Streaming forms of the operators: windowed counts, lost events and interval pairing with state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.trace_source import register


def stream_trace(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """Events of traces that grow, packet by packet, with a timestamp column ts for watermarks."""
    register(spark)
    events = spark.readStream.format("trace").options(**{k: str(v) for k, v in options.items()}).load(json.dumps(list(paths)))
    return events.withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000")))


def count_by_window(events: DataFrame, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Events by name and time window; later events than the watermark allows are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), F.coalesce("event_name", F.lit("UNNAMED EVENT")).alias("event_name"))
        .agg(F.count("*").alias("n_events"))
    )


def lost_events(packets: DataFrame, key: str = "stream_file") -> DataFrame:
    """key, packet_idx, n_lost for packets (key, packet_idx, snapshot) in order of index, the last counter being kept as state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("packet_idx").drop_duplicates("packet_idx")
        seen = rows["snapshot"].astype("int64")
        lost = (seen - seen.shift(fill_value=last)).clip(lower=0)
        state.update((int(seen.iloc[-1]),))
        yield pd.DataFrame({key: k[0], "packet_idx": rows["packet_idx"], "n_lost": lost})

    return packets.groupBy(key).applyInPandasWithState(step, f"{key} string, packet_idx long, n_lost long", "last long", "append", GroupStateTimeout.NoTimeout)


def pair_intervals(marks: DataFrame, key: str, key_type: str = "long") -> DataFrame:
    """key, state, ns of each closed interval of marks (key, ts_ns, kind, state), with the open one kept as state.

    Within a batch marks are taken in order of time, and of `seq` if they have it; one that comes after a later batch is paired with what is open then."""
    order = ["ts_ns", *(c for c in ("seq",) if c in marks.columns)]


    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, start = state.get if state.exists else (None, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values(order, kind="stable").itertuples():
            if r.kind == "begin":
                now, start = r.state, r.ts_ns
            else:
                if now == r.state:
                    out.append((k[0], now, r.ts_ns - start))
                now = None
        state.update((now, int(start)))
        yield pd.DataFrame(out, columns=[key, "state", "ns"])

    return marks.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, state string, ns long", "now string, start long", "append", GroupStateTimeout.NoTimeout)
