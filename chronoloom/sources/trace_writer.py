"""Writing an event DataFrame as a trace: one data stream file per stream, in packets."""

from __future__ import annotations

import os

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoder import encode_packet
from .metadata import Catalog


def write_trace(rows: DataFrame, directory: str, metadata: bytes, payload: list[str], per_packet: int = 64) -> None:
    """rows: stream, seq (order in the stream), cycles, class_id, snapshot and the payload columns.

    Packets are encoded in parallel, a packet in a task. A stream's file is appended to by one task, since a file system has no other way
    to write one file; directory must be one that executors share. Traces of many streams are written by as many tasks."""
    os.makedirs(directory, exist_ok=True)
    with open(os.path.join(directory, "metadata"), "wb") as f:
        f.write(metadata)

    def packet(table: pa.Table) -> pa.Table:
        catalog = Catalog.parse(metadata)
        found = table.sort_by("seq").to_pylist()
        events = [(int(r["cycles"]), int(r["class_id"]), {c: r[c] for c in payload}) for r in found]
        stream, number = int(found[0]["stream"]), int(found[0]["packet"])
        data = encode_packet(catalog, stream, number, max(int(r["snapshot"]) for r in found), events)
        return pa.table({"stream": [stream], "packet": [number], "data": pa.array([data], pa.binary())})

    packets = rows.withColumn("packet", F.expr(f"seq div {per_packet}")).groupBy("stream", "packet").applyInArrow(packet, "stream long, packet long, data binary")

    def files(batches):
        out, now = None, None
        for frame in batches:
            for r in frame.itertuples():
                if r.stream != now:
                    if out:
                        out.close()
                    out, now = open(os.path.join(directory, f"stream_{r.stream}"), "wb"), r.stream
                out.write(r.data)
        if out:
            out.close()
        yield pd.DataFrame({"ok": [1]})

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packets.repartition(n, "stream").sortWithinPartitions("stream", "packet").mapInPandas(files, "ok int").count()
