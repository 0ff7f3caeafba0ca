"""Prints the events of traces: python -m chronoloom [options] PATH..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import events as ops
from .sources.trace_source import read_trace


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronoloom", description=__doc__)
    p.add_argument("paths", nargs="+")
    p.add_argument("-p", "--properties", default="", help="packet-header, packet-context, event-header, event-common-context, event-specific-context, event-payload or all, by commas")
    p.add_argument("-l", "--labels", action="store_true", help="names of properties")
    p.add_argument("-d", "--delta", action="store_true", help="time since the event before")
    p.add_argument("-c", "--cycles", action="store_true", help="timestamps in cycles")
    p.add_argument("-g", "--utc", action="store_true", help="timestamps in UTC")
    p.add_argument("-t", "--date", action="store_true", help="timestamps with dates")
    p.add_argument("-s", "--seconds", action="store_true", help="timestamps in seconds")
    p.add_argument("-b", "--begin", help="first time")
    p.add_argument("-e", "--end", help="last time")
    p.add_argument("-q", "--quiet", action="store_true", help="counts only")
    return p


def bounds(spark: SparkSession, paths: list[str], begin: str | None, end: str | None, zone: str) -> dict[str, int]:
    """Options of read_trace for two timestamps as text; times without a date are of the day of the first event."""
    out, day = {}, None
    for name, text in (("begin_ns", begin), ("end_ns", end)):
        if text is not None:
            ns, dated = X.parse_timestamp(text, zone)
            if not dated:
                if day is None:
                    day = ops.first_day(read_trace(spark, *paths, mode="DROPTAIL")).first()["day"] or 0
                ns += day
            out[name] = ns
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout, err=sys.stderr) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("chronoloom").getOrCreate()
    zone = "UTC" if a.utc else os.environ.get("TZ") or spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    names = {label: p for p, label in X.PROPERTY_LABELS.items()}
    chosen = [names[x] for x in a.properties.split(",") if x in names]
    events = read_trace(spark, *a.paths, mode="PERMISSIVE", **bounds(spark, a.paths, a.begin, a.end, zone))
    failed = events.where(F.col("_error").isNotNull()).select("_error").take(1)
    valid = events.where(F.col("_error").isNull())
    if not a.quiet:
        step = None
        if a.delta:
            valid = ops.with_delta(valid, value="ts_cycles" if a.cycles else "ts_ns", out="_step")
            step = X.delta(F.col("_step"))
        line = X.event(valid, a.labels, chosen or None, step, a.cycles, a.date, a.seconds)
        for row in valid.withColumn("_line", line).orderBy(*ops.ORDER).select("_line").toLocalIterator():
            print(row[0], file=out)
    if failed:
        print(f"read error: {failed[0][0]}", file=err)
    print(f"{valid.count()} events decoded", file=err)
    packets = valid.groupBy("trace_idx", "stream_file", "packet_idx").agg(F.max(F.coalesce("pkt_disc_snapshot", F.lit(0))).alias("snapshot"))
    lost = ops.lost_events(packets, ["trace_idx", "stream_file"], ["packet_idx"]).agg(F.sum("n_lost")).first()[0]
    if lost:
        print(f"{lost} events discarded", file=err)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
