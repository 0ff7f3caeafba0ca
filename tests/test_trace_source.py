from __future__ import annotations

import io
import os

import pytest
from pyspark.sql import functions as F

from chronoloom.__main__ import main
from chronoloom.functions import text as X
from chronoloom.operators import events as ops
from chronoloom.sources import encoder as enc
from chronoloom.sources.metadata import Catalog
from chronoloom.sources.trace_source import decode_files, read_trace
from chronoloom.streaming import events as streaming

MS = 1_000_000  # the clock counts microseconds; times here are in ms
CLASSES = {0: ("begin", enc.structure(enc.member("state", "null-terminated-string"), enc.uint("tid", 32))), 1: ("end", enc.structure(enc.member("state", "null-terminated-string"), enc.uint("tid", 32), enc.uint("extra", 8, mappings={"low": [[0, 9]]})))}
META = enc.trace_metadata(CLASSES)


def packet(stream, sequence, lost, *events):
    rows = [(1000 * t, k, {"state": s, "tid": tid, **({"extra": 7} if k else {})}) for t, k, s, tid in events]
    return enc.encode_packet(Catalog.parse(META), stream, sequence, lost, rows)


PACKETS = {
    "a": [packet(0, 0, 0, (1, 0, "eat", 1), (5, 1, "eat", 1)), packet(0, 1, 4, (11, 0, "think", 1), (30, 1, "think", 1)), packet(0, 2, 9, (40, 0, "eat", 1))],
    "b": [packet(1, 0, 0, (2, 0, "eat", 2), (6, 1, "think", 2), (7, 1, "eat", 2)), packet(1, 1, 1, (20, 0, "eat", 2), (21, 1, "eat", 2))],
}


@pytest.fixture
def traces(tmp_path):
    (tmp_path / "metadata").write_bytes(META)
    for name, data in PACKETS.items():
        (tmp_path / name).write_bytes(b"".join(data))
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(b"junk")
    os.makedirs(tmp_path / "sub")
    return str(tmp_path)


def test_events_in_order_with_their_packets(spark, traces):
    events = ops.mux(read_trace(spark, traces)).collect()
    assert [r.ts_ns // MS for r in events] == [1, 2, 5, 6, 7, 11, 20, 21, 30, 40]
    assert {(r.stream_file, r.pkt_seq_num) for r in events} == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)}
    assert events[0].payload.begin.state == "eat" and events[0].payload.end is None
    assert [r.pkt_disc_snapshot for r in events if r.stream_file == "a"] == [0, 0, 4, 4, 9]
    typed = read_trace(spark, traces, eventClass="end").collect()
    assert {r.payload.extra for r in typed} == {7} and len(typed) == 5
    assert "packet_header" not in read_trace(spark, traces, properties="payload").columns
    assert read_trace(spark, traces, file="b").count() == 5


def test_time_filters_leave_packets_out(spark, traces):
    packets = read_trace(spark, traces, view="packets", packetBytes=1)
    assert packets.count() == 5
    everything = read_trace(spark, traces, packetBytes=1)
    late = read_trace(spark, traces, packetBytes=1, begin_ns=21 * MS)
    assert sorted(r.ts_ns // MS for r in late.collect()) == [21, 30, 40]
    assert everything.rdd.getNumPartitions() == 5 and late.rdd.getNumPartitions() == 3
    some = read_trace(spark, traces, packetBytes=1, begin_ns=6 * MS, end_ns=11 * MS)
    assert some.rdd.getNumPartitions() == 2 and [r.ts_ns // MS for r in ops.mux(some).collect()] == [6, 7, 11]
    # A filter on one use of a DataFrame must not reach another.
    assert (ops.seek(everything, 21 * MS).count(), everything.count(), ops.time_range(everything, end=2 * MS).count()) == (3, 10, 2)
    assert ops.seek_in_range(everything, 0, 6 * MS, 11 * MS).count() == 3 and ops.seek_in_range(everything, 50 * MS, 6 * MS, 11 * MS).count() == 0
    assert ops.time_range_of_day(everything, 20 * MS, None).count() == 4


def test_several_directories(spark, traces, tmp_path_factory):
    other = tmp_path_factory.mktemp("other")
    (other / "metadata").write_bytes(META)
    (other / "c").write_bytes(PACKETS["b"][0])
    both = read_trace(spark, traces, str(other))
    assert {r.trace_idx: r.n for r in both.groupBy("trace_idx").agg(F.count("*").alias("n")).collect()} == {0: 10, 1: 3}


def test_modes_on_broken_streams(spark, tmp_path):
    (tmp_path / "metadata").write_bytes(META)
    (tmp_path / "bad").write_bytes(PACKETS["a"][0] + PACKETS["a"][1][:-12])
    (tmp_path / "good").write_bytes(PACKETS["b"][0])
    with pytest.raises(Exception, match="NOT_ENOUGH_BITS"):
        read_trace(spark, str(tmp_path)).count()
    rows = read_trace(spark, str(tmp_path), mode="PERMISSIVE").collect()
    assert sum(r._error is None for r in rows) == 6 and [r.stream_file for r in rows if r._error] == ["bad"]
    assert read_trace(spark, str(tmp_path), mode="DROPTAIL").count() == 6


def test_decoding_what_spark_reads(spark, traces):
    files = spark.read.format("binaryFile").load(f"{traces}/[ab]")
    assert decode_files(files, META).count() == 10


def test_accounting(spark, traces):
    events = read_trace(spark, traces)
    assert {r.event_name: r.n_events for r in ops.count_by_name(events).collect()} == {"begin": 5, "end": 5}
    index = events.groupBy("stream_file", "packet_idx").agg(F.max("pkt_disc_snapshot").cast("bigint").alias("snapshot"))
    lost = {(r.stream_file, r.packet_idx): r.n_lost for r in ops.lost_events(index, ["stream_file"], ["packet_idx"]).collect()}
    assert lost == {("a", 0): 0, ("a", 1): 4, ("a", 2): 5, ("b", 0): 0, ("b", 1): 1}
    tid, state = ops.find_field(events, "tid"), ops.find_field(events, "state")
    marks = events.select(tid.alias("tid"), state.alias("state"), "ts_ns", "event_name")
    paired = ops.pair_intervals(marks, "tid", F.col("event_name"), F.col("state"), ["ts_ns"]).collect()
    # The end of another state closes what is open: thread 2 ate from 2 to 7, but its end of thinking came between.
    assert {(r.tid, r.state): r.total_ns // MS for r in paired} == {(1, "eat"): 4, (1, "think"): 19, (2, "eat"): 1}
    deltas = sorted((r.ts_ns // MS, r.delta and r.delta // MS) for r in ops.with_delta(events).collect())
    assert deltas == [(1, None), (2, 1), (5, 3), (6, 1), (7, 1), (11, 4), (20, 9), (21, 1), (30, 9), (40, 10)]


def test_text(spark, traces):
    events = read_trace(spark, traces)
    lines = [r.line for r in events.withColumn("line", X.event(events, True, ["payload"])).orderBy(*ops.ORDER).collect()]
    assert lines[0] == '[00:00:00.001000000] begin: { event-payload: { state: "eat", tid: 1 } }'
    assert lines[2] == '[00:00:00.005000000] end: { event-payload: { state: "eat", tid: 1, extra: 7: "low" } }'


def run(spark, *arguments):
    out, err = io.StringIO(), io.StringIO()
    status = main(list(arguments), spark, out, err)
    return status, out.getvalue().splitlines(), err.getvalue().splitlines()


def test_command_line(spark, traces, tmp_path_factory):
    status, out, err = run(spark, "-g", "-d", "-p", "event-payload", "-b", "0.5000000", "-e", "00:00:00.11000000", traces)
    assert status == 0 and err[0] == "4 events decoded"
    assert out[0].startswith("[00:00:00.005000000] (+??????????) end: {") and "(+0001000000)" in out[1]
    assert run(spark, "-q", "-g", traces)[1:] == ([], ["10 events decoded", "10 events discarded"])
    assert run(spark, "-g", "-c", traces)[1][0].startswith("[00000000000000001000] ")
    bad = tmp_path_factory.mktemp("bad")
    (bad / "metadata").write_bytes(META)
    (bad / "x").write_bytes(PACKETS["a"][0][:-8])
    status, out, err = run(spark, "-g", str(bad))
    assert status == 1 and err[0].startswith("read error") and len(out) == 1


def test_growing_trace(spark, tmp_path):
    where = tmp_path / "trace"
    where.mkdir()
    (where / "metadata").write_bytes(META)
    (where / "a").write_bytes(PACKETS["a"][0] + PACKETS["a"][1][:20])

    def drain(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return [r.asDict() for r in spark.table(name).collect()]

    events = streaming.stream_trace(spark, str(where))
    assert [r["ts_ns"] // MS for r in drain(events.select("ts_ns"), "first")] == [1, 5]
    (where / "a").write_bytes(b"".join(PACKETS["a"]))
    assert [r["ts_ns"] // MS for r in drain(events.select("ts_ns"), "again")] == [1, 5, 11, 30, 40]
    packets = events.select("stream_file", "packet_idx", F.col("pkt_disc_snapshot").cast("bigint").alias("snapshot"))
    assert sorted((r["packet_idx"], r["n_lost"]) for r in drain(streaming.lost_events(packets), "lost")) == [(0, 0), (1, 4), (2, 5)]
    tid, state = ops.find_field(events, "tid"), ops.find_field(events, "state")
    marks = events.select(tid.alias("tid"), "ts_ns", F.col("event_name").alias("kind"), state.alias("state"))
    assert sorted((r["state"], r["ns"] // MS) for r in drain(streaming.pair_intervals(marks, "tid"), "pairs")) == [("eat", 4), ("think", 19)]
    counted = drain(streaming.count_by_window(events, "1 minute", "0 seconds"), "counts", "complete")
    assert {r["event_name"]: r["n_events"] for r in counted} == {"begin": 3, "end": 2}
