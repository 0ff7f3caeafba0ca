"""One query for each operator on the driver's tables, with the SQL that says the same.

`trace` is the events table as a trace: ts_ns, stream = user_id % 4, event_name, order (ts_ns, event_id), packets of 64 events a stream."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import numbers as N
from .functions import text as X
from .operators import events as ops
from .sources import encoder as enc
from .sources.trace_source import read_trace
from .sources.trace_writer import write_trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# A stretch of the events' month, in ns since 1970.
BEGIN, END = 1704500000000000000, 1705500000000000000
FREQUENCY, OFFSET_S, OFFSET_C = 1333337, 1700000000, 4242
RANGES = {"low": [(1, 10)], "mid": [(8, 30)], "odd": [(1, 1), (3, 3), (5, 5)], "high": [(31, 50)]}
FLAGS = {"first": [(0, 0)], "second": [(1, 1)], "both": [(0, 1)], "third": [(2, 2)]}
ORDER = ["ts_ns", "event_id"]

_TR = """
WITH tr AS (
  SELECT event_id, CAST(epoch_us(ts) AS BIGINT) * 1000 AS ts_ns, CAST(user_id % 4 AS BIGINT) AS stream, user_id, event_type AS event_name, value, props,
    CAST((row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1) // 64 AS BIGINT) AS packet
  FROM events)
"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanoseconds(column: str):
    """Nanoseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ)) * 1000")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", nanoseconds("ts").alias("ts_ns"), (F.col("user_id") % 4).alias("stream"), "user_id", F.col("event_type").alias("event_name"), "value", "props"
    )


def with_packets(tr: DataFrame) -> DataFrame:
    return tr.withColumn("packet", F.expr("(row_number() over (partition by stream order by ts_ns, event_id) - 1) div 64").cast("long"))


def packet_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr = with_packets(trace(spark, sf_dir))
    return tr.groupBy("stream", "packet").agg(
        F.count("*").alias("n_events"), F.min("ts_ns").alias("begin_ns"), F.max("ts_ns").alias("end_ns"), F.max("event_id").alias("snapshot")
    )


@query("trace_scan", _TR + "SELECT event_id, event_name, ts_ns, stream FROM tr")
def trace_scan(spark, sf_dir):
    return trace(spark, sf_dir).select("event_id", "event_name", "ts_ns", "stream")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
#: Traces written in this session by tables and name, so that each is written once.
_KEPT: dict[tuple, str] = {}


def new_directory(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share; a temporary one only where none is set."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
    if base:
        os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(prefix="trace-", dir=base or None)


def kept_trace(spark: SparkSession, sf_dir: str, name: str, write: Callable[[], str]) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT or not os.path.isdir(_KEPT[key]):
        _KEPT[key] = write()
    return _KEPT[key]


def event_metadata() -> bytes:
    payload = enc.structure(enc.member("event_id", "fixed-length-signed-integer", length=64, byte_order="little-endian"), enc.uint("user_id", 32), enc.member("value", "fixed-length-floating-point-number", length=64, byte_order="little-endian"), enc.member("props", "null-terminated-string"))
    return enc.trace_metadata({i: (name, payload) for i, name in enumerate(EVENT_TYPES)})


def event_trace(spark: SparkSession, sf_dir: str, per_packet: int = 64) -> str:
    """The events table written as a trace; the directory."""
    return kept_trace(spark, sf_dir, f"events {per_packet}", lambda: _write_events(spark, sf_dir, per_packet))


def _write_events(spark: SparkSession, sf_dir: str, per_packet: int) -> str:
    metadata = event_metadata()
    number = F.array_position(F.lit(EVENT_TYPES), F.col("event_name")) - 1
    seq = F.row_number().over(W.partitionBy("stream").orderBy("ts_ns", "event_id")) - 1
    rows = trace(spark, sf_dir).select("stream", seq.cast("long").alias("seq"), F.expr("ts_ns div 1000").alias("cycles"), number.alias("class_id"), F.col("event_id").alias("snapshot"), "event_id", "user_id", "value", "props")
    return written(spark, rows, metadata, ["event_id", "user_id", "value", "props"], per_packet)


def written(spark, rows, metadata, payload, per_packet=64) -> str:
    directory = new_directory(spark)
    write_trace(rows, directory, metadata, payload, per_packet)
    return directory


@query("ctf_roundtrip", "SELECT event_id, event_type AS event_name, user_id, value, props, CAST(epoch_us(ts) AS BIGINT) * 1000 AS ts_ns FROM events")
def ctf_roundtrip(spark, sf_dir):
    events = read_trace(spark, event_trace(spark, sf_dir))
    return events.select(F.col("payload.event_id").alias("event_id"), "event_name", F.col("payload.user_id").alias("user_id"), F.col("payload.value").alias("value"), F.col("payload.props").alias("props"), "ts_ns")


@query(
    "ctf_roundtrip_lineitem",
    "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag, CAST(epoch_us(l_shipdate) AS BIGINT) * 1000 AS ts_ns FROM lineitem",
)
def ctf_roundtrip_lineitem(spark, sf_dir):
    payload = enc.structure(
        enc.member("l_orderkey", "variable-length-unsigned-integer"), enc.member("l_partkey", "variable-length-signed-integer"),
        enc.member("l_linenumber", "fixed-length-unsigned-integer", length=3, byte_order="little-endian"),
        enc.member("l_quantity", "fixed-length-floating-point-number", length=32, byte_order="big-endian", alignment=32),
        enc.member("l_returnflag", "static-length-string", length=2),
    )
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("stream"), F.lit(0).alias("class_id"), F.lit(0).alias("snapshot"), F.expr(f"{'timestampdiff(MICROSECOND, TIMESTAMP_NTZ'}'1970-01-01 00:00:00', CAST(l_shipdate AS TIMESTAMP_NTZ))").alias("cycles"),
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag",
    )
    rows = rows.withColumn("seq", F.row_number().over(W.partitionBy("stream").orderBy("cycles", "l_orderkey", "l_linenumber")).cast("long") - 1)
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"]
    metadata = enc.trace_metadata({0: ("item", payload)})
    events = read_trace(spark, kept_trace(spark, sf_dir, "lineitem", lambda: written(spark, rows, metadata, columns, 512)))
    p = F.col("payload")
    return events.select(
        p["l_orderkey"].cast("bigint").alias("l_orderkey"), p["l_partkey"].alias("l_partkey"), p["l_linenumber"].cast("int").alias("l_linenumber"),
        p["l_quantity"].cast("double").alias("l_quantity"), p["l_returnflag"].alias("l_returnflag"), "ts_ns",
    )


@query("time_range_counts", _TR + f"SELECT event_name, count(*) AS n_events FROM tr WHERE ts_ns BETWEEN {BEGIN} AND {END} GROUP BY event_name")
def time_range_counts(spark, sf_dir):
    """The slice end to end: a trace is written, read with pruned packets, cut to a range and counted by name."""
    return ops.count_by_name(read_trace(spark, event_trace(spark, sf_dir), begin_ns=BEGIN, end_ns=END))


@query("file_discovery", _TR + "SELECT DISTINCT 'stream_' || stream AS stream_file FROM tr")
def file_discovery(spark, sf_dir):
    return read_trace(spark, event_trace(spark, sf_dir), view="packets").select("stream_file").distinct()


@query("trace_packets", _TR + "SELECT stream, packet AS pkt_seq_num, count(*) AS n_events, min(ts_ns) AS pkt_begin_ns, max(ts_ns) AS pkt_end_ns FROM tr GROUP BY ALL")
def trace_packets(spark, sf_dir):
    events = read_trace(spark, event_trace(spark, sf_dir))
    keys = [F.col("stream_id").cast("bigint").alias("stream"), F.col("pkt_seq_num").cast("bigint").alias("pkt_seq_num"), "pkt_begin_ns", "pkt_end_ns"]
    return events.groupBy(*keys).agg(F.count("*").alias("n_events"))


@query("mux_order", _TR + "SELECT event_id, stream, row_number() OVER (ORDER BY ts_ns, event_id) AS position FROM tr")
def mux_order(spark, sf_dir):
    tr = trace(spark, sf_dir)
    merged = ops.mux(*(tr.where(F.col("stream") == i) for i in range(4)), sort=False)
    return ops.with_position(merged, ORDER).select("event_id", "stream", "position")


@query("seek_from", _TR + f"SELECT event_id, ts_ns FROM tr WHERE ts_ns >= {END}")
def seek_from(spark, sf_dir):
    return ops.seek(trace(spark, sf_dir), END).select("event_id", "ts_ns")


@query("time_range", _TR + f"SELECT event_id, ts_ns FROM tr WHERE ts_ns BETWEEN {BEGIN} AND {END}")
def time_range(spark, sf_dir):
    return ops.time_range(trace(spark, sf_dir), BEGIN, END).select("event_id", "ts_ns")


@query("time_range_full", _TR + "SELECT count(*) AS n_events FROM tr")
def time_range_full(spark, sf_dir):
    return ops.count_events(ops.time_range(trace(spark, sf_dir)))


@query(
    "time_range_nodate",
    _TR + ", d AS (SELECT first_ns - first_ns % 86400000000000 AS day FROM (SELECT arg_min(ts_ns, (ts_ns, event_id)) AS first_ns FROM tr)) "
    "SELECT event_id, ts_ns FROM tr, d WHERE ts_ns BETWEEN day + 3600000000000 AND day + 7200000000000000",
)
def time_range_nodate(spark, sf_dir):
    return ops.time_range_of_day(trace(spark, sf_dir), 3600 * X.NS, 7200000 * X.NS, ORDER).select("event_id", "ts_ns")


@query("seek_clamped", _TR + f"SELECT event_id FROM tr WHERE ts_ns >= greatest({BEGIN}, {BEGIN - 5}) AND ts_ns <= {END}")
def seek_clamped(spark, sf_dir):
    return ops.seek_in_range(trace(spark, sf_dir), BEGIN - 5, BEGIN, END).select("event_id")


@query("property_projection", _TR + "SELECT event_id, ts_ns, value FROM tr")
def property_projection(spark, sf_dir):
    tr = trace(spark, sf_dir).select("event_id", "ts_ns", F.struct("user_id").alias("common_context"), F.struct("value", "props").alias("payload"))
    return ops.project(tr, ["payload"]).select("event_id", "ts_ns", F.col("payload.value").alias("value"))


@query(
    "delta_prev",
    _TR + "SELECT event_id, d AS delta, '(+' || CASE WHEN d IS NULL THEN '??????????' ELSE printf('%010d', d) END || ')' AS shown "
    "FROM (SELECT event_id, ts_ns - lag(ts_ns) OVER (ORDER BY ts_ns, event_id) AS d FROM tr)",
)
def delta_prev(spark, sf_dir):
    found = ops.with_delta(trace(spark, sf_dir), ORDER)
    return found.select("event_id", "delta", X.delta(F.col("delta")).alias("shown"))


@query("delta_by_stream", _TR + "SELECT event_id, ts_ns - lag(ts_ns) OVER (PARTITION BY stream ORDER BY ts_ns, event_id) AS delta FROM tr")
def delta_by_stream(spark, sf_dir):
    return ops.with_delta(trace(spark, sf_dir), ORDER, by=["stream"]).select("event_id", "delta")


@query("field_lookup_first", _TR + "SELECT event_id, user_id AS found, value AS payload_value FROM tr")
def field_lookup_first(spark, sf_dir):
    tr = trace(spark, sf_dir).select("event_id", F.struct(F.col("user_id").alias("key")).alias("common_context"), F.struct(F.col("value").alias("key"), "value").alias("payload"))
    return tr.select("event_id", ops.find_field(tr, "key").alias("found"), ops.find_field(tr, "value").alias("payload_value"))


@query("struct_get", _TR + "SELECT event_id, user_id AS by_name, value AS by_index, 2 AS n FROM tr")
def struct_get(spark, sf_dir):
    tr = trace(spark, sf_dir).select("event_id", F.struct("user_id", "value").alias("s"))
    fields = tr.schema["s"].dataType
    return tr.select("event_id", F.col("s").getField("user_id").alias("by_name"), F.col("s").getField(fields.names[1]).alias("by_index"), F.lit(len(fields)).alias("n"))


@query("array_get", "SELECT p_partkey, string_split(p_name, ' ')[2] AS second, string_split(p_name, ' ')[100] AS beyond, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n FROM part")
def array_get(spark, sf_dir):
    a = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.get(a, F.lit(1)).alias("second"), F.get(a, F.lit(99)).alias("beyond"), F.size(a).alias("n"))


_INDEX = _TR + ", pk AS (SELECT stream, packet, count(*) AS n_events, min(ts_ns) AS begin_ns, max(ts_ns) AS end_ns, max(event_id) AS snapshot FROM tr GROUP BY stream, packet) "


@query("packet_index", _INDEX + "SELECT * FROM pk")
def packet_index_query(spark, sf_dir):
    return packet_index(spark, sf_dir)


@query("packet_skip", _INDEX + f"SELECT stream, packet FROM pk WHERE end_ns >= {END}")
def packet_skip(spark, sf_dir):
    return ops.packets_from(packet_index(spark, sf_dir), END).select("stream", "packet")


@query("lost_events", _INDEX + "SELECT stream, packet, greatest(snapshot - coalesce(lag(snapshot) OVER (PARTITION BY stream ORDER BY packet), 0), 0) AS n_lost FROM pk")
def lost_events(spark, sf_dir):
    return ops.lost_events(packet_index(spark, sf_dir), ["stream"], ["packet"]).select("stream", "packet", "n_lost")


@query("lost_events_global", _INDEX + "SELECT stream, packet, greatest(snapshot - coalesce(lag(snapshot) OVER (ORDER BY begin_ns, stream, packet), 0), 0) AS n_lost FROM pk")
def lost_events_global(spark, sf_dir):
    return ops.lost_events(packet_index(spark, sf_dir), [], ["begin_ns", "stream", "packet"]).select("stream", "packet", "n_lost")


@query("count_by_name", _TR + "SELECT coalesce(nullif(event_name, 'view'), 'UNNAMED EVENT') AS event_name, count(*) AS n_events FROM tr GROUP BY 1")
def count_by_name(spark, sf_dir):
    return ops.count_by_name(trace(spark, sf_dir).withColumn("event_name", F.expr("nullif(event_name, 'view')")))


@query(
    "interval_pairs",
    _TR + ", m AS (SELECT *, CASE event_name WHEN 'click' THEN 'begin' WHEN 'purchase' THEN 'end' END AS kind FROM tr WHERE event_name IN ('click', 'purchase')), "
    "p AS (SELECT *, lag(kind) OVER w AS k, lag(ts_ns) OVER w AS t FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, event_id)) "
    "SELECT user_id, 'buying' AS state, CAST(sum(ts_ns - t) AS BIGINT) AS total_ns, count(*) AS n_intervals FROM p WHERE kind = 'end' AND k = 'begin' GROUP BY user_id",
)
def interval_pairs(spark, sf_dir):
    kind = F.when(F.col("event_name") == "click", "begin").when(F.col("event_name") == "purchase", "end")
    return ops.pair_intervals(trace(spark, sf_dir), "user_id", kind, F.lit("buying"), ORDER)


@query(
    "cycles_to_ns",
    f"SELECT event_id, ({OFFSET_S} + (event_id * 1000000 + {OFFSET_C}) // {FREQUENCY}) * 1000000000 + ((event_id * 1000000 + {OFFSET_C}) % {FREQUENCY}) * 1000000000 // {FREQUENCY} AS ns FROM events",
)
def cycles_to_ns(spark, sf_dir):
    cycles = (F.col("event_id") * 1000000).cast(N.U64)
    return table(spark, sf_dir, "events").select("event_id", N.cycles_to_ns(cycles, FREQUENCY, OFFSET_S, OFFSET_C).alias("ns"))


@query("clock_unwrap", _TR + "SELECT event_id, ts_ns // 1000 - (min(ts_ns // 1000) OVER ()) // 1099511627776 * 1099511627776 AS cycles FROM tr")
def clock_unwrap(spark, sf_dir):
    """Exact where events follow each other within 2**40 us; the low 40 bits of each are all that is used."""
    low = trace(spark, sf_dir).select("event_id", "ts_ns", F.expr(f"(ts_ns div 1000) & {(1 << 40) - 1}").alias("low"), F.lit(0).alias("one"))
    return ops.unwrap_clock(low, "low", 40, ["one"], ORDER).select("event_id", "cycles")


_U64 = "18446744073709551615"


@query("coerce_uint", f"SELECT c_custkey, CAST(greatest(v, 0) AS VARCHAR) AS from_int, '{_U64}' AS from_text FROM (SELECT c_custkey, CAST(round(c_acctbal) AS BIGINT) AS v FROM customer)")
def coerce_uint(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", N.to_uint(F.round("c_acctbal").cast("bigint"), "signed int").cast("string").alias("from_int"), N.to_uint(F.col("c_name"), "string").cast("string").alias("from_text"))


@query("coerce_int", "SELECT c_custkey, CAST(least(CAST(c_custkey % 18 AS DECIMAL(20,0)) * 1000000000000000000, 9223372036854775807) AS BIGINT) AS from_uint, 9223372036854775807 AS from_text FROM customer")
def coerce_int(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    # Up to 17 * 10^18, which 64 bits hold for every key.
    big = ((F.col("c_custkey") % 18).cast("decimal(19,0)") * F.lit("1000000000000000000").cast("decimal(19,0)")).cast(N.U64)
    return c.select("c_custkey", N.to_int(big, "unsigned int").alias("from_uint"), N.to_int(F.col("c_name"), "string").alias("from_text"))


@query("coerce_bool", "SELECT l_orderkey, l_linenumber, l_linenumber - 1 <> 0 AS from_int, false AS from_text FROM lineitem")
def coerce_bool(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", N.to_bool(F.col("l_linenumber") - 1, "signed int").alias("from_int"), N.to_bool(F.col("l_returnflag"), "string").alias("from_text"))


@query("coerce_real", "SELECT c_custkey, c_acctbal AS from_real, CAST(1.7976931348623157e308 AS DOUBLE) AS from_int FROM customer")
def coerce_real(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.to_real(F.col("c_acctbal"), "real").alias("from_real"), N.to_real(F.col("c_custkey"), "signed int").alias("from_int"))


_QUANTITY = "(SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"
_LABELS = "list_filter([CASE WHEN q BETWEEN 1 AND 10 THEN 'low' END, CASE WHEN q BETWEEN 8 AND 30 THEN 'mid' END, CASE WHEN q IN (1, 3, 5) THEN 'odd' END, CASE WHEN q BETWEEN 31 AND 50 THEN 'high' END], lambda x: x IS NOT NULL)"


@query("labels_all", f"SELECT l_orderkey, l_linenumber, array_to_string({_LABELS}, ',') AS labels FROM {_QUANTITY}")
def labels_all(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(N.labels(q, RANGES), ",").alias("labels"))


@query("labels_first", f"SELECT l_orderkey, l_linenumber, ({_LABELS})[1] AS label FROM {_QUANTITY}")
def labels_first(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.first_label(F.col("l_quantity").cast("bigint"), RANGES).alias("label"))


@query(
    "labels_range_join",
    "SELECT l_orderkey, l_linenumber, label FROM (VALUES ('low', 1, 10), ('mid', 8, 30), ('odd', 1, 1), ('odd', 3, 3), ('odd', 5, 5), ('high', 31, 50)) r(label, low, high) JOIN lineitem ON CAST(l_quantity AS BIGINT) BETWEEN low AND high",
)
def labels_range_join(spark, sf_dir):
    ranges = spark.createDataFrame([(name, a, b) for name, r in RANGES.items() for a, b in r], "label string, low long, high long")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    return ops.label_join(li, ranges, "q").select("l_orderkey", "l_linenumber", "label")


@query("range_membership", f"SELECT l_orderkey, l_linenumber, q BETWEEN 1 AND 5 OR q BETWEEN 40 AND 45 AS inside FROM {_QUANTITY}")
def range_membership(spark, sf_dir):
    ranges = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in [(1, 5), (40, 45)]))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.in_range_array(F.col("l_quantity").cast("bigint"), ranges).alias("inside"))


@query(
    "rangeset_intersect",
    "SELECT p_partkey, (10 <= p_size + 2 AND p_size <= 12) OR (30 <= p_size + 2 AND p_size <= 30) AS meets FROM part",
)
def rangeset_intersect(spark, sf_dir):
    one = F.array(F.struct(F.col("p_size").alias("low"), (F.col("p_size") + 2).alias("high")))
    other = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in [(10, 12), (30, 30)]))
    return table(spark, sf_dir, "part").select("p_partkey", N.range_arrays_intersect(one, other).alias("meets"))


_FLAGS = "list_filter([CASE WHEN l_linenumber & 1 <> 0 THEN 'first' END, CASE WHEN l_linenumber & 2 <> 0 THEN 'second' END, CASE WHEN l_linenumber & 3 <> 0 THEN 'both' END, CASE WHEN l_linenumber & 4 <> 0 THEN 'third' END], lambda x: x IS NOT NULL)"


@query("flags_all", f"SELECT l_orderkey, l_linenumber, array_to_string({_FLAGS}, ',') AS flags FROM lineitem")
def flags_all(spark, sf_dir):
    v = F.col("l_linenumber").cast("bigint")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(N.flags(v, FLAGS), ",").alias("flags"))


@query("flags_first", f"SELECT l_orderkey, l_linenumber, ({_FLAGS})[1] AS flag FROM lineitem")
def flags_first(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.first_flag(F.col("l_linenumber").cast("bigint"), FLAGS).alias("flag"))


@query("sign_extend", "SELECT event_id, CASE WHEN event_id % 256 >= 128 THEN event_id % 256 - 256 ELSE event_id % 256 END AS v FROM events")
def sign_extend(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.sign_extend(F.col("event_id"), 8).alias("v"))


@query("bit_reverse", "SELECT event_id, list_sum(list_transform(range(0, 24), lambda i: ((event_id >> i) & 1) << (23 - i)))::BIGINT AS v FROM events")
def bit_reverse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.reverse_bits(F.col("event_id"), 24).alias("v"))


@query("leb128_size", "SELECT event_id, CAST(CASE WHEN event_id < 128 THEN 1 WHEN event_id < 16384 THEN 2 WHEN event_id < 2097152 THEN 3 ELSE 4 END AS INTEGER) AS n FROM events")
def leb128_size(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.leb128_bytes(F.col("event_id")).alias("n"))


_V = "(SELECT event_id, event_id - 500 AS v FROM events)"
for _name, _base, _sql in (
    ("format_bin", 2, "CASE WHEN v < 0 THEN '-' ELSE '' END || '0b' || to_base(abs(v), 2)"),
    ("format_oct", 8, "CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN v = 0 THEN '0' ELSE '0' || to_base(abs(v), 8) END"),
    ("format_dec", 10, "CAST(v AS VARCHAR)"),
    ("format_hex", 16, "CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN v = 0 THEN '0' ELSE '0x' || lower(to_base(abs(v), 16)) END"),
):
    query(_name, f"SELECT event_id, {_sql} AS shown FROM {_V}")(
        lambda spark, sf_dir, base=_base: table(spark, sf_dir, "events").select("event_id", X.integer(F.col("event_id") - 500, base).alias("shown"))
    )


@query("format_float", "SELECT event_id, printf('%.6f', value) AS shown FROM events")
def format_float(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.real(F.col("value")).alias("shown"))


@query("format_bool", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '1' ELSE '0' END AS shown FROM events")
def format_bool(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.boolean(F.col("event_id") % 3 == 0).alias("shown"))


@query("format_nil", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'nil' ELSE '\"' || event_type || '\"' END AS shown FROM events")
def format_nil(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.nil(X.string(F.expr("nullif(event_type, 'view')"))).alias("shown"))


@query("format_blob", "SELECT event_id, lower(hex(encode(props))) AS shown FROM events")
def format_blob(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.blob(F.encode("props", "UTF-8")).alias("shown"))


@query("format_array", "SELECT p_partkey, '[' || array_to_string(string_split(p_name, ' '), ', ') || ']' AS shown FROM part")
def format_array(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.array(F.split("p_name", " ")).alias("shown"))


@query("format_struct", "SELECT p_partkey, '{ name: \"' || p_name || '\", size: ' || p_size || ' }' AS shown FROM part")
def format_struct(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.struct([("name", X.string(F.col("p_name"))), ("size", X.integer(F.col("p_size")))]).alias("shown"))


@query("format_labels", f"SELECT l_orderkey, l_linenumber, q || ': ' || CASE WHEN len({_LABELS}) = 0 THEN 'nil' ELSE '\"' || array_to_string({_LABELS}, '\",\"') || '\"' END AS shown FROM {_QUANTITY}")
def format_labels(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.labelled(X.integer(q), N.labels(q, RANGES)).alias("shown"))


_NANOS = "lpad(CAST(ts_ns % 1000000000 AS VARCHAR), 9, '0')"


@query("format_ts", _TR + f"SELECT event_id, strftime(make_timestamp(ts_ns // 1000), '[%H:%M:%S.') || {_NANOS} || ']' AS shown FROM tr")
def format_ts(spark, sf_dir):
    return trace(spark, sf_dir).select("event_id", X.timestamp(F.col("ts_ns")).alias("shown"))


@query("format_ts_date", _TR + f"SELECT event_id, strftime(make_timestamp(ts_ns // 1000), '[%Y-%m-%d %H:%M:%S.') || {_NANOS} || ']' AS shown FROM tr")
def format_ts_date(spark, sf_dir):
    return trace(spark, sf_dir).select("event_id", X.timestamp(F.col("ts_ns"), date=True).alias("shown"))


@query("format_ts_sec", _TR + f"SELECT event_id, '[' || ts_ns // 1000000000 || '.' || {_NANOS} || ']' AS shown FROM tr")
def format_ts_sec(spark, sf_dir):
    return trace(spark, sf_dir).select("event_id", X.timestamp(F.col("ts_ns"), seconds=True).alias("shown"))


@query("format_cycles", _TR + "SELECT event_id, '[' || lpad(CAST(ts_ns // 1000 AS VARCHAR), 20, '0') || ']' AS shown FROM tr")
def format_cycles(spark, sf_dir):
    return trace(spark, sf_dir).select("event_id", X.cycles(F.expr("ts_ns div 1000")).alias("shown"))


@query("format_prefix", _TR + "SELECT event_id, CASE WHEN event_name = 'view' THEN '' WHEN stream = 0 THEN event_name || ': ' ELSE 's' || stream || '::' || event_name || ': ' END AS shown FROM tr")
def format_prefix(spark, sf_dir):
    space = F.when(F.col("stream") != 0, F.concat(F.lit("s"), F.col("stream").cast("string")))
    return trace(spark, sf_dir).select("event_id", X.event_prefix(space, F.expr("nullif(event_name, 'view')")).alias("shown"))


@query(
    "format_event",
    _TR + f"SELECT event_id, strftime(make_timestamp(ts_ns // 1000), '[%H:%M:%S.') || {_NANOS} || '] ' || event_name || ': {{ event-payload: {{ event_id: ' || event_id || ', user_id: ' || user_id || "
    "', value: ' || printf('%.6f', value) || ', props: \"' || props || '\" } }' AS line FROM tr",
)
def format_event(spark, sf_dir):
    events = read_trace(spark, event_trace(spark, sf_dir))
    return events.select(F.col("payload.event_id").alias("event_id"), X.event(events, with_labels=True, properties=["payload"]).alias("line"))


@query("parse_ts", "SELECT o_orderkey, CAST(epoch_us(o_orderdate) AS BIGINT) * 1000 + o_orderkey % 1000 AS ns FROM orders")
def parse_ts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd HH:mm:ss"), F.lit("."), (F.col("o_orderkey") % 1000).cast("string"))
    return o.select("o_orderkey", X.parse_timestamp_column(text).alias("ns"))


@query("parse_ts_seconds", "SELECT o_orderkey, -(o_orderkey * 1000000000 + o_orderkey % 7) AS ns FROM orders")
def parse_ts_seconds(spark, sf_dir):
    text = F.concat(F.lit("-"), F.col("o_orderkey").cast("string"), F.lit("."), (F.col("o_orderkey") % 7).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.parse_timestamp_column(text).alias("ns"))


_CLASSES = "(SELECT event_type AS event_name, row_number() OVER (ORDER BY event_type) - 1 AS event_class_id FROM (SELECT DISTINCT event_type FROM events))"


@query("catalog_events", f"SELECT event_name, event_class_id FROM {_CLASSES}")
def catalog_events(spark, sf_dir):
    from .plans.catalog import catalog_rows
    from .sources.metadata import Catalog

    schema, rows = catalog_rows(Catalog.parse(event_metadata()))["event_classes"]
    return spark.createDataFrame(rows, schema).select(F.col("name").alias("event_name"), F.col("id").cast("bigint").alias("event_class_id"))


@query("catalog_lookup_join", f"SELECT event_id, event_class_id FROM events JOIN {_CLASSES} c ON c.event_name = event_type")
def catalog_lookup_join(spark, sf_dir):
    classes = catalog_events(spark, sf_dir)
    return trace(spark, sf_dir).join(classes, "event_name").select("event_id", "event_class_id")


@query("saturating_add", f"SELECT event_id, CAST(least(CAST(event_id AS HUGEINT) + {_U64}::HUGEINT - 100, {_U64}::HUGEINT) AS VARCHAR) AS v FROM events")
def saturating_add(spark, sf_dir):
    near = F.lit(str(N.U64_MAX - 100)).cast(N.U64)
    return table(spark, sf_dir, "events").select("event_id", N.saturating_add(F.col("event_id"), near).cast("string").alias("v"))


from . import decoded_queries  # noqa: E402, F401  (registers its queries)
