"""The Spark data source `trace`: events or packets of trace directories, one partition per group of packets.

Options: path (a directory, or several as a JSON list or one per line), view (events or packets), eventClass (name or id of one event class),
properties (comma-separated; none are all), metadataFile, batchSize (rows of an Arrow batch), packetBytes (bytes of packets per partition),
beginNs and endNs (packets wholly outside of this time are left out), mode (FAILFAST raises; PERMISSIVE adds a row with _error after the valid events; DROPTAIL leaves the rest of the stream out).

Files are read where executors see them as paths. `decode_files` decodes what Spark's binaryFile reads instead.
"""

from __future__ import annotations

import json
import mmap
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import TraceError
from ..plans.schema import ERROR_COLUMN, EVENT_COLUMNS, PACKET_COLUMNS, Layout, arrow_type
from .columnar import ColumnarDecoder
from .decoder import PROPERTIES, Event, PacketState, StreamDecoder
from .metadata import Catalog

_SHIPPED = ("chronoloom.errors", "chronoloom.plans.schema", "chronoloom.sources.classes", "chronoloom.sources.metadata", "chronoloom.sources.decoder", "chronoloom.sources.columnar", "chronoloom.sources.trace_source")
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def trace_paths(options: dict) -> list[str]:
    given = options.get("path") or options.get("paths") or ""
    if given.startswith("["):
        return [str(p) for p in json.loads(given)]
    return [p for p in given.splitlines() if p]


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def stream_files(directory: str, metadata_name: str) -> list[str]:
    """Data streams of a directory in order of name: regular files with content, but the metadata and hidden ones."""
    with os.scandir(local(directory)) as found:
        return sorted(f.name for f in found if f.name != metadata_name and not f.name.startswith(".") and f.is_file() and f.stat().st_size)


def load_catalog(directory: str, metadata_name: str = "metadata") -> Catalog:
    with open(os.path.join(local(directory), metadata_name), "rb") as f:
        return Catalog.parse(f.read())


def mapped(path: str):
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


@dataclass
class Slice(InputPartition):
    """Packets of a file from a place on: how many (None: to the end), and the index of the first."""

    trace: int
    directory: str
    file: str
    start: int
    index: int
    count: int | None

    def __init__(self, trace, directory, file, start, index, count):
        super().__init__(None)
        self.trace, self.directory, self.file, self.start, self.index, self.count = trace, directory, file, start, index, count


def _ns(stream, cycles: int | None) -> int | None:
    if cycles is None:
        return None
    value = stream.clock.ns(cycles) if stream.clock else 0
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


def packet_values(trace: int, directory: str, file: str, s: PacketState) -> dict:
    return {
        "trace_idx": trace, "trace_path": directory, "stream_file": file, "packet_idx": s.index, "stream_class_id": s.stream.id,
        "stream_id": s.stream_id, "pkt_seq_num": s.sequence, "pkt_begin_cycles": s.begin, "pkt_begin_ns": _ns(s.stream, s.begin),
        "pkt_end_cycles": s.end, "pkt_end_ns": _ns(s.stream, s.end), "pkt_disc_snapshot": s.discarded, "pkt_content_bits": s.content, "pkt_total_bits": s.total,
    }


class Rows:
    """Collects events to Arrow batches. What a packet's events share is kept once for them all."""

    _OWN = ("event_idx", "event_class_id", "event_ns", "event_name", "ts_cycles", "ts_ns", "has_clock")

    def __init__(self, layout: Layout, schema: T.StructType, size: int):
        self.layout, self.size = layout, size
        self.names = schema.names
        self.kinds = [arrow_type(f.dataType) for f in schema.fields]
        self.properties = [p for p in layout.properties if p in self.names and p not in PROPERTIES[:2]]
        self.shared = [p for p in PROPERTIES[:2] if p in self.names and p in layout.properties]
        self.clear()

    def clear(self):
        self.runs: list[list] = []  # base, events, packet's own properties
        self.rows: list[tuple] = []
        self.errors: list[str | None] = []
        self.n = 0

    def add(self, base: dict, event: Event | None, error: str | None = None) -> None:
        if not self.runs or self.runs[-1][0] is not base:
            trace, values = base["trace_idx"], {}
            if event is not None:
                for p in self.shared:
                    values[p] = self.layout.value(p, trace, event.packet.stream.id, event.cls.id, event.properties[p])
            self.runs.append([base, 0, values])
        self.runs[-1][1] += 1
        if event is None:
            self.rows.append((None,) * (len(self._OWN) + len(self.properties)))
        else:
            s, cls = event.packet, event.cls
            clock = s.stream.clock
            own = (event.index, cls.id, cls.namespace, cls.name, event.cycles, _ns(s.stream, event.cycles) if clock else 0, clock is not None)
            value, trace, stream = self.layout.value, base["trace_idx"], s.stream.id
            self.rows.append(own + tuple(value(p, trace, stream, cls.id, event.properties[p]) for p in self.properties))
        self.errors.append(error)
        self.n += 1

    def batch(self) -> pa.RecordBatch:
        own = dict(zip((*self._OWN, *self.properties), zip(*self.rows, strict=True), strict=True))
        arrays = []
        for name, kind in zip(self.names, self.kinds, strict=True):
            if name in own:
                arrays.append(pa.array(own[name], kind))
            elif name == ERROR_COLUMN:
                arrays.append(pa.array(self.errors, kind))
            else:
                arrays.append(pa.concat_arrays([pa.repeat(pa.scalar(base.get(name, values.get(name)), kind), n) for base, n, values in self.runs]))
        out = pa.RecordBatch.from_arrays(arrays, names=self.names)
        self.clear()
        return out


class Settings:
    """What reading needs to know: options, catalogs and layout."""

    def __init__(self, options: dict):
        self.paths = trace_paths(options)
        self.metadata_name = options.get("metadatafile", options.get("metadataFile", "metadata"))
        get = lambda name, other=None: options.get(name, options.get(name.lower(), other))
        self.view, self.mode = get("view", "events"), str(get("mode", "FAILFAST")).upper()
        self.batch, self.packet_bytes = int(get("batchSize", 4096)), int(get("packetBytes", 32 << 20))
        chosen = tuple(p.strip().replace("-", "_") for p in (get("properties") or "").split(",") if p.strip())
        self.catalogs = [load_catalog(p, self.metadata_name) for p in self.paths]
        self.layout = Layout(self.catalogs, get("eventClass"), chosen or PROPERTIES)
        self.low, self.high = int(get("beginNs", LOWEST)), int(get("endNs", HIGHEST))
        self.files = {f for f in (get("file") or "").split(",") if f}
        if self.mode not in ("FAILFAST", "PERMISSIVE", "DROPTAIL"):
            raise ValueError(f"no mode is called {self.mode}")

    def schema(self) -> T.StructType:
        if self.view == "packets":
            return T.StructType([T.StructField(n, t) for n, t in PACKET_COLUMNS])
        return self.layout.schema(self.mode == "PERMISSIVE")

    def streams(self) -> Iterator[tuple[int, str, str]]:
        for t, directory in enumerate(self.paths):
            for name in stream_files(directory, self.metadata_name):
                if not self.files or name in self.files:
                    yield t, directory, name


def decode_slice(s: Settings, schema: T.StructType, at: Slice, data) -> Iterator[pa.RecordBatch]:
    """The rows of a slice. Packets whose times say that nothing of them lies in the range asked for are not decoded."""
    rows = Rows(s.layout, schema, s.batch)
    decoder = StreamDecoder(s.catalogs[at.trace], data)
    columns, held = ColumnarDecoder(s.catalogs[at.trace], s.layout, rows.names, rows.kinds), []
    base: dict = {"trace_idx": at.trace, "trace_path": at.directory, "stream_file": at.file, "packet_idx": at.index}
    try:
        for packet in islice(decoder.packets(at.start, at.index), at.count):
            base = packet_values(at.trace, at.directory, at.file, packet)
            if s.view == "packets":
                rows.add(base, None)
            elif outside(base, s.low, s.high):
                continue
            elif (made := columns.batch(data, packet, base)) is not None:
                if rows.n:
                    yield rows.batch()
                held.append(made)
                if sum(b.num_rows for b in held) >= s.batch:
                    yield pa.concat_batches(held)
                    held.clear()
            else:
                if held:
                    yield pa.concat_batches(held)
                    held.clear()
                for event in decoder.events(packet):
                    if s.layout.wanted(event.cls):
                        rows.add(base, event)
                        if rows.n >= s.batch:
                            yield rows.batch()
            if rows.n >= s.batch:
                yield rows.batch()
    except TraceError as e:
        if held:
            yield pa.concat_batches(held)
            held.clear()
        if s.mode == "FAILFAST":
            if rows.n:
                yield rows.batch()
            raise
        if s.mode == "PERMISSIVE" and s.view == "events":
            rows.add(base, None, str(e))
    if held:
        yield pa.concat_batches(held)
    if rows.n:
        yield rows.batch()


def outside(packet: dict, low: int, high: int) -> bool:
    """Whether a packet's own times put it wholly before low or after high."""
    begin, end = packet["pkt_begin_ns"], packet["pkt_end_ns"]
    return (end is not None and end < low) or (begin is not None and begin > high)


def slices(s: Settings, t: int, directory: str, name: str) -> list[Slice]:
    """Groups of a file's packets by a walk over headers and contexts. A stream with an error ends in a slice that runs into it."""
    out: list[Slice] = []
    decoder = StreamDecoder(s.catalogs[t], mapped(os.path.join(local(directory), name)))
    group: Slice | None = None
    size = 0
    try:
        for p in decoder.packets():
            if s.view == "events" and outside(packet_values(t, directory, name, p), s.low, s.high):
                group = None
                continue
            if group is None or size >= s.packet_bytes:
                group, size = Slice(t, directory, name, p.start, p.index, 0), 0
                out.append(group)
            group.count += 1
            size += (p.total or 0) // 8
            if p.total is None:
                group.count = None
    except TraceError:
        if group is None:
            group = Slice(t, directory, name, 0, 0, None)
            out.append(group)
        group.count = None
    return out


class TraceReader(DataSourceReader):
    def __init__(self, settings: Settings, schema: T.StructType):
        self.settings, self.schema = settings, schema

    def partitions(self):
        return [s for file in self.settings.streams() for s in slices(self.settings, *file)] or [InputPartition(None)]

    def read(self, partition):
        if isinstance(partition, Slice):
            data = mapped(os.path.join(local(partition.directory), partition.file))
            yield from decode_slice(self.settings, self.schema, partition, data)


class TraceStreamReader(DataSourceStreamReader):
    """Growing traces: the offset holds each file's next packet; only whole packets are read."""

    def __init__(self, settings: Settings, schema: T.StructType):
        self.settings, self.schema = settings, schema

    def initialOffset(self) -> dict:
        return {}

    def _ends(self, start: dict) -> dict:
        """By file: bytes and packets that are complete."""
        out = dict(start)
        for t, directory, name in self.settings.streams():
            key = json.dumps([t, directory, name])
            at, index = start.get(key, [0, 0])
            data = mapped(os.path.join(local(directory), name))
            try:
                for p in StreamDecoder(self.settings.catalogs[t], data).packets(8 * at, index):
                    if p.total is None or p.start + p.total > 8 * len(data):
                        break
                    at, index = (p.start + p.total) // 8, p.index + 1
            except TraceError:
                pass  # a packet's start may be all that is there yet
            out[key] = [at, index]
        return out

    def latestOffset(self, *args) -> dict:
        return self._ends(getattr(self, "_last", {}))

    def partitions(self, start: dict, end: dict):
        self._last = end
        out = []
        for key, (at, index) in end.items():
            t, directory, name = json.loads(key)
            was, first = start.get(key, [0, 0])
            if index > first:
                out.append(Slice(t, directory, name, 8 * was, first, index - first))
        return out or [InputPartition(None)]

    def read(self, partition):
        if isinstance(partition, Slice):
            data = mapped(os.path.join(local(partition.directory), partition.file))
            yield from decode_slice(self.settings, self.schema, partition, data)

    def commit(self, end: dict) -> None:
        pass


class TraceDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trace"

    @property
    def settings(self) -> Settings:
        return Settings(dict(self.options))

    def schema(self) -> T.StructType:
        return self.settings.schema()

    def reader(self, schema: T.StructType) -> TraceReader:
        return TraceReader(self.settings, schema)

    def streamReader(self, schema: T.StructType) -> TraceStreamReader:
        return TraceStreamReader(self.settings, schema)


def register(spark: SparkSession) -> None:
    """Makes format("trace") known to a session."""
    for module in _SHIPPED:  # workers need not have the package installed
        register_pickle_by_value(sys.modules[module])
    spark.dataSource.register(TraceDataSource)


#: Bytes of data streams beyond which packets are listed by executors.
PLAN_BYTES = 8 << 30


def _bytes(paths: tuple[str, ...], options: dict) -> int:
    name = options.get("metadataFile", "metadata")
    return sum(os.path.getsize(os.path.join(local(p), f)) for p in paths for f in stream_files(p, name))


def read_trace(spark: SparkSession, *paths: str, begin_ns: int | None = None, end_ns: int | None = None, **options) -> DataFrame:
    """Events of trace directories, of a time range if one is given.

    planner: `driver` lists packets as the data source is planned, `executors` in a job with a task for each file; left out, the size
    of the files decides. The range goes to the source as options, so that packets outside of it are neither decoded nor given a task, and is applied to events
    again. It isn't left to filters pushed by Spark: 4.1 keeps what it pushed to a Python source for later queries on the same DataFrame."""
    register(spark)
    bounds = {"beginNs": begin_ns, "endNs": end_ns}
    planner = options.pop("planner", None)
    given = {k: str(v) for k, v in {**options, **bounds}.items() if v is not None}
    if planner == "executors" or (planner is None and options.get("view", "events") == "events" and _bytes(paths, given) > PLAN_BYTES):
        settings = Settings({**given, "path": json.dumps(list(paths))})
        found = plan_on_executors(spark, settings)
        # A round-robin deal keeps a file's slices from being one task.
        out = decode_slices(found.repartition(max(1, _bytes(paths, given) // settings.packet_bytes + 1)), settings, settings.schema())
    else:
        out = spark.read.format("trace").options(**given).load(json.dumps(list(paths)))
    if options.get("view", "events") == "events":
        for bound, test in ((begin_ns, lambda t: t >= begin_ns), (end_ns, lambda t: t <= end_ns)):
            if bound is not None:
                out = out.where(test(F.col("ts_ns")) | F.col("ts_ns").isNull())
    return out


_SLICES = "trace int, directory string, file string, start long, index long, count long"


def plan_on_executors(spark: SparkSession, settings: Settings) -> DataFrame:
    """The slices of a trace's files as rows: each file's packet headers are walked by a task of its own, not by the driver."""
    files = [(t, directory, name) for t, directory, name in settings.streams()]
    names = spark.createDataFrame(files, "trace int, directory string, file string")

    def walk(batches):
        for batch in batches:
            for t, directory, name in zip(*(batch.column(c).to_pylist() for c in ("trace", "directory", "file")), strict=True):
                found = slices(settings, t, directory, name)
                rows = [(s.trace, s.directory, s.file, s.start, s.index, s.count) for s in found]
                kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["trace", "directory", "file", "start", "index", "count"])

    return names.repartition(max(1, len(files)), "trace", "directory", "file").mapInArrow(walk, _SLICES)


def decode_slices(found: DataFrame, settings: Settings, schema: T.StructType) -> DataFrame:
    """Events of slices, dealt to tasks."""

    def run(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = mapped(os.path.join(local(row[1]), row[2]))
                yield from decode_slice(settings, schema, Slice(*row), data)

    return found.mapInArrow(run, schema)


def decode_files(files: DataFrame, metadata: bytes, **options) -> DataFrame:
    """Events of in-memory streams: rows (path, content) as binaryFile gives them, all of one trace's metadata."""
    catalog = Catalog.parse(metadata)
    layout = Layout([catalog], options.get("eventClass"))
    schema = layout.schema()
    size = int(options.get("batchSize", 4096))

    class Given:
        catalogs, view, mode, batch = [catalog], "events", options.get("mode", "FAILFAST"), size
        low, high = LOWEST, HIGHEST

    Given.layout = layout

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if content:
                    yield from decode_slice(Given, schema, Slice(0, os.path.dirname(path), os.path.basename(path), 0, 0, None), content)

    return files.select("path", "content").mapInArrow(run, schema)


__all__ = ["EVENT_COLUMNS", "TraceDataSource", "decode_files", "load_catalog", "read_trace", "register", "stream_files"]
