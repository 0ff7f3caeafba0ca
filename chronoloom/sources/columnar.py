"""Packets whose events all have one fixed size, decoded at once by numpy instead of event by event."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa

from ..plans.schema import Layout
from . import classes as c
from .decoder import PROPERTIES, PacketState, member_names
from .metadata import Catalog, StreamClass

_KINDS = {c.FIXED_UINT: "u", c.FIXED_BITS: "u", c.FIXED_SINT: "i", c.FIXED_FLOAT: "f"}
_OF_EVENT = PROPERTIES[2:]


def record_format(cls: c.FieldClass | None) -> tuple[list[str], list[str]] | None:
    """Columns and numpy formats of a structure of byte-sized numbers without gaps; None for any other."""
    if cls is None:
        return [], []
    formats, at = [], 0
    for m in cls.members:
        x = m.cls
        if x.kind not in _KINDS or x.length not in (8, 16, 32, 64) or x.bit_order != c.NATURAL_BIT_ORDER[x.byte_order] or x.alignment > 8:
            return None
        formats.append(("<" if x.byte_order == "little-endian" else ">") + _KINDS[x.kind] + str(x.length // 8))
        at += x.length // 8
    return (member_names(cls.members), formats) if cls.effective_alignment <= 8 else None


class StreamPlan:
    """How the events of a stream class lie in bytes, if they all have one size."""

    def __init__(self, stream: StreamClass):
        self.stream, self.views, self.size = stream, {}, None
        for number, event in stream.events.items():
            at, views = 0, {}
            for prop, cls in zip(_OF_EVENT, (stream.event_header, stream.common_context, event.specific_context, event.payload), strict=True):
                found = record_format(cls)
                if found is None:
                    return
                sizes = [np.dtype(f).itemsize for f in found[1]]
                if cls is not None:
                    offsets = [at + sum(sizes[:i]) for i in range(len(sizes))]
                    views[prop] = (cls, found[0], found[1], offsets)
                at += sum(sizes)
            if at == 0 or self.size not in (None, at):
                self.size = None
                return
            self.size, self.views[number] = at, views

    @cached_property
    def usable(self) -> bool:
        clock = self.stream.clock
        return bool(self.size) and len(self.views) == len(self.stream.events) and (clock is None or clock.frequency < 9_000_000_000)

    def role(self, name: str) -> tuple[str, int, int] | None:
        """Format, offset and bits of the header member with a role; the last one counts."""
        found = None
        header = next(iter(self.views.values())).get("event_header")
        if header:
            for m, f, at in zip(header[0].members, header[2], header[3], strict=True):
                if name in m.cls.roles:
                    found = (f, at, m.cls.length)
        return found


class ColumnarDecoder:
    def __init__(self, catalog: Catalog, layout: Layout, names: list[str], kinds: list[pa.DataType]):
        self.layout, self.names, self.kinds = layout, names, kinds
        self.plans = {n: StreamPlan(s) for n, s in catalog.streams.items()}

    def batch(self, data, s: PacketState, base: dict) -> pa.RecordBatch | None:
        """The events of a packet, or None if they have to be decoded one by one."""
        plan = self.plans[s.stream.id]
        if not plan.usable or s.content is None or s.first_event % 8 or s.start + s.content > 8 * len(data):
            return None
        bits = s.start + s.content - s.first_event
        n, rest = divmod(bits, 8 * plan.size)
        if rest or n <= 0:
            return None
        raw = np.frombuffer(data, np.uint8, n * plan.size, s.first_event // 8)

        def column(fmt: str, at: int) -> np.ndarray:
            view = np.dtype({"names": ["x"], "formats": [fmt], "offsets": [at], "itemsize": plan.size})
            return raw.view(view)["x"].astype(fmt[1:])  # native byte order

        at = plan.role("event-record-class-id")
        ids = column(*at[:2]).astype(np.uint64) if at else np.zeros(n, np.uint64)
        present = np.unique(ids).tolist()
        if any(i not in plan.views for i in present):
            return None
        cycles = self._cycles(plan, s, n, column)
        events = s.stream.events
        of_class = lambda f, kind: pa.array([f(events[i]) for i in present], kind).take(pa.array(np.searchsorted(np.array(present, np.uint64), ids)))
        values = {
            "event_idx": pa.array(np.arange(n)), "event_class_id": of_class(lambda e: e.id, pa.decimal128(20, 0)), "event_ns": of_class(lambda e: e.namespace, pa.string()),
            "event_name": of_class(lambda e: e.name, pa.string()), "ts_cycles": pa.array(cycles).cast(pa.decimal128(20, 0)), "ts_ns": pa.array(self._ns(s, cycles)),
            "has_clock": pa.repeat(pa.scalar(s.stream.clock is not None), n),
        }
        for p in self.layout.properties:
            if p in self.names:
                kind = self.kinds[self.names.index(p)]
                if p in _OF_EVENT:
                    values[p] = self._property(p, kind, plan, base["trace_idx"], ids, present, column, n)
                else:
                    decoded = s.header if p == "packet_header" else s.context
                    values[p] = pa.repeat(pa.scalar(self.layout.value(p, base["trace_idx"], s.stream.id, -1, decoded), kind), n)
        arrays = [values[x] if x in values else pa.repeat(pa.scalar(base.get(x), k), n) for x, k in zip(self.names, self.kinds, strict=True)]
        out = pa.RecordBatch.from_arrays(arrays, names=self.names)
        wanted = [i for i in present if self.layout.wanted(events[i])]
        return out if len(wanted) == len(present) else out.filter(pa.array(np.isin(ids, np.array(wanted, np.uint64))))

    def _cycles(self, plan: StreamPlan, s: PacketState, n: int, column) -> np.ndarray:
        at = plan.role("default-clock-timestamp")
        if at is None:
            return np.zeros(n, np.uint64)
        low = column(*at[:2]).astype(np.uint64)
        if at[2] == 64:
            return low
        turn = 1 << at[2]
        before = np.concatenate(([np.uint64(s.clock % turn)], low[:-1]))
        return np.uint64(s.clock - s.clock % turn) + low + np.cumsum(low < before).astype(np.uint64) * np.uint64(turn)

    @staticmethod
    def _ns(s: PacketState, cycles: np.ndarray) -> np.ndarray:
        clock = s.stream.clock
        if clock is None:
            return np.zeros(len(cycles), np.int64)
        total, f = cycles + np.uint64(clock.offset_cycles), np.uint64(clock.frequency)
        part = total % f * np.uint64(1_000_000_000) // f
        return (np.int64(clock.offset_seconds) + (total // f).view(np.int64)) * np.int64(1_000_000_000) + part.view(np.int64)

    def _property(self, p, kind, plan, trace, ids, present, column, n) -> pa.Array:
        """A property's struct column: of all events, or by class where classes differ."""

        def made(number: int, struct: pa.DataType, mask) -> pa.Array:
            _, columns, formats, offsets = plan.views[number][p]
            children = [pa.array(column(f, at)).cast(struct.field(i).type) for i, (f, at) in enumerate(zip(formats, offsets, strict=True))]
            if not columns:
                return pa.array([None if m else {} for m in mask], struct)
            return pa.StructArray.from_arrays(children, fields=list(struct), mask=pa.array(mask))

        owners, merged = self.layout.owners[p], self.layout.merged[p]
        parts: dict[str, pa.Array] = {}
        none = np.ones(n, bool)
        of = [(i, owners.get((trace, plan.stream.id, i)) or owners.get((trace, plan.stream.id, None))) for i in present if p in plan.views[i]]
        of = [(i, x[0]) for i, x in of if x]
        if not of:
            return pa.nulls(n, kind)
        shared = (trace, plan.stream.id, None) in owners
        if not merged:
            missing = ~np.isin(ids, np.array([i for i, _ in of], np.uint64))
            return made(of[0][0], kind, missing)
        for i, label in of:
            mask = np.zeros(n, bool) if shared else ids != i
            parts.setdefault(label, made(i, kind.field(label).type, mask))
            none &= mask
        children = [parts[f.name] if f.name in parts else pa.nulls(n, f.type) for f in kind]
        return pa.StructArray.from_arrays(children, fields=list(kind), mask=pa.array(none))

