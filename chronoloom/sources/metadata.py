"""The metadata of a trace: fragments of lenient JSON, checked and linked to a catalog of classes."""

from __future__ import annotations

import json
import re
import struct
from dataclasses import dataclass, field
from typing import Any

from ..errors import Code, TraceError
from .classes import STATIC_BLOB, STRUCTURE, FieldClass, integer, json_object, mapping, parse_class, required, sequence, text, wrong

# The header of a metadata packet.
PACKET_MAGIC = 0x75D11D57
PACKET_HEADER_BYTES = 44
PACKET_VERSION = (2, 0)
SEPARATOR = b"\x1e"


@dataclass
class Clock:
    id: str
    frequency: int
    offset_seconds: int = 0
    offset_cycles: int = 0
    origin: str | tuple[str | None, str, str] | None = None  # unix-epoch, (namespace, name, uid) or none
    precision: int | None = None
    accuracy: int | None = None
    namespace: str | None = None
    name: str | None = None
    uid: str | None = None
    description: str | None = None
    attributes: Any = None
    extensions: Any = None

    def ns(self, cycles: int) -> int:
        """Nanoseconds from origin; sums wrap as 64-bit unsigned integers do."""
        cycles = (cycles + self.offset_cycles) & ((1 << 64) - 1)
        return (self.offset_seconds + cycles // self.frequency) * 1_000_000_000 + cycles % self.frequency * 1_000_000_000 // self.frequency

    def same_identity(self, other: Clock, strict: bool = False) -> bool:
        keys = ("namespace", "name", "uid", *(("frequency", "precision", "accuracy", "origin") if strict else ()))
        return all(getattr(self, k) == getattr(other, k) for k in keys)


@dataclass
class EventClass:
    id: int
    stream_class_id: int
    namespace: str | None = None
    name: str | None = None
    uid: str | None = None
    specific_context: FieldClass | None = None
    payload: FieldClass | None = None
    attributes: Any = None
    extensions: Any = None


@dataclass
class StreamClass:
    id: int
    namespace: str | None = None
    name: str | None = None
    uid: str | None = None
    clock: Clock | None = None
    packet_context: FieldClass | None = None
    event_header: FieldClass | None = None
    common_context: FieldClass | None = None
    events: dict[int, EventClass] = field(default_factory=dict)
    attributes: Any = None
    extensions: Any = None


@dataclass
class Catalog:
    uuid: bytes | None = None
    preamble: dict = field(default_factory=dict)
    trace: dict | None = None
    packet_header: FieldClass | None = None
    clocks: dict[str, Clock] = field(default_factory=dict)
    streams: dict[int, StreamClass] = field(default_factory=dict)
    aliases: dict[str, FieldClass] = field(default_factory=dict)
    alias_properties: dict[str, dict] = field(default_factory=dict)

    @staticmethod
    def parse(data: bytes | str) -> Catalog:
        raw = data.encode() if isinstance(data, str) else data
        out, first = Catalog(), True
        for piece in unwrap_packets(raw).split(SEPARATOR):
            if piece.strip():
                _add_fragment(out, lenient_json(piece.decode()), first)
                first = False
        return out

    def roots(self):
        """(stream class id, event class id, property, class) of every top-level structure."""
        if self.packet_header:
            yield None, None, "packet_header", self.packet_header
        for s in self.streams.values():
            for name in ("packet_context", "event_header", "common_context"):
                if getattr(s, name):
                    yield s.id, None, name, getattr(s, name)
            for e in s.events.values():
                for name in ("specific_context", "payload"):
                    if getattr(e, name):
                        yield s.id, e.id, name, getattr(e, name)


def unwrap_packets(raw: bytes) -> bytes:
    """The metadata stream in metadata packets, joined; anything else as it is."""
    order = next((o for o in "<>" if len(raw) >= 4 and struct.unpack(f"{o}I", raw[:4])[0] == PACKET_MAGIC), None)
    if order is None:
        return raw
    out, at, uuid = [], 0, None
    while at < len(raw):
        if len(raw) - at < PACKET_HEADER_BYTES:
            raise wrong(Code.JSON_PARSE_ERROR, "metadata packet: not enough data")
        magic, who, _, content, total, packed, crypted, summed, major, minor, header = struct.unpack(f"{order}I16sIIIBBBBB3xI", raw[at : at + PACKET_HEADER_BYTES])
        ok = (
            magic == PACKET_MAGIC and (uuid is None or who == uuid) and content % 8 == 0 and total % 8 == 0 and content <= total
            and not (packed or crypted or summed) and (major, minor) == PACKET_VERSION and header == 8 * PACKET_HEADER_BYTES and content >= header
        )
        if not ok:
            raise wrong(Code.INVALID_METADATA_PACKET, f"metadata packet at byte {at}")
        if at + total // 8 > len(raw):
            raise wrong(Code.JSON_PARSE_ERROR, "metadata packet: not enough data")
        uuid = who
        out.append(raw[at + PACKET_HEADER_BYTES : at + content // 8])
        at += total // 8
    return b"".join(out)


_COMMA = re.compile(r'"(?:[^"\\]|\\.)*"|,(?=\s*[}\]])')


def lenient_json(source: str) -> Any:
    """JSON in which a comma may follow the last element."""
    try:
        return json.loads(_COMMA.sub(lambda m: m[0] if m[0][0] == '"' else "", source))
    except json.JSONDecodeError as e:
        raise wrong(Code.JSON_PARSE_ERROR, str(e)) from None


def _add_fragment(c: Catalog, j: Any, first: bool) -> None:
    j = mapping(j, "fragment")
    kind = text(required(j, "type"), "type")
    if first != (kind == "preamble"):
        raise wrong(Code.NO_PREAMBLE if first else Code.DUPLICATE, "a preamble comes first, and once")
    if kind not in _FRAGMENTS:
        raise wrong(Code.JSON_ERROR, f"no fragment is called `{kind}`")
    try:
        _FRAGMENTS[kind](c, j)
    except TraceError as e:
        raise e.within(kind) from None


def _identity(j: dict) -> dict:
    return {k: text(j[k], k) if k in j else None for k in ("namespace", "name", "uid")}


def _extras(j: dict) -> dict:
    return {k: json_object(j, k) for k in ("attributes", "extensions")}


def _preamble(c: Catalog, j: dict) -> None:
    if integer(required(j, "version"), "version") != 2:
        raise wrong(Code.UNSUPPORTED_VERSION, f"{j['version']}")
    if "uuid" in j:
        found = sequence(j["uuid"], "uuid")
        if len(found) != 16 or any(isinstance(x, bool) or not isinstance(x, int) or not 0 <= x < 256 for x in found):
            raise wrong(Code.INVALID_UUID, "a uuid is 16 bytes")
        c.uuid = bytes(found)
    c.preamble = _extras(j)
    if c.preamble["extensions"]:
        raise wrong(Code.UNSUPPORTED_EXTENSION, ", ".join(c.preamble["extensions"]))


def _alias(c: Catalog, j: dict) -> None:
    name = text(required(j, "name"), "name")
    if name in c.aliases:
        raise wrong(Code.DUPLICATE, f"alias `{name}`")
    c.aliases[name] = parse_class(required(j, "field-class"), c.aliases)
    c.alias_properties[name] = _extras(j)


def _structure(c: Catalog, j: dict, key: str) -> FieldClass | None:
    if key not in j:
        return None
    try:
        out = parse_class(j[key], c.aliases)
    except TraceError as e:
        raise e.within(key) from None
    if out.kind != STRUCTURE:
        raise wrong(Code.NOT_A_STRUCT, key)
    return out


def _in_structures(cls: FieldClass):
    """Members of nested structures; what is inside arrays, optionals and variants is not looked at."""
    for k, m in enumerate(cls.members):
        yield k, m.cls
        if m.cls.kind == STRUCTURE:
            yield from ((None, x) for _, x in _in_structures(m.cls))


def _check_clock_roles(cls: FieldClass | None, clock: Clock | None) -> None:
    if cls and not clock and any(m.roles & {"default-clock-timestamp", "packet-end-default-clock-timestamp"} for _, m in _in_structures(cls)):
        raise wrong(Code.NO_DEFAULT_CLOCK, "a timestamp without a default clock")


def _trace(c: Catalog, j: dict) -> None:
    if c.trace is not None:
        raise wrong(Code.DUPLICATE, "a second trace class")
    environment = json_object(j, "environment")
    if environment and any(isinstance(v, bool) or not isinstance(v, (int, str)) for v in environment.values()):
        raise wrong(Code.INVALID_ENVIRONMENT, "an environment has integers and strings only")
    c.packet_header = _structure(c, j, "packet-header-field-class")
    for k, m in _in_structures(c.packet_header) if c.packet_header else ():
        if "metadata-stream-uuid" in m.roles and (c.uuid is None or m.kind != STATIC_BLOB or m.length != 16):
            raise wrong(Code.INVALID_UUID_ROLE, "the uuid needs one in the preamble and 16 bytes")
        if "packet-magic-number" in m.roles and k != 0:
            raise wrong(Code.INVALID_MAGIC_ROLE, "the magic number is the first member")
    c.trace = {**_identity(j), "environment": environment, **_extras(j)}


def _clock(c: Catalog, j: dict) -> None:
    name = text(required(j, "id"), "id")
    if name in c.clocks:
        raise wrong(Code.DUPLICATE, f"clock `{name}`")
    offset = mapping(j.get("offset-from-origin", {}), "offset-from-origin")
    origin = j.get("origin")
    if isinstance(origin, str):
        if origin != "unix-epoch":
            raise wrong(Code.NO_SUCH_ORIGIN, f"`{origin}`")
    elif origin is not None:
        o = mapping(origin, "origin")
        origin = (text(o["namespace"], "namespace") if "namespace" in o else None, text(required(o, "name"), "name"), text(required(o, "uid"), "uid"))
    clock = Clock(
        name, integer(required(j, "frequency"), "frequency", 1), integer(offset.get("seconds", 0), "seconds"), integer(offset.get("cycles", 0), "cycles", 0), origin,
        *(integer(j[k], k, 0) if k in j else None for k in ("precision", "accuracy")), **_identity(j),
        description=text(j["description"], "description") if "description" in j else None, **_extras(j),
    )
    if clock.offset_cycles >= clock.frequency:
        raise wrong(Code.CYCLES_GTE_FREQUENCY, f"{clock.offset_cycles} cycles at {clock.frequency} Hz")
    c.clocks[name] = clock


def _stream(c: Catalog, j: dict) -> None:
    number = integer(j.get("id", 0), "id", 0)
    if number in c.streams:
        raise wrong(Code.DUPLICATE, f"data stream class {number}")
    clock = None
    if "default-clock-class-id" in j:
        clock = c.clocks.get(text(j["default-clock-class-id"], "default-clock-class-id"))
        if clock is None:
            raise wrong(Code.NO_SUCH_ID, f"no clock class is called `{j['default-clock-class-id']}`")
    keys = ("packet-context-field-class", "event-record-header-field-class", "event-record-common-context-field-class")
    found = [_structure(c, j, k) for k in keys]
    for cls in found[:2]:
        _check_clock_roles(cls, clock)
    c.streams[number] = StreamClass(number, **_identity(j), clock=clock, packet_context=found[0], event_header=found[1], common_context=found[2], **_extras(j))


def _event(c: Catalog, j: dict) -> None:
    stream = integer(j.get("data-stream-class-id", 0), "data-stream-class-id", 0)
    number = integer(j.get("id", 0), "id", 0)
    if stream not in c.streams:
        raise wrong(Code.NO_SUCH_ID, f"no data stream class {stream}")
    if number in c.streams[stream].events:
        raise wrong(Code.DUPLICATE, f"event record class {number}")
    found = [_structure(c, j, k) for k in ("specific-context-field-class", "payload-field-class")]
    c.streams[stream].events[number] = EventClass(number, stream, **_identity(j), specific_context=found[0], payload=found[1], **_extras(j))


_FRAGMENTS = {
    "preamble": _preamble,
    "field-class-alias": _alias,
    "trace-class": _trace,
    "clock-class": _clock,
    "data-stream-class": _stream,
    "event-record-class": _event,
}
