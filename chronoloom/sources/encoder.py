"""Writing traces: rows to data streams, for round trips and tests. Covers what the classes of `trace_metadata` use and more."""

from __future__ import annotations

import json
import struct
from typing import Any

from . import classes as c
from .classes import FieldClass
from .decoder import member_names
from .metadata import PACKET_HEADER_BYTES, PACKET_MAGIC, PACKET_VERSION


class Bits:
    """Bits written so far, from the start of the file."""

    def __init__(self):
        self.data, self.pos = bytearray(), 0

    def align(self, n: int) -> None:
        self._grow(-(-self.pos // n) * n if n > 1 else self.pos)

    def _grow(self, pos: int) -> None:
        self.pos = pos
        self.data.extend(bytes(-(-pos // 8) - len(self.data)))

    def fixed(self, value: int, n: int, order: str) -> None:
        pos, inside = self.pos, self.pos & 7
        self._grow(pos + n)
        size = (inside + n + 7) // 8
        shift = inside if order == "little-endian" else 8 * size - inside - n
        side = "little" if order == "little-endian" else "big"
        at = pos >> 3
        old = int.from_bytes(self.data[at : at + size], side)
        self.data[at : at + size] = (old | (value & ((1 << n) - 1)) << shift).to_bytes(size, side)

    def bytes(self, raw: bytes) -> None:
        at = self.pos >> 3
        self._grow(self.pos + 8 * len(raw))
        self.data[at : at + len(raw)] = raw


def leb128(value: int, signed: bool) -> bytes:
    out = bytearray()
    while True:
        low, value = value & 0x7F, value >> 7
        done = (value == 0 and (not signed or not low & 0x40)) or (signed and value == -1 and low & 0x40)
        out.append(low if done else low | 0x80)
        if done:
            return bytes(out)


def encode(bits: Bits, cls: FieldClass, value: Any) -> None:
    """Appends a value. Structures are dicts by member name; variants are (option index, value), or as rows have them: `_tag` and a
    column for each option; strings get their null character."""
    k = cls.kind
    if k == c.OPTIONAL:
        if value is not None:
            encode(bits, cls.element, value)
        return
    if k == c.VARIANT:
        if isinstance(value, dict):
            value = (value["_tag"], value[member_names(cls.options)[value["_tag"]]])
        encode(bits, cls.options[value[0]].cls, value[1])
        return
    bits.align(cls.effective_alignment)
    if k in c.FIXED:
        if k == c.FIXED_FLOAT:
            a, b = (">f", ">I") if cls.length == 32 else (">d", ">Q")
            value = struct.unpack(b, struct.pack(a, value))[0]
        value = int(value) & ((1 << cls.length) - 1)
        if cls.bit_order != c.NATURAL_BIT_ORDER[cls.byte_order]:
            value = int(format(value, f"0{cls.length}b")[::-1], 2)
        bits.fixed(value, cls.length, cls.byte_order)
    elif k in (c.VAR_UINT, c.VAR_SINT):
        bits.bytes(leb128(value, k == c.VAR_SINT))
    elif k in c.STRINGS:
        raw = value.encode(cls.encoding)
        if k == c.NULL_STRING:
            raw += bytes(c.ENCODINGS[cls.encoding])
        elif k == c.STATIC_STRING:
            raw = raw.ljust(cls.length, b"\0")
        bits.bytes(raw)
    elif k in (c.STATIC_BLOB, c.DYNAMIC_BLOB):
        bits.bytes(value)
    elif k == c.STRUCTURE:
        for m in cls.members:
            encode(bits, m.cls, value[m.name])
    else:
        for x in value:
            encode(bits, cls.element, x)


def uint(name: str, length: int, *roles: str, **more) -> dict:
    """A member class: little-endian unsigned integer."""
    return {"name": name, "field-class": {"type": c.FIXED_UINT, "length": length, "byte-order": "little-endian", **({"roles": list(roles)} if roles else {}), **more}}


def member(name: str, kind: str, **more) -> dict:
    return {"name": name, "field-class": {"type": kind, **{k.replace("_", "-"): v for k, v in more.items()}}}


def structure(*members: dict) -> dict:
    return {"type": c.STRUCTURE, "member-classes": list(members)}


def trace_metadata(
    event_classes: dict[int, tuple[str, dict]], frequency: int = 1_000_000, uuid: bytes | None = None, aliases: dict[str, Any] | None = None, attributes: dict[int, dict] | None = None, **clock
) -> bytes:
    """Metadata of a trace with packet sizes, sequence numbers, a clock and named event classes (id: name, payload class).

    aliases are field classes by name, attributes those of event classes by id; further keywords are properties of the clock class."""
    own = [member("uuid", c.STATIC_BLOB, length=16, roles=["metadata-stream-uuid"])] if uuid else []
    header = structure(uint("magic", 32, "packet-magic-number"), *own, uint("stream_id", 32, "data-stream-id"))
    context = structure(
        uint("begin", 64, "default-clock-timestamp"),
        uint("end", 64, "packet-end-default-clock-timestamp"),
        uint("discarded", 64, "discarded-event-record-counter-snapshot"),
        uint("sequence", 64, "packet-sequence-number"),
        uint("content", 64, "packet-content-length"),
        uint("total", 64, "packet-total-length"),
    )
    record = structure(uint("ts", 64, "default-clock-timestamp"), uint("class", 16, "event-record-class-id"))
    fragments = [
        {"type": "preamble", "version": 2, **({"uuid": list(uuid)} if uuid else {})},
        *({"type": "field-class-alias", "name": name, "field-class": cls} for name, cls in (aliases or {}).items()),
        {"type": "trace-class", "packet-header-field-class": header},
        {"type": "clock-class", "id": "clock", "frequency": frequency, "origin": "unix-epoch"} | clock,
        {"type": "data-stream-class", "id": 0, "default-clock-class-id": "clock", "packet-context-field-class": context, "event-record-header-field-class": record},
        *({"type": "event-record-class", "id": i, "name": name, "payload-field-class": payload, **({"attributes": attributes[i]} if attributes else {})} for i, (name, payload) in event_classes.items()),
    ]
    return b"".join(b"\x1e" + json.dumps(f).encode() + b"\n" for f in fragments)


def metadata_packets(stream: bytes, uuid: bytes, order: str = "<", size: int = 100) -> bytes:
    """A metadata stream in metadata packets of `size` bytes of it each, so that fragments run over their ends."""
    out = b""
    for at in range(0, len(stream), size):
        part = stream[at : at + size]
        content = 8 * (PACKET_HEADER_BYTES + len(part))
        out += struct.pack(f"{order}I16sIIIBBBBB3xI", PACKET_MAGIC, uuid, 0, content, content + 64, 0, 0, 0, *PACKET_VERSION, 8 * PACKET_HEADER_BYTES) + part + bytes(8)
    return out


def encode_packet(catalog, stream_id: int, sequence: int, discarded: int, events: list[tuple[int, int, dict]]) -> bytes:
    """A packet of a `trace_metadata` trace; events are (clock value, event class id, payload)."""
    stream = catalog.streams[0]
    body = Bits()
    head = Bits()
    header = {"magic": 0xC1FC1FC1, "uuid": catalog.uuid, "stream_id": stream_id}
    encode(head, catalog.packet_header, header)
    context = {"begin": events[0][0], "end": events[-1][0], "discarded": discarded, "sequence": sequence, "content": 0, "total": 0}
    encode(head, stream.packet_context, context)
    body._grow(head.pos)
    for ts, number, payload in events:
        encode(body, stream.event_header, {"ts": ts, "class": number})
        encode(body, stream.events[number].payload, payload)
    content = body.pos
    body.align(64)
    head = Bits()
    encode(head, catalog.packet_header, header)
    encode(head, stream.packet_context, context | {"content": content, "total": body.pos})
    body.data[: len(head.data)] = head.data
    return bytes(body.data)
