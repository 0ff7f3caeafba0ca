"""Decoding: bits to Python values, compiled from field classes to closures.

A packet is decoded alone: its clock starts at 0 and nothing but its own bytes and the catalog is read. Structures whose members
all are plain byte-sized numbers decode in one `struct` call.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from ..errors import Code, TraceError
from . import classes as c
from .classes import FieldClass, Location
from .metadata import Catalog, EventClass, StreamClass

# Fixed value: the magic number of a packet.
PACKET_MAGIC = 0xC1FC1FC1
U64 = c.U64
UNBOUNDED = 1 << 80

PROPERTIES = ("packet_header", "packet_context", "event_header", "common_context", "specific_context", "payload")
_ROOT_OF = dict(zip(c.ORIGINS, PROPERTIES, strict=True))


class Bits:
    """A place in a buffer, in bits from the start of the file, and how far may be read."""

    __slots__ = ("data", "end", "limit", "order", "pos")

    def __init__(self, data, pos: int = 0):
        self.data, self.pos = data, pos
        self.end = self.limit = 8 * len(data)
        self.order: str | None = None

    def align(self, n: int) -> None:
        if n > 1:
            pos = -(-self.pos // n) * n
            if pos > self.limit:
                raise TraceError(Code.NOT_ENOUGH_BITS, "alignment goes beyond the packet")
            self.pos = pos

    def need(self, n: int) -> None:
        if self.pos + n > self.limit:
            raise TraceError(Code.NOT_ENOUGH_BITS, f"{n} bits wanted, {self.limit - self.pos} left")

    def fixed(self, n: int, order: str) -> int:
        pos, inside = self.pos, self.pos & 7
        if inside and self.order not in (None, order):
            raise TraceError(Code.MID_BYTE_ORDER_CHANGE)
        self.need(n)
        self.order = order
        self.pos = pos + n
        raw = self.data[pos >> 3 : (pos + n + 7) >> 3]
        if order == "little-endian":
            return (int.from_bytes(raw, "little") >> inside) & ((1 << n) - 1)
        return (int.from_bytes(raw, "big") >> (8 * len(raw) - inside - n)) & ((1 << n) - 1)

    def bytes(self, n: int) -> bytes:
        self.need(8 * n)
        at = self.pos >> 3
        self.pos += 8 * n
        return bytes(self.data[at : at + n])


class Frame:
    """A structure being decoded or decoded: where field locations look names up."""

    __slots__ = ("fields", "parent")

    def __init__(self, parent: Frame | None):
        self.fields: dict[str, tuple[Any, FieldClass | None]] = {}
        self.parent = parent


class Elements:
    """An array in the course of decoding; `now` is the structure that is its current element."""

    __slots__ = ("done", "now")

    def __init__(self):
        self.now: Any = None
        self.done = False


class At:
    """Where decoding is: the structure under way, the roots of field locations, and who hears of roles."""

    __slots__ = ("encoded", "frame", "handle", "roots")

    def __init__(self, roots: dict[str, Any], handle=None):
        self.roots, self.handle = roots, handle
        self.frame = Frame(None)
        self.encoded: int | None = None  # bits of the last variable-length integer


class Tagged(dict):
    """A variant's value: the index of its option and the value."""


def reversed_bits(v: int, n: int) -> int:
    return int(format(v, f"0{n}b")[::-1], 2)


def sign_extended(v: int, n: int) -> int:
    return v - (1 << n) if n and v >> (n - 1) & 1 else v


def read_leb128(bits: Bits) -> tuple[int, int]:
    """The unsigned value cut to 64 bits, and how many bits the encoding holds."""
    value = shift = 0
    while True:
        byte = bits.bytes(1)[0]
        value |= (byte & 0x7F) << shift
        shift += 7
        if not byte & 0x80:
            return value & U64, shift


def text_of(raw: bytes, encoding: str) -> str:
    """Bytes up to the first null character, decoded; bytes that are none are shown as `?`."""
    unit = c.ENCODINGS[encoding]
    end = next((i for i in range(0, len(raw) - unit + 1, unit) if not any(raw[i : i + unit])), None)
    if end is None and len(raw) % unit:
        raise TraceError(Code.INVALID_STRING_LENGTH, f"{len(raw)} bytes of {encoding}")
    return raw[:end].decode(encoding, "replace").replace("�", "?")


@dataclass
class PacketState:
    index: int = 0
    start: int = 0  # bits
    stream: StreamClass | None = None
    clock: int = 0
    stream_class_id: int = 0
    stream_id: int | None = None
    sequence: int | None = None
    begin: int | None = None
    end: int | None = None
    discarded: int | None = None
    content: int | None = None
    total: int | None = None
    first_event: int = 0  # bits
    header: Any = None
    context: Any = None
    frames: dict[str, Frame] = field(default_factory=dict)


@dataclass
class Event:
    packet: PacketState
    index: int
    cls: EventClass
    cycles: int
    properties: dict[str, Any]


#: decode(bits, at, place) -> (value, the class that it has). A structure or array tells place() of itself when it begins.
Decode = Callable[[Bits, At, Callable[[Any], None]], tuple[Any, FieldClass]]

_FORMATS = {(8, False): "B", (8, True): "b", (16, False): "H", (16, True): "h", (32, False): "I", (32, True): "i", (64, False): "Q", (64, True): "q"}


def _located(where: Location, at: At) -> tuple[Any, FieldClass]:
    """The field at a location, which must be decoded already."""
    missing = lambda why: TraceError(Code.MISSING_FIELD_LOCATION, f"{list(where.path)}: {why}")
    here: Any = at.frame
    if where.origin is not None:
        here = at.roots.get(_ROOT_OF[where.origin])
        if here is None:
            raise missing(f"no {where.origin}")
    found: tuple[Any, FieldClass | None] = (here, None)
    for k, name in enumerate(where.path):
        here = found[0]
        if isinstance(here, Elements):
            while isinstance(here, Elements):
                if here.done:
                    raise missing("already decoded array")
                here = here.now
        if not isinstance(here, Frame):
            raise missing(f"element {k} is in no structure")
        if name is None:
            if here.parent is None:
                raise missing("no structure is above")
            found = (here.parent, None)
        elif name in here.fields:
            found = here.fields[name]
        else:
            raise missing(f"`{name}` is not yet decoded")
    if isinstance(found[0], (Frame, Elements)):
        raise missing("it is neither boolean nor integer")
    return found


def _integer_at(where: Location, at: At) -> tuple[int | bool, FieldClass]:
    value, cls = _located(where, at)
    if cls.kind not in (*c.INTEGERS, c.FIXED_BITS, c.FIXED_BOOL) or value is None:
        raise TraceError(Code.MISSING_FIELD_LOCATION, "the field is neither boolean nor integer")
    return value, cls


def _length(cls: FieldClass, at: At) -> int:
    value, found = _integer_at(cls.length_location, at)
    if found.kind not in (c.FIXED_UINT, c.VAR_UINT, c.FIXED_BITS):
        raise TraceError(Code.WRONG_FIELD_TYPE, "a length is an unsigned integer")
    return value


def compile_class(cls: FieldClass) -> Decode:
    """The decoder of a field class."""
    return _COMPILERS[cls.kind](cls)


def _fixed(cls: FieldClass) -> Decode:
    n, order, align, turn = cls.length, cls.byte_order, cls.alignment, cls.bit_order != c.NATURAL_BIT_ORDER[cls.byte_order]
    if cls.kind == c.FIXED_SINT:
        finish = lambda v: sign_extended(v, n)
    elif cls.kind == c.FIXED_BOOL:
        finish = bool
    elif cls.kind == c.FIXED_FLOAT:
        pack, fmt = (struct.Struct("<I"), struct.Struct("<f")) if n == 32 else (struct.Struct("<Q"), struct.Struct("<d"))
        finish = lambda v: fmt.unpack(pack.pack(v))[0]
    else:
        finish = None

    def decode(bits, at, place):
        bits.align(align)
        v = bits.fixed(n, order)
        if turn:
            v = reversed_bits(v, n)
        return (finish(v) if finish else v), cls

    return decode


def _variable(cls: FieldClass) -> Decode:
    signed = cls.kind == c.VAR_SINT

    def decode(bits, at, place):
        bits.align(8)
        v, n = read_leb128(bits)
        at.encoded = n
        return (sign_extended(v, min(n, 64)) if signed else v), cls

    return decode


def _null_string(cls: FieldClass) -> Decode:
    unit, zero = c.ENCODINGS[cls.encoding], bytes(c.ENCODINGS[cls.encoding])

    def decode(bits, at, place):
        bits.align(8)
        start, last = bits.pos >> 3, bits.limit >> 3
        end = bits.data.find(zero, start, last)
        while end >= 0 and (end - start) % unit:
            end = bits.data.find(zero, end + 1, last)
        if end < 0:
            raise TraceError(Code.NOT_ENOUGH_BITS, "a string has no end")
        bits.pos = 8 * (end + unit)
        return text_of(bytes(bits.data[start : end + unit]), cls.encoding), cls

    return decode


def _sized(cls: FieldClass) -> Decode:
    """Strings and blobs of a static or dynamic length."""
    dynamic = cls.length_location is not None
    finish = (lambda raw: text_of(raw, cls.encoding)) if cls.kind in c.STRINGS else (lambda raw: raw)

    def decode(bits, at, place):
        bits.align(8)
        return finish(bits.bytes(_length(cls, at) if dynamic else cls.length)), cls

    return decode


def member_names(members: list[c.Member]) -> list[str]:
    """Names of columns for members or options: the second of a name gets #2, and so on; options without one are option_<index>."""
    seen: dict[str, int] = {}
    out = []
    for i, m in enumerate(members):
        name = f"option_{i}" if m.name is None else m.name
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}#{seen[name]}")
    return out


def _plain(cls: FieldClass) -> tuple[struct.Struct, int] | None:
    """A `struct` for a structure of byte-sized natural numbers of one byte order without gaps, and its alignment."""
    orders, fmt, at, align = set(), "", 0, cls.effective_alignment
    for m in cls.members:
        x = m.cls
        if x.kind not in (c.FIXED_UINT, c.FIXED_SINT, c.FIXED_FLOAT, c.FIXED_BITS) or x.bit_order != c.NATURAL_BIT_ORDER[x.byte_order]:
            return None
        code = {32: "f", 64: "d"}[x.length] if x.kind == c.FIXED_FLOAT else _FORMATS.get((x.length, x.kind == c.FIXED_SINT))
        if code is None or at % x.alignment or x.alignment > max(align, 1):
            return None
        orders.add(x.byte_order)
        fmt += code
        at += x.length
    if len(orders) != 1:
        return None
    return struct.Struct(("<" if orders == {"little-endian"} else ">") + fmt), align


def _runs(members: list[c.Member], names: list[str]) -> dict[int, tuple[struct.Struct, list[tuple[str, str, FieldClass]]]]:
    """By first index: runs of two members or more that one `struct` call decodes where they begin on a byte."""
    out, i = {}, 0
    while i < len(members):
        j = i
        while j < len(members) and members[j].cls.kind in c.FIXED and members[j].cls.alignment <= 8 and _plain(FieldClass(c.STRUCTURE, members=members[i : j + 1])):
            j += 1
        if j - i > 1:
            some = [(m.name, n, m.cls) for m, n in zip(members[i:j], names[i:j], strict=True)]
            out[i] = (_plain(FieldClass(c.STRUCTURE, members=members[i:j]))[0], some)
        i = max(j, i + 1)
    return out


def _structure(cls: FieldClass) -> Decode:
    names = member_names(cls.members)
    parts = [(m.name, n, compile_class(m.cls)) for m, n in zip(cls.members, names, strict=True)]
    align, plain = cls.effective_alignment, _plain(cls) if cls.members else None
    runs = _runs(cls.members, names)

    def members(bits, at, mine, out):
        fields, done = mine.fields, 0
        for i, (name, column, part) in enumerate(parts):
            if i < done:
                continue
            run = runs.get(i)
            if run and not bits.pos & 7 and bits.pos + 8 * run[0].size <= bits.limit:
                values = run[0].unpack_from(bits.data, bits.pos >> 3)
                bits.pos += 8 * run[0].size
                bits.order = run[1][0][2].byte_order
                for (member, key, inner), v in zip(run[1], values, strict=True):
                    out[key] = v
                    fields.setdefault(member, (v, inner))
                    if inner.roles and at.handle:
                        at.handle(v, inner, None)
                done = i + len(run[1])
                continue
            try:
                v, found = part(bits, at, lambda x, name=name: fields.setdefault(name, (x, None)))
            except TraceError as e:
                raise e.within(f"`{name}`") from None
            out[column] = v
            value = v["value"] if isinstance(v, Tagged) else v
            fields.setdefault(name, (value, found))
            if found.roles and at.handle:
                at.handle(value, found, at.encoded)

    def at_once(bits, at, mine, out):
        values = plain[0].unpack_from(bits.data, bits.pos >> 3)
        bits.pos += 8 * plain[0].size
        bits.order = cls.members[0].cls.byte_order
        for m, column, v in zip(cls.members, names, values, strict=True):
            out[column] = v
            mine.fields.setdefault(m.name, (v, m.cls))
            if m.cls.roles and at.handle:
                at.handle(v, m.cls, None)

    def decode(bits, at, place):
        bits.align(align)
        above, out = at.frame, {}
        at.frame = mine = Frame(above)
        place(mine)
        try:
            if plain and not bits.pos & 7 and bits.pos + 8 * plain[0].size <= bits.limit:
                at_once(bits, at, mine, out)
            else:
                members(bits, at, mine, out)
        finally:
            at.frame = above
        return out, cls

    return decode


def _array(cls: FieldClass) -> Decode:
    element, align, dynamic = compile_class(cls.element), cls.effective_alignment, cls.length_location is not None

    def decode(bits, at, place):
        n = _length(cls, at) if dynamic else cls.length
        bits.align(align)
        mine = Elements()
        place(mine)

        def now(x):
            mine.now = x

        # Roles of elements are not heeded.
        handle, at.handle = at.handle, None
        try:
            out = [element(bits, at, now)[0] for _ in range(n)]
        finally:
            at.handle = handle
        mine.done = True
        return out, cls

    return decode


def _optional(cls: FieldClass) -> Decode:
    inner = compile_class(cls.element)

    def decode(bits, at, place):
        value, found = _integer_at(cls.selector_location, at)
        if found.kind == c.FIXED_BOOL:
            there = value
        elif cls.selector_ranges is None:
            raise TraceError(Code.NO_SELECTOR_FIELD, "an integer selects by ranges, and there are none")
        else:
            there = c.contains(cls.selector_ranges, value)
        return inner(bits, at, place) if there else (None, cls)

    return decode


def _variant(cls: FieldClass) -> Decode:
    options = [(o.ranges, compile_class(o.cls)) for o in cls.options]

    def decode(bits, at, place):
        value, found = _integer_at(cls.selector_location, at)
        if found.kind == c.FIXED_BOOL:
            raise TraceError(Code.WRONG_FIELD_TYPE, "a boolean selects no option")
        for i, (ranges, option) in enumerate(options):
            if c.contains(ranges, value):
                v, inner = option(bits, at, place)
                return Tagged(tag=i, value=v), inner
        raise TraceError(Code.NO_SELECTOR_FIELD, f"no option for {value}")

    return decode


_COMPILERS = {
    **dict.fromkeys(c.FIXED, _fixed),
    c.VAR_UINT: _variable,
    c.VAR_SINT: _variable,
    c.NULL_STRING: _null_string,
    **dict.fromkeys((c.STATIC_STRING, c.DYNAMIC_STRING, c.STATIC_BLOB, c.DYNAMIC_BLOB), _sized),
    c.STRUCTURE: _structure,
    c.STATIC_ARRAY: _array,
    c.DYNAMIC_ARRAY: _array,
    c.OPTIONAL: _optional,
    c.VARIANT: _variant,
}


def advanced(clock: int, value: int, n: int) -> int:
    """The clock after a timestamp of n bits: its low bits are replaced, and a fall means one turn."""
    if n >= 64:
        return value
    low = clock & ((1 << n) - 1)
    return (clock - low + value + ((1 << n) if value < low else 0)) & U64


def _clock_bits(cls: FieldClass, encoded: int | None) -> int:
    return cls.length if cls.kind in c.FIXED else encoded


class StreamDecoder:
    """Packets and events of the bytes of one data stream."""

    def __init__(self, catalog: Catalog, data):
        self.catalog, self.data = catalog, data
        self._compiled: dict[int, Decode] = {}

    def _run(self, cls: FieldClass | None, bits: Bits, roots: dict, name: str, handle) -> Any:
        if cls is None:
            return None
        if id(cls) not in self._compiled:
            self._compiled[id(cls)] = compile_class(cls)
        try:
            return self._compiled[id(cls)](bits, At(roots, handle), lambda x: roots.__setitem__(name, x))[0]
        except TraceError as e:
            raise e.within(name.replace("_", "-")) from None

    def _packet(self, bits: Bits, index: int) -> PacketState:
        s = PacketState(index, bits.pos)
        roots: dict = s.frames
        bits.limit = bits.end

        def in_header(v, cls, _):
            for role in cls.roles:
                if role == "packet-magic-number" and v != PACKET_MAGIC:
                    raise TraceError(Code.MAGIC_MISMATCH, f"{v:#x}")
                if role == "metadata-stream-uuid" and v != self.catalog.uuid:
                    raise TraceError(Code.UUID_MISMATCH)
                if role == "data-stream-class-id":
                    s.stream_class_id = v
                if role == "data-stream-id":
                    s.stream_id = v

        def in_context(v, cls, encoded):
            for role in cls.roles:
                if role == "default-clock-timestamp":
                    s.clock = s.begin = advanced(s.clock, v, _clock_bits(cls, encoded))
                elif role == "discarded-event-record-counter-snapshot":
                    s.discarded = v
                elif role == "packet-content-length":
                    s.content = v
                elif role == "packet-end-default-clock-timestamp":
                    s.end = v
                elif role == "packet-sequence-number":
                    s.sequence = v
                elif role == "packet-total-length":
                    s.total = v

        s.header = self._run(self.catalog.packet_header, bits, roots, "packet_header", in_header)
        if s.stream_class_id not in self.catalog.streams:
            raise TraceError(Code.NO_SUCH_ID, f"no data stream class {s.stream_class_id}")
        s.stream = self.catalog.streams[s.stream_class_id]
        s.context = self._run(s.stream.packet_context, bits, roots, "packet_context", in_context)
        if s.total is None:
            s.total = s.content
        if s.content is None:
            s.content = s.total
        if s.content is not None and s.content > s.total:
            raise TraceError(Code.INVALID_CONTENT_LENGTH, f"{s.content} > {s.total} bits")
        s.first_event = bits.pos
        return s

    def packets(self, start: int = 0, index: int = 0) -> Iterator[PacketState]:
        """Packets in order by headers and contexts alone; a packet without sizes is the rest of the file."""
        bits = Bits(self.data, start)
        while bits.pos < bits.end:
            s = self._packet(bits, index)
            yield s
            if s.total is None:
                return
            if s.total == 0:
                raise TraceError(Code.INVALID_CONTENT_LENGTH, "a packet of 0 bits")
            bits.pos = min(s.start + s.total, bits.end)
            bits.order = None
            index += 1

    def events(self, s: PacketState) -> Iterator[Event]:
        """The events of a packet; what is wrong with one is raised after those before it."""
        bits = Bits(self.data, s.first_event)
        end = bits.end if s.content is None else s.start + s.content
        bits.limit = min(end, bits.end)
        index, clock = 0, s.clock
        while bits.pos < end:
            if bits.pos >= bits.end:
                if s.content is not None:
                    raise TraceError(Code.NOT_ENOUGH_BITS, "the packet is cut off")
                return
            seen = {"id": 0, "cycles": 0}
            roots = dict(s.frames)

            def in_event(v, cls, encoded, seen=seen):
                nonlocal clock
                if "event-record-class-id" in cls.roles:
                    seen["id"] = v
                if "default-clock-timestamp" in cls.roles:
                    clock = seen["cycles"] = advanced(clock, v, _clock_bits(cls, encoded))

            header = self._run(s.stream.event_header, bits, roots, "event_header", in_event)
            cls = s.stream.events.get(seen["id"])
            if cls is None:
                raise TraceError(Code.NO_SUCH_ID, f"no event record class {seen['id']}")
            rest = [(n, x) for n, x in (("common_context", s.stream.common_context), ("specific_context", cls.specific_context), ("payload", cls.payload))]
            found = {n: self._run(x, bits, roots, n, None) for n, x in rest}
            at = bits.pos
            yield Event(s, index, cls, seen["cycles"], {"packet_header": s.header, "packet_context": s.context, "event_header": header, **found})
            if bits.pos == at and at == s.first_event and not any(x for x in found.values()) and header is None:
                return  # an event without bits would repeat for ever
            index += 1
