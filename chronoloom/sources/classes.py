"""Field classes: the type system of a trace, parsed from its JSON."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from typing import Any

from ..errors import Code, TraceError

U64, I64, I64_LOW = (1 << 64) - 1, (1 << 63) - 1, -(1 << 63)

# The names that the format defines.
FIXED_BITS = "fixed-length-bit-array"
FIXED_MAP = "fixed-length-bit-map"
FIXED_UINT = "fixed-length-unsigned-integer"
FIXED_SINT = "fixed-length-signed-integer"
FIXED_BOOL = "fixed-length-boolean"
FIXED_FLOAT = "fixed-length-floating-point-number"
VAR_UINT = "variable-length-unsigned-integer"
VAR_SINT = "variable-length-signed-integer"
NULL_STRING = "null-terminated-string"
STATIC_STRING = "static-length-string"
DYNAMIC_STRING = "dynamic-length-string"
STATIC_BLOB = "static-length-blob"
DYNAMIC_BLOB = "dynamic-length-blob"
STRUCTURE = "structure"
STATIC_ARRAY = "static-length-array"
DYNAMIC_ARRAY = "dynamic-length-array"
OPTIONAL = "optional"
VARIANT = "variant"

FIXED = {FIXED_BITS, FIXED_MAP, FIXED_UINT, FIXED_SINT, FIXED_BOOL, FIXED_FLOAT}
INTEGERS = {FIXED_UINT, FIXED_SINT, VAR_UINT, VAR_SINT}
STRINGS = {NULL_STRING, STATIC_STRING, DYNAMIC_STRING}
ENCODINGS = {"utf-8": 1, "utf-16be": 2, "utf-16le": 2, "utf-32be": 4, "utf-32le": 4}
ORIGINS = (
    "packet-header",
    "packet-context",
    "event-record-header",
    "event-record-common-context",
    "event-record-specific-context",
    "event-record-payload",
)
ROLES = {
    "data-stream-class-id",
    "data-stream-id",
    "packet-magic-number",
    "metadata-stream-uuid",
    "default-clock-timestamp",
    "discarded-event-record-counter-snapshot",
    "packet-content-length",
    "packet-end-default-clock-timestamp",
    "packet-sequence-number",
    "packet-total-length",
    "event-record-class-id",
}
NATURAL_BIT_ORDER = {"little-endian": "first-to-last", "big-endian": "last-to-first"}

Ranges = tuple[tuple[int, int], ...]


@dataclass
class Location:
    origin: str | None
    path: tuple[str | None, ...]


@dataclass
class Member:
    """A structure's member or a variant's option."""

    name: str | None
    cls: FieldClass
    attributes: Any = None
    extensions: Any = None
    ranges: Ranges | None = None


@dataclass
class FieldClass:
    kind: str
    length: int | None = None
    byte_order: str | None = None
    bit_order: str | None = None
    alignment: int = 1
    base: int = 10
    mappings: dict[str, Ranges] = field(default_factory=dict)
    flags: dict[str, Ranges] = field(default_factory=dict)
    roles: frozenset[str] = frozenset()
    encoding: str | None = None
    media_type: str | None = None
    length_location: Location | None = None
    selector_location: Location | None = None
    selector_ranges: Ranges | None = None
    minimum_alignment: int = 1
    members: list[Member] = field(default_factory=list)  # of structures
    options: list[Member] = field(default_factory=list)  # of variants
    element: FieldClass | None = None  # of arrays and optionals
    alias: str | None = None
    attributes: Any = None
    extensions: Any = None

    @property
    def signed(self) -> bool:
        return self.kind in (FIXED_SINT, VAR_SINT)

    @property
    def effective_alignment(self) -> int:
        if self.kind in FIXED:
            return self.alignment
        if self.kind == STRUCTURE:
            return max([self.minimum_alignment, *(m.cls.effective_alignment for m in self.members)])
        if self.kind in (STATIC_ARRAY, DYNAMIC_ARRAY):
            return max(self.minimum_alignment, self.element.effective_alignment)
        return 1 if self.kind in (OPTIONAL, VARIANT) else 8

    def walk(self, path: tuple[str, ...] = ()):
        """This class and all below it, with their paths."""
        yield path, self
        for i, m in enumerate([*self.members, *self.options]):
            yield from m.cls.walk((*path, m.name if m.name is not None else f"[{i}]"))
        if self.element is not None:
            yield from self.element.walk((*path, "[]"))


def wrong(code: Code, text: str) -> TraceError:
    return TraceError(code, text)


def integer(value: Any, what: str, least: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise wrong(Code.JSON_WRONG_TYPE, f"{what} is no integer")
    if least is not None and value < least:
        raise wrong(Code.JSON_NOT_GTEZ if least == 0 else Code.JSON_NOT_GTZ, f"{what} is {value}")
    return value


def text(value: Any, what: str) -> str:
    if not isinstance(value, str):
        raise wrong(Code.JSON_WRONG_TYPE, f"{what} is no string")
    return value


def mapping(value: Any, what: str) -> dict:
    if not isinstance(value, dict):
        raise wrong(Code.JSON_WRONG_TYPE, f"{what} is no object")
    return value


def sequence(value: Any, what: str) -> list:
    if not isinstance(value, list):
        raise wrong(Code.JSON_WRONG_TYPE, f"{what} is no array")
    return value


def required(j: dict, key: str) -> Any:
    if key not in j:
        raise wrong(Code.MISSING_PROPERTY, f"`{key}` is missing")
    return j[key]


def json_object(j: dict, key: str) -> Any:
    return mapping(j[key], key) if key in j else None


def power_of_two(value: Any, what: str) -> int:
    n = integer(value, what, 1)
    if n & (n - 1):
        raise wrong(Code.INVALID_ALIGNMENT, f"{what} is {n}")
    return n


def ranges(value: Any, what: str) -> Ranges:
    """A non-empty set of inclusive ranges."""
    out = []
    for r in sequence(value, what):
        if len(sequence(r, what)) != 2:
            raise wrong(Code.INVALID_RANGE, f"{what}: a range has two bounds")
        low, high = (integer(x, what) for x in r)
        if low > high:
            raise wrong(Code.INVALID_RANGE, f"{what}: {low} > {high}")
        out.append((low, high))
    if not out:
        raise wrong(Code.INVALID_RANGE_SET, f"{what} is empty")
    return tuple(out)


def selector_ranges(value: Any, what: str) -> Ranges:
    found = ranges(value, what)
    if any(a < 0 for a, _ in found) and any(b > I64 for _, b in found):
        raise wrong(Code.INVALID_RANGE_SET, f"{what} mixes negative bounds and ones beyond 64-bit signed integers")
    return found


def _clipped(found: Ranges, signed: bool) -> Ranges:
    """Ranges cut to what an integer can hold; those wholly beyond it go."""
    low, high = (I64_LOW, I64) if signed else (0, U64)
    return tuple((max(a, low), min(b, high)) for a, b in found if b >= low and a <= high)


def merged(found: Ranges) -> Ranges:
    """Ranges in order, with those that meet made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return tuple(out)


def contains(found: Ranges, value: int) -> bool:
    return any(a <= value <= b for a, b in found)


def intersect(one: Ranges, other: Ranges) -> bool:
    return any(a <= d and c <= b for a, b in one for c, d in other)


def location(value: Any) -> Location:
    j = mapping(value, "field location")
    origin = j.get("origin")
    if origin is not None and text(origin, "origin") not in ORIGINS:
        raise wrong(Code.INVALID_FIELD_LOCATION, f"no origin is called `{origin}`")
    path = sequence(required(j, "path"), "path")
    if not path:
        raise wrong(Code.INVALID_FIELD_LOCATION, "the path is empty")
    if any(x is not None and not isinstance(x, str) for x in path):
        raise wrong(Code.INVALID_FIELD_LOCATION, "a path has names and nulls only")
    if path[-1] is None:
        raise wrong(Code.INVALID_FIELD_LOCATION, "the path ends in null")
    return Location(origin, tuple(path))


def parse_class(j: Any, aliases: dict[str, FieldClass]) -> FieldClass:
    """A field class from JSON; a string names an alias defined before."""
    if isinstance(j, str):
        if j not in aliases:
            raise wrong(Code.NO_SUCH_ALIAS, f"no alias is called `{j}`")
        out = copy.deepcopy(aliases[j])
        out.alias = j
        return out
    if not isinstance(j, dict):
        raise wrong(Code.INVALID_FIELD_CLASS, "a field class is an object or the name of an alias")
    kind = text(required(j, "type"), "type")
    if kind not in _PARSERS:
        raise wrong(Code.INVALID_FIELD_CLASS, f"no field class is called `{kind}`")
    out = FieldClass(kind, attributes=json_object(j, "attributes"), extensions=json_object(j, "extensions"))
    for step in _PARSERS[kind]:
        step(out, j, aliases)
    return out


def _bits(c: FieldClass, j: dict, _) -> None:
    c.length = integer(required(j, "length"), "length", 1)
    allowed = (32, 64) if c.kind == FIXED_FLOAT else range(1, 65)
    if c.length not in allowed:
        raise wrong(Code.UNSUPPORTED_LENGTH, f"{c.kind} of {c.length} bits")
    c.byte_order = text(required(j, "byte-order"), "byte-order")
    if c.byte_order not in NATURAL_BIT_ORDER:
        raise wrong(Code.INVALID_BYTE_ORDER, f"`{c.byte_order}`")
    c.bit_order = text(j.get("bit-order", NATURAL_BIT_ORDER[c.byte_order]), "bit-order")
    if c.bit_order not in NATURAL_BIT_ORDER.values():
        raise wrong(Code.INVALID_BIT_ORDER, f"`{c.bit_order}`")
    c.alignment = power_of_two(j.get("alignment", 1), "alignment")


def _flags(c: FieldClass, j: dict, _) -> None:
    found = mapping(required(j, "flags"), "flags")
    if not found:
        raise wrong(Code.INVALID_FLAGS, "no flag is given")
    c.flags = {name: ranges(r, f"flag {name}") for name, r in found.items()}
    if any(a < 0 for r in c.flags.values() for a, _ in r):
        raise wrong(Code.INVALID_FLAGS, "a flag's bit is negative")


def _integer(c: FieldClass, j: dict, _) -> None:
    c.base = integer(j.get("preferred-display-base", 10), "preferred-display-base")
    if c.base not in (2, 8, 10, 16):
        raise wrong(Code.INVALID_BASE, f"{c.base}")
    for name, r in mapping(j.get("mappings", {}), "mappings").items():
        c.mappings[name] = merged(_clipped(ranges(r, f"mapping {name}"), c.signed))


def _roles(c: FieldClass, j: dict, _) -> None:
    found = sequence(j.get("roles", []), "roles")
    c.roles = frozenset(text(r, "role") for r in found) & ROLES


def _encoding(c: FieldClass, j: dict, _) -> None:
    c.encoding = text(j.get("encoding", "utf-8"), "encoding")
    if c.encoding not in ENCODINGS:
        raise wrong(Code.INVALID_ENCODING, f"`{c.encoding}`")


def _media(c: FieldClass, j: dict, _) -> None:
    c.media_type = text(j.get("media-type", "application/octet-stream"), "media-type")


def _static(c: FieldClass, j: dict, _) -> None:
    c.length = integer(required(j, "length"), "length", 0)


def _dynamic(c: FieldClass, j: dict, _) -> None:
    c.length_location = location(required(j, "length-field-location"))


def _minimum(c: FieldClass, j: dict, _) -> None:
    c.minimum_alignment = power_of_two(j.get("minimum-alignment", 1), "minimum-alignment")


def _members(c: FieldClass, j: dict, aliases) -> None:
    for m in sequence(j.get("member-classes", []), "member-classes"):
        m = mapping(m, "member class")
        name = text(required(m, "name"), "name")
        try:
            c.members.append(Member(name, parse_class(required(m, "field-class"), aliases), json_object(m, "attributes"), json_object(m, "extensions")))
        except TraceError as e:
            raise e.within(f"member `{name}`") from None


def _element(c: FieldClass, j: dict, aliases) -> None:
    c.element = parse_class(required(j, "element-field-class"), aliases)


def _optional(c: FieldClass, j: dict, aliases) -> None:
    c.element = parse_class(required(j, "field-class"), aliases)
    c.selector_location = location(required(j, "selector-field-location"))
    if "selector-field-ranges" in j:
        c.selector_ranges = selector_ranges(j["selector-field-ranges"], "selector-field-ranges")


def _variant(c: FieldClass, j: dict, aliases) -> None:
    c.selector_location = location(required(j, "selector-field-location"))
    for o in sequence(required(j, "options"), "options"):
        o = mapping(o, "option")
        name = text(o["name"], "name") if "name" in o else None
        c.options.append(
            Member(name, parse_class(required(o, "field-class"), aliases), json_object(o, "attributes"), json_object(o, "extensions"), selector_ranges(required(o, "selector-field-ranges"), "selector-field-ranges"))
        )
    if not c.options:
        raise wrong(Code.INVALID_VARIANT, "a variant has an option at least")
    for i, one in enumerate(c.options):
        if any(intersect(one.ranges, other.ranges) for other in c.options[:i]):
            raise wrong(Code.INVALID_VARIANT, "ranges of two options intersect")


_PARSERS = {
    FIXED_BITS: (_bits,),
    FIXED_MAP: (_bits, _flags),
    FIXED_UINT: (_bits, _integer, _roles),
    FIXED_SINT: (_bits, _integer),
    FIXED_BOOL: (_bits,),
    FIXED_FLOAT: (_bits,),
    VAR_UINT: (_integer, _roles),
    VAR_SINT: (_integer,),
    NULL_STRING: (_encoding,),
    STATIC_STRING: (_static, _encoding),
    DYNAMIC_STRING: (_dynamic, _encoding),
    STATIC_BLOB: (_static, _media, _roles),
    DYNAMIC_BLOB: (_dynamic, _media),
    STRUCTURE: (_minimum, _members),
    STATIC_ARRAY: (_static, _minimum, _element),
    DYNAMIC_ARRAY: (_dynamic, _minimum, _element),
    OPTIONAL: (_optional,),
    VARIANT: (_variant,),
}
