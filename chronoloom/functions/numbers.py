"""Integers: clocks, coercions, bit fields, ranges, labels and flags.

Unsigned 64-bit values are DECIMAL(20,0); everything else is BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

I64_MAX, U64_MAX = (1 << 63) - 1, (1 << 64) - 1
_WIDE = "decimal(38,0)"
U64 = "decimal(20,0)"
Ranges = list[tuple[int, int]]


def wide(value: int) -> Column:
    return F.lit(str(value)).cast(_WIDE)


def quotient(a: Column, b: Column) -> Column:
    """Whole division of non-negative numbers of up to 38 digits, rounding down."""
    return ((a - a % b) / b).cast(_WIDE)


def cycles_to_ns(cycles: Column, frequency: int, offset_seconds: int = 0, offset_cycles: int = 0) -> Column:
    """Nanoseconds from a clock's origin. Cycles and their offset wrap as 64-bit unsigned integers do."""
    total = (cycles.cast(_WIDE) + wide(offset_cycles)) % wide(U64_MAX + 1)
    rest = total % wide(frequency)
    seconds = quotient(total, wide(frequency)) + wide(offset_seconds)
    return (seconds * wide(1_000_000_000)).cast(_WIDE).cast("bigint") + quotient((rest * wide(1_000_000_000)).cast(_WIDE), wide(frequency)).cast("bigint")


def to_uint(value: Column, kind: str) -> Column:
    """A field as unsigned integer: negatives are 0, what is no integer is the largest."""
    if kind in ("unsigned int", "bit map"):
        return value.cast(U64)
    if kind == "signed int":
        return F.greatest(value, F.lit(0)).cast(U64)
    return F.when(value.isNotNull(), F.lit(str(U64_MAX)).cast(U64))


def to_int(value: Column, kind: str) -> Column:
    """A field as signed integer: large values and what is no integer are the largest."""
    if kind in ("unsigned int", "bit map"):
        return F.least(value.cast(U64), F.lit(str(I64_MAX)).cast(U64)).cast("bigint")
    return value.cast("bigint") if kind == "signed int" else F.when(value.isNotNull(), F.lit(I64_MAX))


def to_bool(value: Column, kind: str) -> Column:
    """A field as boolean: integers are true if they are not 0; bit maps, strings and the rest are false."""
    if kind == "bool":
        return value
    return value != 0 if kind in ("unsigned int", "signed int") else F.when(value.isNotNull(), False)


def to_real(value: Column, kind: str) -> Column:
    """A field as double: what is no real is the largest double."""
    return value.cast("double") if kind == "real" else F.when(value.isNotNull(), F.lit(1.7976931348623157e308))


def sign_extend(value: Column, bits: int) -> Column:
    """A BIGINT's low bits as a signed integer."""
    return F.shiftright(F.shiftleft(value, 64 - bits), 64 - bits)


def reverse_bits(value: Column, bits: int) -> Column:
    low = value if bits >= 63 else value.bitwiseAND(F.lit((1 << bits) - 1))
    return F.conv(F.reverse(F.lpad(F.bin(low), bits, "0")), 2, 10).cast(U64 if bits >= 64 else "bigint")


def leb128_bytes(value: Column) -> Column:
    """Bytes that an unsigned variable-length integer takes."""
    size = F.lit(1)
    for n in range(1, 9):
        size = size + F.when(value >= F.lit(1 << (7 * n)), 1).otherwise(0)
    return size


def saturating_add(a: Column, b: Column) -> Column:
    """The sum of two unsigned 64-bit integers, at most the largest."""
    return F.least(a.cast(_WIDE) + b.cast(_WIDE), wide(U64_MAX)).cast(U64)


def _bound(x: int, value_kind: str | None) -> Column:
    return F.lit(x) if -(1 << 63) <= x <= I64_MAX and value_kind is None else wide(x)


def in_ranges(value: Column, ranges: Ranges) -> Column:
    """Whether a value lies in one of some inclusive ranges."""
    out = F.lit(False)
    for a, b in ranges:
        kind = "wide" if max(abs(a), abs(b)) > I64_MAX else None
        v = value if kind is None else value.cast(_WIDE)
        out = out | v.between(_bound(a, kind), _bound(b, kind))
    return out


def in_range_array(value: Column, ranges: Column) -> Column:
    """The same for ranges in an array column of (low, high)."""
    return F.exists(ranges, lambda r: (value >= r["low"]) & (value <= r["high"]))


def range_arrays_intersect(one: Column, other: Column) -> Column:
    return F.exists(one, lambda a: F.exists(other, lambda b: (a["low"] <= b["high"]) & (b["low"] <= a["high"])))


def labels(value: Column, mappings: dict[str, Ranges]) -> Column:
    """Every label with a range that holds the value, in order of declaration."""
    found = [F.when(in_ranges(value, r), F.lit(name)) for name, r in mappings.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def first_label(value: Column, mappings: dict[str, Ranges]) -> Column:
    out = F.lit(None).cast("string")
    for name, r in reversed(mappings.items()):
        out = F.when(in_ranges(value, r), name).otherwise(out)
    return out


def flag_mask(ranges: Ranges) -> int:
    mask = 0
    for a, b in ranges:
        for bit in range(a, min(b, 63) + 1):
            mask |= 1 << bit
    return mask


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def as_bits(value: Column) -> Column:
    """The low 64 bits of an unsigned DECIMAL as BIGINT."""
    wide_value = value.cast(_WIDE)
    return F.when(wide_value > wide(I64_MAX), wide_value - wide(U64_MAX + 1)).otherwise(wide_value).cast("bigint")


def flags(value: Column, declared: dict[str, Ranges]) -> Column:
    """Every flag that shares a bit with the value, in order of declaration. The value is BIGINT (bits) here."""
    found = [F.when(value.bitwiseAND(F.lit(_signed(flag_mask(r)))) != 0, F.lit(name)) for name, r in declared.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def first_flag(value: Column, declared: dict[str, Ranges]) -> Column:
    return F.get(flags(value, declared), F.lit(0))


def unwrap_step(previous: Column, low: Column, bits: int) -> Column:
    """The turn of a clock of `bits` low bits between two values: 2**bits if it fell."""
    return F.when(low < previous, F.lit(1 << bits)).otherwise(F.lit(0))


# Names of field types.
FIELD_TYPES = ("nil", "bool", "signed int", "unsigned int", "bit map", "real", "string", "blob", "array", "struct")
