"""Text: how fields, timestamps and whole events are written, and how timestamps are read."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import numbers as N

NS = 1_000_000_000
DAY_NS = 86_400 * NS


def integer(value: Column, base: int = 10) -> Column:
    """An integer in base 2 (0b1), 8 (017), 10 or 16 (0x1f); a minus sign comes first; 0 has no prefix but in base 2."""
    if base == 10:
        return value.cast("string")
    size = F.abs(value.cast("decimal(38,0)"))
    digits = F.lower(F.conv(size.cast("string"), 10, base))
    body = F.concat(F.lit({2: "0b", 8: "0", 16: "0x"}[base]), digits)
    if base != 2:
        body = F.when(size == 0, "0").otherwise(body)
    return F.concat(F.when(value < 0, "-").otherwise(""), body)


def real(value: Column) -> Column:
    return F.format_string("%.6f", value.cast("double"))


def boolean(value: Column) -> Column:
    return value.cast("int").cast("string")


def string(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def blob(value: Column) -> Column:
    return F.lower(F.hex(value))


def nil(text: Column) -> Column:
    return F.coalesce(text, F.lit("nil"))


def array(items: Column) -> Column:
    """[a, b] of formatted items."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def struct(parts: list[tuple[str, Column]]) -> Column:
    """{ k: v, k: v } of formatted values."""
    inside = [F.concat(F.lit(f"{name}: "), value) for name, value in parts]
    return F.concat(F.lit("{ "), F.concat_ws(", ", *inside) if inside else F.lit(""), F.lit(" }"))


def labelled(text: Column, names: Column) -> Column:
    """value: "a","b", or value: nil without a name."""
    quoted = F.array_join(F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ",")
    return F.concat(text, F.lit(": "), F.when(F.size(names) > 0, quoted).otherwise("nil"))


def field(value: Column, kind: T.DataType, cls: dict) -> Column:
    """A field formatted by its class description (see plans.schema.description)."""
    k = cls["kind"]
    if k == "merged":
        parts = [F.when(value[m["column"]].isNotNull(), field(value[m["column"]], kind[m["column"]].dataType, m["cls"])) for m in cls["members"]]
        return F.coalesce(*parts)
    if k == "structure":
        parts = [(m["name"], field(value.getField(m["column"]), kind[m["column"]].dataType, m["cls"])) for m in cls.get("members", [])]
        made = struct(parts)
    elif k in ("static-length-array", "dynamic-length-array"):
        made = array(F.transform(value, lambda x: field(x, kind.elementType, cls["element"])))
    elif k == "optional":
        return field(value, kind, cls["element"])
    elif k == "variant":
        parts = [F.when(value["_tag"] == i, field(value.getField(o["column"]), kind[o["column"]].dataType, o["cls"])) for i, o in enumerate(cls["options"])]
        made = F.coalesce(*parts)
    elif k == "fixed-length-floating-point-number":
        made = real(value)
    elif k == "fixed-length-boolean":
        made = boolean(value)
    elif k.endswith("string"):
        made = string(value)
    elif k.endswith("blob"):
        made = blob(value)
    else:
        made = integer(value, cls.get("base", 10))
        ranges = lambda d: {n: [tuple(r) for r in v] for n, v in d.items()}
        if cls.get("mappings"):
            made = labelled(made, N.labels(value, ranges(cls["mappings"])))
        if cls.get("flags"):
            bits = N.as_bits(value) if isinstance(kind, T.DecimalType) else value
            made = labelled(made, N.flags(bits, ranges(cls["flags"])))
    return F.when(value.isNotNull(), made).otherwise("nil")


def timestamp(ns: Column, date: bool = False, seconds: bool = False) -> Column:
    """[HH:MM:SS.nnnnnnnnn], with the date before, or as seconds; in the session's time zone."""
    part = F.pmod(ns, F.lit(NS))
    whole = ((ns - part).cast("decimal(38,0)") / N.wide(NS)).cast("bigint")
    if seconds:
        size = F.abs(ns.cast("decimal(38,0)"))
        rest = size % F.lit(NS)
        return F.concat(F.lit("["), F.when(ns < 0, "-").otherwise(""), N.quotient(size, N.wide(NS)).cast("string"), F.lit("."), F.lpad(rest.cast("bigint").cast("string"), 9, "0"), F.lit("]"))
    shown = F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd HH:mm:ss" if date else "HH:mm:ss")
    return F.concat(F.lit("["), shown, F.lit("."), F.lpad(part.cast("string"), 9, "0"), F.lit("]"))


def cycles(value: Column) -> Column:
    return F.concat(F.lit("["), F.lpad(value.cast("string"), 20, "0"), F.lit("]"))


def delta(value: Column) -> Column:
    """(+0000000012), (+-000000012) for a step back, or question marks for the first event."""
    return F.concat(F.lit("(+"), F.when(value.isNull(), "??????????").otherwise(F.format_string("%010d", value.cast("bigint"))), F.lit(")"))


def event_prefix(namespace: Column, name: Column) -> Column:
    """namespace::name: , name: , or nothing."""
    return F.when(name.isNull(), "").when(namespace.isNull(), F.concat(name, F.lit(": "))).otherwise(F.concat(namespace, F.lit("::"), name, F.lit(": ")))


# How properties are called in text.
PROPERTY_LABELS = {
    "packet_header": "packet-header",
    "packet_context": "packet-context",
    "event_header": "event-header",
    "common_context": "event-common-context",
    "specific_context": "event-specific-context",
    "payload": "event-payload",
}


def event(events: DataFrame, with_labels: bool = False, properties: list[str] | None = None, with_delta: Column | None = None, show_cycles: bool = False, date: bool = False, seconds: bool = False) -> Column:
    """A line for each event of a trace DataFrame."""
    parts = []
    for name, label in PROPERTY_LABELS.items():
        if name in events.columns and (properties is None or name in properties):
            f = events.schema[name]
            made = field(F.col(name), f.dataType, json.loads(f.metadata["trace"]))
            parts.append(F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{label}: "), made) if with_labels else made))
    stamp = cycles(F.col("ts_cycles")) if show_cycles else timestamp(F.col("ts_ns"), date, seconds)
    stamp = F.when(F.col("has_clock"), F.concat(stamp, F.lit(" "), *([with_delta, F.lit(" ")] if with_delta is not None else []))).otherwise("")
    body = F.concat(F.lit("{ "), F.concat_ws(", ", *parts) if parts else F.lit(""), F.lit(" }"))
    return F.concat(stamp, event_prefix(F.col("event_ns"), F.col("event_name")), body)


_DATE = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,9}))?)?")
_TIME = re.compile(r"(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,9}))?)?")
_SECONDS = re.compile(r"(-?)(\d+)(?:\.(\d{1,9}))?")


def parse_timestamp(text: str, zone: str = "UTC") -> tuple[int, bool]:
    """Nanoseconds of `yyyy-mm-dd hh:ii[:ss[.n]]`, `hh:ii[:ss[.n]]` or `[-]s[.n]`, and whether a date is in it.

    n counts nanoseconds: .5 is 5 ns."""
    tz = timezone.utc if zone == "UTC" else ZoneInfo(zone)
    if m := _DATE.fullmatch(text):
        y, mo, d, h, mi, s, n = (int(x or 0) for x in m.groups())
        at = datetime(y, mo, d, h, mi, s, tzinfo=tz)
        return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(seconds=1) * NS + n, True
    if m := _TIME.fullmatch(text):
        h, mi, s, n = (int(x or 0) for x in m.groups())
        if h > 23 or mi > 59 or s > 59:
            raise ValueError(f"no time: {text}")
        shift = tz.utcoffset(datetime(1970, 1, 1)) // timedelta(seconds=1)
        return ((h * 60 + mi) * 60 + s - shift) * NS + n, False
    if m := _SECONDS.fullmatch(text):
        value = int(m[2]) * NS + int(m[3] or 0)
        return (-value if m[1] else value), True
    raise ValueError(f"no timestamp: {text}")


def parse_timestamp_column(text: Column) -> Column:
    """The same for a column, in UTC; null where the text is no timestamp."""
    date, clock = r"^(\d{4})-(\d{1,2})-(\d{1,2})[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,9}))?)?$", r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,9}))?)?$"
    plain = r"^(-?)(\d+)(?:\.(\d{1,9}))?$"
    n = lambda p, i: F.coalesce(F.nullif(F.regexp_extract(text, p, i), F.lit("")).cast("bigint"), F.lit(0))
    day = F.datediff(F.make_date(n(date, 1).cast("int"), n(date, 2).cast("int"), n(date, 3).cast("int")), F.lit("1970-01-01").cast("date")).cast("bigint")
    of_day = lambda p, i: ((n(p, i) * 60 + n(p, i + 1)) * 60 + n(p, i + 2)) * NS + n(p, i + 3)
    seconds = n(plain, 2) * NS + n(plain, 3)
    return (
        F.when(text.rlike(date), day * DAY_NS + of_day(date, 4))
        .when(text.rlike(clock), of_day(clock, 1))
        .when(text.rlike(plain), F.when(F.regexp_extract(text, plain, 1) == "-", -seconds).otherwise(seconds))
    )
