"""From field classes to Spark types and values, with a description of each class for formatting."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

from ..sources import classes as c
from ..sources.classes import FieldClass
from ..sources.decoder import PROPERTIES, Tagged, member_names
from ..sources.metadata import Catalog

U64_TYPE = T.DecimalType(20, 0)
#: Columns of an event row before its properties.
EVENT_COLUMNS = [
    ("trace_idx", T.IntegerType()),
    ("trace_path", T.StringType()),
    ("stream_file", T.StringType()),
    ("packet_idx", T.LongType()),
    ("event_idx", T.LongType()),
    ("stream_class_id", U64_TYPE),
    ("stream_id", U64_TYPE),
    ("pkt_seq_num", U64_TYPE),
    ("pkt_begin_cycles", U64_TYPE),
    ("pkt_begin_ns", T.LongType()),
    ("pkt_end_cycles", U64_TYPE),
    ("pkt_end_ns", T.LongType()),
    ("pkt_disc_snapshot", U64_TYPE),
    ("pkt_content_bits", U64_TYPE),
    ("pkt_total_bits", U64_TYPE),
    ("event_class_id", U64_TYPE),
    ("event_ns", T.StringType()),
    ("event_name", T.StringType()),
    ("ts_cycles", U64_TYPE),
    ("ts_ns", T.LongType()),
    ("has_clock", T.BooleanType()),
]
PACKET_COLUMNS = [x for x in EVENT_COLUMNS if x[0] in ("trace_idx", "trace_path", "stream_file", "packet_idx", "stream_class_id", "stream_id") or x[0].startswith("pkt_")]
ERROR_COLUMN = "_error"


def spark_type(cls: FieldClass) -> T.DataType:
    k = cls.kind
    if k in (c.FIXED_BITS, c.FIXED_MAP, c.FIXED_UINT):
        return T.LongType() if cls.length < 64 else U64_TYPE
    if k in (c.FIXED_SINT, c.VAR_SINT):
        return T.LongType()
    if k == c.VAR_UINT:
        return U64_TYPE
    if k == c.FIXED_BOOL:
        return T.BooleanType()
    if k == c.FIXED_FLOAT:
        return T.FloatType() if cls.length == 32 else T.DoubleType()
    if k in c.STRINGS:
        return T.StringType()
    if k in (c.STATIC_BLOB, c.DYNAMIC_BLOB):
        return T.BinaryType()
    if k == c.STRUCTURE:
        return T.StructType([T.StructField(n, spark_type(m.cls)) for n, m in zip(member_names(cls.members), cls.members, strict=True)])
    if k in (c.STATIC_ARRAY, c.DYNAMIC_ARRAY):
        return T.ArrayType(spark_type(cls.element))
    if k == c.OPTIONAL:
        return spark_type(cls.element)
    options = zip(member_names(cls.options), cls.options, strict=True)
    return T.StructType([T.StructField("_tag", T.IntegerType()), *(T.StructField(n, spark_type(o.cls)) for n, o in options)])


def description(cls: FieldClass) -> dict[str, Any]:
    """What formatting and lookups need to know of a class, as JSON."""
    out: dict[str, Any] = {"kind": cls.kind, "base": cls.base}
    if cls.mappings:
        out["mappings"] = {k: [list(r) for r in v] for k, v in cls.mappings.items()}
    if cls.flags:
        out["flags"] = {k: [list(r) for r in v] for k, v in cls.flags.items()}
    if cls.members:
        out["members"] = [{"name": m.name, "column": n, "cls": description(m.cls)} for n, m in zip(member_names(cls.members), cls.members, strict=True)]
    if cls.options:
        out["options"] = [{"column": n, "cls": description(o.cls)} for n, o in zip(member_names(cls.options), cls.options, strict=True)]
    if cls.element:
        out["element"] = description(cls.element)
    return out


def _has_variant(cls: FieldClass) -> bool:
    return any(x.kind == c.VARIANT for _, x in cls.walk())


def row_value(cls: FieldClass, value: Any) -> Any:
    """A decoded value as its Spark type has it: variants become structs of their options."""
    if value is None or not _has_variant(cls):
        return value
    if cls.kind == c.STRUCTURE:
        return {n: row_value(m.cls, value[n]) for n, m in zip(member_names(cls.members), cls.members, strict=True)}
    if cls.kind in (c.STATIC_ARRAY, c.DYNAMIC_ARRAY):
        return [row_value(cls.element, v) for v in value]
    if cls.kind == c.VARIANT and isinstance(value, Tagged):
        i = value["tag"]
        return {"_tag": i, member_names(cls.options)[i]: row_value(cls.options[i].cls, value["value"])}
    return row_value(cls.element, value) if cls.element else value


def arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    simple = {
        T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.FloatType: pa.float32(),
        T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary(),
    }
    return pa.decimal128(20, 0) if isinstance(t, T.DecimalType) else simple[type(t)]


class Layout:
    """How the six properties of the events of some traces become columns.

    A property that has one class over all is that struct; one with several is a struct with a nullable struct for each, named by
    stream class (`stream_0`) or event class (`name`, or `event_0_5` without one)."""

    def __init__(self, catalogs: list[Catalog], event_class: str | None = None, properties: tuple[str, ...] = PROPERTIES):
        self.properties = tuple(p for p in PROPERTIES if p in properties)
        self.event_class = event_class
        self.owners: dict[str, dict[Any, tuple[str, FieldClass]]] = {p: {} for p in PROPERTIES}
        for t, cat in enumerate(catalogs):
            names: dict[str, int] = {}
            for s, e, prop, cls in cat.roots():
                if e is None:
                    label = "trace" if s is None else f"stream_{s}"
                else:
                    event = cat.streams[s].events[e]
                    if not self.wanted(event):
                        continue
                    label = event.name or f"event_{s}_{e}"
                    key = f"{prop} {label}"
                    names[key] = names.get(key, 0) + 1
                    if names[key] > 1:
                        label = f"{label}#{names[key]}"
                self.owners[prop][(t, s, e)] = (label, cls)
        self._found: dict[tuple, Any] = {}
        self.types: dict[str, T.StructType | None] = {}
        self.merged: dict[str, bool] = {}
        for prop, owners in self.owners.items():
            kinds: dict[str, T.StructType] = {}
            for label, cls in owners.values():
                kinds.setdefault(label, spark_type(cls))
            distinct = {t.json() for t in kinds.values()}
            self.merged[prop] = len(distinct) > 1
            if not kinds:
                self.types[prop] = None
            elif len(distinct) == 1:
                self.types[prop] = next(iter(kinds.values()))
            else:
                self.types[prop] = T.StructType([T.StructField(k, t) for k, t in kinds.items()])

    def wanted(self, event) -> bool:
        return self.event_class is None or self.event_class in (event.name, str(event.id))

    def schema(self, errors: bool = False) -> T.StructType:
        fields = [T.StructField(n, t) for n, t in EVENT_COLUMNS]
        for p in self.properties:
            if self.types[p] is not None:
                if self.merged[p]:
                    made = {label: description(cls) for label, cls in self.owners[p].values()}
                    meta = {"kind": "merged", "members": [{"column": k, "cls": d} for k, d in made.items()]}
                else:
                    meta = description(next(iter(self.owners[p].values()))[1])
                fields.append(T.StructField(p, self.types[p], metadata={"trace": json.dumps(meta)}))
        if errors:
            fields.append(T.StructField(ERROR_COLUMN, T.StringType()))
        return T.StructType(fields)

    def value(self, prop: str, trace: int, stream: int, event: int, decoded: Any) -> Any:
        if decoded is None:
            return None
        key = (prop, trace, stream, event)
        if key not in self._found:
            owners = self.owners[prop]
            found = next((owners[k] for k in ((trace, stream, event), (trace, stream, None), (trace, None, None)) if k in owners), None)
            self._found[key] = found and (found[0], found[1], _has_variant(found[1]))
        found = self._found[key]
        if found is None:
            return None
        value = row_value(found[1], decoded) if found[2] else decoded
        return {found[0]: value} if self.merged[prop] else value
