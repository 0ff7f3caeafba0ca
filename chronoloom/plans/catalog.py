"""A trace's classes as DataFrames, so that they join with events."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..sources.metadata import Catalog
from .schema import description

CLOCKS = "id string, frequency long, offset_seconds long, offset_cycles long, origin string, precision long, accuracy long, namespace string, name string, uid string, description string, attributes string, extensions string"
STREAMS = "id decimal(20,0), namespace string, name string, uid string, clock_id string, packet_context boolean, event_header boolean, common_context boolean, n_event_classes int, attributes string, extensions string"
EVENTS = "stream_class_id decimal(20,0), id decimal(20,0), namespace string, name string, uid string, specific_context boolean, payload boolean, attributes string, extensions string"
FIELDS = (
    "stream_class_id decimal(20,0), event_class_id decimal(20,0), property string, path array<string>, type string, length long, byte_order string, bit_order string, alignment int, "
    "minimum_alignment int, base int, encoding string, media_type string, roles array<string>, mappings string, flags string, length_origin string, length_path array<string>, "
    "selector_origin string, selector_path array<string>, selector_ranges array<array<decimal(20,0)>>, n_members int, n_options int, alias string, attributes string, extensions string"
)
TRACE = "uuid binary, namespace string, name string, uid string, environment string, packet_header boolean, attributes string, extensions string, preamble_attributes string"
ALIASES = "name string, field_class string, attributes string, extensions string"


def _json(x) -> str | None:
    return None if x is None else json.dumps(x)


def catalog_rows(c: Catalog) -> dict[str, tuple[str, list[tuple]]]:
    """Schema and rows of each view."""
    from decimal import Decimal

    number = lambda x: None if x is None else Decimal(x)
    t = c.trace or {}
    fields = []
    for s, e, prop, root in c.roots():
        for path, x in root.walk():
            at, by = x.length_location, x.selector_location
            fields.append((
                number(s), number(e), prop, list(path), x.kind, x.length, x.byte_order, x.bit_order, x.effective_alignment, x.minimum_alignment, x.base, x.encoding, x.media_type,
                sorted(x.roles), _json(x.mappings or None), _json(x.flags or None), at.origin if at else None, list(at.path) if at else None, by.origin if by else None,
                list(by.path) if by else None, [[number(a), number(b)] for a, b in x.selector_ranges] if x.selector_ranges else None, len(x.members), len(x.options), x.alias, _json(x.attributes), _json(x.extensions),
            ))
    return {
        "clocks": (CLOCKS, [(k.id, k.frequency, k.offset_seconds, k.offset_cycles, k.origin if k.origin is None or isinstance(k.origin, str) else json.dumps(k.origin), k.precision, k.accuracy, k.namespace, k.name, k.uid, k.description, _json(k.attributes), _json(k.extensions)) for k in c.clocks.values()]),
        "stream_classes": (STREAMS, [(number(s.id), s.namespace, s.name, s.uid, s.clock.id if s.clock else None, s.packet_context is not None, s.event_header is not None, s.common_context is not None, len(s.events), _json(s.attributes), _json(s.extensions)) for s in c.streams.values()]),
        "event_classes": (EVENTS, [(number(e.stream_class_id), number(e.id), e.namespace, e.name, e.uid, e.specific_context is not None, e.payload is not None, _json(e.attributes), _json(e.extensions)) for s in c.streams.values() for e in s.events.values()]),
        "fields": (FIELDS, fields),
        "trace": (TRACE, [(c.uuid, t.get("namespace"), t.get("name"), t.get("uid"), _json(t.get("environment")), c.packet_header is not None, _json(t.get("attributes")), _json(t.get("extensions")), _json(c.preamble.get("attributes")))]),
        "aliases": (ALIASES, [(n, json.dumps(description(x)), _json(c.alias_properties[n]["attributes"]), _json(c.alias_properties[n]["extensions"])) for n, x in c.aliases.items()]),
    }


def catalog_views(spark: SparkSession, c: Catalog, prefix: str = "") -> dict[str, DataFrame]:
    """DataFrames clocks, stream_classes, event_classes, fields, trace and aliases, also as temporary views."""
    out = {}
    for name, (schema, rows) in catalog_rows(c).items():
        out[name] = spark.createDataFrame(rows, schema)
        out[name].createOrReplaceTempView(prefix + name)
    return out
