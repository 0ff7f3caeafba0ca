from __future__ import annotations

import json
import struct

import pytest

from chronoloom.errors import Code, TraceError, describe
from chronoloom.plans.catalog import catalog_views
from chronoloom.sources import classes as c
from chronoloom.sources.metadata import Catalog, Clock, lenient_json, unwrap_packets

PREAMBLE = {"type": "preamble", "version": 2}


def parse(*fragments) -> Catalog:
    return Catalog.parse(b"".join(b"\x1e" + json.dumps(f).encode() for f in fragments))


def uint(length=8, **more):
    return {"type": c.FIXED_UINT, "length": length, "byte-order": "little-endian", **more}


def struct_of(**members):
    return {"type": "structure", "member-classes": [{"name": k, "field-class": v} for k, v in members.items()]}


def payload(cls):
    return parse(PREAMBLE, {"type": "data-stream-class"}, {"type": "event-record-class", "payload-field-class": struct_of(x=cls)}).streams[0].events[0].payload.members[0].cls


def code(*fragments) -> Code:
    with pytest.raises(TraceError) as e:
        parse(*fragments)
    return e.value.code


def payload_code(cls) -> Code:
    return code(PREAMBLE, {"type": "data-stream-class"}, {"type": "event-record-class", "payload-field-class": struct_of(x=cls)})


def test_lenient_json():
    assert lenient_json('{"a": [1, 2,], "b": "x,}",}') == {"a": [1, 2], "b": "x,}"}
    with pytest.raises(TraceError):
        lenient_json('{"a" 1}')


def test_fragments():
    clock = {"type": "clock-class", "id": "k", "frequency": 1000, "offset-from-origin": {"seconds": 5, "cycles": 10}, "origin": {"name": "n", "uid": "u"}, "precision": 1}
    cat = parse(
        {**PREAMBLE, "uuid": list(range(16)), "attributes": {"a": 1}},
        {"type": "field-class-alias", "name": "byte", "field-class": uint()},
        {"type": "field-class-alias", "name": "also", "field-class": "byte"},
        {"type": "trace-class", "name": "t", "environment": {"x": 1, "y": "z"}},
        clock,
        {"type": "data-stream-class", "id": 3, "default-clock-class-id": "k"},
        {"type": "event-record-class", "id": 4, "data-stream-class-id": 3, "name": "e", "payload-field-class": struct_of(v="also")},
    )
    assert cat.uuid == bytes(range(16)) and cat.trace["environment"] == {"x": 1, "y": "z"}
    assert cat.streams[3].clock.origin == (None, "n", "u") and cat.streams[3].clock.ns(1990) == 7_000_000_000
    assert cat.streams[3].events[4].payload.members[0].cls.alias == "also"


@pytest.mark.parametrize(
    ("fragments", "expected"),
    [
        ([{"type": "data-stream-class"}], Code.NO_PREAMBLE),
        ([PREAMBLE, PREAMBLE], Code.DUPLICATE),
        ([{"type": "preamble", "version": 1}], Code.UNSUPPORTED_VERSION),
        ([{**PREAMBLE, "uuid": [1, 2]}], Code.INVALID_UUID),
        ([{**PREAMBLE, "extensions": {"a": {}}}], Code.UNSUPPORTED_EXTENSION),
        ([PREAMBLE, {"type": "what"}], Code.JSON_ERROR),
        ([PREAMBLE, {"type": "trace-class"}, {"type": "trace-class"}], Code.DUPLICATE),
        ([PREAMBLE, {"type": "trace-class", "environment": {"a": 1.5}}], Code.INVALID_ENVIRONMENT),
        ([PREAMBLE, {"type": "trace-class", "packet-header-field-class": uint()}], Code.NOT_A_STRUCT),
        ([PREAMBLE, {"type": "clock-class", "id": "k", "frequency": 0}], Code.JSON_NOT_GTZ),
        ([PREAMBLE, {"type": "clock-class", "id": "k", "frequency": 5, "offset-from-origin": {"cycles": 5}}], Code.CYCLES_GTE_FREQUENCY),
        ([PREAMBLE, {"type": "clock-class", "id": "k", "frequency": 5, "origin": "moon"}], Code.NO_SUCH_ORIGIN),
        ([PREAMBLE, {"type": "data-stream-class", "default-clock-class-id": "k"}], Code.NO_SUCH_ID),
        ([PREAMBLE, {"type": "event-record-class"}], Code.NO_SUCH_ID),
        ([PREAMBLE, {"type": "data-stream-class", "packet-context-field-class": struct_of(t=uint(roles=["default-clock-timestamp"]))}], Code.NO_DEFAULT_CLOCK),
        ([PREAMBLE, {"type": "trace-class", "packet-header-field-class": struct_of(a=uint(), m=uint(32, roles=["packet-magic-number"]))}], Code.INVALID_MAGIC_ROLE),
        ([PREAMBLE, {"type": "trace-class", "packet-header-field-class": struct_of(u={"type": c.STATIC_BLOB, "length": 16, "roles": ["metadata-stream-uuid"]})}], Code.INVALID_UUID_ROLE),
    ],
)
def test_wrong_fragments(fragments, expected):
    assert code(*fragments) == expected


@pytest.mark.parametrize(
    ("cls", "expected"),
    [
        (uint(128), Code.UNSUPPORTED_LENGTH),
        (uint(0), Code.JSON_NOT_GTZ),
        ({**uint(), "byte-order": "middle"}, Code.INVALID_BYTE_ORDER),
        (uint(alignment=3), Code.INVALID_ALIGNMENT),
        (uint(**{"preferred-display-base": 7}), Code.INVALID_BASE),
        (uint(mappings={"a": []}), Code.INVALID_RANGE_SET),
        (uint(mappings={"a": [[2, 1]]}), Code.INVALID_RANGE),
        ("nowhere", Code.NO_SUCH_ALIAS),
        ({"type": "nothing"}, Code.INVALID_FIELD_CLASS),
        ({"type": c.FIXED_MAP, "length": 8, "byte-order": "little-endian", "flags": {}}, Code.INVALID_FLAGS),
        ({"type": c.NULL_STRING, "encoding": "ebcdic"}, Code.INVALID_ENCODING),
        ({"type": c.DYNAMIC_BLOB, "length-field-location": {"path": []}}, Code.INVALID_FIELD_LOCATION),
        ({"type": c.DYNAMIC_BLOB}, Code.MISSING_PROPERTY),
        ({"type": c.FIXED_FLOAT, "length": 16, "byte-order": "little-endian"}, Code.UNSUPPORTED_LENGTH),
        (
            {"type": "variant", "selector-field-location": {"path": ["s"]}, "options": [{"field-class": uint(), "selector-field-ranges": [[0, 5]]}, {"field-class": uint(), "selector-field-ranges": [[5, 6]]}]},
            Code.INVALID_VARIANT,
        ),
        ({"type": "optional", "field-class": uint(), "selector-field-location": {"path": ["s"]}, "selector-field-ranges": [[-10, 2**64 - 1]]}, Code.INVALID_RANGE_SET),
    ],
)
def test_wrong_classes(cls, expected):
    assert payload_code(cls) == expected


def test_mappings_are_clipped_and_merged():
    x = payload(uint(64, mappings={"a": [[-10, 3], [2, 9]], "gone": [[-5, -3], [7, 7]], "top": [[2**64 - 1, 2**70]]}))
    assert x.mappings == {"a": ((0, 9),), "gone": ((7, 7),), "top": ((2**64 - 1, 2**64 - 1),)}


def test_alignment():
    x = payload(struct_of(a=uint(8, alignment=8), b=uint(32, alignment=32)))
    assert x.effective_alignment == 32
    assert payload({"type": c.STATIC_ARRAY, "length": 2, "element-field-class": uint(alignment=16), "minimum-alignment": 64}).effective_alignment == 64


def test_clock_identity():
    one, two = Clock("a", 1000, name="n"), Clock("b", 2000, name="n")
    assert one.same_identity(two) and not one.same_identity(two, strict=True)


def packetized(text: bytes, order: str, sizes=(22, 0, 40), **change) -> bytes:
    out, at = b"", 0
    for n in (*sizes, len(text) - sum(sizes)):
        part, at = text[at : at + n], at + n
        f = {"magic": 0x75D11D57, "content": 8 * (44 + n), "total": 8 * (44 + n + 3), "version": 2, "header": 352} | change
        out += struct.pack(f"{order}I16sIIIBBBBB3xI", f["magic"], b"u" * 16, 0, f["content"], f["total"], 0, 0, 0, f["version"], 0, f["header"]) + part + b"\xff" * 3
    return out


@pytest.mark.parametrize("order", ["<", ">"])
def test_metadata_packets(order):
    text = b"\x1e" + json.dumps(PREAMBLE).encode() + b"\x1e" + json.dumps({"type": "data-stream-class", "name": "n" * 50}).encode()
    raw = packetized(text, order)
    assert unwrap_packets(raw) == text
    assert Catalog.parse(raw).streams[0].name == "n" * 50
    for bad, expected in ((raw[:-1], Code.JSON_PARSE_ERROR), (packetized(text, order, version=3), Code.INVALID_METADATA_PACKET), (packetized(text, order, header=8), Code.INVALID_METADATA_PACKET)):
        with pytest.raises(TraceError) as e:
            unwrap_packets(bad)
        assert e.value.code == expected


def test_ranges():
    assert c.contains(((1, 3), (7, 7)), 7) and not c.contains(((1, 3),), 4)
    assert c.intersect(((1, 3),), ((3, 9),)) and not c.intersect(((-5, -1),), ((0, 4),))


def test_errors():
    assert describe(-40) == "not enough bits" and describe(99) == "unknown error"
    assert str(TraceError(Code.DUPLICATE, "x").within("y")) == "y: x (DUPLICATE)"


def test_catalog_views(spark):
    cat = parse(PREAMBLE, {"type": "clock-class", "id": "k", "frequency": 9}, {"type": "data-stream-class", "default-clock-class-id": "k"}, {"type": "event-record-class", "name": "e", "payload-field-class": struct_of(v=uint(mappings={"a": [[1, 2]]}))})
    views = catalog_views(spark, cat, "t_")
    assert views["clocks"].first().frequency == 9
    joined = spark.sql("select e.name, s.clock_id from t_event_classes e join t_stream_classes s on s.id = e.stream_class_id").first()
    assert (joined.name, joined.clock_id) == ("e", "k")
    fields = {tuple(r.path): r for r in views["fields"].collect()}
    assert fields[("v",)].type == c.FIXED_UINT and json.loads(fields[("v",)].mappings) == {"a": [[1, 2]]}
    assert views["trace"].count() == 1 and views["aliases"].count() == 0
