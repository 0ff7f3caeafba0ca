from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.errors import Code, TraceError
from chronoloom.sources import classes as c
from chronoloom.sources import encoder as enc
from chronoloom.sources.decoder import Bits, StreamDecoder, advanced, read_leb128, text_of
from chronoloom.sources.metadata import Catalog


def catalog(payload, header=None, context=None, clock=False, trace=None, events=()):
    fragments = [{"type": "preamble", "version": 2, "uuid": [7] * 16}]
    if trace:
        fragments.append({"type": "trace-class", "packet-header-field-class": trace})
    if clock:
        fragments.append({"type": "clock-class", "id": "k", "frequency": 1000})
    stream = {"type": "data-stream-class"} | ({"default-clock-class-id": "k"} if clock else {})
    stream |= {"event-record-header-field-class": header} if header else {}
    stream |= {"packet-context-field-class": context} if context else {}
    fragments += [stream, {"type": "event-record-class", "payload-field-class": payload}, *events]
    return Catalog.parse(b"".join(b"\x1e" + json.dumps(f).encode() for f in fragments))


def decoded(cat, data):
    out = []
    decoder = StreamDecoder(cat, data)
    try:
        for p in decoder.packets():
            for e in decoder.events(p):
                out.append(e)
    except TraceError as e:
        return out, e.code
    return out, None


def payloads(payload, data, **more):
    events, code = decoded(catalog(payload, **more), data)
    return [e.properties["payload"] for e in events], code


def fixed(name, kind, length, order="little-endian", **more):
    return {"name": name, "field-class": {"type": kind, "length": length, "byte-order": order, **more}}


def round_trip(payload, value):
    cat = catalog(payload)
    bits = enc.Bits()
    enc.encode(bits, cat.streams[0].events[0].payload, value)
    events, code = decoded(cat, bytes(bits.data))
    assert code is None and len(events) == 1
    return events[0].properties["payload"]


@given(
    st.lists(
        st.tuples(st.integers(1, 64), st.sampled_from([c.FIXED_UINT, c.FIXED_SINT, c.FIXED_BITS]), st.sampled_from(["first-to-last", "last-to-first"]), st.sampled_from([1, 2, 8, 16])),
        min_size=1,
        max_size=8,
    ),
    st.sampled_from(["little-endian", "big-endian"]),
    st.data(),
)
@settings(max_examples=150, deadline=None)
def test_integers_of_any_length_order_and_alignment(fields, order, data):
    members = [fixed(f"m{i}", kind, n, order, **{"bit-order": bit, "alignment": a}) for i, (n, kind, bit, a) in enumerate(fields)]
    value = {f"m{i}": data.draw(st.integers(-(1 << (n - 1)), (1 << (n - 1)) - 1) if kind == c.FIXED_SINT else st.integers(0, (1 << n) - 1)) for i, (n, kind, _, _) in enumerate(fields)}
    members.append(fixed("end", c.FIXED_UINT, 64, order, alignment=8))  # so that padding is no event
    value["end"] = 1
    assert round_trip(enc.structure(*members), value) == value


@given(st.integers(0, (1 << 64) - 1), st.integers(-(1 << 63), (1 << 63) - 1))
@settings(max_examples=100, deadline=None)
def test_variable_length_integers(u, s):
    assert round_trip(enc.structure(enc.member("u", c.VAR_UINT), enc.member("s", c.VAR_SINT)), {"u": u, "s": s}) == {"u": u, "s": s}


def test_leb128_counts_its_bits():
    assert read_leb128(Bits(bytes([0xB4, 0xC7, 0x72]))) == (1876916, 21)


@pytest.mark.parametrize("encoding", sorted(c.ENCODINGS))
def test_strings(encoding):
    value = {"a": "Üñ €", "n": 8 * c.ENCODINGS[encoding], "b": "", "d": ""}
    raw = "hello wo".encode(encoding)
    payload = enc.structure(
        enc.member("a", c.NULL_STRING, encoding=encoding), enc.uint("n", 16),
        {"name": "d", "field-class": {"type": c.DYNAMIC_STRING, "encoding": encoding, "length-field-location": {"path": ["n"]}}}, enc.member("b", c.STATIC_STRING, length=8, encoding=encoding),
    )
    value = {"a": "Üñ €", "n": len(raw), "d": "hello wo", "b": "a"}
    assert round_trip(payload, value) == value


def test_string_ends():
    assert text_of(b"ab\0cd", "utf-8") == "ab" and text_of(b"a\xffb", "utf-8") == "a?b"
    with pytest.raises(TraceError) as e:
        text_of(b"abc", "utf-16le")
    assert e.value.code == Code.INVALID_STRING_LENGTH
    assert payloads(enc.structure(enc.member("a", c.NULL_STRING)), b"abc")[1] == Code.NOT_ENOUGH_BITS


def test_floats_booleans_blobs_and_arrays():
    payload = enc.structure(
        fixed("f", c.FIXED_FLOAT, 32, "big-endian"), fixed("d", c.FIXED_FLOAT, 64, "big-endian"), fixed("t", c.FIXED_BOOL, 8, "big-endian"),
        enc.member("b", c.STATIC_BLOB, length=3), {"name": "a", "field-class": {"type": c.STATIC_ARRAY, "length": 3, "element-field-class": enc.structure(enc.uint("x", 8))}},
    )
    value = {"f": 1.5, "d": -2.25, "t": True, "b": b"\1\2\3", "a": [{"x": 1}, {"x": 2}, {"x": 3}]}
    assert round_trip(payload, value) == value


def test_variants_and_optionals():
    ranges = lambda *r: {"selector-field-ranges": [list(x) for x in r]}
    at = {"origin": "event-record-payload", "path": ["s"]}
    small = fixed("", c.FIXED_SINT, 8)["field-class"]
    payload = enc.structure(
        enc.uint("s", 8),
        {"name": "v", "field-class": {"type": "variant", "selector-field-location": at, "options": [{"field-class": small, **ranges((0, 9))}, {"name": "big", "field-class": enc.uint("", 32)["field-class"], **ranges((10, 20))}]}},
        {"name": "o", "field-class": {"type": "optional", "field-class": small, "selector-field-location": at, **ranges((0, 4), (15, 20))}},
    )
    got, code = payloads(payload, bytes([5, 0xFB, 20, 1, 0, 0, 0, 7, 3, 4, 0xFE]))
    assert code is None
    assert [(p["v"]["tag"], p["v"]["value"], p["o"]) for p in got] == [(0, -5, None), (1, 1, 7), (0, 4, -2)]
    assert payloads(payload, bytes([99]))[1] == Code.NO_SELECTOR_FIELD


def test_field_locations():
    inner = enc.structure(enc.uint("n", 8), {"name": "b", "field-class": {"type": c.DYNAMIC_BLOB, "length-field-location": {"origin": "event-record-payload", "path": ["outer", "n"]}}})
    payload = enc.structure({"name": "outer", "field-class": {"type": c.STATIC_ARRAY, "length": 2, "element-field-class": inner}})
    got, code = payloads(payload, bytes([1, 65, 2, 66, 67]))
    assert code is None and got[0]["outer"] == [{"n": 1, "b": b"A"}, {"n": 2, "b": b"BC"}]
    up = enc.structure(enc.uint("n", 8), {"name": "in", "field-class": enc.structure({"name": "b", "field-class": {"type": c.DYNAMIC_BLOB, "length-field-location": {"path": [None, "n"]}}})})
    assert payloads(up, bytes([2, 1, 2]))[0][0]["in"] == {"b": b"\1\2"}
    late = enc.structure({"name": "b", "field-class": {"type": c.DYNAMIC_BLOB, "length-field-location": {"path": ["n"]}}}, enc.uint("n", 8))
    assert payloads(late, bytes([1, 1]))[1] == Code.MISSING_FIELD_LOCATION
    after = enc.structure(*payload["member-classes"], {"name": "z", "field-class": {"type": c.DYNAMIC_BLOB, "length-field-location": {"path": ["outer", "n"]}}})
    assert payloads(after, bytes([0, 0, 1]))[1] == Code.MISSING_FIELD_LOCATION


def test_byte_order_cannot_change_within_a_byte():
    mixed = enc.structure(fixed("a", c.FIXED_UINT, 5), fixed("b", c.FIXED_UINT, 3, "big-endian"))
    assert payloads(mixed, b"\xff")[1] == Code.MID_BYTE_ORDER_CHANGE


def test_clock_turns():
    assert advanced(0x1FE, 0x01, 8) == 0x201 and advanced(0x1FE, 0xFF, 8) == 0x1FF and advanced(5, 3, 64) == 3


def test_packets_errors_and_what_came_before():
    meta = enc.trace_metadata({0: ("e", enc.structure(enc.uint("x", 32)))})
    cat = Catalog.parse(meta)
    one = enc.encode_packet(cat, 1, 0, 0, [(10, 0, {"x": 1}), (20, 0, {"x": 2})])
    two = enc.encode_packet(cat, 1, 1, 5, [(30, 0, {"x": 3})])
    events, code = decoded(cat, one + two)
    assert code is None and [(e.cycles, e.properties["payload"]["x"], e.packet.sequence, e.packet.discarded) for e in events] == [(10, 1, 0, 0), (20, 2, 0, 0), (30, 3, 1, 5)]
    assert decoded(cat, (one + two)[:-2])[1] in (Code.NOT_ENOUGH_BITS, None)
    events, code = decoded(cat, one + two[:-12])
    assert len(events) == 2 and code == Code.NOT_ENOUGH_BITS
    events, code = decoded(cat, one + b"\0" + two[1:])
    assert len(events) == 2 and code == Code.MAGIC_MISMATCH
    unknown = enc.structure(enc.uint("id", 8, "event-record-class-id"))
    events, code = decoded(catalog(enc.structure(enc.uint("x", 8)), header=unknown), bytes([0, 1, 9, 1]))
    assert len(events) == 1 and code == Code.NO_SUCH_ID
    uuid = enc.structure({"name": "u", "field-class": {"type": c.STATIC_BLOB, "length": 16, "roles": ["metadata-stream-uuid"]}})
    assert decoded(catalog(enc.structure(enc.uint("x", 8)), trace=uuid), bytes([8] * 17))[1] == Code.UUID_MISMATCH
    sizes = enc.structure(enc.uint("c", 8, "packet-content-length"), enc.uint("t", 8, "packet-total-length"))
    assert decoded(catalog(enc.structure(enc.uint("x", 8)), context=sizes), bytes([64, 32, 1, 1]))[1] == Code.INVALID_CONTENT_LENGTH
