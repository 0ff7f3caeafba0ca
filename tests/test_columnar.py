"""What numpy decodes at once equals what is decoded event by event."""

from __future__ import annotations

import random

import pytest

from chronoloom.plans.schema import Layout, arrow_type
from chronoloom.sources import encoder as enc
from chronoloom.sources.columnar import ColumnarDecoder
from chronoloom.sources.decoder import StreamDecoder
from chronoloom.sources.metadata import Catalog
from chronoloom.sources.trace_source import Rows, packet_values


def number(name, kind, length, order="little-endian"):
    return enc.member(name, kind, length=length, byte_order=order)


SINT, FLOAT = "fixed-length-signed-integer", "fixed-length-floating-point-number"
SAME = enc.structure(enc.uint("a", 64), number("b", SINT, 32, "big-endian"), number("c", FLOAT, 32))
OTHER = enc.structure(number("x", FLOAT, 64, "big-endian"), number("y", SINT, 16), enc.uint("z", 16), enc.uint("z", 32))


@pytest.mark.parametrize("classes", [{0: ("one", SAME)}, {0: ("one", SAME), 7: ("two", OTHER)}, {0: ("one", SAME), 3: (None, SAME)}])
def test_equal_to_one_by_one(classes):
    r = random.Random(6)
    draw = {"a": lambda: r.getrandbits(64), "b": lambda: r.randint(-(1 << 31), (1 << 31) - 1), "c": lambda: 1.5, "x": lambda: r.random(), "y": lambda: r.randint(-9, 9), "z": lambda: r.getrandbits(16)}
    meta = enc.trace_metadata({k: v for k, v in classes.items()}, frequency=1333337)
    if any(name is None for name, _ in classes.values()):
        meta = meta.replace(b'"name": null, ', b"")
    catalog = Catalog.parse(meta)
    rows = []
    for i in range(50):
        k = r.choice(list(classes))
        rows.append((1000 + i, k, {m["name"]: draw[m["name"]]() for m in classes[k][1]["member-classes"]}))
    data = enc.encode_packet(catalog, 4, 2, 3, rows[:30]) + enc.encode_packet(catalog, 4, 3, 3, rows[30:])
    for wanted in (None, "one"):
        layout = Layout([catalog], wanted)
        schema = layout.schema()
        slow = Rows(layout, schema, 1000)
        fast = ColumnarDecoder(catalog, layout, schema.names, [arrow_type(f.dataType) for f in schema.fields])
        decoder, got = StreamDecoder(catalog, data), []
        for p in decoder.packets():
            base = packet_values(0, "d", "f", p)
            got += fast.batch(data, p, base).to_pylist()
            for e in decoder.events(p):
                if layout.wanted(e.cls):
                    slow.add(base, e)
        assert got == slow.batch().to_pylist() and len(got)


def test_other_layouts_are_left():
    text = enc.structure(enc.member("s", "null-terminated-string"))
    catalog = Catalog.parse(enc.trace_metadata({0: ("e", text)}))
    data = enc.encode_packet(catalog, 0, 0, 0, [(1, 0, {"s": "a"})])
    layout = Layout([catalog])
    schema = layout.schema()
    fast = ColumnarDecoder(catalog, layout, schema.names, [arrow_type(f.dataType) for f in schema.fields])
    p = next(StreamDecoder(catalog, data).packets())
    assert fast.batch(data, p, packet_values(0, "d", "f", p)) is None
