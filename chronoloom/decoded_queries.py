"""Queries that write a trace from the driver's tables and decode it again, one for each part of the format.

`items` is the part table as a trace: three streams, an event for each part, whose payload has a member of every field class."""

from __future__ import annotations

import json
import os
import shutil
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import queries as Q
from .errors import Code, TraceError, describe
from .operators import events as ops
from .plans.catalog import catalog_rows
from .queries import _TR, query, table
from .sources import classes as c
from .sources import encoder as enc
from .sources.metadata import Catalog
from .sources.trace_source import decode_files, load_catalog, read_trace
from .streaming import events as streaming

UUID = bytes(range(16))
#: Ranges of p_size (1 to 50) by which the optional and the variant choose.
_FEW, _SOME, _MANY = [[1, 10]], [[11, 30]], [[31, 50]]


def _fixed(name: str, kind: str, length: int, order: str = "little-endian", **more) -> dict:
    return enc.member(name, kind, length=length, byte_order=order, **more)


def _sized(name: str, kind: str, path: list, origin: str | None = None, **more) -> dict:
    return enc.member(name, kind, length_field_location={"path": path, **({"origin": origin} if origin else {})}, **more)


def _class(m: dict):
    return m["field-class"]


def item_class() -> dict:
    selector = {"origin": "event-record-payload", "path": ["size"]}
    inner = enc.structure(enc.uint("n", 8), _sized("b", c.DYNAMIC_BLOB, ["outer", "n"], "event-record-payload"))
    option = lambda cls, r, **name: {"field-class": cls, "selector-field-ranges": r, **name}
    return enc.structure(
        enc.member("key", c.VAR_UINT),
        enc.uint("size", 8, mappings={"small": [[5, 10], [1, 6]], "odd": [[1, 1], [3, 3], [5, 5]], "below": [[-9, 2]], "never": [[-9, -1]]}),
        _fixed("below", c.FIXED_SINT, 11, bit_order="last-to-first"),
        _fixed("turned", c.FIXED_UINT, 24, "big-endian", bit_order="first-to-last", alignment=8, preferred_display_base=16),
        _fixed("bits", c.FIXED_BITS, 5, alignment=8),
        _fixed("marks", c.FIXED_MAP, 8, alignment=8, flags={"low": [[0, 3]], "top": [[7, 7]]}),
        _fixed("even", c.FIXED_BOOL, 8, alignment=8),
        _fixed("price", c.FIXED_FLOAT, 64, alignment=8),
        _fixed("half", c.FIXED_FLOAT, 32, "big-endian", alignment=32),
        {"name": "name_bytes", "field-class": "length"},
        _sized("name", c.DYNAMIC_STRING, ["name_bytes"]),
        enc.member("brand", c.STATIC_STRING, length=12),
        enc.member("kind", c.NULL_STRING, encoding="utf-16le"),
        enc.member("wide", c.NULL_STRING, encoding="utf-32be"),
        enc.uint("n_words", 8),
        _sized("words", c.DYNAMIC_ARRAY, ["n_words"], element_field_class={"type": c.NULL_STRING}),
        enc.member("pair", c.STATIC_ARRAY, length=2, element_field_class=enc.structure(enc.uint("x", 8), _fixed("y", c.FIXED_SINT, 16))),
        enc.member("four", c.STATIC_BLOB, length=4),
        enc.uint("n_raw", 8),
        _sized("raw", c.DYNAMIC_BLOB, ["n_raw"]),
        enc.member("maybe", c.OPTIONAL, field_class=_class(_fixed("", c.FIXED_SINT, 16)), selector_field_location=selector, selector_field_ranges=[[1, 10], [20, 30]]),
        enc.member("by_flag", c.OPTIONAL, field_class={"type": c.VAR_SINT}, selector_field_location={"path": ["even"]}),
        enc.member("choice", c.VARIANT, selector_field_location=selector, options=[option(_class(enc.uint("", 16)), _FEW, name="few"), option({"type": c.NULL_STRING}, _SOME, name="some"), option(enc.structure(enc.uint("n", 8)), _MANY, name="many")]),
        enc.member("outer", c.STATIC_ARRAY, length=2, element_field_class=inner),
        enc.member("up", c.STRUCTURE, member_classes=[enc.uint("m", 8), enc.member("deep", c.STRUCTURE, member_classes=[_sized("t", c.DYNAMIC_STRING, [None, "m"])])]),
    )


def item_metadata() -> bytes:
    return enc.trace_metadata({0: ("item", item_class())}, uuid=UUID, aliases={"length": _class(enc.uint("", 16))})


def item_trace(spark: SparkSession, sf_dir: str) -> str:
    part = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    raw = lambda text: F.encode(text, "UTF-8")
    short = F.substr(F.col("p_type"), F.lit(1), size % 6 + 1)
    nothing = lambda kind: F.lit(None).cast(kind)
    values = {
        "key": key, "size": size, "below": size - 25, "turned": key, "bits": size % 32, "marks": key % 256, "even": size % 2 == 0, "price": F.col("p_retailprice"), "half": (size / 4).cast("float"),
        "name_bytes": F.octet_length("p_name").cast("long"), "name": F.col("p_name"), "brand": F.col("p_brand"), "kind": F.col("p_type"), "wide": F.concat("p_type", F.lit(" é€")),
        "n_words": size % 4, "words": F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.col("p_brand"), F.lit("-"), i.cast("string"))),
        "pair": F.array(*(F.struct(((key + i) % 200).alias("x"), (i - key % 1000).alias("y")) for i in (0, 1))),
        "four": raw(F.lpad((key % 10000).cast("string"), 4, "0")), "n_raw": F.octet_length(short).cast("long"), "raw": raw(short),
        "maybe": F.when(size.between(1, 10) | size.between(20, 30), size * 3 - 60), "by_flag": F.when(size % 2 == 0, -key),
        "choice": F.when(size <= 10, F.struct(F.lit(0).alias("_tag"), (size * 2).alias("few"), nothing("string").alias("some"), nothing("struct<n:bigint>").alias("many")))
        .when(size <= 30, F.struct(F.lit(1).alias("_tag"), nothing("bigint").alias("few"), F.col("p_brand").alias("some"), nothing("struct<n:bigint>").alias("many")))
        .otherwise(F.struct(F.lit(2).alias("_tag"), nothing("bigint").alias("few"), nothing("string").alias("some"), F.struct((key % 100).alias("n")).alias("many"))),
        "outer": F.array(F.struct(F.octet_length(short).cast("long").alias("n"), raw(short).alias("b")), F.struct(F.lit(2).cast("long").alias("n"), raw(F.substr(F.col("p_name"), F.lit(1), F.lit(2))).alias("b"))),
        "up": F.struct(F.octet_length("p_type").cast("long").alias("m"), F.struct(F.col("p_type").alias("t")).alias("deep")),
    }
    # The elements beyond n_words are not written.
    values["words"] = F.slice(values["words"], F.lit(1), (size % 4).cast("int"))
    place = F.row_number().over(W.partitionBy("stream").orderBy("cycles")).cast("long") - 1
    rows = part.select((key % 3).alias("stream"), (key * 1000).alias("cycles"), F.lit(0).alias("class_id"), F.lit(0).alias("snapshot"), *(v.alias(k) for k, v in values.items())).withColumn("seq", place)
    return Q.kept_trace(spark, sf_dir, "items", lambda: Q.written(spark, rows, item_metadata(), list(values)))


def items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    return read_trace(spark, item_trace(spark, sf_dir)), F.col("payload")


def _key(p):
    return p["key"].cast("bigint").alias("p_partkey")


@query("optional_field", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 OR p_size BETWEEN 20 AND 30 THEN CAST(p_size * 3 - 60 AS BIGINT) END AS v, CASE WHEN p_size % 2 = 0 THEN -p_partkey END AS by_flag FROM part")
def optional_field(spark, sf_dir):
    events, p = items(spark, sf_dir)
    return events.select(_key(p), p["maybe"].alias("v"), p["by_flag"].alias("by_flag"))


@query(
    "variant_field",
    "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 30 THEN 1 ELSE 2 END AS tag, CASE WHEN p_size <= 10 THEN CAST(p_size * 2 AS VARCHAR) WHEN p_size <= 30 THEN p_brand ELSE CAST(p_partkey % 100 AS VARCHAR) END AS v FROM part",
)
def variant_field(spark, sf_dir):
    events, p = items(spark, sf_dir)
    x = p["choice"]
    return events.select(_key(p), x["_tag"].alias("tag"), F.coalesce(x["few"].cast("string"), x["some"], x["many"]["n"].cast("string")).alias("v"))


@query("dyn_array", "SELECT p_partkey, CAST(p_size % 4 AS INTEGER) AS n, array_to_string(list_transform(range(1, p_size % 4 + 1), lambda i: p_brand || '-' || i), ',') AS v FROM part")
def dyn_array(spark, sf_dir):
    events, p = items(spark, sf_dir)
    return events.select(_key(p), F.size(p["words"]).alias("n"), F.array_join(p["words"], ",").alias("v"))


@query("static_array", "SELECT p_partkey, p_partkey % 200 AS x0, 0 - p_partkey % 1000 AS y0, (p_partkey + 1) % 200 AS x1, 1 - p_partkey % 1000 AS y1 FROM part")
def static_array(spark, sf_dir):
    events, p = items(spark, sf_dir)
    return events.select(_key(p), *(p["pair"][i][k].alias(f"{k}{i}") for i in (0, 1) for k in "xy"))


@query("dyn_string", "SELECT p_partkey, p_name AS v, CAST(strlen(p_name) AS BIGINT) AS n_bytes FROM part")
def dyn_string(spark, sf_dir):
    events, p = items(spark, sf_dir)
    return events.select(_key(p), p["name"].alias("v"), p["name_bytes"].alias("n_bytes"))


@query("string_encodings", "SELECT p_partkey, p_brand AS fixed, p_type AS utf16, p_type || ' é€' AS utf32 FROM part")
def string_encodings(spark, sf_dir):
    events, p = items(spark, sf_dir)
    return events.select(_key(p), p["brand"].alias("fixed"), p["kind"].alias("utf16"), p["wide"].alias("utf32"))


_SHORT = "substr(p_type, 1, p_size % 6 + 1)"


@query("blob_field", f"SELECT p_partkey, lower(hex(encode(lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0')))) AS four, lower(hex(encode({_SHORT}))) AS raw FROM part")
def blob_field(spark, sf_dir):
    events, p = items(spark, sf_dir)
    return events.select(_key(p), *(F.lower(F.hex(p[k])).alias(k) for k in ("four", "raw")))


@query("field_location", f"SELECT p_partkey, {_SHORT} || '|' || substr(p_name, 1, 2) AS in_arrays, p_type AS above FROM part")
def field_location(spark, sf_dir):
    events, p = items(spark, sf_dir)
    return events.select(_key(p), F.array_join(F.transform(p["outer"], lambda x: F.decode(x["b"], "UTF-8")), "|").alias("in_arrays"), p["up"]["deep"]["t"].alias("above"))


@query("decoded_integers", "SELECT p_partkey, CAST(p_size - 25 AS BIGINT) AS below, p_partkey AS turned, CAST(p_size % 32 AS BIGINT) AS bits, p_partkey % 256 AS marks, p_size % 2 = 0 AS even FROM part")
def decoded_integers(spark, sf_dir):
    events, p = items(spark, sf_dir)
    return events.select(_key(p), *(p[k].alias(k) for k in ("below", "turned", "bits", "marks", "even")))


@query("decoded_floats", "SELECT p_partkey, p_retailprice AS price, p_size / 4.0 AS half FROM part")
def decoded_floats(spark, sf_dir):
    events, p = items(spark, sf_dir)
    return events.select(_key(p), p["price"].alias("price"), p["half"].cast("double").alias("half"))


@query("packet_field_lookup", "SELECT p_partkey, p_partkey % 3 AS stream, (row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) - 1) // 64 AS packet, lower(hex('\\x00\\x01\\x02\\x03\\x04\\x05\\x06\\x07\\x08\\x09\\x0A\\x0B\\x0C\\x0D\\x0E\\x0F'::BLOB)) AS uuid FROM part")
def packet_field_lookup(spark, sf_dir):
    events, p = items(spark, sf_dir)
    found = {k: ops.find_field(events, k, packet=True) for k in ("stream_id", "sequence", "uuid")}
    return events.select(_key(p), found["stream_id"].cast("bigint").alias("stream"), found["sequence"].cast("bigint").alias("packet"), F.lower(F.hex(found["uuid"])).alias("uuid"))


@query(
    "decoded_labels",
    "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' END, CASE WHEN p_size IN (1, 3, 5) THEN 'odd' END, CASE WHEN p_size BETWEEN 0 AND 2 THEN 'below' END], lambda x: x IS NOT NULL), ',') AS labels FROM part",
)
def decoded_labels(spark, sf_dir):
    """Labels by the mappings in the metadata: ranges merged, cut to what the class holds."""
    from .functions import numbers as N

    events, p = items(spark, sf_dir)
    size = next(m.cls for m in load_catalog(item_trace(spark, sf_dir)).streams[0].events[0].payload.members if m.name == "size")
    return events.select(_key(p), F.array_join(N.labels(p["size"], {k: list(r) for k, r in size.mappings.items()}), ",").alias("labels"))


_FIELDS = (
    "('key', 'variable-length-unsigned-integer', 8, NULL), ('size', 'fixed-length-unsigned-integer', 1, NULL), ('below', 'fixed-length-signed-integer', 1, NULL), ('turned', 'fixed-length-unsigned-integer', 8, NULL), "
    "('bits', 'fixed-length-bit-array', 8, NULL), ('marks', 'fixed-length-bit-map', 8, NULL), ('even', 'fixed-length-boolean', 8, NULL), ('price', 'fixed-length-floating-point-number', 8, NULL), "
    "('half', 'fixed-length-floating-point-number', 32, NULL), ('name_bytes', 'fixed-length-unsigned-integer', 1, NULL), ('name', 'dynamic-length-string', 8, 'utf-8'), ('brand', 'static-length-string', 8, 'utf-8'), "
    "('kind', 'null-terminated-string', 8, 'utf-16le'), ('wide', 'null-terminated-string', 8, 'utf-32be'), ('n_words', 'fixed-length-unsigned-integer', 1, NULL), ('words', 'dynamic-length-array', 8, NULL), "
    "('pair', 'static-length-array', 1, NULL), ('four', 'static-length-blob', 8, NULL), ('n_raw', 'fixed-length-unsigned-integer', 1, NULL), ('raw', 'dynamic-length-blob', 8, NULL), ('maybe', 'optional', 1, NULL), "
    "('by_flag', 'optional', 1, NULL), ('choice', 'variant', 1, NULL), ('outer', 'static-length-array', 8, NULL), ('up', 'structure', 8, NULL)"
)


@query("catalog_fields", f"SELECT * FROM (VALUES {_FIELDS}) f(name, type, alignment, encoding)")
def catalog_fields(spark, sf_dir):
    """Top-level members of the payload as the catalog's view of fields has them, with alignments worked out."""
    schema, rows = catalog_rows(Catalog.parse(item_metadata()))["fields"]
    found = spark.createDataFrame(rows, schema).where((F.col("property") == "payload") & (F.size("path") == 1))
    return found.select(F.col("path")[0].alias("name"), "type", "alignment", "encoding")


@query(
    "mapping_ranges",
    "SELECT * FROM (VALUES ('odd', '1-1,3-3,5-5'), ('small', '1-10'), ('below', '0-2'), ('never', '')) m(label, ranges)",
)
def mapping_ranges(spark, sf_dir):
    """Ranges of a label as the metadata compiler leaves them: sorted, merged where they meet, cut to the class's values."""
    size = Catalog.parse(item_metadata()).streams[0].events[0].payload.members[1].cls
    rows = [(name, ",".join(f"{a}-{b}" for a, b in r)) for name, r in size.mappings.items()]
    return spark.createDataFrame(rows, "label string, ranges string")


@query("catalog_trace", "SELECT '000102030405060708090a0b0c0d0e0f' AS uuid, 'length' AS alias, 'metadata-stream-uuid' AS role")
def catalog_trace(spark, sf_dir):
    views = {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in catalog_rows(Catalog.parse(item_metadata())).items()}
    role = views["fields"].where(F.array_contains("roles", "metadata-stream-uuid")).select(F.col("roles")[0].alias("role"))
    one = lambda frame, *c: frame.select(*c, F.lit(1).alias("one")).coalesce(1)  # noqa: E731  (one row each)
    trace, alias = one(views["trace"], F.lower(F.hex("uuid")).alias("uuid")), one(views["aliases"], F.col("name").alias("alias"))
    return trace.join(alias, "one").join(one(role, "role"), "one").drop("one")


_BRANDS = "(SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS id FROM (SELECT DISTINCT p_brand FROM part))"


@query("json_attributes", f"SELECT p_brand AS event_name, CAST(id AS BIGINT) AS event_class_id, CAST(id * 3 AS BIGINT) AS k, CASE WHEN id % 2 = 0 THEN 'even' END AS tag FROM {_BRANDS}")
def json_attributes(spark, sf_dir):
    """User attributes of event classes: objects in the metadata, parsed to variants in the catalog."""
    brands = sorted(r[0] for r in table(spark, sf_dir, "part").select("p_brand").distinct().collect())
    payload = enc.structure(enc.uint("x", 8))
    extra = {i: {"k": 3 * i, "deep": {"tags": ["even"] if i % 2 == 0 else []}} for i in range(len(brands))}
    schema, rows = catalog_rows(Catalog.parse(enc.trace_metadata({i: (b, payload) for i, b in enumerate(brands)}, attributes=extra)))["event_classes"]
    a = F.parse_json("attributes")
    return spark.createDataFrame(rows, schema).select(F.col("name").alias("event_name"), F.col("id").cast("bigint").alias("event_class_id"), F.variant_get(a, "$.k", "bigint").alias("k"), F.try_variant_get(a, "$.deep.tags[0]", "string").alias("tag"))


_CLOCKS = [("a", None, "mono", "u1", 1000, 5), ("b", None, "mono", "u1", 1000, None), ("c", "ns", "mono", "u1", 2000, 5), ("d", "ns", "mono", "u1", 2000, 5)]


@query(
    "clock_identity",
    "WITH c(id, namespace, name, uid, frequency, precision) AS (VALUES ('a', NULL, 'mono', 'u1', 1000, 5), ('b', NULL, 'mono', 'u1', 1000, NULL), ('c', 'ns', 'mono', 'u1', 2000, 5), ('d', 'ns', 'mono', 'u1', 2000, 5)) "
    "SELECT x.id AS one, y.id AS other, x.namespace IS NOT DISTINCT FROM y.namespace AND x.name IS NOT DISTINCT FROM y.name AND x.uid IS NOT DISTINCT FROM y.uid AS same, "
    "x.namespace IS NOT DISTINCT FROM y.namespace AND x.name IS NOT DISTINCT FROM y.name AND x.uid IS NOT DISTINCT FROM y.uid AND x.frequency IS NOT DISTINCT FROM y.frequency AND x.precision IS NOT DISTINCT FROM y.precision AS strict "
    "FROM c x JOIN c y ON x.id < y.id",
)
def clock_identity(spark, sf_dir):
    """Every pair of the clocks of a trace, compared by identity and in full."""
    fragments = [{"type": "preamble", "version": 2}]
    for i, namespace, name, uid, frequency, precision in _CLOCKS:
        given = {"namespace": namespace, "name": name, "uid": uid, "frequency": frequency, "precision": precision}
        fragments.append({"type": "clock-class", "id": i} | {k: v for k, v in given.items() if v is not None})
    clocks = Catalog.parse(b"".join(b"\x1e" + json.dumps(f).encode() for f in fragments)).clocks
    rows = [(i, j, clocks[i].same_identity(clocks[j]), clocks[i].same_identity(clocks[j], strict=True)) for i, j in combinations(sorted(clocks), 2)]
    return spark.createDataFrame(rows, "one string, other string, same boolean, strict boolean")


_BROKEN = [
    ("no preamble", [{"type": "trace-class"}]), ("second preamble", [{"type": "preamble", "version": 2}] * 2), ("version", [{"type": "preamble", "version": 3}]),
    ("uuid", [{"type": "preamble", "version": 2, "uuid": [1]}]), ("extension", [{"type": "preamble", "version": 2, "extensions": {"x": 1}}]),
]
_BROKEN_CLASSES = [
    ("alias", "none"), ("class", {"type": "none"}), ("no length", {"type": c.FIXED_UINT, "byte-order": "big-endian"}), ("length", {"type": c.FIXED_FLOAT, "length": 16, "byte-order": "big-endian"}),
    ("byte order", {"type": c.FIXED_UINT, "length": 8, "byte-order": "x"}), ("bit order", {"type": c.FIXED_UINT, "length": 8, "byte-order": "big-endian", "bit-order": "x"}),
    ("alignment", {"type": c.FIXED_UINT, "length": 8, "byte-order": "big-endian", "alignment": 3}), ("base", {"type": c.VAR_UINT, "preferred-display-base": 3}), ("range", {"type": c.VAR_UINT, "mappings": {"a": [[2, 1]]}}),
    ("ranges", {"type": c.VAR_UINT, "mappings": {"a": []}}), ("encoding", {"type": c.NULL_STRING, "encoding": "x"}), ("flags", {"type": c.FIXED_MAP, "length": 8, "byte-order": "big-endian", "flags": {}}),
    ("location", {"type": c.DYNAMIC_BLOB, "length-field-location": {"path": []}}),
    ("variant", {"type": c.VARIANT, "selector-field-location": {"path": ["s"]}, "options": [{"field-class": {"type": c.VAR_UINT}, "selector-field-ranges": [[1, 5]]}, {"field-class": {"type": c.VAR_UINT}, "selector-field-ranges": [[5, 9]]}]}),
    ("clock role", {"type": c.VAR_UINT, "roles": ["default-clock-timestamp"]}),
]
_BROKEN_HEADERS = [
    ("uuid role", enc.structure(enc.member("u", c.STATIC_BLOB, length=16, roles=["metadata-stream-uuid"]))), ("magic role", enc.structure(enc.uint("x", 8), enc.uint("m", 32, "packet-magic-number"))),
]


@query(
    "metadata_errors",
    "SELECT * FROM (VALUES ('no preamble', -37, 'no preamble'), ('second preamble', -34, 'duplicate'), ('version', -36, 'unsupported version'), ('uuid', -15, 'invalid uuid'), ('extension', -28, 'unsupported extension'), "
    "('alias', -26, 'no such alias'), ('class', -17, 'invalid field class'), ('no length', -27, 'missing property'), ('length', -21, 'unsupported length'), ('byte order', -11, 'invalid byte order'), "
    "('bit order', -12, 'invalid bit order'), ('alignment', -10, 'invalid alignment'), ('base', -20, 'invalid base'), ('range', -13, 'invalid range'), ('ranges', -14, 'invalid range set'), ('encoding', -22, 'invalid encoding'), "
    "('flags', -18, 'invalid flags'), ('location', -16, 'invalid field location'), ('variant', -24, 'invalid variant'), ('clock role', -30, 'no default clock'), ('uuid role', -31, 'invalid uuid role'), "
    "('magic role', -32, 'invalid magic role'), ('stream', -35, 'no such id'), ('structure', -33, 'not a struct'), ('cycles', -25, 'cycles gte frequency')) e(broken, code, message)",
)
def metadata_errors(spark, sf_dir):
    """What the metadata compiler says to metadata that breaks one rule each."""
    good = [{"type": "preamble", "version": 2}]
    stream = lambda cls: {"type": "data-stream-class", "event-record-header-field-class": cls}
    cases = [*_BROKEN, *((name, [*good, stream(enc.structure({"name": "x", "field-class": cls}))]) for name, cls in _BROKEN_CLASSES)]
    cases += [(name, [*good, {"type": "trace-class", "packet-header-field-class": cls}]) for name, cls in _BROKEN_HEADERS]
    cases += [("stream", [*good, {"type": "event-record-class"}]), ("structure", [*good, stream({"type": c.VAR_UINT})]), ("cycles", [*good, {"type": "clock-class", "id": "k", "frequency": 5, "offset-from-origin": {"cycles": 5}}])]
    rows = []
    for name, fragments in cases:
        try:
            Catalog.parse(b"".join(b"\x1e" + json.dumps(f).encode() for f in fragments))
            code = Code.OK
        except TraceError as e:
            code = e.code
        rows.append((name, int(code), describe(code)))
    return spark.createDataFrame(rows, "broken string, code int, message string")


@query("multi_dir_union", _TR + "SELECT event_id, ts_ns, CAST(stream % 2 AS INTEGER) AS trace_idx FROM tr")
def multi_dir_union(spark, sf_dir):
    """Two directories with metadata of their own, read as one trace."""
    whole = Q.event_trace(spark, sf_dir)

    def split() -> str:
        top = Q.new_directory(spark)
        for i in (0, 1):
            os.makedirs(f"{top}/{i}")
            shutil.copy(f"{whole}/metadata", f"{top}/{i}/metadata")
            for k in (i, i + 2):
                os.link(f"{whole}/stream_{k}", f"{top}/{i}/stream_{k}")
        return top

    top = Q.kept_trace(spark, sf_dir, "two directories", split)
    events = read_trace(spark, f"{top}/0", f"{top}/1")
    return events.select(F.col("payload.event_id").alias("event_id"), "ts_ns", "trace_idx")


@query("single_stream", _TR + "SELECT event_id, ts_ns FROM tr WHERE stream = 1")
def single_stream(spark, sf_dir):
    """One stream file alone: nothing is merged or sorted."""
    events = read_trace(spark, Q.event_trace(spark, sf_dir), file="stream_1")
    return ops.mux(events, sort=False).select(F.col("payload.event_id").alias("event_id"), "ts_ns")


@query("in_memory_streams", _TR + "SELECT event_id, ts_ns, stream FROM tr")
def in_memory_streams(spark, sf_dir):
    """Streams whose bytes Spark's own reader has read."""
    where = Q.event_trace(spark, sf_dir)
    with open(f"{where}/metadata", "rb") as f:
        metadata = f.read()
    events = decode_files(spark.read.format("binaryFile").load(f"file://{where}/stream_*"), metadata)
    return events.select(F.col("payload.event_id").alias("event_id"), "ts_ns", F.col("stream_id").cast("bigint").alias("stream"))


@query("planned_on_executors", _TR + "SELECT event_id, ts_ns, stream FROM tr")
def planned_on_executors(spark, sf_dir):
    """Packets listed by a job, not by the driver."""
    events = read_trace(spark, Q.event_trace(spark, sf_dir), planner="executors", packetBytes=1 << 16)
    return events.select(F.col("payload.event_id").alias("event_id"), "ts_ns", F.col("stream_id").cast("bigint").alias("stream"))


@query("packetized_metadata", _TR + "SELECT event_name, count(*) AS n_events FROM tr GROUP BY event_name")
def packetized_metadata(spark, sf_dir):
    """Metadata in packets of its own, under another name."""
    whole = Q.event_trace(spark, sf_dir)

    def packed() -> str:
        where = Q.new_directory(spark)
        with open(f"{whole}/metadata", "rb") as f, open(f"{where}/described", "wb") as out:
            out.write(enc.metadata_packets(f.read(), UUID, ">"))
        for k in range(4):
            os.link(f"{whole}/stream_{k}", f"{where}/stream_{k}")
        return where

    where = Q.kept_trace(spark, sf_dir, "packetized", packed)
    return ops.count_by_name(read_trace(spark, where, metadataFile="described", batchSize=100))


def _cut_trace(spark, sf_dir) -> str:
    """The trace of events with each file 8 bytes shorter: padding and a part of the last event."""
    whole = Q.event_trace(spark, sf_dir)

    def cut() -> str:
        where = Q.new_directory(spark)
        shutil.copy(f"{whole}/metadata", f"{where}/metadata")
        for k in range(4):
            shutil.copy(f"{whole}/stream_{k}", f"{where}/stream_{k}")
            os.truncate(f"{where}/stream_{k}", os.path.getsize(f"{whole}/stream_{k}") - 8)
        return where

    return Q.kept_trace(spark, sf_dir, "cut", cut)


@query("broken_streams", _TR + "SELECT 'stream_' || stream AS stream_file, count(*) - 1 AS n_valid, CAST(1 AS BIGINT) AS n_errors FROM tr GROUP BY stream")
def broken_streams(spark, sf_dir):
    """Valid events come first, then the error of each stream."""
    events = read_trace(spark, _cut_trace(spark, sf_dir), mode="PERMISSIVE")
    return events.groupBy("stream_file").agg(F.count_if(F.col("_error").isNull()).alias("n_valid"), F.count_if(F.col("_error").contains("NOT_ENOUGH_BITS")).alias("n_errors"))


@query("dropped_tails", _TR + "SELECT count(*) - count(DISTINCT stream) AS n_events FROM tr")
def dropped_tails(spark, sf_dir):
    return ops.count_events(read_trace(spark, _cut_trace(spark, sf_dir), mode="DROPTAIL"))


@query("event_count", _TR + "SELECT count(*) AS n_events FROM tr")
def event_count(spark, sf_dir):
    """The quiet sink: everything is decoded and counted."""
    return ops.count_events(read_trace(spark, Q.event_trace(spark, sf_dir)))


_LINE = (
    f"strftime(make_timestamp(ts_ns // 1000), '[%H:%M:%S.') || {Q._NANOS} || '] ' || event_name || ': {{ event-payload: {{ event_id: ' || event_id || ', user_id: ' || user_id || "
    "', value: ' || printf('%.6f', value) || ', props: \"' || props || '\" } }'"
)


@query("text_sink", _TR + f"SELECT {_LINE} AS line FROM tr")
def text_sink(spark, sf_dir):
    where = Q.new_directory(spark)
    ops.write_text(read_trace(spark, Q.event_trace(spark, sf_dir)), f"file://{where}/lines", with_labels=True, properties=["payload"])
    return spark.read.text(f"file://{where}/lines").select(F.col("value").alias("line"))


@query(
    "command_line",
    Q._INDEX + "SELECT (SELECT count(*) FROM tr) || ' events decoded' AS first, CAST(sum(n_lost) AS BIGINT) || ' events discarded' AS second FROM "
    "(SELECT greatest(snapshot - coalesce(lag(snapshot) OVER (PARTITION BY stream ORDER BY packet), 0), 0) AS n_lost FROM pk)",
)
def command_line(spark, sf_dir):
    """What the command prints when told to be quiet."""
    import io

    from .__main__ import main

    said = io.StringIO()
    main(["-q", "-g", Q.event_trace(spark, sf_dir)], spark, io.StringIO(), said)
    return spark.createDataFrame([tuple(said.getvalue().splitlines())], "first string, second string")


# Streams: each query runs until what is there has been read.


def _drained(spark: SparkSession, frame: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a streaming query has written once it has read everything there is."""
    where, schema = f"file://{Q.new_directory(spark)}", frame.schema
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True)
    if mode == "append":
        running = writer.format("parquet").option("path", f"{where}/rows").start()
    else:
        running = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{where}/rows")).start()
    running.awaitTermination()
    return spark.read.schema(schema).parquet(f"{where}/rows")


@query("windowed_counts", _TR + "SELECT event_name, ts_ns // 86400000000000 AS day, count(*) AS n_events FROM tr GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    events = streaming.stream_trace(spark, Q.event_trace(spark, sf_dir))
    found = _drained(spark, streaming.count_by_window(events, "1 day", "1 hour"), "complete")
    return found.select("event_name", F.expr("unix_micros(window.start) div 86400000000").alias("day"), "n_events")


@query("streamed_lost_events", Q._INDEX + "SELECT 'stream_' || stream AS stream_file, packet AS packet_idx, greatest(snapshot - coalesce(lag(snapshot) OVER (PARTITION BY stream ORDER BY packet), 0), 0) AS n_lost FROM pk")
def streamed_lost_events(spark, sf_dir):
    events = streaming.stream_trace(spark, Q.event_trace(spark, sf_dir))
    return _drained(spark, streaming.lost_events(events.select("stream_file", "packet_idx", F.col("pkt_disc_snapshot").cast("bigint").alias("snapshot"))))


@query("streamed_intervals", Q.ORACLES["interval_pairs"])
def streamed_intervals(spark, sf_dir):
    events = streaming.stream_trace(spark, Q.event_trace(spark, sf_dir))
    kind = F.when(F.col("event_name") == "click", "begin").when(F.col("event_name") == "purchase", "end")
    marks = events.select(F.col("payload.user_id").alias("user_id"), "ts_ns", F.col("payload.event_id").alias("seq"), kind.alias("kind"), F.lit("buying").alias("state")).where(F.col("kind").isNotNull())
    found = _drained(spark, streaming.pair_intervals(marks, "user_id"))
    return found.groupBy("user_id", "state").agg(F.sum("ns").alias("total_ns"), F.count("*").alias("n_intervals"))

