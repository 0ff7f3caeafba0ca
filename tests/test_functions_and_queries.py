from __future__ import annotations

import os
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom import queries
from chronoloom.functions import numbers as N
from chronoloom.functions import text as X

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_clock_conversion_wraps(spark):
    ns = lambda c, *a: one(spark, N.cycles_to_ns(F.lit(str(c)).cast("decimal(20,0)"), *a))
    assert ns(304, 1333337) == 227999 and ns(2**64 - 1, 10**9, 0, 1) == 0
    assert ns(2**64 - 1, 20 * 10**9) == (2**64 - 1) // 20


def test_coercions(spark):
    big = F.lit(str(2**64 - 1)).cast("decimal(20,0)")
    assert one(spark, N.to_int(big, "unsigned int")) == 2**63 - 1 and one(spark, N.to_uint(F.lit(-1), "signed int")) == 0
    assert one(spark, N.to_uint(F.lit("x"), "string")) == 2**64 - 1 and one(spark, N.to_bool(F.lit(3), "bit map")) is False
    assert one(spark, N.to_real(F.lit(3), "signed int")) > 1e308


def test_integers_in_all_bases(spark):
    shown = lambda v, b, t="bigint": one(spark, X.integer(F.lit(str(v)).cast(t), b))
    for v in (0, 1, 8, 255, -5, 2**63 - 1, -(2**63)):
        assert shown(v, 2) == ("-" if v < 0 else "") + bin(abs(v))
        assert shown(v, 16) == ("-" if v < 0 else "") + (hex(abs(v)) if v else "0")
        assert shown(v, 8) == ("-" if v < 0 else "") + ("0" + oct(abs(v))[2:] if v else "0")
        assert shown(v, 10) == str(v)
    assert shown(2**64 - 1, 16, "decimal(20,0)") == hex(2**64 - 1)


def test_flags_and_labels(spark):
    declared = {"lo": [(0, 3)], "top": [(63, 63)]}
    bits = N.as_bits(F.lit(str(2**63 + 1)).cast("decimal(20,0)"))
    assert one(spark, N.flags(bits, declared)) == ["lo", "top"] and one(spark, N.first_flag(F.lit(0), declared)) is None
    ranges = {"a": [(-5, 5)], "b": [(5, 2**64 - 1)]}
    assert one(spark, N.labels(F.lit(5), ranges)) == ["a", "b"] and one(spark, N.first_label(F.lit(9), ranges)) == "b" and one(spark, N.labels(F.lit(-9), ranges)) == []


def test_timestamps_as_text(spark):
    show = lambda ns, **k: one(spark, X.timestamp(F.lit(ns), **k))
    assert show(1_500_000_000) == "[00:00:01.500000000]" and show(-1) == "[23:59:59.999999999]"
    assert show(-500_000_000, seconds=True) == "[-0.500000000]" and show(0, date=True) == "[1970-01-01 00:00:00.000000000]"
    assert one(spark, X.delta(F.lit(-12))) == "(+-000000012)" and one(spark, X.delta(F.lit(12))) == "(+0000000012)"


def test_timestamps_from_text(spark):
    cases = {"2024-02-29 01:02:03.5": 1709168523000000005, "01:02": 3720 * 10**9, "01:02:03.000000009": 3723 * 10**9 + 9, "-7.5": -7000000005, "12": 12 * 10**9}
    for text, ns in cases.items():
        assert X.parse_timestamp(text)[0] == ns and one(spark, X.parse_timestamp_column(F.lit(text))) == ns
    assert X.parse_timestamp("01:02")[1] is False and X.parse_timestamp("2024-01-01 00:00", "Europe/Stockholm")[0] == 1704063600 * 10**9
    for bad in ("x", "12:", "25:00:00", "1.2.3"):
        with pytest.raises(ValueError):
            X.parse_timestamp(bad)


def test_saturation_and_bits(spark):
    assert one(spark, N.saturating_add(F.lit(str(2**64 - 2)).cast("decimal(20,0)"), F.lit(5))) == Decimal(2**64 - 1)
    assert one(spark, N.sign_extend(F.lit(0xFF), 8)) == -1 and one(spark, N.reverse_bits(F.lit(1), 8)) == 128


def same(value):
    if value is None or pd.isna(value):
        return None
    return f"{value:.6f}" if isinstance(value, float) and value % 1 else str(int(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name not in queries.ORACLES:
        assert len(got)
        return
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "part", "customer", "supplier", "nation", "region"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    expected = con.execute(queries.ORACLES[name]).df()
    columns = sorted(expected.columns)
    assert columns == sorted(got.columns)
    rows = [sorted((tuple(map(same, r)) for r in f[columns].astype(object).itertuples(index=False)), key=str) for f in (expected, got)]
    assert rows[0] == rows[1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_lineitem_round_trip_covers_the_whole_table(spark):
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"]
    items = queries.table(spark, DATA, "lineitem").select(*columns, (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts_ns"))
    got = queries.QUERIES["ctf_roundtrip_lineitem"](spark, DATA).select(*columns, "ts_ns")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, items.collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_int_coercion_covers_every_customer(spark):
    keys = [r.c_custkey for r in queries.table(spark, DATA, "customer").select("c_custkey").collect()]
    got = [tuple(r) for r in queries.QUERIES["coerce_int"](spark, DATA).select("c_custkey", "from_uint", "from_text").collect()]
    assert sorted(got) == sorted((k, min(k % 18 * 10**18, 2**63 - 1), 2**63 - 1) for k in keys) and max(keys) > 18


def test_positions_and_losses_over_all_streams(spark):
    from chronoloom.operators import events as ops

    rows = [(t, s, 10 * i) for i, (t, s) in enumerate([(5, 0), (5, 1), (9, 0), (40, 1), (41, 1)])]
    frame = spark.createDataFrame(rows, "t long, s int, snapshot long")
    assert [r.position for r in ops.with_position(frame, ["t", "s"]).orderBy("t", "s").collect()] == [1, 2, 3, 4, 5]
    assert [r.n_lost for r in ops.lost_events(frame, [], ["t", "s"]).orderBy("t", "s").collect()] == [0, 10, 10, 10, 10]
    assert ops.with_position(frame.limit(0), ["t", "s"]).count() == 0 and ops.lost_events(frame.limit(0), [], ["t", "s"]).count() == 0


def test_many_ranges_meet_values_by_blocks(spark):
    from chronoloom.operators import events as ops

    ranges = [("a", -7, 12), ("b", 0, 0), ("c", 3, 3), ("d", -(2**40), 2**40), ("e", 5, 4), ("f", 2**62, 2**63 - 1)]
    values = [-8, -7, 0, 3, 12, 13, 2**40, 2**62, 2**63 - 1, -(2**63)]
    cut = spark.createDataFrame(ranges, "label string, low long, high long")
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    found = {(r.v, r.label) for r in ops.label_join(frame, cut, "v", most=2).collect()}
    assert found == {(v, n) for v in values for n, a, b in ranges if a <= v <= b} == {(r.v, r.label) for r in ops.label_join(frame, cut, "v").collect()}
