import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars as S


def values(spark, inputs, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_paths(spark):
    given = ["./src\\nested/../example.ts", "../../a", "/a/b", ".", "", "  a//b ", None]
    assert values(spark, given, S.normalize_path) == ["src/example.ts", "a", "a/b", ".", ".", "a/b", None]


def test_spans(spark):
    given = ["L10C1-L10C4", "l1-5", "L0", "L5-L1", "3:4-3:2", "9:0-9:3", "abc", None]
    got = values(spark, given, lambda c: S.parse_span(c, F.lit("typescript")))
    assert [tuple(g) if g else None for g in got] == [(10, 1, 10, 4), (1, None, 5, None), (0, None, 0, None), None, None, (9, 0, 9, 3), None, None]
    zero = values(spark, ["9:0-9:3", "L9C1-L9C2"], lambda c: S.parse_span(c, F.lit("scip-typescript")))
    assert [tuple(z) for z in zero] == [(10, 1, 10, 4), (9, 1, 9, 2)]


def test_packed_ranges(spark):
    df = spark.createDataFrame([([9, 0, 3],), ([1, 2, 3, 4],), ([1, 2],), ([1, -1, 2],)], "x array<bigint>")
    got = [r.y for r in df.select(S.packed_range(F.col("x"), F.lit("scip")).alias("y")).collect()]
    assert [tuple(g) if g else None for g in got] == [(10, 1, 10, 4), (2, 3, 4, 5), None, None]


def test_kinds(spark):
    given = ["FunctionDeclaration", "constructor", "type-reference", "call-site", "prototype", "profile", "GetAccessor", " _-"]
    assert values(spark, given, S.kind_family) == ["callable", "class", "type", "callsite", "type", "module", "getaccessor", "symbol"]
    df = spark.createDataFrame([(["symbol", "class"],), (["class", "type"],), (["symbol"],)], "k array<string>")
    assert [r.y for r in df.select(S.canonical_kind(F.col("k")).alias("y")).collect()] == ["class", "symbol", "symbol"]


def test_symbols(spark):
    assert values(spark, ['"src/types".Shape', "a.b.a", '""'], S.symbol_keys) == [["src/types.Shape", "src", "types", "Shape"], ["a.b.a", "a", "b"], []]
    assert values(spark, ["a.b.a", '""'], S.last_symbol_part) == ["b", None]
    assert values(spark, ["( value : string ) :  string"], S.normalize_signature) == ["(value:string):string"]
    assert values(spark, ["  x﻿", "  "], S.clean) == ["x", None]


@pytest.mark.parametrize(("n", "d", "want"), [(1, 2, 0.5), (0, 0, None)])
def test_ratio(spark, n, d, want):
    assert spark.range(1).select(S.ratio(F.lit(n), F.lit(d)).alias("r")).first().r == want
