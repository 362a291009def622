import math

import pytest
from pyspark.sql import functions as F

from millrace.plans.expressions import Context, column
from millrace.plans.parsing import ExpressionError, parse

CASES = [
    ("1 + 2 * 3", 7.0), ("(1 + 2) * 3", 9.0), ("7 % 4", 3.0), ("-2 + 3", 1.0), ("'a' + 1", "a1"), ("1 + 'b'", "1b"), ("2 > 1 ? 'y' : 'n'", "y"), ("!0", True), ("!''", True), ("!'x'", False),
    ("1 == '1'", True), ("1 === '1'", False), ("'b' > 'a'", True), ("5 & 3", 1.0), ("5 | 3", 7.0), ("5 ^ 3", 6.0), ("1 << 4", 16.0), ("-1 >>> 28", 15.0), ("~5", -6.0), ("max(1, 9, 3)", 9.0), ("min()", math.inf), ("abs(-4)", 4.0),
    ("round(4.5)", 5.0), ("round(-4.5)", -5.0), ("floor(-1.5)", -2.0), ("log(E)", 1.0), ("pow(2, 10)", 1024.0), ("length('abc')", 3.0), ("length('😀')", 2.0), ("indexof('hello', 'l')", 2.0), ("indexof('hello', 'z')", -1.0), ("lastindexof('hello', 'l')", 3.0),
    ("upper('aé')", "AÉ"), ("replace('aaa', 'a', 'b')", "bbb"), ("replace('aaa', /a/, 'b')", "baa"), ("replace('aaa', /a/g, 'b')", "bbb"), ("test(/B/i, 'abc')", True), ("slice('hello', 1, 3)", "el"), ("slice('hello', -3)", "llo"), ("substring('hello', 3, 1)", "el"),
    ("parseFloat('3.5px')", 3.5), ("parseInt('ff', 16)", 255.0), ("parseInt('12abc')", 12.0), ("if(1 < 2, 'a', 'b')", "a"), ("clamp(11, 0, 10)", 10.0), ("inrange(5, 10, 0)", True), ("isNaN(NaN)", True), ("year(utc(2020, 13, 1))", 2021.0), ("month(utc(2020, 1, 1))", 1.0), ("day(utc(2023, 0, 1))", 0.0),
    ("time(utc(1970, 0, 2))", 86400000.0), ("format(1234.5, ',.2f')", "1,234.50"), ("0x10 + 1", 17.0), ("'\\u0041'", "A"), ("datum.k * 2", 6.0), ("datum['s'] + '!'", "x!"), ("datum.missing", None), ("unknown", None), ("datum.k && datum.s", "x"), ("0 || 'z'", "z"), ("isFinite(1 / 3)", True),
]


def test_values(spark):
    df = spark.createDataFrame([(3, "x")], "k int, s string")
    context = Context(df.schema)
    row = df.select(*[column(text, context).column.alias(f"c{i}") for i, (text, _) in enumerate(CASES)]).first()
    for i, (text, want) in enumerate(CASES):
        got = row[f"c{i}"]
        assert (got == pytest.approx(want) if isinstance(want, float) else got == want), (text, got, want)


def test_compat(spark):
    df = spark.createDataFrame([(None, 0.0)], "a double, z double")
    context = Context(df.schema, compat=True)
    texts = ["datum.a + 1", "1 / datum.z", "-1 / datum.z", "datum.z / datum.z", "'' + datum.a"]
    row = df.select(*[column(x, context).column.alias(f"c{i}") for i, x in enumerate(texts)]).first()
    assert row.c0 == 1.0 and row.c1 == math.inf and row.c2 == -math.inf and math.isnan(row.c3) and row.c4 == "null"


@pytest.mark.parametrize("text", ["1 +", "typeof 1", "a instanceof b", "(1", "1 2", "x = 1", "a++", "'open"])
def test_errors(text):
    with pytest.raises(ExpressionError):
        parse(text)


def test_filters_reach_the_scan(spark, sf):
    from millrace.operators.transforms import filter_

    df = filter_(spark.read.parquet(f"{sf}/lineitem.parquet"), "datum.l_quantity > 30 && datum.l_returnflag == 'R'").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan
    assert "GreaterThan(l_quantity,30.0)" in plan


def test_templates(spark):
    from millrace.functions.templates import template

    df = spark.createDataFrame([("hello", 1234.5, 2.0)], "s string, n double, m double")
    c = Context(df.schema)
    cases = {"{{datum.s|upper}}!": "HELLO!", "{{datum.n|number:',.1f'}}": "1,234.5", "{{datum.s|left:2}}-{{datum.s|right:2}}": "he-lo", "{{datum.s|pad:7,'left'}}|": "  hello|", "{{datum.s|truncate:3}}": "he…", "{{datum.m|month}}": "March", "{{datum.s|slice:1,-1|upper}}": "ELL", "{{datum.none}}x": "x"}
    row = df.select(*[template(t, c).alias(f"c{i}") for i, t in enumerate(cases)]).first()
    assert [row[i] for i in range(len(cases))] == list(cases.values())


def test_number_formats(spark):
    from millrace.functions.numbers import d3_format

    cases = [(1234.567, ".2f", "1234.57"), (1234567.0, ",", "1,234,567"), (0.123, ".1%", "12.3%"), (42.0, "08d", "00000042"), (-5.0, "+d", "-5"), (5.0, "+d", "+5"), (-3.5, "(.1f", "(3.5)"), (255.0, "x", "ff"), (255.0, "#x", "0xff"), (10.0, "b", "1010"), (8.0, "o", "10"), (1500.0, "s", "1.5k"), (42e6, ".3s", "42.0M"), (0.0015, "s", "1.5m"), (1234.0, "e", "1.234000e+3"), (3.14159, ".3r", "3.14"), (123456.0, ".2r", "120000"), (42.0, "*^8d", "***42***"), (42.0, "<6d", "42    "), (1.5, "$.2f", "$1.50"), (0.00001, ".2g", "0.000010"), (-0.0001, ".2f", "0.00"), (65.0, "c", "A")]
    df = spark.createDataFrame([(1,)], "i int")
    row = df.select(*[d3_format(F.lit(x), s).alias(f"c{i}") for i, (x, s, _) in enumerate(cases)]).first()
    for i, (x, s, want) in enumerate(cases):
        assert row[i] == want, (x, s, row[i], want)
