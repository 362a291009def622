"""Functions and operators beyond the plain transforms: mathematics, dates, zones, texts, titles, ticks, changes of tables."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, infix, numbers, text, titles
from millrace.markup import extract, sections
from millrace.operators import scales, ticks
from millrace.operators import transforms as t
from millrace.plans.spec import Spec
from millrace.queries import query, table
from millrace.queries.extract import _pages
from millrace.sources import search


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


_TRIG = {"s": "sin(datum.p_size)", "c": "cos(datum.p_size)", "t": "tan(datum.p_size / 100)", "at": "atan(datum.p_size)", "at2": "atan2(datum.p_size, datum.p_partkey + 1)", "sn": "asin(datum.p_size / 100)", "cs": "acos(datum.p_size / 100)", "e": "exp(datum.p_size / 10)", "k": "PI * E + LN2 + LN10 + LOG2E + LOG10E + SQRT2 + SQRT1_2"}


@query(f"""
SELECT p_partkey, round(sin(p_size), 9) + 0.0 AS s, round(cos(p_size), 9) + 0.0 AS c, round(tan(p_size / 100), 9) + 0.0 AS t, round(atan(p_size), 9) AS at, round(atan2(p_size, p_partkey + 1), 9) AS at2, round(asin(p_size / 100), 9) AS sn,
  round(acos(p_size / 100), 9) AS cs, round(exp(p_size / 10), 9) AS e, round({math.pi * math.e + math.log(2) + math.log(10) + math.log2(math.e) + math.log10(math.e) + math.sqrt(2) + math.sqrt(0.5)!r}::DOUBLE, 9) AS k,
  abs(25 - p_size)::DOUBLE AS distance, round(p_retailprice / 7) AS whole, least(p_size, 20, p_retailprice / 40)::DOUBLE AS least, p_size > 25 AS odd, p_size < 25 AS finite
FROM part
""")
def math_trigonometry(spark: SparkSession, sf: str) -> DataFrame:
    """Trigonometry, constants, rounding, and the not-a-numbers of logarithms."""
    more = {"distance": "abs(25 - datum.p_size)", "whole": "round(datum.p_retailprice / 7)", "least": "min(datum.p_size, 20, datum.p_retailprice / 40)", "odd": "isNaN(log(25 - datum.p_size))", "finite": "isFinite(log(25 - datum.p_size))"}
    return _rounded(t.formulas(table(spark, sf, "part"), {**_TRIG, **more}).select("p_partkey", *_TRIG, *more), 9, *_TRIG)


@query("""
SELECT p_partkey, p_retailprice AS price, p_size::DOUBLE AS size, p_size::DOUBLE AS hex, true AS none, floor(p_retailprice)::DOUBLE AS whole FROM part
""")
def parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.concat("p_retailprice", F.lit(" for each")).alias("a"), F.concat(F.lit(" "), "p_size", F.lit("cm")).alias("b"), F.lower(F.hex("p_size")).alias("h"))
    return t.formulas(p, {"price": "parseFloat(datum.a)", "size": "parseInt(datum.b)", "hex": "parseInt(datum.h, 16)", "none": "isNaN(parseFloat(datum.p_brand))", "whole": "parseInt(datum.a)"}).drop("p_brand", "a", "b", "h")


@query("""
SELECT o_orderkey, year(o_orderdate)::DOUBLE AS y, (month(o_orderdate) - 1)::DOUBLE AS m, dayofweek(o_orderdate)::DOUBLE AS wd, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + INTERVAL 14 MONTH + to_days(CAST(day(o_orderdate) + 39 AS INTEGER)) + INTERVAL 93665 SECOND AS made,
  CAST(make_date(CAST(1990 + o_orderkey % 20 AS BIGINT), 1, 1) AS TIMESTAMP) + to_months(CAST(o_custkey % 30 - 3 AS INTEGER)) + to_days(CAST(o_orderkey % 60 - 1 AS INTEGER)) + to_hours(CAST(o_orderkey % 50 AS INTEGER)) AS parts
FROM orders
""")
def date_construct(spark: SparkSession, sf: str) -> DataFrame:
    """Dates made of parts that overflow, as an expression and as Columns."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("d"))
    o = t.formulas(o, {"y": "utcyear(datum.d)", "m": "utcmonth(datum.d)", "wd": "utcday(datum.d)", "made": "utc(utcyear(datum.d), utcmonth(datum.d) + 14, utcdate(datum.d) + 40, 25, 61, 5)"})
    k = F.col("o_orderkey")
    parts = dates.make(1990 + k % 20, F.col("o_custkey") % 30 - 2, k % 60, k % 50, F.lit(0), F.lit(0))
    return o.select("o_orderkey", "y", "m", "wd", F.col("made").cast("timestamp_ntz").alias("made"), parts.cast("timestamp_ntz").alias("parts"))


@query("""
SELECT o_orderkey, CAST(day(d) AS VARCHAR) AS currentday, strftime(d, '%d') AS localday2, strftime(d, '%A') AS currentdayname, strftime(d, '%w') AS localdow, strftime(d, '%H') AS currenthour, strftime(d, '%m') AS localmonth, CAST(month(d) AS VARCHAR) AS currentmonth1,
  strftime(d, '%b') AS localmonthabbrev, strftime(d, '%B') AS currentmonthname, strftime(d, '%H:%M') AS localtime, strftime(d, '%Y%m%d%H%M%S') AS currenttimestamp, CAST(weekofyear(d) AS VARCHAR) AS localweek, strftime(d, '%Y') AS currentyear,
  make_timestamp(year(d), 7, 4, 0, 0, 0) AS of_year
FROM (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS d FROM orders)
""")
def date_words(spark: SparkSession, sf: str) -> DataFrame:
    """The words of the current time at each order's, and four-digit arguments, which are years."""
    clock = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    names = ["currentday", "localday2", "currentdayname", "localdow", "currenthour", "localmonth", "currentmonth1", "localmonthabbrev", "currentmonthname", "localtime", "currenttimestamp", "localweek", "currentyear"]
    year = dates.time_argument(F.date_format(clock, "yyyy"), dt.datetime(2000, 7, 4, 0, 0, tzinfo=dt.timezone.utc))
    return table(spark, sf, "orders").select("o_orderkey", *[dates.time_word(n, clock).alias(n) for n in names], year.cast("timestamp_ntz").alias("of_year"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS d FROM orders),
r AS (SELECT *, make_date(year(d), 4, 1) AS april, make_date(year(d), 10, 31) AS october FROM o),
s AS (SELECT *, d >= CAST(april + CAST((7 - isodow(april)) % 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 7 HOUR AND d < CAST(october - CAST(isodow(october) % 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 6 HOUR AS summer FROM r)
SELECT o_orderkey, summer, CASE WHEN summer THEN -14400 ELSE -18000 END::BIGINT AS seconds, d - CASE WHEN summer THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS local, date_trunc('day', d)::TIMESTAMP AS day FROM s
""")
def date_zones(spark: SparkSession, sf: str) -> DataFrame:
    """New York's clock at each order: summer time from April's first to October's last Sunday, as the law was before 2007."""
    d = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    zone = "America/New_York"
    return table(spark, sf, "orders").select("o_orderkey", dates.is_dst(d, zone).alias("summer"), dates.offset_seconds(d, zone).cast("long").alias("seconds"), dates.in_zone(d, zone).cast("timestamp_ntz").alias("local"), dates.truncated(d, "day").cast("timestamp_ntz").alias("day"))


@query("""
SELECT o_orderkey, year(d)::BIGINT AS year, dayofweek(d)::BIGINT + 1 AS wday, dayofyear(d)::BIGINT AS yday, strftime(d, '%d/%m/%y %H:%M') AS text, epoch(CAST(date_trunc('month', d) AS TIMESTAMP) + INTERVAL 12 HOUR + to_days(CAST(o_orderkey % 90 - 1 AS INTEGER)))::BIGINT AS seconds
FROM (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS d FROM orders)
""")
def script_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The dates of scripts: parts, patterns, and seconds of parts that overflow."""
    d = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    parts = dates.os_date(d, "*t")
    seconds = dates.os_time(F.year(d), F.month(d), F.col("o_orderkey") % 90)
    return table(spark, sf, "orders").select("o_orderkey", *[parts[k].cast("long").alias(k) for k in ("year", "wday", "yday")], dates.os_date(d, "!%d/%m/%y %H:%M").alias("text"), seconds.cast("long").alias("seconds"))


@query("""
SELECT p_partkey, '<' || p_name || '> & ééA &nope;' AS decoded, '&lt;' || replace(p_name, ' ', '&amp;') || '&gt;' AS encoded,
  replace(replace(replace(replace(replace(p_name, 'blue', chr(1)), 'red', chr(2)), 'e', '3'), chr(1), 'red'), chr(2), 'blue') AS swapped, p_name || ' costs ' || p_size || ' or $3' AS message,
  CASE WHEN length(p_name) <= 6 THEN p_name ELSE substr(p_name, 1, 6) || '…' END AS cut, replace(p_name, ' ', ' and ') || ', é' AS listed, format('{:,}', p_partkey * 1234567) || '.5' AS grouped, CAST(p_partkey * 1234567 AS VARCHAR) || '.5' AS ungrouped,
  printf('%.14g', p_retailprice / 7) AS shown, (p_size + 0.5)::DOUBLE AS float, p_size::BIGINT AS int, 0.0::DOUBLE AS none, CASE WHEN p_size = 1 THEN 'one' ELSE 'many' END AS noun, p_size = 7 AS same
FROM part
""")
def text_library(spark: SparkSession, sf: str) -> DataFrame:
    """Entities, translations, messages, lists and the numbers of texts."""
    name, size, digits = F.col("p_name"), F.col("p_size"), F.concat((F.col("p_partkey") * 1234567).cast("string"), F.lit(".5"))
    return table(spark, sf, "part").select(
        "p_partkey",
        text.entities(F.concat(F.lit("&lt;"), name, F.lit("&gt; &amp; &#233;&eacute;&#x41; &nope;"))).alias("decoded"),
        text.encode_entities(F.concat(F.lit("<"), F.replace(name, F.lit(" "), F.lit("&")), F.lit(">"))).alias("encoded"),
        text.strtr(name, {"red": "blue", "blue": "red", "e": "3"}).alias("swapped"),
        text.message("$1 costs $2 or $3", name, size).alias("message"),
        text.truncate(name, 6).alias("cut"),
        F.concat(text.list_to_text(F.split(name, " ")), F.lit(", "), text.normalised(F.lit("é"))).alias("listed"),
        numbers.formatnum(digits).alias("grouped"),
        numbers.formatnum(numbers.formatnum(digits), "R").alias("ungrouped"),
        numbers.php_number(F.col("p_retailprice") / 7).alias("shown"),
        numbers.floatval(F.concat(F.lit(" "), size, F.lit(".5 cm"))).alias("float"),
        numbers.intval(F.concat(size, F.lit(".5 cm"))).alias("int"),
        numbers.floatval(name).alias("none"),
        numbers.plural(size, F.lit("one"), F.lit("many")).alias("noun"),
        numbers.loosely_equal(size.cast("string"), F.lit("7.0")).alias("same"),
    )


@query("""
SELECT s_suppkey, 'Supply/' || s_nationkey || '/' || s_suppkey || '/notes' AS below, 'Supply/' || s_nationkey || '/x' AS beside, 'Supply' AS above, 'Other' AS far, 'User talk:Supplier ' || s_suppkey || '/log' AS talk, 'User:Supplier ' || s_suppkey || '/log' AS subject,
  'log' AS sub, 'Supplier ' || s_suppkey AS base, '2' AS number, '/wiki/User:Supplier_' || s_suppkey || '/log' AS url, '//w.example/wiki/User:Supplier_' || s_suppkey || '/log?action=raw' AS full
FROM supplier
""")
def title_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Relative titles, and the words of a user's subpage."""
    page = F.concat(F.lit("Supply/"), "s_nationkey", F.lit("/"), "s_suppkey")
    title = titles.parse_title(F.concat(F.lit("user: supplier_"), "s_suppkey", F.lit("/log")))
    words = {"talk": "TALKPAGENAME", "subject": "SUBJECTPAGENAME", "sub": "SUBPAGENAME", "base": "BASEPAGENAME", "number": "NAMESPACENUMBER"}
    return table(spark, sf, "supplier").select(
        "s_suppkey",
        titles.joined(page, F.lit("/notes/")).alias("below"), titles.joined(page, F.lit("../x")).alias("beside"), titles.joined(page, F.lit("../../")).alias("above"), titles.joined(page, F.lit("Other")).alias("far"),
        *[titles.words(w, title).alias(n) for n, w in words.items()],
        titles.local_url(title).alias("url"), titles.full_url(title, "//w.example", "action=raw").alias("full"),
    )


_INFIX = ["sin {0}", "cos {0} + pi", "e ^ 2 * {0}", "ln ({0} - 25)", "sqrt(25 - {0})", "{0} / ({0} - 7)", "asin ({0} / 100) round 5", "trunc(-{0} / 4)", "ceil({0} / 4) mod 3", "exp (-{0})", "({0}", "{0} {0}"]


@query("""
SELECT p_partkey, k, round(CASE k WHEN 0 THEN sin(p_size) WHEN 1 THEN cos(p_size) + pi() WHEN 2 THEN exp(2) * p_size WHEN 3 THEN CASE WHEN p_size > 25 THEN ln(p_size - 25) END WHEN 4 THEN CASE WHEN p_size <= 25 THEN sqrt(25 - p_size) END
  WHEN 5 THEN CASE WHEN p_size <> 7 THEN p_size / (p_size - 7) END WHEN 6 THEN round(asin(p_size / 100), 5) WHEN 7 THEN -floor(p_size / 4) WHEN 8 THEN ceil(p_size / 4) % 3 WHEN 9 THEN exp(-p_size) END, 9) + 0.0 AS value,
  CASE k WHEN 3 THEN p_size <= 25 WHEN 4 THEN p_size > 25 WHEN 5 THEN p_size = 7 ELSE k > 9 END AS failed
FROM part, range(12) t(k)
""")
def infix_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Functions, constants and errors of infix expressions, each part's size written into each."""
    texts = F.array(*[F.replace(F.lit(x), F.lit("{0}"), F.col("p_size").cast("string")) for x in _INFIX])
    rows = table(spark, sf, "part").select("p_partkey", F.posexplode(texts).alias("k", "body")).withColumn("r", infix.column(F.col("body")))
    return rows.select("p_partkey", F.col("k").cast("long").alias("k"), (F.round(F.col("r.value"), 9) + 0.0).alias("value"), F.col("r.error").isNotNull().alias("failed"))


@query("SELECT p_partkey, 'one ' || p_partkey || 'three ' || p_size AS labelled, 'head ' || 'two ' || 'tail' AS others, 'body of ' || p_name AS heading FROM part")
def section_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled sections of each part's page, the page without them, and what stands under a heading."""
    mark = lambda n, body: F.concat(F.lit(f'<section begin="{n}" />'), *body, F.lit(f'<section end="{n}" />'))
    page = F.concat(F.lit("head "), mark("a", [F.lit("one "), F.col("p_partkey").cast("string")]), F.lit("two "), mark("a", [F.lit("three "), F.col("p_size").cast("string")]), F.lit("tail"))
    under = F.concat(F.lit("x\n== Of "), F.col("p_brand"), F.lit(" ==\nbody of "), F.col("p_name"), F.lit("\n== Other ==\ny"))
    return table(spark, sf, "part").select("p_partkey", sections.column("labelled", page, "a").alias("labelled"), sections.column("unlabelled", page, "a").alias("others"), sections.column("under_heading", F.replace(under, F.col("p_brand"), F.lit("it")), "of IT").alias("heading"))


@query("SELECT p_partkey AS page_id, markers, length(markers)::INTEGER AS depth, text FROM (SELECT p_partkey, '*' AS markers, 'of ' || p_type AS text FROM part UNION ALL SELECT p_partkey, '**', 'of ' || p_size FROM part)")
def wiki_lists(spark: SparkSession, sf: str) -> DataFrame:
    return extract.lists(_pages(spark, sf)).select("page_id", "markers", "depth", "text")


@query("""
SELECT p_partkey AS page_id, tag, body FROM part, LATERAL (SELECT unnest(['ref', 'ref', 'ref', 'ref', 'nowiki']) AS tag, unnest(['Measured ' || p_size, 'List of ' || p_partkey, NULL, 'Note', '[[no link]]']) AS body)
""")
def wiki_extensions(spark: SparkSession, sf: str) -> DataFrame:
    """The extension tags of each page; one that closes itself has no body."""
    found = extract.extensions(_pages(spark, sf))
    return found.select("page_id", "tag", F.nullif("body", F.lit("")).alias("body"))


@query("SELECT p_partkey AS page_id, p_name || ' ' || p_partkey || ' is of the brand ' || p_brand AS start, false AS markup FROM part")
def wiki_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each page as plain text: how it begins, and whether markup is left in it."""
    out = extract.text(_pages(spark, sf)).join(table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.length(F.concat_ws(" ", "p_name", "p_partkey", F.lit("is of the brand"), "p_brand")).alias("n")), "page_id")
    return out.select("page_id", F.substring("text", F.lit(1), F.col("n")).alias("start"), F.col("text").rlike(r"'''|\{\{|\{\||==|<ref").alias("markup"))


@query("""
WITH o AS (SELECT o_custkey AS key, 'orders' AS origin FROM orders GROUP BY ALL), c AS (SELECT c_custkey * 2 AS key, 'customers' AS origin FROM customer)
SELECT 'insert' AS kind, * FROM (SELECT * FROM c UNION ALL SELECT * FROM o) UNION ALL SELECT 'upsert', * FROM (SELECT * FROM o UNION ALL SELECT * FROM c WHERE key NOT IN (SELECT key FROM o))
UNION ALL SELECT 'toggle', * FROM (SELECT * FROM c WHERE key NOT IN (SELECT key FROM o) UNION ALL SELECT * FROM o WHERE key NOT IN (SELECT key FROM c)) UNION ALL SELECT 'clear', * FROM c WHERE key <= 100
""")
def modify_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' doubled keys changed by those that have orders, in each way."""
    c = table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("key"), F.lit("customers").alias("origin"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.lit("orders").alias("origin")).distinct()
    out = t.modify(c, "clear", test="datum.key > 100").withColumn("kind", F.lit("clear"))
    for kind in ("insert", "upsert", "toggle"):
        out = out.unionByName(t.modify(c, kind, o, "key").withColumn("kind", F.lit(kind)))
    return out


_STEP = "CASE WHEN r / pow(10, floor(log10(r))) < sqrt(2) THEN 1 WHEN r / pow(10, floor(log10(r))) < sqrt(10) THEN 2 WHEN r / pow(10, floor(log10(r))) < sqrt(50) THEN 5 ELSE 10 END * pow(10, floor(log10(r)))"


@query(f"""
WITH e AS (SELECT 'lineitem' AS name, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem UNION ALL SELECT 'orders', min(o_totalprice), max(o_totalprice) FROM orders UNION ALL SELECT 'customer', min(c_acctbal), max(c_acctbal) FROM customer UNION ALL SELECT 'part', min(p_retailprice), max(p_retailprice) FROM part),
a AS (SELECT *, {_STEP} AS step FROM (SELECT *, (hi - lo) / 10 AS r FROM e)), b AS (SELECT name, lo AS lo0, hi AS hi0, step AS step0, floor(lo / step) * step AS lo, ceil(hi / step) * step AS hi FROM a),
c AS (SELECT *, {_STEP} AS step FROM (SELECT *, (hi - lo) / 10 AS r FROM b)), d AS (SELECT *, floor(lo / step) * step AS lo2, ceil(hi / step) * step AS hi2 FROM c)
SELECT name, round(lo2, 6) + 0.0 AS lo, round(hi2, 6) + 0.0 AS hi, CAST(floor(hi0 / step0) - ceil(lo0 / step0) + 1 AS BIGINT) AS ticks, round(ceil(lo0 / step0) * step0, 6) + 0.0 AS first, round(floor(hi0 / step0) * step0, 6) + 0.0 AS last FROM d
""")
def ticks_nice(spark: SparkSession, sf: str) -> DataFrame:
    """Four columns' extents, made nice, and their ticks."""
    rows = []
    for name, column in (("lineitem", "l_extendedprice"), ("orders", "o_totalprice"), ("customer", "c_acctbal"), ("part", "p_retailprice")):
        lo, hi = scales.extent(table(spark, sf, name), column)
        found = ticks.linear_ticks(lo, hi, 10)
        rows.append((name, *(round(x, 6) + 0.0 for x in ticks.nice(lo, hi, 10)), len(found), round(found[0], 6) + 0.0, round(found[-1], 6) + 0.0))
    return spark.createDataFrame(rows, "name string, lo double, hi double, ticks long, first double, last double")


@query("""
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT 'log' AS kind, (k * pow(10, p))::DOUBLE AS value FROM e, range(1, 10) a(k), range(0, 12) b(p) WHERE k * pow(10, p) BETWEEN lo AND hi
UNION ALL SELECT 'time', epoch_ms(d)::DOUBLE FROM (SELECT unnest(generate_series(date_trunc('day', lo)::TIMESTAMP, hi, INTERVAL 1 DAY)) AS d, lo FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM events)) WHERE d >= lo AND day(d) % 2 = 1
""")
def ticks_log_time(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks of the orders' prices on a logarithmic scale, and of the month of events, every other day."""
    lo, hi = scales.extent(table(spark, sf, "orders"), "o_totalprice")
    ts = table(spark, sf, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(*[F.unix_micros(F.col(c).cast("timestamp")) / 1000.0 for c in ("lo", "hi")]).first()
    rows = [("log", float(x)) for x in ticks.log_ticks(lo, hi)] + [("time", float(x)) for x in ticks.time_ticks(ts[0], ts[1], 10)]
    return spark.createDataFrame(rows, "kind string, value double")


@query("""
WITH s AS (SELECT n_regionkey, n_nationkey, n_name, sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS e FROM nation), m AS (SELECT max(e) AS most FROM s),
o AS (SELECT DISTINCT n_regionkey, dense_rank() OVER (ORDER BY n_regionkey) - 1 AS place FROM nation)
SELECT n_name, round(place * 500.0 / (SELECT count(DISTINCT n_regionkey) FROM nation), 6) AS x, round(200 - (e - n_nationkey) * 200.0 / most, 6) AS y, round(n_nationkey * 200.0 / most, 6) AS height, CASE WHEN n_nationkey > 12 THEN 'high' ELSE 'low' END AS label, n_name || '!' AS text, '#' || printf('%02x', n_nationkey * 10) || '00ff' AS fill
FROM s JOIN o USING (n_regionkey), m
""")
def mark_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The marks of a stacked bar chart of nations by region: a transform of the mark's own, scales, rules and a template."""
    spec = Spec({
        "version": 2, "width": 500, "height": 200,
        "data": [{"name": "sums", "source": "nations", "transform": [{"type": "aggregate", "groupby": ["n_regionkey"], "summarize": [{"field": "n_nationkey", "ops": ["sum"]}]}]}, {"name": "nations"}],
        "scales": [{"name": "x", "type": "ordinal", "range": "width", "domain": {"data": "nations", "field": "n_regionkey", "sort": True}}, {"name": "y", "type": "linear", "range": "height", "domain": {"data": "sums", "field": "sum_n_nationkey"}}],
        "predicates": [{"name": "high", "type": ">", "operands": [{"arg": "k"}, 12]}],
    }, spark, tables={"nations": table(spark, sf, "nation")})
    mark = {"from": {"data": "nations", "transform": [{"type": "stack", "groupby": ["n_regionkey"], "sortby": ["n_nationkey"], "field": "n_nationkey"}]}, "properties": {"enter": {
        "n_name": {"field": "n_name"}, "x": {"scale": "x", "field": "n_regionkey"}, "y": {"scale": "y", "field": "layout_start"}, "y2": {"scale": "y", "field": "layout_end"},
        "fill": {"r": {"field": "n_nationkey", "mult": 10}, "g": {"value": 0}, "b": {"value": 255}}, "label": [{"predicate": "high", "input": {"k": "n_nationkey"}, "value": "high"}, {"value": "low"}], "text": {"template": "{{datum.n_name}}!"},
    }}}
    return _rounded(spec.mark(mark).select("n_name", "x", "y", "height", "label", "text", "fill"), 6, "x", "y", "height")


@query("""
SELECT event_id, CASE WHEN cut = date_trunc('year', cut) THEN strftime(cut, '%Y') WHEN cut = date_trunc('month', cut) THEN strftime(cut, '%B') WHEN cut = date_trunc('day', cut) THEN CASE WHEN dayofweek(cut) = 0 THEN strftime(cut, '%b %d') ELSE strftime(cut, '%a %d') END
  WHEN cut = date_trunc('hour', cut) THEN strftime(cut, '%I %p') WHEN cut = date_trunc('minute', cut) THEN strftime(cut, '%I:%M') ELSE ':' || strftime(cut, '%S') END AS time,
  format('{:,}', CAST(floor(abs(v)) AS BIGINT)) || substr(printf('%.2f', abs(v) - floor(abs(v))), 2) AS number
FROM (SELECT event_id, date_trunc((['year', 'month', 'day', 'hour', 'minute', 'second'])[event_id % 6 + 1], ts)::TIMESTAMP AS cut, event_id * 1.25 AS v FROM events)
""")
def auto_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's time, cut to some unit, and a number, in the formats that their ticks would get."""
    k = F.col("event_id") % 6
    ts = F.col("ts").cast("timestamp")
    at = F.when(k == 0, F.date_trunc("year", ts)).when(k == 1, F.date_trunc("month", ts)).when(k == 2, F.date_trunc("day", ts)).when(k == 3, F.date_trunc("hour", ts)).when(k == 4, F.date_trunc("minute", ts)).otherwise(F.date_trunc("second", ts))
    return table(spark, sf, "events").select("event_id", dates.auto_format(at).alias("time"), numbers.d3_format(F.col("event_id") * 1.25, numbers.auto_format(0.0, 0.3)).alias("number"))


@query("SELECT title FROM (SELECT DISTINCT p_brand || ' ' || p_name AS title FROM part) WHERE regexp_matches(title, '(?i)(gear|bolt)$') ORDER BY lower(title), title LIMIT 25 OFFSET 25")
def title_search_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of a search by pattern."""
    names = table(spark, sf, "part").select(F.concat("p_brand", F.lit(" "), "p_name").alias("title")).distinct()
    return search.search(names, "(gear|bolt)$", page=2, per_page=25)


@query("SELECT s_suppkey, x + 0.0 AS x FROM (SELECT s_suppkey, CASE WHEN n = 1 THEN 250 ELSE 10 + (dense_rank() OVER (ORDER BY s_nationkey) - 1) * 480.0 / (n - 1) END AS x FROM supplier, (SELECT count(DISTINCT s_nationkey) AS n FROM supplier))")
def scale_points(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' nations as points of a range."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    domain = scales.domain_frame([(s, ["s_nationkey"])], sort=True)
    places = scales.points(domain.count(), 10, 490)
    return scales.mapped(s, "s_nationkey", domain, places, "x").select("s_suppkey", F.col("x").cast("double").alias("x"))
