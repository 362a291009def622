"""Expression functions, dates, numbers, text and titles over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, infix, numbers, text, titles
from millrace.functions.templates import template
from millrace.operators import transforms as t
from millrace.plans.expressions import Context
from millrace.queries import query, table


@query("""
SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, round(ln(o_totalprice), 6) AS log, CAST(floor(o_totalprice / 7) AS DOUBLE) AS low, CAST(ceil(o_totalprice / 7) AS DOUBLE) AS high,
  round(pow(o_custkey, 1.5), 4) AS power, CAST(least(greatest(o_totalprice, 1000), 200000) AS DOUBLE) AS clamped, CAST(o_custkey & 15 AS DOUBLE) AS bits,
  (o_totalprice BETWEEN 1000 AND 90000) AS inside, greatest(o_totalprice / 1000, o_custkey::DOUBLE) AS most
FROM orders
""")
def math_functions(spark: SparkSession, sf: str) -> DataFrame:
    out = t.formulas(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), {
        "root": "sqrt(datum.o_totalprice)", "log": "log(datum.o_totalprice)", "low": "floor(datum.o_totalprice / 7)", "high": "ceil(datum.o_totalprice / 7)", "power": "pow(datum.o_custkey, 1.5)",
        "clamped": "clamp(datum.o_totalprice, 1000, 200000)", "bits": "datum.o_custkey & 15", "inside": "inrange(datum.o_totalprice, 90000, 1000)", "most": "max(datum.o_totalprice / 1000, datum.o_custkey)",
    })
    return out.drop("o_totalprice", "o_custkey").withColumns({"root": F.round("root", 6), "log": F.round("log", 6), "power": F.round("power", 4)})


@query("""
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, CAST(length(p_name) AS DOUBLE) AS len, CAST(strpos(p_name, 'a') - 1 AS DOUBLE) AS at,
  replace(p_name, 'a', 'A') AS swapped, regexp_replace(p_name, '[aeiou]', '*', 'g') AS stars, regexp_replace(p_name, '[aeiou]', '*') AS star, regexp_matches(p_type, '(?i)steel') AS steel,
  substr(p_name, 3, 4) AS part, p_brand || ':' || CAST(p_size AS VARCHAR) AS joined, CASE WHEN p_size > 25 THEN 'L' WHEN p_size > 10 THEN 'M' ELSE 'S' END AS size
FROM part
""")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    out = t.formulas(table(spark, sf, "part"), {
        "up": "upper(datum.p_name)", "low": "lower(datum.p_brand)", "len": "length(datum.p_name)", "at": "indexof(datum.p_name, 'a')", "swapped": "replace(datum.p_name, 'a', 'A')", "stars": "replace(datum.p_name, /[aeiou]/g, '*')",
        "star": "replace(datum.p_name, /[aeiou]/, '*')", "steel": "test(/steel/i, datum.p_type)", "part": "slice(datum.p_name, 2, 6)", "joined": "datum.p_brand + ':' + datum.p_size", "size": "datum.p_size > 25 ? 'L' : datum.p_size > 10 ? 'M' : 'S'",
    })
    return out.select("p_partkey", "up", "low", "len", "at", "swapped", "stars", "star", "steel", "part", "joined", "size")


@query("""
SELECT event_id, CAST(year(ts) AS DOUBLE) AS y, CAST(month(ts) - 1 AS DOUBLE) AS m, CAST(day(ts) AS DOUBLE) AS d, CAST(dayofweek(ts) AS DOUBLE) AS wd, CAST(hour(ts) AS DOUBLE) AS h, CAST(minute(ts) AS DOUBLE) AS mi,
  CAST(epoch_us(ts) // 1000 AS DOUBLE) AS ms, CAST(quarter(ts) AS BIGINT) AS q FROM events
""")
def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    out = t.formulas(table(spark, sf, "events").select("event_id", "ts"), {"y": "year(datum.ts)", "m": "month(datum.ts)", "d": "date(datum.ts)", "wd": "day(datum.ts)", "h": "hours(datum.ts)", "mi": "minutes(datum.ts)", "ms": "time(datum.ts)"})
    return out.withColumn("q", F.quarter("ts").cast("long")).drop("ts")


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso, strftime(ts, '%a %b %d, %j') AS text, strftime(ts, '%y%m%d') AS short,
  CAST(day(ts) AS VARCHAR) || ' ' || strftime(ts, '%B %Y') AS letters, strftime(ts, '%G') || '-W' || strftime(ts, '%V') AS week
FROM events
""")
def date_format(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", dates.strftime(ts, "%Y-%m-%d %H:%M:%S").alias("iso"), dates.strftime(ts, "%a %b %d, %j").alias("text"), dates.strftime(ts, "%y%m%d").alias("short"), dates.letters(ts, "j F Y").alias("letters"), dates.letters(ts, 'o"-W"W').alias("week"))


@query("SELECT o_orderkey, o_orderdate AS parsed, o_orderdate + INTERVAL 14 DAY AS later, date_trunc('month', o_orderdate) AS first FROM orders")
def date_parse(spark: SparkSession, sf: str) -> DataFrame:
    d = F.date_format("o_orderdate", "d MMMM yyyy")
    now = dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc)
    own = table(spark, sf, "orders").select("o_orderkey", d.alias("d"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"))
    return own.select("o_orderkey", dates.free_text(F.col("d"), now).alias("parsed"), dates.free_text(F.concat("iso", F.lit(" +2 weeks")), now).alias("later"), dates.free_text(F.concat(F.lit("first day of "), "iso"), now).alias("first")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("parsed", "later", "first")})


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS d, isodow(o_orderdate) AS w FROM orders)
SELECT o_orderkey, d AS american, d AS pointed, d + INTERVAL 3723 SECOND AS compact, d AS day_of_year, d AS iso_week, CAST(date_trunc('week', d) AS TIMESTAMP) + INTERVAL 7 DAY AS next_monday,
  CAST(last_day(d) AS TIMESTAMP) AS month_end, d + INTERVAL 12 HOUR AS noon, d - INTERVAL 10 DAY AS before, d + to_days(CAST(CASE WHEN w >= 5 THEN 12 - w ELSE 5 - w END AS INTEGER)) AS friday,
  CAST(date_trunc('month', d) AS TIMESTAMP) + to_days(CAST((8 - isodow(date_trunc('month', d))) % 7 + 7 AS INTEGER)) AS second_monday
FROM o
""")
def date_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Eleven written forms of each order's date, absolute and relative, read back."""
    now = dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc)
    d = F.col("o_orderdate")
    iso = F.date_format(d, "yyyy-MM-dd")
    after = lambda text: F.concat(iso, F.lit(text))
    before = lambda text: F.concat(F.lit(text), iso)
    forms = {
        "american": F.date_format(d, "M/d/yyyy"), "pointed": F.date_format(d, "dd.MM.yyyy"), "compact": F.date_format(d, "yyyyMMdd'T010203'"), "day_of_year": F.date_format(d, "yyyyDDD"), "iso_week": dates.letters(d, 'o"-W"W"-"N'),
        "next_monday": after(" monday next week"), "month_end": before("last day of "), "noon": after(" noon"), "before": after(" 10 days ago"), "friday": after(" next friday"), "second_monday": before("second monday of "),
    }
    return table(spark, sf, "orders").select("o_orderkey", *[dates.free_text(text, now).cast("timestamp_ntz").alias(name) for name, text in forms.items()])


@query("SELECT event_id, CAST(floor(x / 86400) AS BIGINT) AS days, CAST(floor((x % 86400) / 3600) AS BIGINT) AS hours, CAST(floor((x % 3600) / 60) AS BIGINT) AS minutes, CAST(x % 60 AS BIGINT) AS seconds FROM (SELECT event_id, CAST(event_id * 977 AS BIGINT) AS x FROM events)")
def duration_intervals(spark: SparkSession, sf: str) -> DataFrame:
    d = dates.duration(F.col("event_id") * 977, ["days", "hours", "minutes", "seconds"])
    return table(spark, sf, "events").select("event_id", d.alias("d")).select("event_id", "d.*")


@query("""
SELECT p_partkey, printf('%.2f', p_retailprice) AS fixed, regexp_replace(format('{:,.1f}', p_retailprice), '', '') AS commas, printf('%08.2f', p_retailprice) AS padded,
  lower(printf('%x', p_partkey)) AS hex, CASE WHEN p_size > 0 THEN '+' ELSE '' END || CAST(p_size AS VARCHAR) AS signed
FROM part
""")
def number_format(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("p_retailprice")
    d = numbers.d3_format
    return table(spark, sf, "part").select("p_partkey", d(x, ".2f").alias("fixed"), d(x, ",.1f").alias("commas"), d(x, "08.2f").alias("padded"), d(F.col("p_partkey").cast("double"), "x").alias("hex"), d(F.col("p_size").cast("double"), "+d").alias("signed"))


#: Three significant digits, ties away from zero, with the prefix of the rounded number's thousands.
_SI_SQL = """
WITH x AS (SELECT o_orderkey, unnest([o_totalprice, o_totalprice * 10]) AS v, unnest(['si', 'si_tens']) AS name FROM orders),
e AS (SELECT o_orderkey, name, v, floor(log10(v))::INTEGER AS e FROM x), n AS (SELECT o_orderkey, name, e, round(v / pow(10, e - 2))::BIGINT AS n FROM e),
r AS (SELECT o_orderkey, name, CASE WHEN n = 1000 THEN 100 ELSE n END AS n, CASE WHEN n = 1000 THEN e + 1 ELSE e END AS e FROM n),
t AS (SELECT o_orderkey, name, CASE e % 3 WHEN 0 THEN printf('%.2f', n / 100) WHEN 1 THEN printf('%.1f', n / 10) ELSE printf('%d', n) END || (['', 'k', 'M', 'G'])[e // 3 + 1] AS si FROM r)
SELECT o_orderkey, max(si) FILTER (name = 'si') AS si, max(si) FILTER (name = 'si_tens') AS si_tens FROM t GROUP BY ALL
"""


@query(_SI_SQL)
def number_si_orders(spark: SparkSession, sf: str) -> DataFrame:
    """All orders, and their tenfold for the millions."""
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", numbers.d3_format(price, ".3s").alias("si"), numbers.d3_format(price * 10, ".3s").alias("si_tens"))


@query("""
SELECT p_partkey, CASE WHEN length(CAST(p_size AS VARCHAR)) >= 5 THEN CAST(p_size AS VARCHAR) ELSE lpad(CAST(p_size AS VARCHAR), 5, '0') END AS padded, lower(substr(p_name, 1, 1)) || substr(p_name, 2) AS lcfirst,
  upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS ucfirst, CASE p_size % 4 WHEN 0 THEN 'zero' WHEN 1 THEN 'low' WHEN 2 THEN 'low' ELSE 'other' END AS switched,
  CASE WHEN p_size = 1 THEN 'item' ELSE 'items' END AS noun, format('{:,}', p_partkey * 1234567) AS grouped
FROM part
""")
def text_conditionals(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    switched = text.switch((F.col("p_size") % 4).cast("string"), [("0", F.lit("zero")), ("1", None), ("2", F.lit("low"))], F.lit("other"))
    return table(spark, sf, "part").select("p_partkey", text.padleft(size, 5).alias("padded"), text.lcfirst(F.col("p_name")).alias("lcfirst"), text.ucfirst(F.col("p_name")).alias("ucfirst"), switched.alias("switched"), numbers.plural(F.col("p_size"), F.lit("item"), F.lit("items")).alias("noun"), numbers.formatnum((F.col("p_partkey") * 1234567).cast("string")).alias("grouped"))


@query("SELECT page_id, array_to_string(list_slice(string_split(url, '/'), 1, 3), '/') AS head, string_split(url, '/')[-1] AS tail, replace(replace(url_encode(url), '%2F', '/'), '%3A', ':') AS encoded FROM pages")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.titleparts(url, 3, 1).alias("head"), text.titleparts(url, 1, -1).alias("tail"), text.urlencode(url, "WIKI").alias("encoded"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity + 2) * 3 - l_discount / 0.5, 6) AS value, CAST(l_quantity >= 25 AND l_tax < 0.05 AS DOUBLE) AS test, CAST(CAST(l_quantity AS BIGINT) % 7 AS DOUBLE) AS rest FROM lineitem")
def infix_compiled(spark: SparkSession, sf: str) -> DataFrame:
    c = {"q": F.col("l_quantity"), "d": F.col("l_discount"), "x": F.col("l_tax")}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(infix.compiled("(q + 2) * 3 - d / 0.5", **c), 6).alias("value"), infix.compiled("q >= 25 and x < 0.05", **c).alias("test"), infix.compiled("q mod 7", **c).alias("rest"))


@query("SELECT p_partkey, CAST(p_size * 2 + 3 AS DOUBLE) AS value FROM part")
def infix_interpreted(spark: SparkSession, sf: str) -> DataFrame:
    expression = F.concat(F.col("p_size").cast("string"), F.lit(" * 2 + 3"))
    return table(spark, sf, "part").select("p_partkey", infix.column(expression).getField("value").alias("value"))


@query("SELECT s_suppkey, upper(s_name) || ' has ' || printf('%.2f', s_acctbal) || ' in ' || CAST(s_nationkey AS VARCHAR) AS label FROM supplier")
def text_template(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", template("{{datum.s_name|upper}} has {{datum.s_acctbal|number:'.2f'}} in {{datum.s_nationkey}}", Context(s.schema)).alias("label"))


@query("""
SELECT p_partkey, 'Help:' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || '/Sub' AS full_name, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS base, 'Help talk:' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || '/Sub' AS talk, 'Sub' AS sub, 12::INTEGER AS ns FROM part
""")
def title_parts(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit(" help : "), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("/Sub#frag"))
    t_ = table(spark, sf, "part").select("p_partkey", titles.parse_title(raw).alias("t"))
    x = F.col("t")
    return t_.select("p_partkey", titles.prefixed(x).alias("full_name"), titles.base(x).alias("base"), titles.talk(x).alias("talk"), titles.subpage(x).alias("sub"), F.col("t.ns").alias("ns"))


@query("SELECT p_partkey, md5(p_name) AS md5, sha256(p_name) AS sha256, CAST(p_partkey & 255 AS BIGINT) AS band, CAST((p_partkey << 3) & 4294967295 AS BIGINT) AS shift, regexp_replace(p_name, '(\\w+)', '<\\1>', 'g') AS gsub FROM part")
def library_functions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.md5("p_name").alias("md5"), F.sha2("p_name", 256).alias("sha256"), text.bit("band", k, 255).alias("band"), text.bit("lshift", k, 3).alias("shift"), text.lua_gsub(F.col("p_name"), "(%w+)", "<%1>").alias("gsub"))
