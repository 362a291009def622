"""Scales, ticks and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import scales, ticks
from millrace.queries import query, table


@query("""
WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part)
SELECT p_partkey, CASE WHEN p_retailprice < a THEN 'q1' WHEN p_retailprice < b THEN 'q2' WHEN p_retailprice < c THEN 'q3' ELSE 'q4' END AS quartile FROM part, q
""")
def scale_quantile(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    return parts.select("p_partkey", scales.quantile(parts, "p_retailprice", ["q1", "q2", "q3", "q4"]).apply(F.col("p_retailprice")).alias("quartile"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band FROM lineitem")
def scale_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scales.Bucketed([10, 30], ["low", "mid", "high"]).apply(F.col("l_quantity")).alias("band"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.025 THEN 'a' WHEN l_discount < 0.05 THEN 'b' WHEN l_discount < 0.075 THEN 'c' ELSE 'd' END AS band FROM lineitem")
def scale_quantize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scales.quantize(0.0, 0.1, ["a", "b", "c", "d"]).apply(F.col("l_discount")).alias("band"))


@query("SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo) * 500, 6) AS x, round((log10(o_totalprice) - log10(lo)) / (log10(hi) - log10(lo)) * 300, 6) AS y, round(sqrt(o_totalprice) / sqrt(hi) * 100, 6) AS r FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def scale_continuous(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    lo, hi = scales.extent(orders, "o_totalprice")
    x = F.col("o_totalprice")
    make = lambda d, r, kind: F.round(scales.Continuous(d, r, kind).apply(x), 6)
    return orders.select("o_orderkey", make([lo, hi], [0, 500], "linear").alias("x"), make([lo, hi], [0, 300], "log").alias("y"), make([0.0, hi], [0, 100], "sqrt").alias("r"))


@query("SELECT c_custkey, CAST((dense_rank() OVER (ORDER BY c_mktsegment) - 1) * 90 + 9 AS DOUBLE) AS x, ['red', 'green', 'blue'][(dense_rank() OVER (ORDER BY c_mktsegment) - 1) % 3 + 1] AS color FROM customer")
def scale_band(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    domain = scales.domain_frame([(customers, ["c_mktsegment"])], sort=True)
    values = [r.value for r in domain.orderBy("index").collect()]
    starts, width = scales.bands(len(values), 0, 459, 0.2, 0.1)
    starts = [round(s, 9) for s in scales.bands(len(values), 0, 90 * len(values), 0.2, 0.1)[0]]
    x = scales.Ordinal(values, starts, width).apply(F.col("c_mktsegment"))
    return scales.mapped(customers.withColumn("x", x), "c_mktsegment", domain, ["red", "green", "blue"], "color").drop("c_mktsegment")


@query("SELECT o_orderpriority AS value, row_number() OVER (ORDER BY m DESC, o_orderpriority) - 1 AS index FROM (SELECT o_orderpriority, median(o_totalprice) AS m FROM orders GROUP BY ALL)")
def scale_domain_sorted(spark: SparkSession, sf: str) -> DataFrame:
    out = scales.domain_frame([(table(spark, sf, "orders"), ["o_orderpriority"])], sort={"op": "median", "field": "o_totalprice", "order": "desc"})
    return out.withColumn("index", F.col("index").cast("long"))


@query("SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('day', ts) AS d, date_trunc('month', ts) AS m, date_trunc('day', ts) - INTERVAL 1 DAY * dayofweek(ts) AS w, date_trunc('month', ts) + INTERVAL 1 MONTH AS next FROM events")
def tick_floor(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    cut = lambda u: ticks.floor_interval(ts, u).cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", cut("hour").alias("h"), cut("day").alias("d"), cut("month").alias("m"), cut("week").alias("w"), ticks.step_interval(ticks.floor_interval(ts, "month"), "month", 1).cast("timestamp_ntz").alias("next"))


@query("SELECT CAST(v AS DOUBLE) AS value FROM (VALUES (0.0), (20.0), (40.0), (60.0), (80.0), (100.0)) t(v)")
def ticks_linear(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(float(x),) for x in ticks.linear_ticks(0, 100, 5)], "value double")
