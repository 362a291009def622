"""Layouts: geography, link paths, treemaps, hierarchies, timelines, force and words."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.layout import geo as g
from millrace.layout import graphs, timeline, treemap, words
from millrace.layout import linkpath as lp
from millrace.operators import transforms as t
from millrace.operators.aggregates import ORDER
from millrace.queries import query, table

_LON = "(CAST(s_suppkey * 37 % 360 AS DOUBLE) - 180)"
_LAT = "(CAST(s_suppkey * 23 % 160 AS DOUBLE) - 80)"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", ((k * 37 % 360).cast("double") - 180).alias("lon"), ((k * 23 % 160).cast("double") - 80).alias("lat"))


@query(f"SELECT s_suppkey, round(radians({_LON}) * 150 + 480, 4) AS layout_x, round(250 - ln(tan(pi() / 4 + radians({_LAT}) / 2)) * 150, 4) AS layout_y FROM supplier")
def geo_mercator(spark: SparkSession, sf: str) -> DataFrame:
    out = g.geo(_points(spark, sf), projection="mercator")
    return out.select("s_suppkey", F.round("layout_x", 4).alias("layout_x"), F.round("layout_y", 4).alias("layout_y"))


@query(f"SELECT s_suppkey, round(radians({_LON}) * cos(radians({_LAT})) * 100 + 480, 4) AS layout_x, round(250 - radians({_LAT}) * 100, 4) AS layout_y FROM supplier")
def geo_sinusoidal(spark: SparkSession, sf: str) -> DataFrame:
    out = g.geo(_points(spark, sf), projection="sinusoidal", scale=100.0)
    return out.select("s_suppkey", F.round("layout_x", 4).alias("layout_x"), F.round("layout_y", 4).alias("layout_y"))


@query()
def geo_mollweide(spark: SparkSession, sf: str) -> DataFrame:
    """Iterative: tested against its closed-form inverse."""
    return g.geo(_points(spark, sf), projection="mollweide")


@query("SELECT s_suppkey, 'M' || s_suppkey || ',0L' || (s_suppkey + 10) || ',5' AS line, 'M' || s_suppkey || ',0V5H' || (s_suppkey + 10) AS corner FROM supplier")
def linkpaths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select("s_suppkey", k.alias("sx"), F.lit(0).alias("sy"), (k + 10).alias("tx"), F.lit(5).alias("ty"))
    rows = lp.linkpath(rows, "sx", "sy", "tx", "ty", "line", output={"path": "line"})
    return lp.linkpath(rows, "sx", "sy", "tx", "ty", "cornerX", output={"path": "corner"}).select("s_suppkey", "line", "corner")


@query("""
WITH n AS (SELECT r_regionkey, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT r_regionkey, round(10000.0 * n / (SELECT sum(n) FROM n), 3) AS area FROM n
""")
def treemap_area(spark: SparkSession, sf: str) -> DataFrame:
    """Areas are in proportion to values."""
    counts = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("value"))
    rows = counts.select((F.col("n_regionkey") + 1).cast("long").alias(ORDER), F.lit(0.0).alias("parent"), F.col("value").cast("double").alias("value"), F.col("n_regionkey").alias("r_regionkey"))
    top = spark.createDataFrame([(0, None, 0.0, -1)], f"`{ORDER}` long, parent double, value double, r_regionkey int")
    out = treemap.treemap(top.unionByName(rows), size=(100, 100), round=False)
    return out.filter("r_regionkey >= 0").select("r_regionkey", F.round(F.col("layout_width") * F.col("layout_height"), 3).alias("area"))


@query("""
WITH c AS (SELECT n_regionkey AS r, count(*)::DOUBLE AS v FROM nation GROUP BY ALL), t AS (SELECT sum(v) AS s FROM c)
SELECT 'all' AS id, 0::INTEGER AS depth, s AS value FROM t UNION ALL SELECT 'r' || r, 1, v FROM c
""")
def hierarchy_partition(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).cast("double").alias("v"))
    nodes = n.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("id"), F.lit("all").alias("parent"), "v")
    nodes = nodes.union(spark.createDataFrame([("all", None, None)], "id string, parent string, v double"))
    return t.hierarchy(nodes, "id", "parent", "v").select("id", "depth", "value")


@query("""
SELECT replace(r_name, ' ', '_') AS bar, (dense_rank() OVER (ORDER BY n_regionkey) - 1)::INTEGER AS bar_index, round(n_nationkey / 100.0, 9) AS start, round((n_nationkey + 10 + n_regionkey) / 100.0, 9) AS "end", CASE WHEN n_nationkey % 2 = 0 THEN 'red' ELSE 'blue' END AS color
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def timeline_segments(spark: SparkSession, sf: str) -> DataFrame:
    """A timeline written from the tables: a bar a region, and on it a segment a nation."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("r_name", F.replace("r_name", F.lit(" "), F.lit("_"))).orderBy("n_regionkey", "n_nationkey").collect()
    bars = "".join(f"  bar:{name}\n" for name in dict.fromkeys(r.r_name for r in rows))
    plot = "".join(f"  bar:{r.r_name} from:{1900 + r.n_nationkey} till:{1910 + r.n_nationkey + r.n_regionkey} {'$even' if r.n_nationkey % 2 == 0 else 'color:blue'}\n" for r in rows)
    text = f"DateFormat = yyyy\nPeriod = from:1900 till:2000\nDefine $even = color:red\nBarData =\n{bars}PlotData =\n  width:10\n{plot}"
    out = timeline.segments(spark, timeline.parse(text))
    return out.select("bar", "bar_index", F.round("start", 9).alias("start"), F.round("end", 9).alias("end"), "color")


@query()
def force_layout(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias(ORDER), "n_name", "n_regionkey")
    links = table(spark, sf, "nation").select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target"))
    return graphs.force(nodes, links, iterations=100).drop(ORDER)


@query()
def wordcloud_types(spark: SparkSession, sf: str) -> DataFrame:
    counts = t.countpattern(table(spark, sf, "part"), "p_type")
    return words.wordcloud(counts, size=(900, 500))


@query(f"SELECT n_nationkey, round(2 * {math.pi!r} * n_nationkey / 25, 6) AS layout_start FROM nation")
def pie_even(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select("n_nationkey", F.col("n_nationkey").alias(ORDER))
    return t.pie(rows).select("n_nationkey", F.round("layout_start", 6).alias("layout_start"))
